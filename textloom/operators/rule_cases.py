"""Literal source units and facts with the findings that the rules must have on them, as the supplied tables hold no code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.catalog import catalog, catalog_sql
from textloom.operators.fact_rules import Facts, fact_findings
from textloom.operators.source_rules import source_findings

LOGS = "\n".join("console.log(x);" for _ in range(5))
PAD = "// " + "x" * 1200

#: path, text, expected findings as (rule, line).
UNITS: tuple[tuple[str, str, tuple[tuple[str, int], ...]], ...] = (
    ("a/dense.ts", "const a: any = 1;\nlet b = c as any;\nfunction f(x: any) {}\nconst d = 1;\nvar e = 2;\n", (("ai/any-density", 1),)),
    ("a/sparse.ts", "const a: any = 1;\nlet b = 1;\nconst c = 2;\nconst d = 1;\nvar e = 2;\n", ()),
    ("a/few.ts", "const a: any = 1;\nlet b: any = 1;\n", ()),
    ("a/any.py", "\n".join("x: any" for _ in range(6)), (("logic/math-any-density", 1),)),
    ("a/storm.js", LOGS, (("logic/math-console-log-storm", 1),)),
    ("a/storm_long.js", PAD + "\n" + LOGS, (("ai/console-debug-storm", 1), ("logic/math-console-log-storm", 2))),
    ("a/storm_logger.js", "import p from 'pino';\n" + PAD + "\n" + "\n".join("console.warn(1); debugger;" for _ in range(6)), ()),
    ("a/storm_ten.js", PAD + "\n" + "\n".join("console.warn(1); debugger;" for _ in range(5)), (("ai/console-debug-storm", 1),)),
    ("a/storm.test.js", PAD + "\n" + "\n".join("console.warn(1);" for _ in range(12)), ()),
    ("a/logs_apart.js", "\n".join("console.log(1);" + "\n" * 39 for _ in range(6)), ()),
    ("b/stack.tsx", "import a from 'next/link'\nimport { b } from 'zustand'\nimport { c } from '@tanstack/react-query/x'\n", (("ai/default-react-stack", 1),)),
    ("b/stack_two.tsx", "import a from 'next'\nimport { b } from 'zustand'\nimport d from 'react'\n", ()),
    ("b/fetch.ts", "fetch(a); fetch (b)\nfetch(c)\n", (("ai/fetch-default-overuse", 1),)),
    ("b/fetch_lib.ts", "import x from 'axios'\nfetch(a); fetch(b); fetch(c)\n", ()),
    ("b/state.jsx", "useState(1);\nuseState(2);\nuseState(3);\nuseState(4);\nuseState(5);\n", (("ai/state-default-overuse", 1),)),
    ("b/state_reducer.jsx", "useReducer(r);\nuseState(1);\nuseState(2);\nuseState(3);\nuseState(4);\nuseState(5);\n", ()),
    ("b/colours.html", '<p class="bg-blue-500 p-4">\n<p class="text-sm bg-blue-500">', (("ai/tailwind-color-overuse", 1),)),
    ("b/colours.txt", '<p class="bg-blue-500 p-4 text-sm">', ()),
    ("b/widgets.jsx", '<input type="date">\n<div class="fixed inset-0 z-50">\n', (("ai/library-reinvention", 1),)),
    ("b/widgets_lib.jsx", 'import d from "dayjs"\n<input type="date">\n<div class="fixed inset-0 z-50">\n', ()),
    ("c/fence.py", "\n```python\nx = 1\n", (("ai/markdown-leakage", 2),)),
    ("c/name.py", "python\n\nprint(value)\n", (("ai/markdown-leakage", 1),)),
    ("c/late.py", "a\nb\nc\nd\ne\n```\nx = 1\n", ()),
    ("d/casts.cpp", "int a = (int)x;\nint b = static_cast<int>(x);\n// (int)y\nvoid f(void) {}\nchar *c = (char*) p;\n", (("cpp/c-style-cast", 1), ("cpp/c-style-cast", 5))),
    ("d/numbers.cpp", "if (n > 977) {\n  return 64;\n}\nint k = 512;\nwhile (m < 1024) {} // 999\n", (("cpp/magic-numbers", 1),)),
    ("d/print.cc", 'printf("a");\nfprintf(f, "b");\n', (("cpp/printf-debug", 1),)),
    ("d/cout.cc", 'std::cout << "a";\n', (("cpp/printf-debug", 1),)),
    ("d/tests/print.cc", 'printf("a");\nfprintf(f, "b");\n', ()),
    ("d/raw.cc", "A* a = new A(1); B* b = new B(2);\ndelete a; delete b;\n", (("cpp/raw-new-delete", 1),)),
    ("d/only_new.cc", "A* a = new A(1); B* b = new B(2);\n", ()),
    ("e/a.cs", "async Task Run() {\n  Work();\n}\n", (("cs/async-without-await", 1),)),
    ("e/b.cs", "async Task Run() {\n  await Work();\n}\ntry { } catch (Exception e) { }\ntry { } catch (Exception e) {\n throw; }\n", (("cs/empty-catch-block", 4), ("cs/empty-catch-block", 5))),
    ("e/c.cs", 'var q = $"SELECT * FROM t WHERE id = {id}";\nvar r = $"SELECT {x}"; c.Parameters.Add(x);\n', (("cs/sql-string-interpolation", 1),)),
    ("f/a.dart", "dynamic x = 1;\nvar y = z as Foo;\n// dynamic z\nprint(x);\n", (("dart/dynamic-call", 1), ("dart/dynamic-call", 2), ("dart/print-debug", 4))),
    ("f/b.dart", "final c = TextEditingController();\nfinal f = FocusNode();\n", (("dart/missing-dispose", 1), ("dart/missing-dispose", 2))),
    ("f/c.dart", "final c = TextEditingController();\nc.dispose();\n", ()),
    ("f/d.dart", "load();\nawait load();\nx = load();\nsetState(a);\n", (("dart/unwrapped-futures", 1),)),
    ("g/a.js", "db.query(`SELECT a FROM t WHERE id = ${id}`)\n", (("db/sql-concat", 1), ("security/sql-construction", 1))),
    ("g/b.js", 'q = "DELETE FROM t WHERE id = " + id\nr = "select a from t"\n', (("security/sql-construction", 1),)),
    ("g/c.js", "q = `WITH x AS (SELECT 1) SELECT a FROM x WHERE b = ${c}`\n", (("db/sql-concat", 1), ("security/sql-construction", 1))),
    ("h/a.go", "var xs []int\nfoo()\nxs = []int{}\n", (("go/nil-slice-vs-empty", 1),)),
    ("h/b.go", "xs = []int{}\nvar xs []int\n", ()),
    ("h/c.go", 'type A struct {\n  X int `json:"x"`\n  Y int `json:"y"`\n  Z int `json:"z,omitempty"`\n}\n', (("go/struct-tag-inconsistency", 4),)),
    ("i/A.java", 'try { a(); } catch (IOException e) {\n  throw new AppException("x");\n}\ntry { a(); } catch (IOException e) { throw new AppException("x", e); }\n', (("java/lost-stack-trace", 2),)),
    ("i/test/B.java", 'try { a(); } catch (IOException e) {\n  throw new AppException("x");\n}\n', ()),
    ("i/C.java", 'String q = "SELECT * FROM t WHERE id=" + id;\nString r = "SELECT * FROM t WHERE id=?" + x;\n', (("java/sql-string-concat", 1), ("security/sql-construction", 1), ("security/sql-construction", 2))),
    ("i/D.java", "public boolean validateUser(String u) { return true; }\npublic int size() { return 0; }\npublic String encryptText(String s) {\n  return s;\n}\n", (("java/suspicious-implementation", 1), ("java/suspicious-implementation", 3))),
    ("i/E.java", "while (open) {\n  Thread.sleep(10);\n}\nThread.sleep(5);\n// for (;;) { Thread.sleep(1); }\n", (("java/thread-sleep-in-loop", 2),)),
    ("j/a.kt", "scope.launch {\n  work()\n}\n", (("kt/coroutine-cancellation-missing", 1),)),
    ("j/b.kt", "scope.launch {\n  ensureActive()\n}\nval x = y!!.name\n// z!!.name\nGlobalScope.launch { isActive }\n", (("kt/force-unwrap", 4), ("kt/global-coroutine-scope", 6))),
    ("j/c.kt", 'val q = "SELECT * FROM t WHERE id = $id"\nval s = "hello $name"\n', (("kt/string-template-injection", 1),)),
    ("k/a.php", "try { f(); } catch (Exception $e) { }\n", (("php/empty-catch", 1),)),
    ("k/b.php", "$q = 'SELECT * FROM t WHERE id = ' . $id;\n$r = $s->bindValue(x, 'SELECT a ' . $y);\n", (("php/sql-injection", 1),)),
    ("l/a.rb", "begin\n  f\nrescue\n  nil\nend\nrescue Foo => e\n", (("rb/exception-swallowing", 3),)),
    ("l/b.rb", "users.each do |u|\n  u.posts.each { |p| p }\nend\n", (("rb/n-plus-one-query", 1),)),
    ("l/c.rb", "User.includes(:posts).each do |u|\n  u.posts.each { |p| p }\nend\n", ()),
    ("l/d.rb", 'q = "SELECT * FROM t WHERE id = #{id}"\nr = "UPDATE t SET a = " + x + " WHERE b"\n', (("rb/sql-string-concat", 1), ("rb/sql-string-concat", 2), ("security/sql-construction", 2))),
    ("m/eval.js", "eval(x)\n// eval(y)\nlet s = 'eval(z)'\nwindow.eval(x)\n/* eval(a)\n*/ new Function('b')\n", (("security/eval", 1), ("security/eval", 4), ("security/eval", 4), ("security/eval", 6))),
    ("m/env.js", "const a = process.env.NEXT_PUBLIC_API_KEY\nconst b = process.env.API_KEY\nconst c = import.meta.env.VITE_TOKEN + process.env.NEXT_PUBLIC_API_KEY\n", (("security/exposed-env-var", 1), ("security/exposed-env-var", 3))),
    ("m/open.js", "// if (process.env.DEV) return true\nif (process.env.NODE_ENV === 'development') return true;\n", (("security/fail-open-auth", 2),)),
    ("m/store.js", "localStorage.setItem('auth_token', t)\nlocalStorage.setItem('theme', t)\nsessionStorage.setItem(jwtKey, t)\n", (("security/localstorage-token", 1), ("security/localstorage-token", 3))),
    ("app/api/x/route.ts", "export async function GET(r) {\n  return 1\n}\n", (("security/missing-auth-check", 1),)),
    ("app/api/y/route.ts", "export async function GET(r) {\n  await requireAuth(r)\n}\n", ()),
    ("pages/admin/users.ts", "const users = 1\n", (("security/public-admin-route", 1),)),
    ("pages/admin/roles.ts", "requireRole('admin')\n", ()),
    ("n/blank.html", '<a href="x" target="_blank">a</a>\n<a href="x" target="_blank" rel="noopener">b</a>\n', (("security/target-blank-no-noopener", 1),)),
    ("n/raw.jsx", '<p dangerouslySetInnerHTML={{ __html: body }} />\n<p dangerouslySetInnerHTML={{ __html: "x" }} />\n', (("security/unsafe-html-render", 1),)),
    ("n/img.html", '<img src="a">\n<img src="b" alt="">\n<img src="c" role="presentation">\n', (("wcag/missing-alt", 1),)),
    ("n/hint.jsx", '<input placeholder="Enter text here">\n<input placeholder="Search products">\n<input placeholder={"lorem ipsum"}>\n', (("typo/placeholder-text", 1), ("typo/placeholder-text", 3))),
    ("n/style.jsx", "<p style={{ color: 'red', top: 1 }}>\n<p style={{ left: 2 }}>\n", (("visual/inline-style-dominance", 1),)),
    ("o/a.swift", "let x = y as! Foo\ntry! load()\nlet z = a!.b\nif a != b {}\n", (("swift/force-unwrap", 1), ("swift/force-unwrap", 2), ("swift/force-unwrap", 3))),
    ("o/b.swift", "fatalError()\nvar v: UILabel!\nprint(1)\nprint(2)\n", (("swift/fatal-error-thrown", 1), ("swift/force-unwrap", 2), ("swift/implicitly-unwrapped-optional", 2), ("swift/print-debug", 3), ("swift/print-debug", 4))),
    ("o/c.swift", "import XCTest\nfatalError()\nlet x = y as! Foo\n", ()),
    ("o/d.swift", "func f() {\n  load { r in\n    self.x = r\n  }\n  // " + "far enough " * 9 + "\n  load { [weak self] r in\n    self.x = r\n  }\n}\n", (("swift/strong-self-capture", 2),)),
    ("p/a.test.ts", "\n".join("beforeEach(() => {\n  render(a)\n  b()\n})" for _ in range(3)), (("test/duplicate-setup", 1), ("test/duplicate-setup", 5), ("test/duplicate-setup", 9))),
    ("p/b.test.ts", "const u = { name: 'John Doe', email: 'alice@acme.com', id: 1 }\nconst v = { name: 'Ann Lee' }\n", (("test/fake-placeholder", 1), ("test/fake-placeholder", 1))),
    ("p/c.test.ts", "expect(x).toBe(x)\nexpect(y).toBeDefined()\n\n\n\nexpect(z).toBeTruthy()\nexpect(z).toEqual(3)\n", (("test/weak-assertion", 1), ("test/weak-assertion", 2))),
    ("q/a.ts", "enum Colour { Red }\nexport const enum B { X }\nimport { type C, d } from 'e'\n", (("ts/enum-vs-as-const", 1), ("ts/enum-vs-as-const", 2), ("ts/import-type-misuse", 3))),
    ("q/b.ts", "function f(x) {\n  a(x as A); b(x as B); c(x as C); d(x as D);\n}\nlet y = z as unknown as string\n", (("ts/excessive-type-assertion", 1), ("ts/excessive-type-assertion", 4))),
    ("q/c.ts", "function f(): never {\n  g()\n}\nfunction h(): never {\n  throw e\n}\n", (("ts/never-vs-unknown", 1),)),
    ("r/Same.tsx", "alpha beta alpha beta " * 30, (("logic/math-variable-name-entropy", 1), ("visual/naturalness-anomaly", 1))),
    ("r/names.py", "aaa bbb " * 20, (("logic/math-variable-name-entropy", 1),)),
    ("r/font.tsx", "x", ()),
    ("r/font_hint.tsx", "@font-face { }", ()),
    ("r/grid.tsx", "<p style={{ padding: '7px', marginTop: '9px', gap: '5px' }}>", (("layout/spacing-grid", 1), ("layout/spacing-grid", 1), ("layout/spacing-grid", 1), ("visual/inline-style-dominance", 1))),
    ("s/lib.rs", "enum Kind { A, B }\nfn f(kind: &str) {}\npub fn used() {}\nfn g() { used(); }\n", (("rust/stringly-typed", 2), ("ts/enum-vs-as-const", 1))),
    ("docs/guide.md", "See [a](../docs/other.md) and [b](missing.md) and [c](https://x.org) and [d](#top).\nCall `oldName`() and `known`().\nRun `npm install left-pad` or `npm install react`\n", (
        ("docs/broken-link", 1), ("docs/stale-function-reference", 2), ("docs/stale-package-reference", 3), ("docs/stale-package-reference", 3),
    )),
)
#: tag, classes, attributes, interactive, line by path; findings that they bring.
E = tuple[str, str, dict[str, str], bool, int]
ELEMENTS: tuple[tuple[str, tuple[E, ...], tuple[tuple[str, int], ...]], ...] = (
    ("x/focus.tsx", (("Button", "outline-none", {}, True, 3), ("Button", "outline-none focus-visible:ring-2", {}, True, 4), ("div", "outline-none", {}, False, 5)), (("wcag/focus-appearance", 3),)),
    ("x/fixed.tsx", (("div", "fixed top-0", {}, False, 1), ("div", "fixed top-0", {}, False, 9), ("div", "sticky sticky-top", {}, False, 2)), (("wcag/focus-obscured", 1),)),
    ("x/img.tsx", (("img", "", {"loading": "lazy"}, False, 1), ("img", "", {"loading": "lazy", "width": "4", "height": "5"}, False, 2), ("img", "aspect-video", {"loading": "lazy"}, False, 3), ("img", "", {}, False, 4)), (("perf/cls-image", 1),)),
    ("x/shad.tsx", (("Button", "", {"className": "bg-red-500 " + "w-full " * 12}, True, 2), ("Button", "", {"className": "bg-red-500"}, True, 3)), (("component/shadcn-prop-mismatch", 2),)),
    ("x/escape.tsx", (("p", "w-[3px] h-[4px]", {}, False, 1), ("p", "p-[5px]", {}, False, 2), ("p", "p-4", {}, False, 3)), (("visual/arbitrary-escape", 1), ("visual/arbitrary-escape", 2), ("visual/spacing-scale-violation", 1), ("visual/spacing-scale-violation", 1), ("visual/spacing-scale-violation", 2))),
    ("x/radius.tsx", (("p", "rounded-[7px]", {}, False, 4), ("p", "rounded-[8px]", {}, False, 5), ("p", "rounded-[0.5rem]", {}, False, 6)), (("visual/radius-scale-violation", 4),)),
    ("r/font.tsx", tuple(("p", "font-sans", {}, False, k) for k in (2, 3, 4)), (("visual/math-default-font", 2),)),
    ("r/font_hint.tsx", tuple(("p", "font-sans", {}, False, k) for k in (2, 3, 4)), ()),
    ("x/form.tsx", (*[("button", "", {}, False, k) for k in (1, 2)], *[("input", "", {}, False, k) for k in (3, 4, 5)]), (("layout/math-element-uniformity", 1),)),
    ("x/labels.tsx", tuple(("button", "", {"aria-label": t}, False, k + 1) for k, t in enumerate(("Save", "Send", "Open", "Close"))), (("typo/math-button-label-uniformity", 1),)),
    ("x/grid.tsx", (("p", "p-[3px] m-[5px] gap-[7px]", {}, False, 1),), (("layout/spacing-grid", 1),) * 3 + (("visual/arbitrary-escape", 1),) + (("visual/spacing-scale-violation", 1),) * 3),
    ("x/bloat.tsx", tuple(("p", "surface-card-wide", {}, False, k) for k in range(1, 6)), (("perf/css-bloat", 1),)),
    ("x/hues.tsx", (("p", "bg-[#7711ff] text-[#8822ff] to-[#6611ee] via-[#9933ff] from-[#5500ee]", {}, False, 3),), (("visual/math-color-cluster", 3),)),
    ("x/rounded.tsx", tuple(("p", "rounded-lg", {}, False, k) for k in range(1, 7)), (("perf/css-bloat", 1), ("visual/math-rounded-entropy", 1))),
    ("x/sizes.tsx", tuple(("p", "text-sm", {}, False, k) for k in range(2, 8)), (("visual/math-font-entropy", 2),)),
    ("x/space.tsx", tuple(("p", "p-4", {}, False, k) for k in range(1, 11)), (("visual/math-spacing-entropy", 1),)),
    ("x/cols.tsx", tuple(("p", "grid-cols-3", {}, False, k) for k in range(1, 5)), (("layout/math-grid-uniformity", 1),)),
    ("x/gaps.tsx", tuple(("p", f"gap-{g}", {}, False, k) for k, g in enumerate((4, 4, 4, 4, 4, 4, 4, 4, 4, 2), 1)), (("layout/gap-monopoly", 1), ("visual/math-spacing-entropy", 1))),
    ("x/gini.tsx", (*[("p", f"c{k}", {}, False, 1) for k in range(20)], *[("p", "c0", {}, False, 2) for _ in range(60)]), (("logic/math-gini-class-usage", 1),)),
)
#: name, size, branches, server, hooks, line by path.
C = tuple[str, int, int, bool, tuple[tuple[str, int], ...], int]
COMPONENTS: tuple[tuple[str, tuple[C, ...], tuple[tuple[str, int], ...]], ...] = (
    ("y/big.tsx", (("Big", 201, 0, False, (), 1),), (("component/giant-component", 1),)),
    ("y/edge.tsx", (("Edge", 200, 7, False, (), 1),), ()),
    ("y/two.tsx", (("A", 5, 8, False, (), 2), ("B", 5, 0, False, (), 9)), (("component/giant-component", 2), ("component/multiple-components-per-file", 2))),
    ("y/soup.tsx", (("Soup", 20, 0, False, (("useEffect", 2), ("useEffect", 3), ("useEffect", 4)), 1),), (("logic/reactive-hook-soup", 1),)),
    ("y/server.tsx", (("Page", 20, 0, True, (("useState", 6), ("useMemo", 7)), 1),), (("logic/boundary-violation", 6),)),
    ("y/terms.tsx", (("UserCard", 5, 0, False, (), 1), ("UserPanel", 5, 0, False, (), 2), ("UserTiles", 5, 0, False, (), 3)), (("component/multiple-components-per-file", 1), ("product/terminology-drift", 1), ("product/terminology-drift", 3))),
    ("y/toasts.tsx", (("AToast", 5, 0, False, (), 1), ("BAlert", 5, 0, False, (), 2), ("CBanner", 5, 0, False, (), 3)), (("component/multiple-components-per-file", 1), ("product/ux-pattern-fragmentation", 1))),
)
#: name, kind, type only, scope, source, referenced, line by path.
BINDINGS: tuple[tuple[str, tuple[tuple[str, str, bool, str, str, bool, int], ...], tuple[tuple[str, int], ...]], ...] = (
    ("z/imports.ts", (("a", "import-specifier", False, "module", "x", False, 1), ("b", "import-specifier", True, "module", "x", False, 2), ("c", "import-default", False, "module", "x", True, 3)), (("dead/unused-import", 1),)),
    ("x/img.tsx", (("React", "import-default", False, "module", "react", False, 1),), ()),
    ("z/locals.ts", (("a", "let", False, "f", "", False, 1), ("_b", "let", False, "f", "", False, 2), ("c", "const", False, "module", "", False, 3), ("d", "let", False, "module", "", False, 4)), (("dead/unused-local", 1), ("dead/unused-local", 4))),
    ("z/params.ts", (("a", "parameter", False, "f", "", False, 1), ("props", "parameter", False, "f", "", False, 2), ("_c", "parameter", False, "f", "", False, 3)), (("dead/unused-parameter", 1),)),
    ("s/lib.rs", (("HashMap", "rust-use", False, "module", "std", False, 1), ("used", "rust-use", False, "module", "std", False, 2)), (("dead/unused-import", 1),)),
)
#: kind, value, depth, flag, line by path.
FACTS: tuple[tuple[str, tuple[tuple[str, str, int, bool, int], ...], tuple[tuple[str, int], ...]], ...] = (
    ("w/dead.ts", (("condition", "if-false", 0, False, 3), ("unreachable", "x()", 0, False, 5), ("unreachable", "<unreachable>", 0, False, 6)), (("dead/dead-branch", 3), ("dead/unreachable", 5))),
    ("w/keys.tsx", (("key", "missing", 0, False, 2), ("key", "index", 0, False, 3)), (("logic/key-prop-missing", 2),)),
    ("w/save.ts", (("optimistic", "", 0, False, 8), ("cors", "cors-origin-wildcard", 0, False, 9)), (("logic/optimistic-no-rollback", 8), ("security/dangerous-cors", 9))),
    ("w/ghost.ts", tuple(("logical", "", d, True, k) for k, d in enumerate((3, 4, 3, 2), 1)), (("logic/ghost-defensive", 1), ("logic/ghost-defensive", 2), ("logic/ghost-defensive", 3))),
    ("w/ghost_two.ts", tuple(("logical", "", 3, True, k) for k in (1, 2)), ()),
    ("w/zombie.tsx", (("state", "a/setA", 0, True, 4), ("state", "b/setB", 0, False, 5)), (("logic/zombie-state", 4),)),
)
IMPORTS = (("v/a.ts", "@/lib/x", 1), ("v/a.ts", "@/ui/y", 2), ("v/a.ts", "react", 3))
FUNCTIONS = (("s/lib.rs", "f", False, False, "kind: &str", 2), ("s/lib.rs", "used", True, False, "", 3), ("s/lib.rs", "gone", True, False, "", 7), ("s/lib.rs", "new", True, False, "", 8))
CALLS = (("s/lib.rs", "todo!", False, 5), ("s/lib.rs", "todo!", True, 6), ("s/lib.rs", "unwrap", False, 9), ("s/lib.rs", "expect", True, 10))
ALLOWED, SPACING_SCALE, RADIUS_SCALE = ["@/lib"], [0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0], [0.25, 0.5, 1.0]
MORE = (("v/a.ts", "context/import-path-mismatch", 2), ("s/lib.rs", "rust/unused-pub-fn", 7), ("s/lib.rs", "rust/todo-macro", 5), ("s/lib.rs", "rust/unwrap-in-production", 9))


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, t) for p, t, _ in UNITS], "path string, text string")


def facts(spark: SparkSession) -> Facts:
    def table(rows, columns: str) -> DataFrame:
        return spark.createDataFrame([(p, *x) for p, xs, _ in rows for x in xs], f"path string, {columns}")

    elements = table(ELEMENTS, "tag string, classes string, attributes map<string,string>, interactive boolean, line int")
    return {
        "elements": elements.withColumn("classes", F.filter(F.split("classes", " "), lambda c: c != "")),
        "components": table(COMPONENTS, "name string, size int, branches int, server boolean, hooks array<struct<name:string,line:int>>, line int"),
        "bindings": table(BINDINGS, "name string, kind string, type_only boolean, scope string, source string, referenced boolean, line int"),
        "facts": table(FACTS, "kind string, value string, depth int, flag boolean, line int"),
        "imports": spark.createDataFrame(list(IMPORTS), "path string, source string, line int"),
        "functions": spark.createDataFrame(list(FUNCTIONS), "path string, name string, public boolean, test boolean, head string, line int"),
        "calls": spark.createDataFrame(list(CALLS), "path string, name string, test boolean, line int"),
        "exports": spark.createDataFrame([("known",)], "name string"),
        "packages": spark.createDataFrame([("react",)], "package string"),
        "files": spark.createDataFrame([("docs/other.md",), ("docs/guide.md",)], "file string"),
    }


def case_findings(spark: SparkSession) -> DataFrame:
    u = units(spark)
    return source_findings(u).unionByName(fact_findings(facts(spark), u, ALLOWED, SPACING_SCALE, RADIUS_SCALE))


def expected() -> list[tuple[str, str, int]]:
    own = [(p, rule, line) for table in (UNITS, ELEMENTS, COMPONENTS, BINDINGS, FACTS) for p, _, found in table for rule, line in found]
    return sorted([*own, *MORE])


def rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings on the literal units, with what the catalog says of their rules; equal findings are one row with their number."""
    found = case_findings(spark).groupBy("path", "rule_id", "line").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(catalog(spark)), "rule_id").select("path", "rule_id", "line", "n", "category", "severity", "ai_specific", "policy")


def _sql() -> str:
    rows = ", ".join(f"('{p}', '{r}', {k})" for p, r, k in expected())
    return f"""WITH f AS (SELECT * FROM (VALUES {rows}) AS t(path, rule_id, line)), c AS ({catalog_sql()})
SELECT path, rule_id, line, count(*) AS n, any_value(category) AS category, any_value(severity) AS severity, any_value(ai_specific) AS ai_specific, any_value(policy) AS policy FROM f JOIN c USING (rule_id) GROUP BY 1, 2, 3"""


RULE_SQL = _sql()
QUERIES = {"rule_findings": rule_findings}
ORACLES = {"rule_findings": RULE_SQL}
