"""Rules on source texts: (path, text) in, findings (path, rule_id, line) out.

Each rule is an expression that gives the lines of its findings; all run together in one pass over the units, and only where a path fits. Runs of
debug output are counted by windows over lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

Lines = Callable[["Unit"], Column]


@dataclass(frozen=True)
class Unit:
    path: Column
    text: Column
    code: Column  # text without comments, lines kept
    lines: Column
    packages: Column  # what is imported or required


@dataclass(frozen=True)
class Rule:
    rule_id: str
    paths: str
    find: Lines
    not_paths: str = ""


def none() -> Column:
    return F.array().cast("array<int>")

# Paths, patterns and word lists that tell what a rule is about.
SCRIPT = r"(?i)\.(?:ts|tsx|js|jsx)$"
CPP = r"(?i)\.(?:cpp|cc|cxx|h|hpp|hh|hxx)$"
UI = r"(?i)\.(?:tsx|jsx|vue|svelte|astro|html|htm|css|scss|less|sass|md|mdx)$"
TEST = r"(?:^|/)__tests__/|(?:^|/)__fixtures__/|\.(?:test|spec|stories)\.[jt]sx?$"
IMPORTED = r"""import\s+.*?from\s+['"]([^'"]+)['"]"""
REQUIRED = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
LOGGERS = ("winston", "pino", "pino-pretty", "bunyan", "loglevel", "npmlog", "debug", "@debug", "consola", "signale", "tslog", "roarr", "logger")
FETCHERS = (
    "@tanstack/react-query", "react-query", "@tanstack/query-core", "swr", "axios", "ky", "got", "node-fetch", "cross-fetch", "whatwg-fetch", "urql", "apollo-client",
    "@apollo/client", "relay-runtime",
)
STATE_LIBRARIES = ("zustand", "jotai", "valtio", "recoil", "@reduxjs/toolkit", "react-redux", "mobx", "mobx-react-lite", "@xstate/react")
WIDGET_LIBRARIES = (
    "react-day-picker", "react-datepicker", "date-fns", "dayjs", "luxon", "moment", "react-hook-form", "formik", "zod", "yup", "joi", "recharts", "chart.js", "react-chartjs-2", "d3",
    "victory", "nivo", "@radix-ui", "shadcn", "sonner", "react-hot-toast", "react-toastify", "notistack",
)
DEFAULT_STACK = (
    "next", "next/router", "next/navigation", "next/link", "next/image", "@tanstack/react-query", "@tanstack/react-table", "@tanstack/react-router", "zustand", "jotai", "valtio",
    "@radix-ui/react-dialog", "@radix-ui/react-dropdown-menu", "@radix-ui/react-select", "@radix-ui/react-toast", "@radix-ui/react-tabs", "@/components/ui/button", "@/components/ui/input",
    "@/components/ui/dialog", "@/components/ui/dropdown-menu", "@/components/ui/select", "@/components/ui/tabs", "vite", "@vitejs/plugin-react",
)
DECLARATION = r"\b(?:const|let|var|function|class|interface|type)\b|:\s*[A-Z][\w<>\[\],\s|]*"
REINVENTED = (
    r"""<input[^>]*\btype\s*=\s*["']date["'][^>]*>""", r"""if\s*\(\s*!\s*\w[\w.]*\s*\)\s*errors\.\w+\s*=\s*['"]""", r"""<path\s+d\s*=\s*["']M\d""", r"\bfixed\s+inset-0\s+z-50\b",
    r"setTimeout\s*\(\s*[^,]+,\s*[2-9]\d{3,}\s*\)", r"""useState\s*\(\s*['"][a-z-]+['"]\s*\)\s*;[\s\S]{0,500}active\s*===\s*['"][a-z-]+['"]""", r"<select\s+onChange\s*=\s*\{",
    r"useState\s*\(\s*(?:false|true)\s*\)[\s\S]{0,200}onClick\s*=\s*\{\s*\(\s*\)\s*=>\s*set\w+\(\s*!\w+\s*\)\s*\}",
)
TAILWIND = (
    "bg-blue-500", "bg-blue-600", "bg-blue-700", "text-blue-500", "text-blue-600", "text-blue-700", "border-blue-500", "ring-blue-500", "bg-slate-50", "bg-slate-100", "bg-slate-900", "text-slate-50",
    "text-slate-500", "text-slate-900", "bg-gray-50", "bg-gray-100", "bg-gray-900", "text-gray-500", "text-gray-600", "text-gray-900", "border-gray-200", "border-gray-300", "bg-red-500", "text-red-500",
    "border-red-500", "bg-green-500", "text-green-500", "rounded-md", "rounded-lg", "rounded-xl", "shadow-md", "shadow-lg", "shadow-xl", "p-4", "p-6", "p-8", "px-4", "px-6", "py-4", "py-6", "text-sm", "text-base", "text-lg",
)
LANGUAGES = (
    "python|python3|py|javascript|typescript|js|ts|jsx|tsx|java|go|golang|rust|rs|c|cpp|c\\+\\+|cxx|cc|c\\#|csharp|cs|ruby|rb|php|kotlin|kt|swift|scala|html|css|scss|sass|less|sql|bash|sh|shell|zsh|"
    "powershell|ps1|json|yaml|yml|toml|xml|markdown|md"
)
FENCE = r"^\s*```\s*(?:[a-zA-Z+#][a-zA-Z0-9+#-]*)?\s*$"
NAMED_NUMBERS = (
    "1024", "65535", "65536", "86400", "3600", "1000", "100.0", "60", "24", "7", "365", "256", "255", "0", "1", "2", "3", "4", "5", "100", "0.0", "0.5", "1.0", "2.0", "4096", "2048", "512", "32", "64", "128", "16", "8", "50",
)
SQL_WORD = r"(?i)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE|DROP\s+TABLE|ALTER\s+TABLE)\b"
SQL_START = (
    r"(?:SELECT\b[^`'\"]*\bFROM\b|INSERT\s+INTO\b|UPDATE\s+\S+\s+SET\b|DELETE\s+FROM\b|REPLACE\s+INTO\b|TRUNCATE(?:\s+TABLE)?\s+\S+\b|MERGE\s+INTO\b"
    r"|WITH\s+(?:RECURSIVE\s+)?[A-Za-z_]\w*\s*(?:\([^)]*\)\s*)?AS\s*(?:(?:NOT\s+)?MATERIALIZED\s*)?\([^`]*?\)\s*(?:SELECT\b|INSERT\s+INTO\b|UPDATE\s+\S+\s+SET\b|DELETE\s+FROM\b))"
)
CONTROLLERS = "TextEditingController|AnimationController|ScrollController|PageController|TabController|StreamController|FocusNode"
STRONG_VERB = (
    r"(?i)(?:validate[sd]?|verify|verifies|verified|check(?:s|ed)?|ensure[sd]?|sanitize[sd]?|escape[sd]?|authenticate[sd]?|authorize[sd]?|audit(?:s|ed)?|inspect(?:s|ed)?|filter(?:s|ed)?|normalize[sd]?"
    r"|encrypt(?:s|ed)?|decrypt(?:s|ed)?|hash(?:es|ed)?|sign(?:s|ed)?|(?:de)?compress(?:es|ed)?|parse[sd]?|format(?:s|ted)?)(?=(?-i:[A-Z])|[^a-zA-Z]|$)"
)
SECRET_NAME = r"(?i)SECRET|KEY|TOKEN|PASSWORD|PASSWD|CREDENTIAL|PRIVATE"
CLIENT_PREFIX = r"(?:NEXT_PUBLIC_|REACT_APP_|VITE_|GATSBY_|EXPO_PUBLIC_|PUBLIC_)[A-Z_][A-Z0-9_]*"
FAIL_OPEN = tuple(
    rf"if\s*\(\s*process\.env\.{test}\s*\)\s*return\s+{what}"
    for test, what in (
        (r"NODE_ENV\s*===\s*['\"]development['\"]", r"true\b"), (r"NODE_ENV\s*!==\s*['\"]production['\"]", r"true\b"), (r"NODE_ENV\s*===\s*['\"]test['\"]", r"true\b"), ("DEV", r"true\b"),
        (r"VERCEL_ENV\s*!==\s*['\"]production['\"]", r"true\b"), (r"ENVIRONMENT\s*!==\s*['\"]production['\"]", r"true\b"), (r"NODE_ENV\s*===\s*['\"]development['\"]", r"next\(\)"),
        (r"NODE_ENV\s*!==\s*['\"]production['\"]", r"next\(\)"),
    )
)
TOKEN_KEY = r"(?i)token|jwt|bearer|access|refresh|auth|session[_-]?id|session[_-]?token|id[_-]?token|sso|api[_-]?key"
PLAIN_KEYS = ("theme", "lang", "locale", "i18n", "user_pref", "userprefs", "prefs", "preferences", "settings", "ui_theme", "sidebar", "view_mode", "cart", "last_seen", "onboarding", "dismissed")
AUTH = (
    r"getServerSession|auth\(|requireAuth|requireRole|withAuth|protect|authorize|verify|jwt\.verify|jsonwebtoken|getCurrentUser|requireUser|authenticate|verifyJwt|verifyToken|getSession|requireSession"
)
ROUTE_FILE = r"(?:^|/)(?:app|pages)/api/|(?:^|/)(?:src/)?routes/|(?i:(?:^|/)(?:route\.[jt]sx?|api/[^/]+\.[jt]sx?|[^/]+\.api\.[jt]s)$)"
HANDLER = r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b|\b(?:app|router)\s*\.\s*(?:get|post|put|patch|delete|options|head)\s*\("
PRIVILEGED = r"(?i)(?:/|^)(?:admin|internal|debug|staff|private|manage|management|backstage|console|moderation|trust|safety)(?:/|$)"
ROLE = r"requireRole|requireAdmin|hasRole|hasPermission|assertRole|ensureRole|isAdmin|requirePermission|checkPermission|rbac"
BAD_PLACEHOLDER = r"(?i)\blorem\s+ipsum\b|\bplaceholder\b|\b(?:todo|fixme|xxx|aaa)\b|\benter\s+text\b|\btype\s+here\b|\byour\s+text\s+here\b|\bclick\s+here\b|\b(?:asdf|qwerty)\b|^(?:test|foo|bar|baz|sample)$"
FAKE = (
    ("name|firstName|lastName|fullName|username|displayName", r"(?i)^(?:(?:John|Jane)\s+Doe|Test\s+User|Foo\s+Bar|Sample\s+(?:User|Name|Text)|Placeholder(?:\s+\w+)?)$"),
    ("email|userEmail|contactEmail|senderEmail", r"(?i)^(?:test@test\.com|test@example\.com|user@example\.com|foo@bar\.com|your@email\.com|name@example\.com|admin@admin\.com)$"),
    ("password|passwd|hashedPassword|plainPassword", r"(?i)^(?:password|123456|test1234|changeme|secret)$"),
    ("createdAt|updatedAt|timestamp|expiresAt|deletedAt", r"(?i)^(?:2020-01-01|2021-01-01|1970-01-01|\d{4}-\d{2}-\d{2}T00:00:00Z?)$"),
)
WEAK_MATCHERS = "toBeDefined|toBeUndefined|toBeTruthy|toBeFalsy|toBeNull|toBeGreaterThan|toBeLessThan|toContain|toHaveLength|toBeInstanceOf"
SETUP_WORDS = (
    "true|false|null|undefined|NaN|Infinity|if|else|return|const|let|var|new|await|async|function|class|import|from|export|expect|jest|vi|describe|it|test|render|fireEvent|setupServer|beforeEach|beforeAll|afterEach|afterAll"
)

#: Parentheses and braces with what they hold, some levels deep, as expressions have no counters.
PARENS = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
BRACES = r"\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\})*\}"


def n_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def each(pattern: str, keep: str = "", drop: str = "", on: str = "text") -> Lines:
    """A finding for each match whose own text has keep and lacks drop."""

    def find(u: Unit) -> Column:
        found = T.matches(getattr(u, on), pattern)
        if keep:
            found = F.filter(found, lambda m: m["value"].rlike(keep))
        if drop:
            found = F.filter(found, lambda m: ~m["value"].rlike(drop))
        return F.transform(found, lambda m: m["line"])

    return find


def both(*finds: Lines) -> Lines:
    return lambda u: F.concat(*[f(u) for f in finds])


def once(test: Callable[[Unit], Column]) -> Lines:
    """One finding, at line 1, of units that pass a test."""
    return lambda u: F.when(test(u), F.array(F.lit(1))).otherwise(none())


def in_lines(count: Callable[[Column], Column], skip: str = "") -> Lines:
    """As many findings for each line as count says; lines that match skip have none."""

    def find(u: Unit) -> Column:
        def of(line: Column, i: Column) -> Column:
            n = count(line)
            return F.array_repeat(i + 1, F.when(line.rlike(skip), F.lit(0)).otherwise(n) if skip else n)

        return F.flatten(F.transform(u.lines, of))

    return find


def line_if(test: Callable[[Column], Column], skip: str = "") -> Lines:
    return in_lines(lambda line: test(line).cast("int"), skip)


def imports_any(u: Unit, names: tuple[str, ...]) -> Column:
    known = F.array(*[F.lit(n) for n in names])
    return F.exists(u.packages, lambda p: F.exists(known, lambda n: (p == n) | p.startswith(F.concat(n, F.lit("/")))))


def _default_stack(u: Unit) -> Column:
    froms = F.regexp_extract_all(u.text, F.lit(IMPORTED), F.lit(1))
    names = F.transform(froms, lambda s: F.when(s.startswith("@/"), s).when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1)))
    known = F.array(*[F.lit(n) for n in DEFAULT_STACK])
    hits = F.filter(F.array_distinct(names), lambda p: (p != "") & F.exists(known, lambda n: (n == p) | n.startswith(F.concat(p, F.lit("/")))))
    return F.size(hits) >= 3


def _markdown(u: Unit) -> Column:
    """The first of the first five filled lines (of seven) that is a fence, or a language's bare name, and has code below."""

    def filled(x: Column) -> Column:
        return F.trim(x) != ""

    def test(i: Column) -> Column:
        line = F.get(u.lines, i)
        early = F.size(F.filter(F.slice(u.lines, 1, i + 1), filled)) <= 5
        below = F.get(F.filter(F.slice(u.lines, i + 2, F.greatest(F.lit(0), F.size(u.lines) - i - 1)), filled), F.lit(0))
        fence = line.rlike(FENCE) & below.isNotNull() & ~below.rlike(FENCE) & below.rlike(r"[a-zA-Z0-9_=(){}\[\];]")
        soon = F.slice(F.filter(F.slice(u.lines, i + 2, 5), filled), 1, 2)
        name = line.rlike(rf"(?i)^\s*(?:{LANGUAGES})\s*$") & F.exists(soon, lambda x: x.rlike(r"[a-zA-Z]{3,}") & x.rlike(r"[=({:]"))
        return filled(line) & early & F.coalesce(fence | name, F.lit(False))

    found = F.filter(F.sequence(F.lit(0), F.least(F.size(u.lines), F.lit(7)) - 1), test)
    return F.transform(F.slice(found, 1, 1), lambda i: i + 1)


def _magic(u: Unit) -> Column:
    def of(line: Column, i: Column) -> Column:
        code = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"//.*$", ""), r'"(?:[^"\\]|\\.)*"', '""'), r"'(?:[^'\\]|\\.)*'", "''")
        numbers = F.regexp_extract_all(code, F.lit(r"(?<!\b(?:constexpr|const)\s{1,4}\w{1,60}\s{0,4}=\s{0,4})\b\d+(?:\.\d+)?\b"), F.lit(0))
        named = F.coalesce(F.get(u.lines, i - 1).rlike(r"\b(?:constexpr|const)\s+\w+\s*=\s*$"), F.lit(False))
        odd = F.filter(numbers, lambda x: ~x.isin(*NAMED_NUMBERS))
        return F.when(line.rlike(r"\b(?:if|while|return|for)\s*[(\s]?[^;]*[<>=!][^;]*") & ~named, F.array_repeat(i + 1, F.size(odd))).otherwise(none())

    return F.flatten(F.transform(u.lines, of))


def _dispose(u: Unit) -> Column:
    def of(line: Column, i: Column) -> Column:
        return F.array_repeat(i + 1, n_of(line, rf"\w+\s*=\s*(?:{CONTROLLERS})\("))

    return F.when(u.text.rlike(r"\.dispose\(\s*\)"), none()).otherwise(F.flatten(F.transform(u.lines, of)))


def _futures(line: Column) -> Column:
    x = F.trim(line)
    call = r"^([a-z][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*;?\s*$"
    odd = x.rlike(r"^(?:await |return |//|throw )") | (x.contains("=") & ~x.startswith("=="))
    return x.rlike(call) & ~odd & ~F.regexp_extract(x, call, 1).isin("print", "setState", "runZoned", "debugPrint")


def _nil_slices(u: Unit) -> Column:
    declared = T.matches(u.text, r"(?m)^[\t ]*var\s+[A-Za-z_][A-Za-z0-9_]*\s+\[\][\w.*]+\b")
    given = T.matches(u.text, r"(?m)^[\t ]*[A-Za-z_][A-Za-z0-9_]*\s*=\s*(?:\[\][\w.*]*\{\}|make\(\[\][\w.*]*)")

    def of(d: Column) -> Column:
        def last(name: Column) -> Column:
            return F.array_max(F.transform(F.filter(d, lambda x: F.regexp_extract(x["value"], r"var\s+(\w+)", 1) == name), lambda x: x["line"]))

        lines = F.transform(given, lambda g: F.struct(last(F.regexp_extract(g["value"], r"(\w+)\s*=", 1)).alias("at"), g["line"].alias("line")))
        return F.transform(F.filter(lines, lambda x: x["at"].isNotNull() & (x["line"] > x["at"])), lambda x: x["at"])

    return T.let(declared, of)


def _struct_tags(u: Unit) -> Column:
    def odd(s: Column) -> Column:
        tags = F.transform(T.matches(s["value"], r'`json:"[^",]+(?:,[^"]+)?"`'), lambda m: F.struct((m["line"] + s["line"] - 1).alias("line"), m["value"].contains(",").alias("more")))

        def minority(t: Column) -> Column:
            more = F.size(F.filter(t, lambda x: x["more"]))
            plain = F.size(t) - more
            usual = F.when(more == plain, F.get(t, F.lit(0))["more"]).otherwise(more > plain)
            return F.when((more > 0) & (plain > 0), F.transform(F.filter(t, lambda x: x["more"] != usual), lambda x: x["line"])).otherwise(none())

        return T.let(tags, minority)

    found = F.filter(F.transform(T.matches(u.text, r"type\s+[A-Z][A-Za-z0-9_]*\s+struct\s*" + BRACES), odd), lambda x: F.size(x) > 0)
    return F.coalesce(F.get(found, F.lit(0)), none())


def _lost_traces(u: Unit) -> Column:
    head = r"catch\s*\(\s*(?:final\s+)?[\w<>,\s]+\s+(\w+)\s*\)\s*"

    def of(block: Column) -> Column:
        name = F.regexp_extract(block["value"], head, 1)
        thrown = T.matches(block["value"], r"throw\s+new\s+\w+(?:Exception|Error|Throwable)\s*\([^)]*\)")
        lost = F.filter(thrown, lambda t: ~F.regexp_like(F.regexp_extract(t["value"], r"(?s)\((.*)\)$", 1), F.concat(F.lit(r"\b"), name, F.lit(r"\b"))))
        return F.transform(lost, lambda t: t["line"] + block["line"] - 1)

    return F.flatten(F.transform(T.matches(u.text, head + BRACES), of))


def _sleeps(u: Unit) -> Column:
    plain = F.regexp_replace(u.code, r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'", '""')
    loops = T.matches(plain, r"(?:\b(?:for|while)\s*" + PARENS + r"|\bdo)\s*" + BRACES)
    return F.flatten(F.transform(loops, lambda x: F.transform(T.matches(x["value"], r"\bThread\.sleep\("), lambda s: s["line"] + x["line"] - 1)))


def _n_plus_one(u: Unit) -> Column:
    def test(i: Column) -> Column:
        line = F.get(u.lines, i)
        nested = F.transform(F.slice(u.lines, i + 1, F.size(u.lines)), lambda x: (n_of(x, r"\{") - n_of(x, r"\}")).cast("int"))
        last = T.let(T.running(F.concat(nested, F.array(F.lit(0)))), lambda r: F.array_min(F.filter(F.transform(r, lambda s, k: F.when((k >= 2) & (s <= 0), k - 1)), lambda k: k.isNotNull())))
        block = F.array_join(F.slice(u.lines, i + 1, F.coalesce(last, F.lit(0)) + 1), "\n")
        return line.rlike(r"\.\s*each\s*(?:\([^)]*\)|\{|\s+do)|\.\s*each\s+do") & line.rlike(r"do\s*\|") & last.isNotNull() & block.rlike(r"\.\w+\.(?:each|map|select|find_each|find_each_with_index)\b")

    found = F.filter(F.sequence(F.lit(0), F.size(u.lines) - 1), test)
    return F.when(u.text.rlike(r"\b(?:includes|preload|eager_load)\b"), none()).otherwise(F.transform(found, lambda i: i + 1))


def _evals(u: Unit) -> Column:
    masked = F.split(T.mask_comments(u.text, r"(?s)/\*.*?\*/"), "\n", -1)

    def of(line: Column, i: Column) -> Column:
        def hits(pattern: str) -> Column:
            pieces, found = F.split(line, pattern, -1), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))

            def open_(k: Column) -> Column:
                before = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(pieces, 1, k), F.slice(found, 1, k), lambda a, b: F.array(a, b))), ""), F.get(pieces, k))
                return ~before.contains("//") & (n_of(before, "['\"`]") % 2 == 0)

            return F.when(F.size(found) > 0, F.size(F.filter(F.sequence(F.lit(0), F.size(found) - 1), open_))).otherwise(F.lit(0))

        total = hits(r"\beval\s*\(") + hits(r"\bnew\s+Function\s*\(") + hits(r"\b(?:window|globalThis|self|global)\s*\.\s*eval\s*\(")
        return F.when(line.rlike(r"\beval\s*\(|\bnew\s+Function\s*\("), F.array_repeat(i + 1, total)).otherwise(none())

    return F.flatten(F.transform(masked, of))


def _env_names(u: Unit) -> Column:
    found = F.transform(T.matches(u.text, r"\b(?:process\.env|import\.meta\.env)\.[A-Z_][A-Z0-9_]*"), lambda m: F.struct(F.regexp_extract(m["value"], r"(\w+)$", 1).alias("name"), m["line"].alias("line")))
    open_ = F.filter(found, lambda m: m["name"].rlike(CLIENT_PREFIX) & m["name"].rlike(SECRET_NAME))
    names = F.array_distinct(F.transform(open_, lambda m: m["name"]))
    return F.transform(names, lambda n: F.array_min(F.transform(F.filter(open_, lambda m: m["name"] == n), lambda m: m["line"])))


def _local_storage(u: Unit) -> Column:
    head = r"(?:localStorage|sessionStorage)\s*\.\s*setItem\s*\(\s*"
    quoted = F.filter(T.matches(u.text, head + r"(['\"`])[^'\"`]+\1"), lambda m: T.let(F.lower(F.regexp_extract(m["value"], r"['\"`]([^'\"`]+)['\"`]$", 1)), lambda k: k.rlike(TOKEN_KEY) & ~k.isin(*PLAIN_KEYS)))
    named = F.filter(T.matches(u.text, head + r"(?!['\"`])[A-Za-z_$][\w$]*"), lambda m: F.regexp_extract(m["value"], r"([\w$]+)$", 1).rlike(TOKEN_KEY))
    return F.transform(F.concat(quoted, named), lambda m: m["line"])


def _blank_targets(u: Unit) -> Column:
    def unsafe(m: Column) -> Column:
        rel = F.split(F.lower(F.trim(F.regexp_extract(m["value"], r"""(?i)\brel\s*=\s*["']([^"']*)["']""", 1))), r"\s+")
        return m["value"].rlike(r"""(?i)\btarget\s*=\s*(["'])_blank\1""") & ~F.array_contains(rel, "noopener") & ~F.array_contains(rel, "noreferrer")

    return F.transform(F.filter(T.matches(u.text, r"(?i)<a\s+[^>]*>"), unsafe), lambda m: m["line"])


def _raw_html(u: Unit) -> Column:
    def loose(m: Column) -> Column:
        value = F.trim(F.regexp_extract(m["value"], r"(?s)__html\s*:\s*(.*?)\}\s*\}\s*[\s/]$", 1))
        return ~value.rlike(r"(?s)^'.*'$") & ~value.rlike(r'(?s)^".*"$') & ~(value.rlike(r"(?s)^`.*`$") & ~value.contains("${"))

    return F.transform(F.filter(T.matches(u.code, r"(?s)dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*.+?\}\s*\}\s*[\s/]"), loose), lambda m: m["line"])


def _strong_self(u: Unit) -> Column:
    """A finding for each self. whose innermost braces are no method's and name no weak capture, at the line where these open.

    Innermost braces hold no others but closed ones before the self., so each opening is tried with what follows up to its first unmatched brace.
    """
    closed = r"(?:[^{}]|" + BRACES + ")*"
    opened = T.matches(u.text, r"[^\n{}]*\{(?=" + closed + r"?\bself\.\w)")

    def of(m: Column) -> Column:
        return ~m["value"].rlike(r"\b(?:func|init\??|deinit|subscript)\b[^;{}\n]*\{$")

    at = F.transform(F.filter(opened, of), lambda m: m["line"])
    weak = F.transform(T.matches(u.text, r"\{(?=[\s\S]{0,79}\[\s*(?:weak|unowned)\s+self\b)"), lambda m: m["line"])
    return F.array_except(F.array_distinct(at), weak)


def _setups(u: Unit) -> Column:
    found = F.filter(T.matches(u.text, r"\b(?:beforeEach|beforeAll|afterEach|afterAll|setupServer)\s*" + PARENS), lambda m: T.newlines(m["value"]) >= 2)

    def of(blocks: Column) -> Column:
        bodies = F.transform(blocks, lambda m: F.struct(m["line"].alias("line"), F.regexp_extract(m["value"], r"(?s)\((.*)\)$", 1).alias("body")))
        shaped = F.transform(bodies, lambda b: F.struct(b["line"].alias("line"), b["body"].alias("body"), F.trim(F.regexp_replace(F.regexp_replace(b["body"], r"\s+", " "), rf"\b(?!(?:{SETUP_WORDS})\b)[A-Za-z_$][\w$]*\b", "X")).alias("shape")))

        def many(s: Column) -> Column:
            def alike(b: Column) -> Column:
                same = F.filter(s, lambda x: x["shape"] == b["shape"])
                return (F.size(same) >= 3) & F.get(same, F.lit(0))["body"].rlike(r"(?i)(?:render|setupServer|jest\.mock|vi\.mock|mount|cleanup|act\s*\()")

            return F.transform(F.filter(s, alike), lambda b: b["line"])

        return T.let(shaped, many)

    return T.let(found, of)


def _fakes(u: Unit) -> Column:
    strings = F.transform(T.matches(u.text, r"\b[a-zA-Z_$][\w$]*\s*:\s*(['\"])[^'\"\n]{1,80}\1"), lambda m: F.struct(m["line"].alias("line"), F.regexp_extract(m["value"], r"^([\w$]+)", 1).alias("prop"), F.regexp_extract(m["value"], r"['\"](.*)['\"]$", 1).alias("value")))
    numbers = F.transform(T.matches(u.text, r"\b(?:id|userId|orderId|productId|tenantId|customerId)\s*:\s*\d{1,6}\b"), lambda m: F.struct(m["line"].alias("line"), F.regexp_extract(m["value"], r"^(\w+)", 1).alias("prop"), F.regexp_extract(m["value"], r"(\d+)$", 1).alias("value")))
    dates = F.transform(T.matches(u.text, r"\b(?:createdAt|updatedAt|deletedAt|timestamp|expiresAt)\s*:\s*(?:new\s+Date\(\s*['\"][^'\"\n]+['\"]\s*\)|['\"][^'\"\n]+['\"])"), lambda m: F.struct(m["line"].alias("line"), F.regexp_extract(m["value"], r"^(\w+)", 1).alias("prop"), F.trim(F.regexp_extract(m["value"], r"['\"]([^'\"\n]+)['\"]", 1)).alias("value")))

    def fake(h: Column) -> Column:
        test = h["prop"].rlike("^(?:id|userId|orderId|productId|tenantId|customerId)$") & h["value"].rlike(r"^\d{1,2}$")
        for props, values in FAKE:
            test = test | (h["prop"].rlike(f"^(?:{props})$") & h["value"].rlike(values))
        v, host = h["value"], F.substring_index(F.lower(F.substring_index(h["value"], "@", -1)), ".", -2)
        words = F.size(F.filter(F.split(v, r"\s+"), lambda x: x != ""))
        real = F.when(v.contains("@"), F.substring_index(v, "@", -1).contains(".") & ~host.isin("test.com", "example.com", "foo.com", "bar.com", "example.org", "gmail.com", "yahoo.com")).otherwise(
            (v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}") & ~v.contains("T00:00:00")) | (words >= 3) | (v.rlike(r"\d") & (words >= 2))
        )
        return test & ~real

    return F.transform(F.filter(F.concat(strings, numbers, dates), fake), lambda h: h["line"])


def _weak(u: Unit) -> Column:
    """Assertions that compare a value with itself or with a literal truth, and weak matchers that no expect( follows on the next three lines."""
    chain = r"(?<![\w$])expect\s*" + PARENS + r"(?:\s*\.\s*\w+)*?\s*\.\s*(?:toBe|toEqual|toStrictEqual|toBeNull|toBeUndefined|toBeDefined|toBeTruthy|toBeFalsy|toContain|toMatch|toHaveLength|toHaveProperty|toBeGreaterThan|toBeLessThan|toThrow)\s*" + PARENS

    def test(m: Column) -> Column:
        arg = F.trim(F.regexp_extract(m["value"], r"(?s)^expect\s*\((.*)\)(?:\s*\.\s*\w+)*?\s*\.\s*\w+\s*" + PARENS + "$", 1))
        other = F.trim(F.regexp_extract(m["value"], r"(?s)\.\s*\w+\s*\(((?:[^()]|" + PARENS + r")*)\)$", 1))
        same = ((other != "") & (arg == other)) | other.rlike("^(?:true|false|null|undefined)$")
        weak = m["value"].rlike(rf"\.\s*(?:{WEAK_MATCHERS})\s*" + PARENS + "$")
        followed = F.exists(F.slice(u.lines, m["line"] + 1, 3), lambda x: x.rlike(r"expect\s*\("))
        return ~F.get(u.lines, m["line"] - 1).rlike("skip|todo") & (same | (weak & ~followed))

    return F.transform(F.filter(T.matches(u.text, chain), test), lambda m: m["line"])


def _assertions(u: Unit) -> Column:
    heads = (
        r"(?:export\s+)?(?:async\s+)?function\s+[A-Za-z_$][\w$]*\s*\([^)]*\)\s*[^{]*", r"(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s+)?\([^)]*\)\s*(?::\s*[^=]+)?\s*=>\s*",
        r"(?:(?:public|private|protected|static|async|abstract|readonly)\s+)*[A-Za-z_$][\w$]*\s*\([^)]*\)\s*:\s*[^{]*",
    )
    bodies = T.matches(u.text, r"(?m)^[ \t]*(?:" + "|".join(heads) + ")" + BRACES)
    kinds = r"(?<![\w$])as\s+(?!const)([A-Z][\w$.,<>\[\]|&]*)"
    many = F.filter(bodies, lambda b: F.size(F.array_distinct(F.regexp_extract_all(b["value"], F.lit(kinds), F.lit(1)))) > 3)
    return F.concat(F.transform(T.matches(u.text, r"\bas\s+unknown\s+as\s+"), lambda m: m["line"]), F.transform(many, lambda b: b["line"]))


def _styles(u: Unit) -> Column:
    blocks = T.matches(u.text, r"style\s*=\s*\{\{[^}]*\}\}")
    pairs = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(F.regexp_extract(b["value"], r"\{\{([^}]*)\}\}", 1), F.lit(r"(\w[\w-]*\s*:\s*(?:['\"][^'\"]*['\"]|[\w.#()-]+))"), F.lit(1))))
    kinds = F.array_distinct(F.transform(pairs, lambda p: F.regexp_replace(p, r"^(\w[\w-]*)\s*:\s*", "$1:")))
    return F.when(F.size(kinds) >= 3, F.array(F.get(blocks, F.lit(0))["line"])).otherwise(none())


def _placeholders(u: Unit) -> Column:
    found = T.matches(u.text, r"""(?i)placeholder\s*=\s*(?:"[^"]*"|'[^']*'|\{\s*"[^"]*"\s*\}|\{\s*'[^']*'\s*\})""")

    def bad(m: Column) -> Column:
        value = F.trim(F.regexp_extract(m["value"], r"""=\s*\{?\s*["']([^"']*)""", 1))
        return (F.length(value) >= 3) & value.rlike(BAD_PLACEHOLDER)

    return F.transform(F.filter(found, bad), lambda m: m["line"])


def _any_lines(u: Unit) -> Column:
    found = T.matches(u.text, r":\s*any\b")
    last = F.array_max(F.transform(found, lambda m: m["line"]))
    return F.when((F.size(found) >= 6) & (F.size(found) * 100 >= 5 * last), F.array(F.get(found, F.lit(0))["line"])).otherwise(none())


SAFE_JAVA = r"PreparedStatement|setParameter|setString|setInt|setLong|createQuery.*:.*\b(?:set|bind)|:name\b|\?"
QUOTED_SQL = r"""(["'])\s*(?:--[^\n]*\n\s*)*(?i:""" + SQL_START + r""")(?:(?!\1|\\)[\s\S]|\\[\s\S])*\1\s*\+"""
TEMPLATE_SQL = r"`\s*(?:--[^\n]*\n\s*)*(?i:" + SQL_START + r")[^`]*\$\{[^`]*\}[^`]*`"
TEMPLATE_KT = r"""["'][^"']*\$\{?\w+\}?[^"']*["']"""
SINK_KT = (
    r"(?i)\b(?:Statement|Connection|JdbcTemplate|EntityManager|exposed|ktorm|Query)\b|\b(?:ProcessBuilder|Runtime\.exec|exec\s*\(|\.command\s*\(|\.bash\s*\(|\.sh\s*\()\b"
    r"|\b(?:File\s*\(|Paths\.get|Files\.write|FileWriter|FileOutputStream|BufferedWriter)\s*\("
)
SAFE_PHP = r"(?i)\b(?:prepare\s*\(|->prepare\s*\(|bindParam\s*\(|bindValue\s*\(|real_escape_string)\b"

RULES = (
    Rule("ai/any-density", r"\.tsx?$", once(lambda u: (n_of(u.text, DECLARATION) >= 5) & (10 * (n_of(u.text, r":\s*any\b") + n_of(u.text, r"\bas\s+any\b") + n_of(u.text, "<any>")) >= 3 * n_of(u.text, DECLARATION)))),
    Rule("ai/default-react-stack", SCRIPT, once(_default_stack)),
    Rule("ai/fetch-default-overuse", r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$", once(lambda u: (n_of(u.text, r"\bfetch\s*\(") >= 3) & ~imports_any(u, FETCHERS))),
    Rule("ai/library-reinvention", r"(?i)\.(?:ts|tsx|js|jsx|vue|svelte|astro|html)$", once(lambda u: (sum((u.text.rlike(p).cast("int") for p in REINVENTED), F.lit(0)) >= 2) & ~imports_any(u, WIDGET_LIBRARIES))),
    Rule("ai/markdown-leakage", "", _markdown),
    Rule("ai/state-default-overuse", SCRIPT, once(lambda u: (F.length(u.text) >= 50) & (n_of(u.text, r"\buseState\s*\(") >= 5) & ~u.text.rlike(r"\buseReducer\s*\(") & ~imports_any(u, STATE_LIBRARIES))),
    Rule("ai/tailwind-color-overuse", UI, once(lambda u: F.size(F.array_distinct(F.regexp_extract_all(u.text, F.lit(r"(?:^|[\s\"'`])(" + "|".join(TAILWIND) + r")\b"), F.lit(1)))) >= 3)),
    Rule("cpp/c-style-cast", CPP, each(
        r"(?<!\b(?:static|reinterpret|const|dynamic)_cast\s{0,4}<[^>]{0,60}>\s{0,4})\(\s*(?:int|long|short|char|float|double|bool|unsigned\s+\w+|signed\s+\w+|size_t|[A-Za-z_]\w*(?:\s*[*,&][^)]*)?)\s*\)\s*(?:\w+|[^a-zA-Z_])",
        keep=r"^\([^)]*(?:\b(?:int|long|short|char|float|double|bool|unsigned|signed|size_t)\b|[*&])[^)]*\)", drop=r"^\(\s*void\s*\)", on="code",
    )),
    Rule("cpp/magic-numbers", CPP, _magic),
    Rule("cpp/printf-debug", CPP, once(lambda u: (n_of(u.text, r"\b(?:printf|fprintf|sprintf|snprintf)\s*\(") > 1) | u.text.rlike(r"""std\s*::\s*(?:cout|cerr|clog)\s*<<\s*(?:"[^"]*"|'[^']*')""")),
         r"/tests?/|_test\.cc|_test\.cpp|Tests?\.cc|Tests?\.cpp|_unittest\.cc|_unittest\.cpp"),
    Rule("cpp/raw-new-delete", CPP, once(lambda u: (n_of(u.text, r"\bnew\s+[A-Za-z_]\w*\s*\(") > 1) & (n_of(u.text, r"\bdelete\s+") > 1))),
    Rule("cs/async-without-await", r"(?i)\.cs$", each(r"\basync\s+(?:Task<[^>]+>|ValueTask<[^>]+>|Task|ValueTask|void)\s+\w+\s*\([^)]*\)\s*\{(?![\s\S]{0,1994}\bawait\s)")),
    Rule("cs/empty-catch-block", r"(?i)\.cs$", each(r"\bcatch\s*\([^)]*\)\s*(?:\{\s*\}|\{\s*throw\s*;\s*\})")),
    Rule("cs/sql-string-interpolation", r"(?i)\.cs$", line_if(
        lambda x: x.rlike(r'(?i)\$\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)[^"]*\{[^}]+\}[^"]*"') & x.rlike(SQL_WORD), r"\b(?:Parameters\.Add|FromSqlInterpolated?|WithParameters|new\s+SqlParameter)\b",
    )),
    Rule("dart/dynamic-call", r"(?i)\.dart$", in_lines(lambda x: n_of(x, r"\bas\s+[A-Z][a-zA-Z0-9_<>,\s]*\b") + n_of(x, r"\bdynamic\s+[a-zA-Z_]"), r"^\s*//")),
    Rule("dart/missing-dispose", r"(?i)\.dart$", _dispose),
    Rule("dart/print-debug", r"(?i)\.dart$", in_lines(lambda x: n_of(x, r"\bprint\s*\("), r"^\s*(?://|\*)")),
    Rule("dart/unwrapped-futures", r"(?i)\.dart$", line_if(_futures)),
    Rule("db/sql-concat", "", each(r"(?i)`(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|WITH)\b[^`]*\$\{[^}]+\}[^`]*`")),
    Rule("go/nil-slice-vs-empty", "", _nil_slices),
    Rule("go/struct-tag-inconsistency", "", _struct_tags),
    Rule("java/lost-stack-trace", r"(?i)\.java$", _lost_traces, r"(?i)/test/"),
    Rule("java/sql-string-concat", r"(?i)\.java$", line_if(lambda x: F.regexp_extract(x, r"(?i)^(.*?)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE|DROP\s+TABLE|ALTER\s+TABLE)\b", 1).rlike(r"""["'=]\s*$""") & x.contains("+"), SAFE_JAVA)),
    Rule("java/suspicious-implementation", r"(?i)\.java$", lambda u: F.transform(F.filter(
        T.matches(u.text, r"(?:public|private|protected)\s+(?:static\s+)?[\w<>,\s\[\]]+?\s+\w+\s*\([^)]*\)\s*\{[^{}]*\}"),
        lambda m: F.regexp_extract(m["value"], r"(\w+)\s*\([^)]*\)\s*\{", 1).rlike(STRONG_VERB) & F.regexp_extract(m["value"], r"\{([^{}]*)\}$", 1).rlike(
            r"^\s*(?:return\s+(?:null|true|false|0|1|0L|0\.0|\"\"|\w+)\s*;\s*|throw\s+new\s+(?:UnsupportedOperationException(?:\([^)]*\))?|RuntimeException\([^)]*\)|IllegalStateException\([^)]*\))\s*;\s*)?$"
        ),
    ), lambda m: m["line"]), r"(?i)/test/"),
    Rule("java/thread-sleep-in-loop", r"(?i)\.java$", _sleeps),
    Rule("kt/coroutine-cancellation-missing", r"(?i)\.kt$", each(
        r"\b(?:launch|async|launchIn|async\s*\{)\s*\{(?![\s\S]{0,4990}\b(?:ensureActive|yield\s*\(|delay\s*\(|isActive|isCancelled|coroutineScope|withContext|currentCoroutineContext)\b)",
    )),
    Rule("kt/force-unwrap", r"(?i)\.kt$", in_lines(lambda x: n_of(x, r"\b\w+\s*!!\b|\w+!!\w+|!!\.\w+"), r"^\s*(?://|/\*|\*)")),
    Rule("kt/global-coroutine-scope", r"(?i)\.kt$", each(r"\bGlobalScope\.(?:launch|async)\s*[({]")),
    Rule("kt/string-template-injection", r"(?i)\.kt$", in_lines(lambda x: F.when(x.rlike(SQL_WORD) | x.rlike(SINK_KT), n_of(x, TEMPLATE_KT)).otherwise(F.lit(0)))),
    Rule("logic/math-any-density", "", _any_lines),
    Rule("php/empty-catch", r"(?i)\.php$", in_lines(lambda x: x.rlike(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}").cast("int") + x.rlike(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*throw\s*;\s*\}").cast("int"))),
    Rule("php/sql-injection", r"(?i)\.php$", lambda u: F.transform(F.filter(
        T.matches(u.text, r"""["'][^"']*["']\s*\.\s*\$[a-zA-Z_]\w*|["'][^"']*\$\{[^}]+\}[^"']*["']"""), lambda m: m["value"].rlike(SQL_WORD) & ~F.get(u.lines, m["line"] - 1).rlike(SAFE_PHP),
    ), lambda m: m["line"])),
    Rule("rb/exception-swallowing", r"(?i)\.rb$", line_if(lambda x: x.rlike(r"\brescue(?:\s+[A-Z][A-Za-z]*(?:::\s*[A-Z][A-Za-z]*)*)?(?:\s*,\s*[A-Za-z_][A-Za-z0-9_]*)?(?:\s*#[^\n]*)?\s*$"))),
    Rule("rb/n-plus-one-query", r"(?i)\.rb$", _n_plus_one),
    Rule("rb/sql-string-concat", r"(?i)\.rb$", both(each(r"""["'][^"']*#\{[^}]+\}[^"']*["']""", keep=SQL_WORD), each(r"""["'][^"']*["']\s*\+\s*\w+\s*\+\s*["'][^"']*["']""", keep=SQL_WORD))),
    Rule("security/eval", "", _evals),
    Rule("security/exposed-env-var", "", _env_names),
    Rule("security/fail-open-auth", "", lambda u: F.concat(*[F.slice(each(p, on="code")(u), 1, 1) for p in FAIL_OPEN])),
    Rule("security/localstorage-token", "", _local_storage),
    Rule("security/missing-auth-check", ROUTE_FILE, once(lambda u: u.text.rlike(HANDLER) & ~u.text.rlike(AUTH))),
    Rule("security/public-admin-route", PRIVILEGED, once(lambda u: ~u.text.rlike(ROLE))),
    Rule("security/sql-construction", "", both(each(TEMPLATE_SQL), each(QUOTED_SQL))),
    Rule("security/target-blank-no-noopener", "", _blank_targets),
    Rule("security/unsafe-html-render", "", _raw_html),
    Rule("swift/fatal-error-thrown", r"(?i)\.swift$", lambda u: F.when(u.text.rlike(r"\bimport\s+XCTest\b"), none()).otherwise(each(r"\b(?:fatalError|preconditionFailure)\s*\(")(u))),
    Rule("swift/force-unwrap", r"(?i)\.swift$", lambda u: F.when(u.text.rlike(r"\bimport\s+XCTest\b"), none()).otherwise(both(each(r"\bas!\s+"), each(r"\btry!\s+"), each(r"(?m)(?<![=!])(?:\w|\])!\s*(?:\.|\(|;|,|\s*$)"))(u))),
    Rule("swift/implicitly-unwrapped-optional", r"(?i)\.swift$", each(r"\b(?:var|let)\s+\w+\s*:\s*[A-Za-z_][\w<>,.\s]*!\s*[=;\n]")),
    Rule("swift/print-debug", r"(?i)\.swift$", lambda u: T.let(each(r"\bprint\s*\(")(u), lambda x: F.when(F.size(x) > 1, F.slice(x, 1, 10)).otherwise(none())), r"/Tests/|/Tests?\.swift|Tests?\.swift$"),
    Rule("swift/strong-self-capture", r"(?i)\.swift$", _strong_self),
    Rule("test/duplicate-setup", TEST, _setups),
    Rule("test/fake-placeholder", TEST, _fakes),
    Rule("test/weak-assertion", TEST, _weak),
    Rule("ts/enum-vs-as-const", "", each(r"(?m)^[ \t]*(?:export\s+)?(?:const\s+)?(?:enum|namespace)\s+[A-Z_][A-Za-z0-9_]*\s*\{")),
    Rule("ts/excessive-type-assertion", "", _assertions),
    Rule("ts/import-type-misuse", "", each(r"(?m)^[ \t]*import\s*\{[^}]*\btype\s+[A-Za-z_]")),
    Rule("ts/never-vs-unknown", "", each(r"(?m)^[ \t]*(?:export\s+)?(?:async\s+)?function\s+[A-Za-z_$][\w$]*[^{]*:\s*(?:Promise<)?never\b[^{]*" + BRACES, drop=r"\b(?:throw\b|while\s*\(|for\s*\(|process\.exit\b|System\.exit\b)")),
    Rule("typo/placeholder-text", "", _placeholders),
    Rule("visual/inline-style-dominance", "", _styles),
    Rule("wcag/missing-alt", UI, each(r"(?i)<img\b[^>]*>", drop=r"""(?i)\balt\s*=\s*(?:"[^"]*"|'[^']*')|\brole\s*=\s*["'](?:presentation|none)["']""")),
)
#: Rules that count matches in windows of lines: pattern, lines that a window spans, matches that it needs.
STORM = {"ai/console-debug-storm": (r"\bconsole\s*\.\s*log\s*\(", 30, 5), "logic/math-console-log-storm": (r"\bconsole\.log\s*\(", 31, 5)}


def source_findings(units: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (path, rule_id, line) of units (path, text). Rows with a null path or text have none; a finding comes once for each of equal rows."""
    given = units.where(F.col("path").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    packages = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (IMPORTED, REQUIRED)]))
    given = given.select("path", "text", T.mask_comments(F.col("text")).alias("code"), F.split("text", "\n", -1).alias("lines"), packages.alias("packages"))
    u = Unit(*[F.col(c) for c in ("path", "text", "code", "lines", "packages")])
    found = []
    for r in rules:
        lines = r.find(u)
        if r.paths:
            fits = u.path.rlike(r.paths) & (~u.path.rlike(r.not_paths) if r.not_paths else F.lit(True))
            lines = F.when(fits, lines)
        found.append(F.struct(F.lit(r.rule_id).alias("rule_id"), lines.alias("lines")))
    rows = given.select("path", F.explode(F.array(*found)).alias("f")).select("path", "f.rule_id", F.explode("f.lines").alias("line"))
    return rows.unionByName(storms(units))


def most_in_window(units: DataFrame, pattern: str, span: int) -> DataFrame:
    """(path, most, first): the most matches that a window of so many lines has, and the line of the first match."""
    rows = units.select("path", F.explode(T.matches(F.col("text"), pattern)).alias("m")).select("path", "m.line")
    near = Window.partitionBy("path").orderBy("line").rangeBetween(-(span - 1), 0)
    return rows.withColumn("n", F.count("*").over(near)).groupBy("path").agg(F.max("n").alias("most"), F.min("line").alias("first"))


def storms(units: DataFrame) -> DataFrame:
    """Findings of the rules on debug output."""
    given = units.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    pattern, span, least = STORM["logic/math-console-log-storm"]
    dense = most_in_window(given, pattern, span).where(F.col("most") >= least).select("path", F.lit("logic/math-console-log-storm").alias("rule_id"), F.col("first").alias("line"))
    packages = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (IMPORTED, REQUIRED)])
    plain = given.where(~F.col("path").rlike(r"(?i)\.(?:test|spec)\.[jt]sx?$|(?:logger|logging|debug|util)\.[jt]sx?$") & (F.length("text") >= 1000))
    known = F.array(*[F.lit(n) for n in LOGGERS])
    plain = plain.where(~F.exists(packages, lambda p: F.exists(known, lambda n: (p == n) | p.startswith(F.concat(n, F.lit("/"))))))
    pattern, span, least = STORM["ai/console-debug-storm"]
    total = n_of(F.col("text"), r"\bconsole\s*\.\s*(?:log|debug|info|warn|error)\s*\(") + n_of(F.col("text"), r"\bdebugger\s*;?")
    many = plain.select("path", total.alias("total")).join(most_in_window(plain, pattern, span), "path", "left").where((F.col("total") >= 10) | (F.col("most") >= least))
    return dense.unionByName(many.select("path", F.lit("ai/console-debug-storm").alias("rule_id"), F.lit(1).alias("line")))
