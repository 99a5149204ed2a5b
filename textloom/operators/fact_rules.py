"""Rules on facts that a parser gives: tables in, findings (path, rule_id, line) out.

Tables, each with path and line: elements (tag, classes, attributes, interactive), components (name, size, branches, server, hooks), bindings (name, kind, type_only,
scope, source, referenced), imports (source), facts (kind, value, depth, flag) for single facts of other kinds, functions (name, public, test, head) and calls (name, test)
of Rust, and for documents spans of code, links, exports, packages and files. Rules that look at a table join nothing larger than it; a unit's facts meet by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

Facts = dict[str, DataFrame]

# Names and patterns that tell what a rule is about.
SHADCN = r"\b(?:Button|Card|Dialog|Sheet|Drawer|Popover|Tooltip|Alert|Badge|Input|Textarea|Select)\b"
LOCALS = ("var", "let", "const", "function", "class", "type", "interface", "enum")
CLIENT_HOOKS = ("useState", "useEffect", "useContext")
UX = (
    ("modal", r"(?i)(?:Modal|Dialog|Sheet|Drawer|Popup|Overlay|Lightbox)$", 4), ("toast", r"(?i)(?:Toast|Snackbar|Notification|Alert|Banner|Flash)$", 3),
    ("button", r"(?i)(?:Button|Action|Cta|LinkButton|FloatingAction)$", 5), ("input", r"(?i)(?:Input|TextField|FormField|TextInput|SearchBox|TextArea|Select)$", 4),
    ("card", r"(?i)(?:Card|Tile|Panel|Box|Surface)$", 4),
)
LAYOUT_VALUE = r"^(?:w|h|p|m|gap|space-x|space-y|px|py|mx|my|min-w|min-h|max-w|max-h|inset)-\[.*\]$"
RADIUS_VALUE = r"^(?:rounded|rounded-t|rounded-r|rounded-b|rounded-l|rounded-tl|rounded-tr|rounded-br|rounded-bl|rounded-ss|rounded-se|rounded-es|rounded-ee)-\[.*\]$"
SPACING = r"^-?(?:p|px|py|pt|pr|pb|pl|m|mx|my|mt|mr|mb|ml|gap|gap-x|gap-y|space-x|space-y)-(.+)$"
INLINE_SPACING = r"^(?:padding|margin)(?:-(?:top|right|bottom|left))?$|^(?:gap|column-gap|row-gap)$"
STRINGLY = ("kind", "type", "mode", "event", "status", "category", "action", "state", "level", "role", "tier", "phase", "tag", "format", "shape", "direction", "side", "method")
API_NAMES = ("new", "default", "from", "from_str", "from_iter", "try_from", "into", "into_iter", "try_into", "as_ref", "as_mut", "clone", "fmt", "eq", "hash", "partial_eq", "partial_cmp", "cmp", "ord")
FONT_HINT = r"(?i)next/font|@import\s+url|fonts\.googleapis|fonts\.gstatic|@font-face|Google_Fonts"
NOT_PACKAGES = (
    "the and for with from this that npm npx pnpm yarn node git cli api sdk src dist lib bin doc docs test spec todo fix bug feat refactor chore http https url json xml yaml sql orm css html svg png jpg pdf "
    "csv md mdx ts tsx js jsx ok no yes aspirational concrete abstract inline exposed deprecated experimental stable beta alpha wip draft final shim polyfill stub mock fake real false true optional required default"
).split()
#: Families of class tokens whose values have little entropy: rule, pattern (value in group 1), least number, most bits.
ENTROPY = (
    ("visual/math-rounded-entropy", r"\brounded(-none|-sm|-md|-lg|-xl|-2xl|-3xl|-full)?\b", 6, 1.8),
    ("visual/math-font-entropy", r"\btext-(xs|sm|base|lg|xl|2xl|3xl|4xl|5xl|6xl)\b", 6, 1.4),
    ("visual/math-spacing-entropy", r"\b(?:p|px|py|pt|pb|pl|pr|m|mx|my|mt|mb|ml|mr|gap|gap-x|gap-y)-(\d+)\b", 10, 1.5),
    ("layout/math-grid-uniformity", r"\bgrid-cols-([1-9]|1[0-2])\b", 4, 1.0),
)
GAP = r"\bgap(?:-x|-y)?-(\d+)\b"


def finding(rows: DataFrame, rule_id: str, line: Column | str = "line") -> DataFrame:
    return rows.select("path", F.lit(rule_id).alias("rule_id"), (F.col(line) if isinstance(line, str) else line).cast("int").alias("line"))


def of_kind(f: Facts, kind: str) -> DataFrame:
    return f["facts"].where(F.col("kind") == kind)


def tokens(f: Facts) -> DataFrame:
    """(path, line, class) of all elements."""
    return f["elements"].select("path", "line", F.explode("classes").alias("class"))


def components(f: Facts) -> list[DataFrame]:
    c = f["components"]
    effects = F.size(F.filter("hooks", lambda h: h["name"] == "useEffect"))
    server = c.where("server").select("path", F.explode("hooks").alias("h")).where(F.col("h.name").isin(*CLIENT_HOOKS)).select("path", F.col("h.line").alias("line"))
    per_file = c.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct("line"))["line"].alias("line")).where("n >= 2")
    named = c.where(F.col("name").rlike("^[A-Z]"))
    # Names of a file that share their first or last word; all but the longest are findings, five for a file at most, as a report of them.
    ends = F.array_distinct(F.array(F.lower(F.regexp_extract("name", "^[A-Z][a-z0-9]*", 0)), F.lower(F.coalesce(F.nullif(F.regexp_extract("name", "[A-Z][a-z0-9]*$", 0), F.lit("")), F.col("name")))))
    stems = named.where(F.length("name") >= 4).groupBy("path", "name").agg(F.min("line").alias("line")).select("path", "name", "line", F.explode(ends).alias("stem"))
    by = Window.partitionBy("path", "stem")
    drift = stems.withColumn("n", F.count("*").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.length("name").desc(), "name"))).where("n >= 3 AND k > 1")
    drift = drift.withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("stem", "k"))).where("i <= 5")
    label = F.lit(None).cast("string")
    for name, pattern, _ in reversed(UX):
        label = F.when(F.col("name").rlike(pattern), name).otherwise(label)
    least = F.lit(None).cast("int")
    for name, _, n in UX:
        least = F.when(F.col("label") == name, n).otherwise(least)
    ux = named.withColumn("label", label).groupBy("path", "label").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= least)
    return [
        finding(c.where("size > 200 OR branches > 7"), "component/giant-component"), finding(per_file, "component/multiple-components-per-file"),
        finding(c.where(effects >= 3), "logic/reactive-hook-soup"), finding(server, "logic/boundary-violation"),
        finding(drift, "product/terminology-drift"), finding(ux, "product/ux-pattern-fragmentation", F.lit(1)),
    ]


def elements(f: Facts, units: DataFrame, spacing_scale: list[float], radius_scale: list[float]) -> list[DataFrame]:
    e = f["elements"]
    label = F.trim(F.coalesce(F.element_at("attributes", "value"), F.element_at("attributes", "aria-label"), F.lit("")))
    outline = F.exists("classes", lambda c: c.rlike(r"^(?:(?:focus|focus-visible):)?outline-none$")) & ~F.exists("classes", lambda c: c.rlike(r"^focus-visible:ring-.+$"))
    joined = F.array_join("classes", " ")
    fixed = e.withColumn("all", joined).where(F.col("all").rlike(r"\b(?:fixed|sticky)\b") & ~F.col("all").rlike(r"\bfixed-(?:width|height)|sticky-(?:top|bottom|left|right)"))

    def positive(name: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(element_at(attributes, '{name}') AS DOUBLE) > 0"), F.lit(False))

    lazy = e.where((F.col("tag") == "img") & (F.element_at("attributes", "loading") == "lazy") & ~(positive("width") & positive("height")) & ~F.exists("classes", lambda c: c.startswith("aspect-")))
    name = F.element_at("attributes", "className")
    shadcn = e.where(F.col("interactive") & F.col("tag").rlike(SHADCN) & (F.length(name) >= 80) & name.rlike(r"\b(?:bg-|text-|border-|hover:)"))
    escapes = e.withColumn("n", F.size(F.filter("classes", lambda c: c.rlike(LAYOUT_VALUE)))).withColumn("all", F.sum("n").over(Window.partitionBy("path"))).where("n > 0 AND all >= 3")
    font = e.withColumn("has", F.exists("classes", lambda c: c.rlike(r"\bfont-(?:sans|mono|serif)\b"))).where("has").groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n >= 3")
    hinted = units.where(F.col("text").rlike(FONT_HINT)).select("path").union(f["imports"].where(F.col("source").rlike(FONT_HINT)).select("path")).distinct()
    kinds = e.groupBy("path").agg(*[F.sum((F.lower("tag") == t).cast("int")).alias(t) for t in ("button", "input", "select")], F.min("line").alias("line"))
    some = F.filter(F.array("button", "input", "select"), lambda n: n > 0)
    uniform = kinds.where((F.size(some) >= 2) & (F.array_min(some) >= 2) & (F.array_max(some) <= 3 * (F.array_min(some) + 1)))
    labels = e.where((F.lower("tag") == "button")).groupBy("path").agg(F.min("line").alias("line"), F.count(F.when(label != "", 1)).alias("n"), F.stddev_pop(F.when(label != "", F.length(label))).alias("sd")).where("n >= 4 AND sd <= 4")
    classes = tokens(f)
    value = F.regexp_extract("class", r"\[(.*)\]", 1)
    unit = F.regexp_extract(F.trim(value), r"^-?\d+(?:\.\d+)?(px|rem|em|%)$", 1)
    number = F.expr(r"try_cast(regexp_extract(trim(regexp_extract(class, '\\[(.*)\\]', 1)), '^(-?\\d+(?:\\.\\d+)?)(?:px|rem|em|%)$', 1) AS DOUBLE)")
    rem = F.when(unit == "px", number / 16).when(unit.isin("rem", "em"), number)

    def off(scale: list[float]) -> Column:
        near = F.array_min(F.transform(F.array(*[F.lit(float(s)) for s in scale]), lambda s: F.abs(s - rem)))
        return F.coalesce(near >= 0.001, F.lit(False)) if scale else F.lit(False)

    # Spacing classes and inline styles whose value, in units of a quarter rem, is no step of the scale.
    raw = F.regexp_replace(F.regexp_extract("class", SPACING, 1), r"^\[(.*)\]$", "$1")
    plain = F.expr("try_cast(raw AS DOUBLE)")
    in_px, in_rem = F.expr(r"try_cast(regexp_extract(raw, '^(-?\\d+(?:\\.\\d+)?)px$', 1) AS DOUBLE) / 4"), F.expr(r"try_cast(regexp_extract(raw, '^(-?\\d+(?:\\.\\d+)?)rem$', 1) AS DOUBLE) / 0.25")
    steps = F.array(*[F.lit(float(s)) for s in spacing_scale])

    def no_step(column: str) -> Column:
        return F.col(column).isNotNull() & (F.col(column) != 0) & ~F.exists(steps, lambda s: F.abs(s - F.col(column)) < 1e-6)

    grid = classes.distinct().withColumn("raw", raw).withColumn("v", F.coalesce(plain, in_px, in_rem)).where(no_step("v")).select("path", "line")
    blocks = units.select("path", F.explode(T.matches(F.col("text"), r"style\s*=\s*\{\{[^}]*\}\}")).alias("m"))
    parts = blocks.select("path", "m.line", F.explode(F.regexp_extract_all(F.regexp_extract("m.value", r"\{\{([^}]*)\}\}", 1), F.lit(r"[a-zA-Z0-9-]+\s*:[^,]*"), F.lit(0))).alias("p"))
    prop = F.lower(F.regexp_replace(F.regexp_extract("p", r"^([a-zA-Z0-9-]+)", 1), "([a-z])([A-Z])", "$1-$2"))
    inline = parts.where(prop.rlike(INLINE_SPACING)).select("path", "line", F.explode(F.regexp_extract_all(F.regexp_extract("p", r":(.*)$", 1), F.lit(r"-?\d+(?:\.\d+)?(?:px|rem)"), F.lit(0))).alias("raw"))
    inline = inline.withColumn("v", F.coalesce(in_px, in_rem)).where(no_step("v")).select("path", "line")
    grid = grid.unionByName(inline).withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n >= 3")
    long = classes.where(F.length("class") >= 10).withColumn("class", F.trim("class"))
    bloat = long.groupBy("path", "class").agg(F.count("*").alias("n")).groupBy("path").agg(F.max("n").alias("n")).where("n >= 5").join(long.groupBy("path").agg(F.min("line").alias("line")), "path")
    hex_ = classes.select("path", "line", F.explode(F.regexp_extract_all("class", F.lit(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"), F.lit(1))).alias("h"))
    six = F.lower(F.when(F.length("h") == 3, F.regexp_replace("h", "(.)", "$1$1")).otherwise(F.col("h")))
    hex_ = hex_.select("path", "line", *[F.conv(F.substring(six, 2 * k + 1, 2), 16, 10).cast("int").alias(c) for k, c in enumerate("rgb")])
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    hue = F.when(most == F.col("r"), ((F.col("g") - F.col("b")) / (most - least)) % 6).when(most == F.col("g"), (F.col("b") - F.col("r")) / (most - least) + 2).otherwise((F.col("r") - F.col("g")) / (most - least) + 4)
    hues = hex_.where(most - least >= 30).withColumn("h", F.pmod(F.floor(hue * 60 + 0.5), F.lit(360)).cast("int"))
    # Few hues are there (360 at most for a file), so pairs of distinct ones are few too.
    spread = hues.groupBy("path").agg(F.count("*").alias("n"), F.collect_set("h").alias("hs"), F.min("line").alias("line")).where("n >= 5")
    gap = F.array_max(F.flatten(F.transform("hs", lambda a: F.transform("hs", lambda b: F.least(F.abs(a - b), 360 - F.abs(a - b))))))
    return [
        finding(e.where(F.col("interactive") & outline), "wcag/focus-appearance"), finding(fixed.groupBy("path", "all").agg(F.min("line").alias("line")), "wcag/focus-obscured"), finding(lazy, "perf/cls-image"),
        finding(shadcn, "component/shadcn-prop-mismatch"), finding(escapes, "visual/arbitrary-escape"), finding(font.join(hinted, "path", "left_anti"), "visual/math-default-font"),
        finding(uniform, "layout/math-element-uniformity"), finding(labels, "typo/math-button-label-uniformity"),
        finding(classes.where(F.col("class").rlike(LAYOUT_VALUE) & off(spacing_scale)), "visual/spacing-scale-violation"),
        finding(classes.where(F.col("class").rlike(RADIUS_VALUE) & off(radius_scale)), "visual/radius-scale-violation"),
        finding(grid, "layout/spacing-grid"), finding(bloat, "perf/css-bloat"), finding(spread.where(gap <= 90), "visual/math-color-cluster"), *spreads(classes),
    ]


def spreads(classes: DataFrame) -> list[DataFrame]:
    """Rules on the entropy, the commonest value's share and the inequality of class tokens' counts."""
    first = classes.groupBy("path").agg(F.min("line").alias("line"))
    out = []
    for rule_id, pattern, least, most in (*ENTROPY, ("layout/gap-monopoly", GAP, 6, None)):
        c = classes.select("path", F.explode(F.regexp_extract_all("class", F.lit(pattern), F.lit(1))).alias("v")).groupBy("path", "v").agg(F.count("*").alias("n"))
        c = c.withColumn("total", F.sum("n").over(Window.partitionBy("path")))
        p = F.col("n") / F.col("total")
        g = c.groupBy("path").agg(F.max("total").alias("total"), (-F.sum(p * F.log2(p))).alias("h"), F.max(p).alias("top"), F.count("*").alias("kinds")).where(F.col("total") >= least)
        bound = F.when(F.col("kinds") <= 3, 0.9).when(F.col("kinds") <= 5, 0.75).otherwise(0.6)
        out.append(finding(g.where(F.col("h") <= most + 1e-12 if most is not None else F.col("top") >= bound).join(first, "path"), rule_id))
    c = classes.select("path", F.explode(F.filter(F.split("class", r"\s+"), lambda x: x != "")).alias("v")).groupBy("path", "v").agg(F.count("*").alias("n"))
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("n", "v")))
    g = c.groupBy("path").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("i") * F.col("n")).alias("w"))
    out.append(finding(g.where((F.col("k") >= 20) & (2 * F.col("w") / (F.col("k") * F.col("total")) - (F.col("k") + 1) / F.col("k") >= 0.5)).join(first, "path"), "logic/math-gini-class-usage"))
    return out


def names(f: Facts, units: DataFrame) -> DataFrame:
    """logic/math-variable-name-entropy: names of state, properties and the text with little entropy."""
    stop = "use set get new const let var function return import export default class extends async await this that with from true false null undefined props state key value index length name string number boolean object array void any unknown".split()
    words = units.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\b[a-z][a-zA-Z0-9]{2,}\b"), F.lit(0))).alias("v"))
    words = words.unionByName(of_kind(f, "state").select("path", F.explode(F.split("value", "/")).alias("v"))).unionByName(of_kind(f, "property").select("path", F.col("value").alias("v")))
    c = words.where((F.col("v") != "") & ~F.lower("v").isin(*stop)).groupBy("path", "v").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("path")))
    p = F.col("n") / F.col("total")
    return finding(c.groupBy("path").agg(F.max("total").alias("total"), (-F.sum(p * F.log2(p))).alias("h")).where("total >= 40 AND h <= 1.8"), "logic/math-variable-name-entropy", F.lit(1))


def bindings(f: Facts) -> list[DataFrame]:
    b = f["bindings"].where(~F.col("referenced"))
    with_jsx = f["elements"].select("path").distinct().withColumn("jsx", F.lit(True))
    imported = b.where(F.col("kind").isin("import-specifier", "import-default", "import-namespace") & ~F.col("type_only") & (F.col("name") != "")).join(with_jsx, "path", "left")
    imported = imported.where(~((F.col("kind") == "import-default") & (F.col("name") == "React") & (F.col("source") == "react") & F.col("jsx").isNotNull()))
    own = b.where(F.col("kind").isin(*LOCALS) & ~F.col("name").isin("React", "_") & ~F.col("name").startswith("_") & ~((F.col("scope") == "module") & ~F.col("kind").isin("var", "let")))
    params = b.where((F.col("kind") == "parameter") & ~F.col("name").startswith("_") & (F.col("name") != "props"))
    return [finding(imported, "dead/unused-import"), finding(own, "dead/unused-local"), finding(params, "dead/unused-parameter")]


def single_facts(f: Facts) -> list[DataFrame]:
    ghosts = of_kind(f, "logical").where("flag AND depth >= 3").withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n >= 3")
    return [
        finding(of_kind(f, "condition"), "dead/dead-branch"), finding(of_kind(f, "unreachable").where("value <> '<unreachable>'"), "dead/unreachable"),
        finding(of_kind(f, "key").where("value = 'missing'"), "logic/key-prop-missing"), finding(of_kind(f, "optimistic"), "logic/optimistic-no-rollback"), finding(ghosts, "logic/ghost-defensive"),
        finding(of_kind(f, "state").where("flag AND split(value, '/')[0] <> '' AND coalesce(split(value, '/')[1], '') <> ''"), "logic/zombie-state"), finding(of_kind(f, "cors"), "security/dangerous-cors"),
    ]


def aliases(f: Facts, allowed: list[str]) -> DataFrame:
    """context/import-path-mismatch: aliased imports that begin with none of the allowed prefixes; none are allowed, none are told."""
    ok = F.exists(F.array(*[F.lit(p) for p in allowed]), lambda p: F.col("source").startswith(p)) if allowed else F.lit(True)
    return finding(f["imports"].where(F.col("source").rlike("^[@~]/") & ~ok), "context/import-path-mismatch")


def rust(f: Facts, units: DataFrame) -> list[DataFrame]:
    calls, fns = f["calls"].where("NOT test"), f["functions"]
    # An enum of 2 to 32 plain variants makes a text parameter of a telling name a finding.
    enums = units.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(?:pub(?:\([^)]+\))?\s+)?enum\s+\w+\s*\{([^}]*)\}"), F.lit(1))).alias("body"))
    variants = F.size(F.filter(F.split("body", r",(?![^()]*\))"), lambda x: F.trim(x).rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\s|$)")))
    with_enum = enums.where(variants.between(2, 32)).select("path").distinct()
    text_params = F.regexp_extract_all("head", F.lit(r"\b([a-z_][a-zA-Z0-9_]*)\s*:\s*&\s*(?:mut\s+)?(?:str|String)\b"), F.lit(1))
    stringly = fns.where(F.arrays_overlap(text_params, F.array(*[F.lit(n) for n in STRINGLY]))).join(with_enum, "path", "left_semi")
    words = units.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0)))).alias("name"))
    unused = fns.where(F.col("public") & ~F.col("test") & ~F.col("name").isin(*API_NAMES)).join(words, ["path", "name"], "left_anti")
    used = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*use\s+[\s\S]*?;\s*$", ""), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    left = units.select("path", F.explode(F.array_distinct(F.regexp_extract_all(used, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0)))).alias("name"))
    imported = f["bindings"].where("kind = 'rust-use'").join(left, ["path", "name"], "left_anti")
    return [
        finding(calls.where(F.col("name").isin("todo!", "unimplemented!", "todo_unimplemented!")), "rust/todo-macro"), finding(calls.where(F.col("name").isin("unwrap", "expect", "unwrap_or_else")), "rust/unwrap-in-production"),
        finding(stringly, "rust/stringly-typed"), finding(unused, "rust/unused-pub-fn"), finding(imported, "dead/unused-import"),
    ]


def documents(f: Facts, units: DataFrame) -> list[DataFrame]:
    """Rules on Markdown: spans and links are read from the text, and meet the project's files, exports and packages."""
    md = units.where(F.col("path").rlike(r"(?i)\.mdx?$")).select("path", T.mask_comments(F.col("text"), r"(?s)<!--.*?-->").alias("text"))
    links = md.select("path", F.explode(T.matches(F.col("text"), r"(?<!!)\[[^\]\n]*\]\([^()\s]+\)")).alias("m")).select("path", "m.line", F.regexp_extract("m.value", r"\(([^()]+)\)$", 1).alias("target"))
    own = links.where(~F.col("target").rlike(r"^(?:https?://|mailto:|tel:|#|/)") & ~F.col("target").rlike(r"\[[^\]]*\]|^\s*[?:=!]|\\|[{}|]"))
    folder, file = F.regexp_replace("path", r"[^/]*$", ""), F.substring_index("target", "#", 1)
    whole = F.concat(folder, F.regexp_replace(file, r"^(?:\./)+", ""))
    for _ in range(8):  # a folder up for each .., some levels deep
        whole = F.regexp_replace(F.regexp_replace(whole, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1"), r"/\./", "/")
    broken = own.where(file != "").withColumn("file", whole).join(f["files"].select("file").distinct(), "file", "left_anti")
    lines = md.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "l")).withColumn("line", F.col("i") + 1)
    spans = lines.select("path", "line", "l", F.explode(F.regexp_extract_all("l", F.lit(r"`[^`\n]+`"), F.lit(0))).alias("span"))
    name = F.regexp_replace("span", "`", "")
    after = F.expr("substring(l, instr(l, span) + length(span))")
    inside = F.trim(F.regexp_extract(after, r"^\s*\(([^)]*)\)", 1))
    prose = inside.rlike(r"(?i)^[`/]|`|\d+\s+[a-z]|[—–]") | ((F.length(inside) > 40) & ~inside.contains(",")) | (inside.rlike("[a-zA-Z]") & (F.length(inside) <= 24) & ~inside.contains(",") & ~inside.contains(":"))
    call = after.rlike(r"^\s*\(") | F.expr("contains(substring(l, instr(l, span) + length(span)), concat(replace(span, '`', ''), '('))")
    stale = spans.where(name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]{2,}$") & call & ~prose & ~F.expr("substring(l, instr(l, span) - 1, 1) IN ('.', '|')")).withColumn("name", name)
    stale = stale.join(f["exports"].select("name").distinct(), "name", "left_anti")
    asked = F.coalesce(*[F.nullif(F.regexp_extract("l", p, 1), F.lit("")) for p in (r"(?i)(?:npm\s+install|pnpm\s+add|yarn\s+add)\s+([A-Za-z0-9_./@-]+)", r"""(?i)from\s+['"]([^'"]+)['"]""", r"""(?i)require\s*\(\s*['"]([^'"]+)['"]\s*\)""")])
    package = F.when(asked.startswith("@"), F.substring_index(asked, "/", 2)).otherwise(F.substring_index(asked, "/", 1))
    gone = spans.withColumn("package", package).where(F.col("package").rlike(r"^@?[a-z][a-z0-9._/-]*$") & (F.length("package") >= 2) & ~F.col("package").isin(*NOT_PACKAGES))
    gone = gone.join(f["packages"].select("package").distinct(), "package", "left_anti")
    return [finding(broken, "docs/broken-link"), finding(stale, "docs/stale-function-reference"), finding(gone, "docs/stale-package-reference")]


def naturalness(f: Facts, units: DataFrame) -> DataFrame:
    """visual/naturalness-anomaly: components, or files without any, of 50 tokens or more of which fewer than a fifth are distinct."""
    from textloom.operators.source_rules import UI

    ui = units.where(F.col("path").rlike(UI))
    parts = f["components"].where("size > 0").select("path", "line", "size")
    ranges = ui.join(parts, "path", "left").withColumn("part", F.when(F.col("line").isNull(), F.col("text")).otherwise(F.expr("array_join(slice(split(text, '\n', -1), line, size), '\n')")))
    t = F.regexp_extract_all(T.plain_code(F.col("part")), F.lit(r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?"), F.lit(0))
    few = ranges.withColumn("t", t).where((F.size("t") >= 50) & (5 * F.size(F.array_distinct("t")) < F.size("t")))
    return finding(few, "visual/naturalness-anomaly", F.coalesce("line", F.lit(1)))


def fact_findings(f: Facts, units: DataFrame, allowed_imports: list[str], spacing_scale: list[float], radius_scale: list[float]) -> DataFrame:
    """All findings of these rules. units are (path, text); rows with nulls there have none."""
    units = units.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    parts = [*components(f), *elements(f, units, spacing_scale, radius_scale), names(f, units), *bindings(f), *single_facts(f), aliases(f, allowed_imports), *rust(f, units), *documents(f, units), naturalness(f, units)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
