"""Column functions on texts: tokens, shingles, comments, measures of code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z_][a-z0-9_]+"
SIMPLE = r"[a-z0-9_]+"
COMMENT = r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)"
DECISION = r"\bif\b|\bfor\b|\bwhile\b|\bdo\b|\bcase\b|\bcatch\b|\?[^=]"
FUNCTION = r"\bfunction\b|\b=>\s*[{(]|\b\w+\s*\([^)]*\)\s*\{"


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased matches of the pattern, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(words: Column, k: int) -> Column:
    """Runs of k words joined by single spaces; fewer words are one shingle, none give none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def ascii_bounds(pattern: str) -> str:
    r"""pattern with \b between ASCII word characters and others, which Java takes for letters of any kind."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def plain_code(text: Column) -> Column:
    """text without comments and with empty strings."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    for quote in "'\"`":
        out = F.regexp_replace(out, rf"{quote}(?:\\.|[^{quote}\\])*{quote}", quote * 2)
    return out


def plain_code_sql(column: str) -> str:
    """plain_code() as SQL."""
    out = rf"regexp_replace(regexp_replace({column}, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')"
    for quote in ("''", '"', "`"):
        out = rf"regexp_replace({out}, '{quote}(?:\\.|[^{quote}\\])*{quote}', '{quote * 2}', 'g')"
    return out


def cyclomatic(text: Column) -> Column:
    """1, functions and decisions of the code; 1 for blank texts."""
    return let(plain_code(text), lambda c: F.when(F.trim(text) == "", F.lit(1)).otherwise(F.lit(1) + count(c, ascii_bounds(FUNCTION)) + count(c, ascii_bounds(DECISION))))


def line_of(text: Column, offset: Column) -> Column:
    """Line of a place in code points, from 1."""
    return F.lit(1) + F.length(F.substring(text, F.lit(1), offset)) - F.length(F.translate(F.substring(text, F.lit(1), offset), "\n", ""))


def identifier_hash(parts: Column, prefix: str = "") -> Column:
    """A short stable id of a set of names."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(parts)), "\n")), 1, 12))


def nearest_scale(value: Column, scale: list[float], tolerance: float) -> Column:
    """Whether a value is within the tolerance of a step of the scale."""
    return F.exists(F.array(*[F.lit(s) for s in scale]), lambda s: F.abs(s - value) < tolerance)


def circular_delta(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360))
    return F.least(d, 360 - d)


def running(values: Column) -> Column:
    """For each of an array of integers, the sum of those before it. It goes by blocks of about the root of their number, as an array that grows in a fold is
    copied each time."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, x: F.struct((s["at"] + x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: within(F.slice(v, k * width + 1, width)))
        done = let(blocks, lambda b: F.flatten(F.zip_with(b, within(F.transform(b, lambda x: x["at"]))["out"], lambda x, o: F.transform(x["out"], lambda y: y + o))))
        return F.when(F.size(v) > 0, done).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern from the left: the line where each starts, from 1, and its text."""

    def of(x: Column) -> Column:
        pieces = F.slice(x["pieces"], 1, F.size(x["found"]))
        before = running(F.zip_with(pieces, x["found"], lambda p, m: newlines(p) + newlines(m)))
        lines = F.zip_with(before, pieces, lambda n, p: n + newlines(p) + 1)
        rows = F.zip_with(lines, x["found"], lambda n, m: F.struct(n.alias("line"), m.alias("value")))
        return F.when(F.size(x["found"]) > 0, rows).otherwise(F.array().cast("array<struct<line:int,value:string>>"))

    return let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), of)


def mask_comments(text: Column, pattern: str = COMMENT) -> Column:
    """text without its comments, whose line breaks stay, so that lines keep their numbers."""

    def of(x: Column) -> Column:
        kept = F.zip_with(F.slice(x["pieces"], 1, F.size(x["found"])), x["found"], lambda p, m: F.concat(p, F.regexp_replace(m, "[^\n]", "")))
        return F.concat(F.array_join(kept, ""), F.element_at(x["pieces"], -1))

    some = let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), of)
    return F.when(text.rlike(pattern), some).otherwise(text)


def re_escape(text: str) -> str:
    """text as a pattern for itself."""
    return "".join("\\" + c if not c.isalnum() and c not in "_/@ " else c for c in text)


def imported_packages(text: Column) -> Column:
    """Packages that code imports, requires or loads, by the first part of their names (two for scoped ones); paths aren't packages."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"""\bfrom\s+['"]([^'"]+)['"]""", r"""\bimport\s*\(\s*['"]([^'"]+)['"]""", r"""\bimport\s+['"]([^'"]+)['"]""", r"""\brequire\s*\(\s*['"]([^'"]+)['"]""")])
    named = F.filter(found, lambda s: ~s.rlike(r"^[./~]|^@/"))
    return F.array_distinct(F.transform(named, lambda s: F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))))


def signatures(text: Column) -> Column:
    """Functions and arrow functions with their parameters' names."""
    found = matches(text, r"\bfunction\s+[A-Za-z_$][\w$]*\s*\([^)]*\)|\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>")
    params = lambda v: F.filter(F.transform(F.split(F.regexp_extract(v, r"\(([^)]*)\)", 1), ","), lambda p: F.regexp_extract(p, r"([A-Za-z_$][\w$]*)", 1)), lambda p: p != "")
    return F.transform(found, lambda m: F.struct(m["line"].alias("line"), F.regexp_extract(m["value"], r"(?:function|const|let|var)\s+([\w$]+)", 1).alias("name"), params(m["value"]).alias("params")))


def in_rem(value: Column) -> Column:
    """A CSS length in rem, 16 px each; null for other units."""
    number = F.regexp_extract(F.trim(value), r"^(-?\d+(?:\.\d+)?)(?:px|rem|em)$", 1)
    return F.when(number != "", number.cast("double") / F.when(F.trim(value).endswith("px"), 16).otherwise(1))


def canonical_style(text: Column) -> Column:
    """A style without comments, with its tokens sorted and single spaces."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(plain), r"\s+"), lambda x: x != "")), " ")


def code_spans(text: Column) -> Column:
    """Inline code of Markdown outside of fences, with its lines."""
    bare = mask_comments(text, r"(?ms)^```.*?^```[^\n]*$|<!--.*?-->")
    return transform_spans(matches(bare, r"`[^`\n]+`"))


def transform_spans(found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["line"].alias("line"), F.regexp_replace(m["value"], "`", "").alias("text")))


def admission_tokens(text: Column) -> Column:
    """Tokens of code with strings and numbers as their kinds, case kept."""
    found = F.regexp_extract_all(strip_comments(text), F.lit(r'''"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\d+(?:\.\d+)?|[A-Za-z_$][\w$]*|\S'''), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike(r"""^["'`].+"""), "<str>").when(t.rlike(r"^\d"), "<num>").otherwise(t))
