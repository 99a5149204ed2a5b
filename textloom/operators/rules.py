"""Findings on documents: statistical rules, from one pass over the documents, and the secret rule; and rules on pages.

Rules on source code are in source_rules and fact_rules; what all rules are is in the catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import text_stats
from textloom.operators.catalog import catalog
from textloom.operators.profile import profile
from textloom.operators.source_rules import RULES, source_findings
from textloom.plans.components import kept
from textloom.sources.tables import table, units


@dataclass(frozen=True)
class Pattern:
    rule_id: str
    category: str
    severity: str
    ai_specific: bool
    pattern: str
    extensions: str = ""
    least: int = 1
    unless: str = ""
    skip_comments: bool = True


#: Predicates as patterns.
SECRET = Pattern("security/hardcoded-secret", "security", "high", True, r"\b(?:sk-[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})|(?i:\b(?:password|secret|token|api_?key)\b)\s*[:=]\s*['\"][^'\"\s]{16,}['\"]")
PAGE_RULES = (
    Pattern("wcag/missing-alt", "wcag", "medium", False, r"(?i)<img\b(?![^>]*\balt\s*=)(?![^>]*\brole\s*=\s*['\"]?(?:presentation|none))[^>]*>", "tsx|jsx|vue|svelte|html"),
    Pattern("security/target-blank-no-noopener", "security", "medium", False, r"(?i)<a\b(?=[^>]*\btarget\s*=\s*['\"]?_blank)(?![^>]*\brel\s*=\s*['\"][^'\"]*no(?:opener|referrer))[^>]*>", "tsx|jsx|vue|svelte|html"),
)
#: (rule, category, severity, AI-specific) of the statistical rules.
STATISTICAL = (
    ("ai/renyi-profile", "ai", "medium", True),
    ("ai/whitespace-regularity", "ai", "medium", True),
    ("ai/text-like-ratio", "ai", "low", True),
    ("ai/errors-near-eof", "ai", "medium", True),
    ("ai/compression-profile", "ai", "low", True),
    ("logic/zipf-slope-anomaly", "logic", "medium", False),
    ("logic/heaps-deviation", "logic", "medium", False),
)
FINDING = "doc_id long, rule_id string, category string, severity string, ai_specific boolean, n long, line int"


def pattern_findings(given: DataFrame, rules: tuple[Pattern, ...] = (SECRET,), extension_col: str | None = None) -> DataFrame:
    """Findings of the pattern rules on (doc_id, text and an extension, if the units have one; rules for extensions don't fire without)."""
    extension = F.lower(F.col(extension_col)) if extension_col else F.lit("")
    rows = given.where(F.col("text").isNotNull()).select("doc_id", "text", extension.alias("ext"), T.strip_comments(F.col("text")).alias("plain"), T.mask_comments(F.col("text")).alias("masked"))
    made = []
    for p in rules:
        text = F.col("plain") if p.skip_comments else F.col("text")
        n = T.count(text, p.pattern)
        fits = F.lit(True) if not p.extensions else F.col("ext").isin(p.extensions.split("|"))
        if p.unless:
            fits = fits & ~F.col("text").rlike(p.unless)
        line = T.line_of(F.col("masked") if p.skip_comments else F.col("text"), F.regexp_instr(F.col("masked") if p.skip_comments else F.col("text"), F.lit(p.pattern)) - 1).cast("int")
        found = F.struct(*[F.lit(v).alias(k) for k, v in (("rule_id", p.rule_id), ("category", p.category), ("severity", p.severity), ("ai_specific", p.ai_specific))], n.cast("long").alias("n"), line.alias("line"))
        made.append(F.when(fits & text.rlike(p.pattern) & (n >= p.least), found))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("doc_id", "f.*")


#: What tells that a statistical rule fires, in a profile.
FIRES = {
    "ai/renyi-profile": "signature", "ai/whitespace-regularity": "regular", "ai/text-like-ratio": "text_like", "ai/errors-near-eof": "unbalanced", "ai/compression-profile": "compressible",
    "logic/zipf-slope-anomaly": "anomaly", "logic/heaps-deviation": "odd_growth",
}


def statistical_findings(docs: DataFrame, squeeze: bool = False) -> DataFrame:
    """Findings of the statistical rules on (doc_id, text), from one pass; those on compression only if asked for."""
    p = profile(docs, "tokens", "spaces", "lines", *(["squeeze"] if squeeze else []))
    for add in (text_stats.with_renyi, text_stats.with_zipf, text_stats.with_heaps, text_stats.with_regularity, text_stats.with_text_like, text_stats.with_balance, *([text_stats.with_compression] if squeeze else [])):
        p = add(p)
    made = []
    for rule_id, category, severity, ai in STATISTICAL:
        if squeeze or rule_id != "ai/compression-profile":
            line = F.floor(F.col("n_lines") * 0.8).cast("int") + 1 if rule_id == "ai/errors-near-eof" else F.lit(1)
            found = F.struct(*[F.lit(v).alias(k) for k, v in (("rule_id", rule_id), ("category", category), ("severity", severity), ("ai_specific", ai))], F.lit(1).cast("long").alias("n"), line.alias("line"))
            made.append(F.when(F.coalesce(F.col(FIRES[rule_id]), F.lit(False)), found))
    return p.select("doc_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("doc_id", "f.*")


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings on documents that SQL can express too: without ai/compression-profile, as SQL has no deflate, and rules on code that any text can break; all_findings has these."""
    docs = units(spark, folder)
    return statistical_findings(docs).unionByName(pattern_findings(docs, (SECRET,)))


def kept_findings(spark: SparkSession, folder: str) -> DataFrame:
    """findings, made once and kept, for queries that read them several times."""
    return kept(findings(spark, folder))


def all_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings on documents: statistical rules, secrets, and the source rules that hold for any path. A document's path is its number."""
    docs = units(spark, folder)
    found = source_findings(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), tuple(r for r in RULES if not r.paths))
    found = found.join(F.broadcast(catalog(spark)), "rule_id").groupBy(F.col("path").cast("long").alias("doc_id"), "rule_id", "category", "severity", "ai_specific").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return statistical_findings(docs, True).unionByName(pattern_findings(docs, (SECRET,))).unionByName(found)


def _fired_sql() -> str:
    s = {k: v for k, v in text_stats.ORACLES.items()}
    parts = [
        ("ai/renyi-profile", "ai", "medium", True, s["renyi_profile"], "signature"), ("ai/whitespace-regularity", "ai", "medium", True, s["whitespace_regularity"], "regular"),
        ("ai/text-like-ratio", "ai", "low", True, s["text_like_ratio"], "text_like"), ("ai/errors-near-eof", "ai", "medium", True, s["delimiter_balance"], "fires"),
        ("logic/zipf-slope-anomaly", "logic", "medium", False, s["zipf_fit"], "anomaly"), ("logic/heaps-deviation", "logic", "medium", False, s["heaps_fit"], "anomaly"),
    ]
    line = {"ai/errors-near-eof": "(floor(n_lines * 0.8) + 1)::INT"}
    selects = [f"SELECT doc_id, '{r}' AS rule_id, '{c}' AS category, '{v}' AS severity, {str(a).lower()} AS ai_specific, 1::BIGINT AS n, {line.get(r, '1')} AS line FROM ({q}) WHERE {f}" for r, c, v, a, q, f in parts]
    pattern = SECRET.pattern.replace("'", "''")
    plain = r"regexp_replace(text, '(?s)//[^\n]*|/\*.*?(?:\*/|\z)', '', 'g')"
    selects.append(
        f"SELECT doc_id, 'security/hardcoded-secret', 'security', 'high', true, len(regexp_extract_all({plain}, '{pattern}'))::BIGINT, "
        f"(1 + length(x) - length(replace(x, chr(10), '')))::INT FROM (SELECT *, substr(text, 1, strpos(text, regexp_extract({plain}, '{pattern}')) - 1) AS x FROM documents) WHERE regexp_matches({plain}, '{pattern}')"
    )
    return " UNION ALL ".join(selects)


FINDINGS_SQL = _fired_sql()


def markup_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts on pages: anchors, images without alternative texts, links that open windows unsafely, and the commonest class's share."""
    pages = table(spark, folder, "pages").where(F.col("html").isNotNull())
    by = {p.rule_id: p for p in PAGE_RULES}
    classes = F.flatten(F.transform(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1)), lambda c: F.split(c, " ")))
    return pages.select(
        "page_id", T.count(F.col("html"), r"<a\b").alias("anchors"), T.count(F.col("html"), by["wcag/missing-alt"].pattern).alias("missing_alt"),
        T.count(F.col("html"), by["security/target-blank-no-noopener"].pattern).alias("unsafe_blank"), F.size(classes).alias("classes"), F.size(F.array_distinct(classes)).alias("distinct_classes"),
    )


MARKUP_SQL = r"""WITH p AS (SELECT page_id, html, flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda c: string_split(c, ' '))) AS c FROM pages)
SELECT page_id, len(regexp_extract_all(html, '<a\b'))::INT AS anchors, len(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*>'), lambda t: NOT regexp_matches(t, '(?i)\balt\s*=') AND NOT regexp_matches(t, '(?i)\brole\s*=\s*[''"]?(?:presentation|none)')))::INT AS missing_alt,
len(list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\btarget\s*=\s*[''"]?_blank') AND NOT regexp_matches(t, '(?i)\brel\s*=\s*[''"][^''"]*no(?:opener|referrer)')))::INT AS unsafe_blank, len(c)::INT AS classes, len(list_distinct(c))::INT AS distinct_classes FROM p"""

QUERIES = {"findings": findings, "all_findings": all_findings, "markup_rules": markup_rules}
ORACLES = {"findings": FINDINGS_SQL, "markup_rules": MARKUP_SQL}
