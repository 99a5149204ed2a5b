"""Distribution statistics of each document's tokens and lines, and of groups of documents.

What tells of one document comes from profile(), in one pass without a shuffle; the SQL beside each query says the same in relational terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.profile import profile
from textloom.sources.tables import table, units

TOKENS_SQL = r"t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')) AS token FROM documents)"
COUNTS_SQL = TOKENS_SQL + ", c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2)"


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def tokens_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    c = profile(units(spark, folder), "tokens").where("n_tokens > 0")
    return c.select("doc_id", "n_tokens", "n_types", F.round(F.col("n_types") / F.col("n_tokens"), 6).alias("type_token_ratio"))


TOKENS_PER_DOC_SQL = f"WITH {COUNTS_SQL} SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*) AS n_types, round(count(*) / sum(n), 6) AS type_token_ratio FROM c GROUP BY doc_id"


def with_renyi(p: DataFrame) -> DataFrame:
    """Adds ratios of the entropies and whether they lie near one another to a profile's tokens."""
    some = F.col("h1") > 1e-12
    p = p.withColumn("r2", F.when(some, F.col("h2") / F.col("h1")).otherwise(F.lit(0.0))).withColumn("rinf", F.when(some, F.col("hinf") / F.col("h1")).otherwise(F.lit(0.0)))
    return p.withColumn("signature", (F.col("n_tokens") >= 50) & (F.col("r2") > 0.85) & (F.col("rinf") > 0.95))


def renyi_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Entropies of order 1, 2, infinity and one half of each document's tokens, and whether they lie near one another."""
    h = with_renyi(profile(units(spark, folder), "tokens").where("n_tokens > 0"))
    return h.select("doc_id", "n_tokens", *[(F.round(k, 6) + 0.0).alias(k) for k in ("h1", "h2", "hinf", "h_half", "r2", "rinf")], "signature")


RENYI_SQL = f"""WITH {COUNTS_SQL}, p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
h AS (SELECT doc_id, max(total)::BIGINT AS n_tokens, -sum(p * log2(p)) AS h1, -log2(sum(p * p)) AS h2, -log2(max(p)) AS hinf, 2 * log2(sum(sqrt(p))) AS h_half FROM p GROUP BY 1),
r AS (SELECT *, CASE WHEN h1 > 1e-12 THEN h2 / h1 ELSE 0 END AS r2, CASE WHEN h1 > 1e-12 THEN hinf / h1 ELSE 0 END AS rinf FROM h)
SELECT doc_id, n_tokens, round(h1, 6) + 0.0 AS h1, round(h2, 6) + 0.0 AS h2, round(hinf, 6) + 0.0 AS hinf, round(h_half, 6) + 0.0 AS h_half, round(r2, 6) + 0.0 AS r2, round(rinf, 6) + 0.0 AS rinf,
       n_tokens >= 50 AND r2 > 0.85 AND rinf > 0.95 AS signature FROM r"""


def with_zipf(p: DataFrame) -> DataFrame:
    some = (F.col("n_types") >= 2) & ~F.col("flat")
    p = p.withColumn("exponent", F.when(some, -F.col("zipf")).otherwise(F.lit(0.0))).withColumn("r2", F.when(some, F.col("fit")).otherwise(F.lit(0.0)))
    return p.withColumn("anomaly", (F.col("n_tokens") >= 50) & (F.col("n_types") >= 10) & (F.col("r2") >= 0.7) & (F.abs((F.col("exponent") - 1.0) / 0.25) >= 2))


def zipf_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares of log frequency on log rank; all zero for fewer than two types or equal frequencies."""
    f = with_zipf(profile(units(spark, folder), "tokens").where("n_tokens > 0"))
    return f.select("doc_id", "n_tokens", "n_types", (F.round("exponent", 6) + 0.0).alias("exponent"), (F.round("r2", 6) + 0.0).alias("r2"), "anomaly")


ZIPF_SQL = f"""WITH {COUNTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c),
f AS (SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*) AS n_types, regr_slope(ln(n), ln(rank)) AS s, corr(ln(n), ln(rank)) AS r, max(n) = min(n) AS flat FROM r GROUP BY 1),
g AS (SELECT *, CASE WHEN n_types >= 2 AND NOT flat THEN -s ELSE 0 END AS e, CASE WHEN n_types >= 2 AND NOT flat THEN r * r ELSE 0 END AS q FROM f)
SELECT doc_id, n_tokens, n_types, round(e, 6) + 0.0 AS exponent, round(q, 6) + 0.0 AS r2, n_tokens >= 50 AND n_types >= 10 AND q >= 0.7 AND abs((e - 1.0) / 0.25) >= 2 AS anomaly FROM g"""


def with_heaps(p: DataFrame) -> DataFrame:
    return p.withColumn("odd_growth", (F.col("n_tokens") >= 50) & (F.col("heaps") != 0) & (F.abs((F.col("heaps") - 0.5) / 0.15) >= 2))


def heaps_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Growth of the vocabulary: least squares of log types on log tokens at 5 to 20 even places; 0 for fewer than ten tokens."""
    f = with_heaps(profile(units(spark, folder), "tokens").where("n_tokens > 0"))
    return f.select("doc_id", "n_tokens", (F.round("heaps", 6) + 0.0).alias("exponent"), F.col("odd_growth").alias("anomaly"))


HEAPS_SQL = r"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS token, unnest(generate_series(1, len(w))) AS pos, len(w) AS n FROM a),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) = 1 THEN 1 ELSE 0 END AS first FROM t),
v AS (SELECT doc_id, n, pos, sum(first) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM f),
s AS (SELECT DISTINCT doc_id, n, (i * n) // m AS pos FROM (SELECT doc_id, n, m, unnest(generate_series(1, m)) AS i
      FROM (SELECT doc_id, len(w) AS n, least(20, greatest(5, floor(log2(len(w)))))::BIGINT AS m FROM a WHERE len(w) > 0))),
g AS (SELECT s.doc_id, max(s.n) AS n_tokens, regr_slope(ln(v), ln(pos)) AS s FROM s LEFT JOIN v USING (doc_id, pos) GROUP BY 1),
e AS (SELECT doc_id, n_tokens, CASE WHEN n_tokens >= 10 THEN coalesce(s, 0) ELSE 0 END AS e FROM g)
SELECT doc_id, n_tokens, round(e, 6) + 0.0 AS exponent, n_tokens >= 50 AND e <> 0 AND abs((e - 0.5) / 0.15) >= 2 AS anomaly FROM e"""


def with_regularity(p: DataFrame) -> DataFrame:
    return p.withColumn("regular", (F.col("n_runs") >= 50) & (F.col("cv") < 0.5) & (F.col("entropy") < 0.8))


def whitespace_regularity(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of runs of spaces: variation and entropy; regular runs are a sign of generated text."""
    g = with_regularity(profile(units(spark, folder), "spaces").where("n_runs > 0"))
    return g.select("doc_id", "n_runs", (F.round("cv", 5) + 0.0).alias("cv"), (F.round("entropy", 6) + 0.0).alias("entropy"), "shortest", "longest", "regular")


WHITESPACE_SQL = """WITH r AS (SELECT doc_id, length(unnest(regexp_extract_all(text, ' +'))) AS len FROM documents), c AS (SELECT doc_id, len, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
g AS (SELECT doc_id, max(total)::BIGINT AS n_runs, sum(n * len) / max(total) AS mean, sum(n * len * len) AS sq, -sum(n / total * log2(n / total)) AS h, min(len)::INT AS shortest, max(len)::INT AS longest FROM t GROUP BY 1),
v AS (SELECT *, sqrt(greatest(0.0, sq / n_runs - mean * mean)) / mean AS cv FROM g)
SELECT doc_id, n_runs, round(cv, 5) + 0.0 AS cv, round(h, 6) + 0.0 AS entropy, shortest, longest, n_runs >= 50 AND cv < 0.5 AND h < 0.8 AS regular FROM v"""

def with_text_like(p: DataFrame) -> DataFrame:
    return p.withColumn("text_like", (F.col("n_lines") >= 10) & (F.col("n_counted") > 0) & (10 * F.col("n_prose") >= 3 * F.col("n_counted")))


def text_like_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Share of lines like prose among those that aren't blank, comments or with an odd number of quotes, of documents with ten lines or more."""
    g = with_text_like(profile(units(spark, folder), "lines").where("n_lines >= 10 AND n_counted > 0"))
    return g.select("doc_id", F.col("n_counted").alias("n_lines"), "n_prose", F.round(F.col("n_prose") / F.col("n_counted"), 6).alias("ratio"), "text_like")


TEXT_LIKE_SQL = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), l AS (SELECT doc_id, trim(unnest(l), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM d WHERE len(l) >= 10),
c AS (SELECT doc_id, length(line) >= 40 AND NOT regexp_matches(line, '[{}()\[\];=<>]|=>|->') AND length(line) - length(replace(line, ' ', '')) >= 2 AND regexp_matches(line, '^[A-Z][^A-Z\n]{20,}(\.|;|:)$') AS prose
      FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(//|#|/\*|\*|--)') AND len(regexp_extract_all(line, '[''"`]')) % 2 = 0),
g AS (SELECT doc_id, count(*) AS n_lines, sum(prose::INT)::BIGINT AS n_prose FROM c GROUP BY 1)
SELECT doc_id, n_lines, n_prose, round(n_prose / n_lines, 6) AS ratio, 10 * n_prose >= 3 * n_lines AS text_like FROM g"""


def with_balance(p: DataFrame) -> DataFrame:
    fires = (F.col("n_lines") >= 20) & (F.col("tail") >= 3) & (10 * F.col("tail") >= F.col("tail_all")) & ~((F.col("tail") <= 2 * F.col("whole")) & (F.col("whole") >= 3))
    return p.withColumn("unbalanced", fires)


def delimiter_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Brackets without a partner in all lines and in the last fifth, and how many stand there, of documents with twenty lines or more."""
    d = with_balance(profile(units(spark, folder), "lines").where("n_lines >= 20"))
    return d.select("doc_id", "n_lines", "whole", "tail", "tail_all", F.col("unbalanced").alias("fires"))


DELIMITER_SQL = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, text, len(l) AS n, array_to_string(l[floor(len(l) * 0.8)::BIGINT + 1 :], chr(10)) AS tail FROM d WHERE len(l) >= 20),
k AS (SELECT doc_id, n, len(regexp_extract_all(text, '[{(\[<]')) AS wo, len(regexp_extract_all(text, '[})\]>]')) AS wc, len(regexp_extract_all(tail, '[{(\[<]')) AS o, len(regexp_extract_all(tail, '[})\]>]')) AS c FROM e),
o AS (SELECT doc_id, n::INT AS n_lines, abs(wo - wc)::INT AS whole, abs(o - c)::INT AS tail, (o + c)::INT AS tail_all FROM k)
SELECT *, tail >= 3 AND 10 * tail >= tail_all AND NOT (tail <= 2 * whole AND whole >= 3) AS fires FROM o"""


def kl_novelty(by: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Divergence of each group's tokens from the corpus's, in nats; documents without a group are one."""
        c = units(spark, folder).select(by, F.explode(T.tokens(F.col("text"))).alias("token")).groupBy(by, "token").agg(F.count("*").alias("n"))
        whole = c.groupBy("token").agg(F.sum("n").alias("q"))
        totals = c.groupBy(F.col(by).alias("__group")).agg(F.sum("n").alias("total"))
        every = c.agg(F.sum("n").alias("every"))  # one row
        j = c.join(whole, "token").join(totals, F.col(by).eqNullSafe(F.col("__group"))).crossJoin(F.broadcast(every))
        p, q = F.col("n") / F.col("total"), F.col("q") / F.col("every")
        return j.groupBy(by).agg(F.max("total").alias("n_tokens"), F.round(F.sum(p * F.ln(p / q)), 6).alias("kl"))

    return query


#: Share of a token that a corpus lacks.
MISSING = 1e-12


def kl_novelty_vs_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of each source's tokens from those of the benchmark, where a token that this lacks has a share of MISSING."""
    c = units(spark, folder).select("source", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    other = table(spark, folder, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("q"))
    totals = c.groupBy(F.col("source").alias("__group")).agg(F.sum("n").alias("total"))
    j = c.join(other, "token", "left").join(totals, F.col("source").eqNullSafe(F.col("__group"))).crossJoin(F.broadcast(other.agg(F.sum("q").alias("every"))))
    p, q = F.col("n") / F.col("total"), F.coalesce(F.col("q") / F.col("every"), F.lit(MISSING))
    return j.groupBy("source").agg(F.max("total").alias("n_tokens"), F.round(F.sum(p * F.ln(p / q)), 6).alias("kl"))


KL_BENCHMARK_SQL = f"""WITH {TOKENS_SQL}, c AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT token, count(*) AS q FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')) AS token FROM benchmark) GROUP BY 1),
x AS (SELECT source, n, sum(n) OVER (PARTITION BY source) AS total, coalesce(q / (SELECT sum(q) FROM b), 1e-12) AS q FROM c LEFT JOIN b USING (token))
SELECT source, max(total)::BIGINT AS n_tokens, round(sum(n / total * ln(n / total / q)), 6) AS kl FROM x GROUP BY 1"""


def kl_sql(by: str) -> str:
    return f"""WITH {TOKENS_SQL}, c AS (SELECT {by}, token, count(*) AS n FROM t GROUP BY 1, 2),
x AS (SELECT {by}, n, sum(n) OVER (PARTITION BY {by}) AS total, sum(n) OVER (PARTITION BY token) AS q, sum(n) OVER () AS every FROM c)
SELECT {by}, max(total)::BIGINT AS n_tokens, round(sum(n / total * ln((n / total) / (q / every))), 6) AS kl FROM x GROUP BY 1"""


#: Tokens that the ranks of a corpus hold; others count as the next.
RANKED = 10_000


def log_rank_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of each document's tokens among the corpus's 10, 100 and 1,000 most common ones and beyond, and the mean binary logarithm of rank + 1."""
    c = token_counts(units(spark, folder))
    top = c.groupBy("token").agg(F.sum("n").alias("q")).orderBy(F.desc("q"), "token").limit(RANKED)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("q"), "token"))).select("token", "rank")  # RANKED rows
    j = c.join(F.broadcast(top), "token", "left")

    def share(low: int, high: int):
        return F.sum(F.when(F.col("rank").between(low, high), F.col("n")).otherwise(0)) / F.sum("n")

    beyond = F.sum(F.when(F.col("rank") <= 1000, 0).otherwise(F.col("n"))) / F.sum("n")
    mean = F.sum(F.col("n") * F.log2(F.coalesce("rank", F.lit(RANKED)) + 1)) / F.sum("n")
    g = j.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), share(1, 10).alias("top10"), share(11, 100).alias("top100"), share(101, 1000).alias("top1000"), beyond.alias("beyond"), mean.alias("mean_log_rank"))
    return g.select("doc_id", "n_tokens", *[F.round(k, 6).alias(k) for k in ("top10", "top100", "top1000", "beyond", "mean_log_rank")])


LOG_RANK_SQL = f"""WITH {COUNTS_SQL}, q AS (SELECT token, row_number() OVER (ORDER BY sum(n) DESC, token) AS rank FROM c GROUP BY token)
SELECT doc_id, sum(n)::BIGINT AS n_tokens, round(sum(CASE WHEN rank <= 10 THEN n ELSE 0 END) / sum(n), 6) AS top10, round(sum(CASE WHEN rank BETWEEN 11 AND 100 THEN n ELSE 0 END) / sum(n), 6) AS top100,
       round(sum(CASE WHEN rank BETWEEN 101 AND 1000 THEN n ELSE 0 END) / sum(n), 6) AS top1000, round(sum(CASE WHEN rank > 1000 THEN n ELSE 0 END) / sum(n), 6) AS beyond,
       round(sum(n * log2(least(rank, 10000) + 1)) / sum(n), 6) AS mean_log_rank FROM c JOIN q USING (token) GROUP BY doc_id"""


def code_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Cyclomatic complexity by patterns, lines with text, comment share of characters."""
    d = units(spark, folder)
    plain = T.strip_comments(F.col("text"))
    filled = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
    return d.select("doc_id", T.cyclomatic(F.col("text")).alias("cyclomatic"), filled.alias("n_lines"), F.length(plain).alias("n_code_chars"), F.round(1 - F.length(plain) / F.length("text"), 6).alias("comment_share"))


CODE_SQL = rf"""WITH d AS (SELECT doc_id, text, {T.plain_code_sql("text")} AS c FROM documents)
SELECT doc_id, (CASE WHEN trim(text) = '' THEN 1 ELSE 1 + len(regexp_extract_all(c, '{T.FUNCTION}')) + len(regexp_extract_all(c, '{T.DECISION}')) END)::INT AS cyclomatic,
len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n_lines, length(regexp_replace(text, '(?s)//[^\n]*|/\*.*?(?:\*/|\z)', '', 'g'))::INT AS n_code_chars,
round(1 - length(regexp_replace(text, '(?s)//[^\n]*|/\*.*?(?:\*/|\z)', '', 'g')) / length(text), 6) AS comment_share FROM d"""


def with_compression(p: DataFrame) -> DataFrame:
    signs = (F.col("savings") > 0.6).cast("int") + F.col("ncd_mean").between(1e-12, 0.25).cast("int") + F.col("ncd_cv").between(1e-12, 0.4).cast("int")
    return p.withColumn("compressible", (F.col("n_bytes") >= 2000) & (signs >= 2))


def compression_profile(spark: SparkSession, folder: str) -> DataFrame:
    """What deflate saves of each document, and normalised compression distances of neighbouring lines."""
    got = with_compression(profile(units(spark, folder), "squeeze"))
    return got.select("doc_id", "n_bytes", "savings", "ncd_mean", "ncd_cv", F.col("compressible").alias("fires"))


QUERIES = {
    "tokens_per_doc": tokens_per_doc, "renyi_profile": renyi_profile, "zipf_fit": zipf_fit, "heaps_fit": heaps_fit, "whitespace_regularity": whitespace_regularity,
    "text_like_ratio": text_like_ratio, "delimiter_balance": delimiter_balance, "kl_novelty_by_lang": kl_novelty("lang"), "kl_novelty_by_source": kl_novelty("source"),
    "kl_novelty_vs_benchmark": kl_novelty_vs_benchmark, "log_rank_histogram": log_rank_histogram, "code_measures": code_measures, "compression_profile": compression_profile,
}
ORACLES = {
    "tokens_per_doc": TOKENS_PER_DOC_SQL, "renyi_profile": RENYI_SQL, "zipf_fit": ZIPF_SQL, "heaps_fit": HEAPS_SQL, "whitespace_regularity": WHITESPACE_SQL,
    "text_like_ratio": TEXT_LIKE_SQL, "delimiter_balance": DELIMITER_SQL, "kl_novelty_by_lang": kl_sql("lang"), "kl_novelty_by_source": kl_sql("source"),
    "kl_novelty_vs_benchmark": KL_BENCHMARK_SQL, "log_rank_histogram": LOG_RANK_SQL, "code_measures": CODE_SQL,
}
