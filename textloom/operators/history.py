"""History analytics on an event table, which stands for a history of scans and outcomes."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.tables import table


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def event_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Daily means by type and their change from the day before."""
    d = events(spark, folder).groupBy("event_type", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    w = Window.partitionBy("event_type").orderBy("day")
    return d.withColumn("delta", F.round(F.col("mean") - F.lag("mean").over(w), 8))


TREND_SQL = """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2)
SELECT *, round(mean - lag(mean) OVER (PARTITION BY event_type ORDER BY day), 8) AS delta FROM d"""


def event_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """For each user, the days in a row up to the last day of the table on which they have events; from 3 on a bump, from 5 on a relaxation."""
    days = events(spark, folder).select("user_id", "day").distinct()
    last = days.agg(F.max("day").alias("last"))
    g = days.crossJoin(F.broadcast(last)).withColumn("back", F.datediff(F.col("last").cast("date"), F.col("day").cast("date")))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("back")) - 1)
    s = g.groupBy("user_id").agg(F.sum((F.col("back") == F.col("rank")).cast("long")).alias("streak"))
    return s.withColumn("action", F.when(F.col("streak") >= 5, "relax").when(F.col("streak") >= 3, "bump").otherwise("none"))


STREAKS_SQL = """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT user_id, datediff('day', day, (SELECT max(day) FROM d)) AS back FROM d),
r AS (SELECT user_id, back, row_number() OVER (PARTITION BY user_id ORDER BY back) - 1 AS k FROM g), s AS (SELECT user_id, count(*) FILTER (WHERE back = k) AS streak FROM r GROUP BY 1)
SELECT *, CASE WHEN streak >= 5 THEN 'relax' WHEN streak >= 3 THEN 'bump' ELSE 'none' END AS action FROM s"""

BASELINE = "2024-01-15"


def event_asof_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """For each user, the first event at or after the baseline's day and the last one: the drift between them."""
    e = table(spark, folder, "events").where(F.col("ts") >= F.lit(BASELINE).cast("timestamp"))
    key = F.struct("ts", "event_id")
    g = e.groupBy("user_id").agg(F.min_by("value", key).alias("base"), F.max_by("value", key).alias("current"), F.min("ts").cast("date").cast("string").alias("since"))
    return g.select("user_id", "since", F.round("base", 6).alias("base"), F.round("current", 6).alias("current"), F.round(F.col("current") - F.col("base"), 5).alias("drift"))


ASOF_SQL = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events WHERE ts >= TIMESTAMP '{BASELINE}')
SELECT user_id, max(CASE WHEN a = 1 THEN ts::DATE::VARCHAR END) AS since, round(max(CASE WHEN a = 1 THEN value END), 6) AS base, round(max(CASE WHEN z = 1 THEN value END), 6) AS current,
round(max(CASE WHEN z = 1 THEN value END) - max(CASE WHEN a = 1 THEN value END), 5) AS drift FROM e GROUP BY 1"""


def event_set_diff(spark: SparkSession, folder: str) -> DataFrame:
    """(user, type) pairs that came up, stayed or went between the two halves of the table."""
    e = events(spark, folder).select("user_id", "event_type", (F.col("day") >= BASELINE).alias("late"))
    g = e.groupBy("user_id", "event_type").agg(F.max((~F.col("late")).cast("int")).alias("early"), F.max(F.col("late").cast("int")).alias("late"))
    return g.select("user_id", "event_type", F.when(F.col("early") == 0, "introduced").when(F.col("late") == 0, "removed").otherwise("unchanged").alias("status"))


DIFF_SQL = f"""SELECT user_id, event_type, CASE WHEN min(ts) >= TIMESTAMP '{BASELINE}' THEN 'introduced' WHEN max(ts) < TIMESTAMP '{BASELINE}' THEN 'removed' ELSE 'unchanged' END AS status FROM events GROUP BY 1, 2"""


def event_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Six-hour windows (an extension: the reference has no event-time windows)."""
    g = table(spark, folder, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


TUMBLING_SQL = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def event_session(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user, ended by six hours without events (an extension)."""
    g = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


SESSION_SQL = """WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s"""


def changepoints(x: np.ndarray, hazard: float = 0.01, warm_up: int = 5) -> list[int]:
    """Places where a run begins anew by online Bayesian inference: normal data, unknown mean and variance, a constant hazard."""
    if len(x) < 2:
        return []
    beta0 = max(float(np.var(x)), 1e-9)
    mean, kappa, alpha, beta = np.array([x.mean()]), np.array([1.0]), np.array([2.0]), np.array([beta0])
    run, found, before = np.array([1.0]), [], 0
    from math import lgamma

    for t, value in enumerate(x):
        scale = beta * (kappa + 1) / (alpha * kappa)
        df = 2 * alpha
        const = np.array([lgamma((d + 1) / 2) - lgamma(d / 2) for d in df])
        density = np.exp(const - 0.5 * np.log(df * np.pi * scale) - (df + 1) / 2 * np.log1p((value - mean) ** 2 / (df * scale)))
        grown = run * density * (1 - hazard)
        run = np.append((run * density * hazard).sum(), grown)
        run /= run.sum()
        beta = np.append(beta0, beta + kappa * (value - mean) ** 2 / (2 * (kappa + 1)))
        mean = np.append(x.mean(), (kappa * mean + value) / (kappa + 1))
        kappa, alpha = np.append(1.0, kappa + 1), np.append(2.0, alpha + 0.5)
        best = int(run.argmax())
        if t >= warm_up and (run[0] > 0.5 or best < before * 0.5):
            found.append(t - best + 1 if best else t)
        before = best
    return sorted(set(found))


def event_changepoints(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a type's daily means change. A group is a type's days, whose number doesn't grow with the events of a day."""
    d = events(spark, folder).groupBy("event_type", "day").agg(F.avg("value").alias("mean"))

    def find(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day")
        at = [k for k in changepoints(g["mean"].to_numpy()) if k < len(g)]
        return pd.DataFrame({"event_type": g["event_type"].iloc[at], "day": g["day"].iloc[at]})

    return d.groupBy("event_type").applyInPandas(find, "event_type string, day string")


def _ks(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    if not len(a) or not len(b):
        return 1.0, 1.0
    every = np.concatenate([a, b])
    gap = np.abs(np.searchsorted(np.sort(a), every, side="right") / len(a) - np.searchsorted(np.sort(b), every, side="right") / len(b)).max()
    lam = gap * (len(a) * len(b) / (len(a) + len(b))) ** 0.5
    p = 0.0 if lam > 3.6 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 101)))) if lam > 0 else 1.0
    return float(gap), float(p)


def ks_two_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of good and bad documents' lengths, over pooled cumulative counts."""
    labels = table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    d = table(spark, folder, "documents").where("n_chars IS NOT NULL").join(labels, "doc_id")
    v = d.groupBy("n_chars").agg(F.sum((F.col("quality") == 1).cast("long")).alias("a"), F.sum((F.col("quality") == 0).cast("long")).alias("b"))
    w = Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct length, not for each document
    totals = v.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = v.withColumn("ca", F.sum("a").over(w)).withColumn("cb", F.sum("b").over(w)).crossJoin(F.broadcast(totals))
    return c.agg(F.max("na").alias("n_good"), F.max("nb").alias("n_bad"), F.round(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))), 6).alias("ks"))


KS_SQL = """WITH v AS (SELECT n_chars, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1),
c AS (SELECT sum(a) OVER (ORDER BY n_chars) AS ca, sum(b) OVER (ORDER BY n_chars) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v)
SELECT max(na)::BIGINT AS n_good, max(nb)::BIGINT AS n_bad, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM c"""

QUERIES = {
    "event_trend": event_trend, "event_streaks": event_streaks, "event_asof_baseline": event_asof_baseline, "event_set_diff": event_set_diff,
    "event_tumbling": event_tumbling, "event_session": event_session, "event_changepoints": event_changepoints, "ks_two_sample": ks_two_sample,
}
ORACLES = {
    "event_trend": TREND_SQL, "event_streaks": STREAKS_SQL, "event_asof_baseline": ASOF_SQL, "event_set_diff": DIFF_SQL,
    "event_tumbling": TUMBLING_SQL, "event_session": SESSION_SQL, "ks_two_sample": KS_SQL,
}
