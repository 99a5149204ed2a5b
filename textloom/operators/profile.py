"""All statistics of a document in one pass: a row in, a row out, without a shuffle.

A document's tokens never leave the task that reads it. Memory and time go with the length of the longest text, whose tokens one worker holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z_][a-z0-9_]+")
RUN = re.compile(" +")
#: What begins a comment, what only code has, and how a line of prose looks.
COMMENT = ("//", "#", "/*", "*", "--")
CODE = re.compile(r"[{}()\[\];=<>]|=>|->")
PROSE = re.compile(r"^[A-Z][^A-Z\n]{20,}(?:\.|;|:)$")
BLANK = " \t\r\f\v"
OPEN, CLOSE = "{([<", "})]>"


def _slope(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Least squares' slope and the square of the correlation; 0 and 0 where x doesn't vary."""
    dx, dy = x - x.mean(), y - y.mean()
    xx, yy, xy = float(dx @ dx), float(dy @ dy), float(dx @ dy)
    return (0.0, 0.0) if xx <= 0 else (xy / xx, xy * xy / (xx * yy) if yy > 0 else 0.0)


def _entropies(counts: list[int], total: int) -> tuple[float, float, float, float]:
    p = np.array(counts, dtype=np.float64) / total
    return float(-(p * np.log2(p)).sum()), float(-np.log2((p * p).sum())), float(-np.log2(p.max())), float(2 * np.log2(np.sqrt(p).sum()))


def tokens(low: str, text: str) -> tuple:
    """Number of tokens and types, entropies of order 1, 2, infinity and one half, Zipf's slope and fit, whether counts are equal, Heaps' slope."""
    t = TOKEN.findall(low)
    if not t:
        return 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True, 0.0
    counts = sorted(Counter(t).values(), reverse=True)
    zipf, fit = _slope(np.log(np.arange(1, len(counts) + 1)), np.log(np.array(counts, dtype=np.float64))) if len(counts) > 1 else (0.0, 0.0)
    n = len(t)
    m = min(20, max(5, floor(log2(n))))
    places = sorted({i * n // m for i in range(1, m + 1)} - {0})
    seen: set[str] = set()
    grown, at = [], 0
    for place in places:
        seen.update(t[at:place])
        at = place
        grown.append(len(seen))
    heaps = _slope(np.log(np.array(places, dtype=np.float64)), np.log(np.array(grown, dtype=np.float64)))[0] if n >= 10 else 0.0
    return n, len(counts), *_entropies(counts, n), zipf, fit, counts[0] == counts[-1], heaps


def spaces(low: str, text: str) -> tuple:
    """Number of runs of spaces, variation and entropy of their lengths, the shortest and the longest."""
    runs = Counter(map(len, RUN.findall(text)))
    n = sum(runs.values())
    if not n:
        return 0, 0.0, 0.0, 0, 0
    mean = sum(k * v for k, v in runs.items()) / n
    variance = max(0.0, sum(k * k * v for k, v in runs.items()) / n - mean * mean)
    return n, variance**0.5 / mean, _entropies(list(runs.values()), n)[0], min(runs), max(runs)


def lines(low: str, text: str) -> tuple:
    """Lines, those that count as text, those like prose; brackets that stand alone in all lines and in the last fifth, and brackets there."""
    rows = text.split("\n")
    counted = prose = 0
    for row in rows:
        row = row.strip(BLANK)
        if not row or row.startswith(COMMENT) or sum(map(row.count, "'\"`")) % 2:
            continue
        counted += 1
        prose += len(row) >= 40 and row.count(" ") >= 2 and not CODE.search(row) and PROSE.match(row) is not None
    end = "\n".join(rows[floor(len(rows) * 0.8) :])
    opened, closed = sum(map(end.count, OPEN)), sum(map(end.count, CLOSE))
    whole = abs(sum(map(text.count, OPEN)) - sum(map(text.count, CLOSE)))
    return len(rows), counted, prose, whole, abs(opened - closed), opened + closed


def surprisal(low: str, text: str) -> tuple:
    """Variation, range and steepest step of the mean surprisal over 20 equal segments, under the document's own add-one trigram model; nulls below 200 tokens."""
    t = TOKEN.findall(low)
    n = len(t)
    if n < 200:
        return None, None, None
    padded = ["<s>", "<s>", *t]
    pairs = list(zip(padded, padded[1:], strict=False))[:n]
    tri, bi, v = Counter(zip(pairs, t, strict=True)), Counter(pairs), len(set(t))
    size = n // 20
    sums, sizes = [0.0] * 20, [0] * 20
    for i, token in enumerate(t):
        segment = min(i // size, 19)
        p = 1 / v if i - segment * size < 2 else (tri[pairs[i], token] + 1) / (bi[pairs[i]] + v)
        sums[segment] -= log2(p)
        sizes[segment] += 1
    means = np.array(sums) / np.array(sizes)
    return float(means.std() / means.mean()), float(means.max() - means.min()), float(np.abs(np.diff(means)).max())


def squeeze(low: str, text: str) -> tuple:
    """Bytes, the part that deflate saves, mean and variation of neighbouring lines' normalised compression distances."""
    rows = [x.encode() for x in text.split("\n") if x.strip()]
    size = [len(zlib.compress(x, 9)) for x in rows]
    joined = [len(zlib.compress(a + b, 9)) for a, b in zip(rows, rows[1:], strict=False)]
    ncd = [(c - min(x, y)) / max(x, y) for c, x, y in zip(joined, size, size[1:], strict=False)]
    raw = text.encode()
    mean = sum(ncd) / len(ncd) if ncd else 0.0
    sd = (sum((x - mean) ** 2 for x in ncd) / len(ncd)) ** 0.5 if ncd else 0.0
    return len(raw), 1 - len(zlib.compress(raw, 9)) / len(raw), mean, sd / max(mean, 0.001) if len(rows) > 1 else 0.0


#: Parts of a profile: what makes them, and their columns.
PARTS: dict[str, tuple[Callable[[str, str], tuple], str]] = {
    "tokens": (tokens, "n_tokens long, n_types long, h1 double, h2 double, hinf double, h_half double, zipf double, fit double, flat boolean, heaps double"),
    "spaces": (spaces, "n_runs long, cv double, entropy double, shortest int, longest int"),
    "lines": (lines, "n_lines int, n_counted long, n_prose long, whole int, tail int, tail_all int"),
    "surprisal": (surprisal, "s_cv double, s_range double, s_step double"),
    "squeeze": (squeeze, "n_bytes long, savings double, ncd_mean double, ncd_cv double"),
}


def profile(docs: DataFrame, *parts: str, key: str = "doc_id") -> DataFrame:
    """The key and the columns of the parts, for each row of docs with a text; null texts have no row."""
    schema = T.StructType([docs.schema[key]])
    for p in parts:
        schema = T.StructType([*schema.fields, *T._parse_datatype_string(PARTS[p][1]).fields])
    made = [PARTS[p][0] for p in parts]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
    types = [kinds[f.dataType.simpleString()] for f in schema.fields[1:]]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sum((f(low.as_py(), text.as_py()) for f in made), ()) for low, text in zip(batch.column("__low"), batch.column("__text"), strict=True)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names)

    given = docs.where(F.col("text").isNotNull()).select(key, F.lower("text").alias("__low"), F.col("text").alias("__text"))
    return given.mapInArrow(run, schema)
