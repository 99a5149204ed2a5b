"""Substring dedup with suffix automata of reference shards.

A word run that two documents share and that is at least WINDOW words long has windows of WINDOW words, and the least of the hashes of a
window's runs of ANCHOR words depends on the window alone. These anchors deal the corpus into reference shards:

1. Each document is cut into segments, stretches of windows with one anchor. Anchors go to their shard, where those of one document end.
2. Segments with shared anchors are read from their documents and go to the anchor's shard, equal ones of a task as one.
3. A shard's task builds a suffix automaton of an anchor's segments, each state with the smallest document that holds its words, and streams
   the segments through it: the matching statistics, held at WINDOW words, tell the windows that a smaller document holds.
4. Maximal spans of such windows are cut from their documents.

Broadcasting every shard's automaton to every document would take work that grows with the square of the corpus, so documents' segments go to the
automata instead. remove_reference() is the broadcast form, for a reference of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batches_of_text, cut, partitions, sequence_hashes, words_of

WINDOW = 13
ANCHOR = 6
#: Bits of an anchor's hash; of two anchors with one hash, both are looked up.
ANCHOR_BITS = 48
#: Words of a reference that may be broadcast.
MAX_BROADCAST_WORDS = 5_000_000


class SuffixAutomaton:
    """Automaton of word lists; each state knows the smallest owner of the lists that hold its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.owner: list[int | None] = [None]

    def add(self, words: Iterable, owner: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def _extend(self, last: int, w) -> int:
        nexts, link, size = self.next, self.link, self.size
        old = nexts[last].get(w)
        if old is not None:
            return old if size[old] == size[last] + 1 else self._split(last, w, old)
        new = self._state(size[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in nexts[at]:
            nexts[at][w] = new
            at = link[at]
        if at >= 0:
            old = nexts[at][w]
            link[new] = old if size[old] == size[at] + 1 else self._split(at, w, old)
        return new

    def _state(self, size: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.size.append(size)
        self.owner.append(None)
        return len(self.size) - 1

    def _split(self, at: int, w, old: int) -> int:
        """A state for the shorter words of old that end where at goes by w."""
        new = self._state(self.size[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = new
            at = self.link[at]
        return new

    def finish(self) -> SuffixAutomaton:
        """Owners of longer words count for their ends too."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            mine, above = self.owner[s], self.link[s]
            if mine is not None and (self.owner[above] is None or mine < self.owner[above]):
                self.owner[above] = mine
        return self

    def matches(self, words: Iterable, window: int) -> Iterator[int | None]:
        """For the end of each word: the smallest owner of the last window words, None where no list holds them."""
        nexts, link, size = self.next, self.link, self.size
        at = length = 0
        for w in words:
            while at and w not in nexts[at]:
                at = link[at]
                length = size[at]
            if w in nexts[at]:
                at = nexts[at][w]
                length += 1
            if length >= window:
                while size[link[at]] >= window:
                    at = link[at]
                length = window
                yield self.owner[at]
            else:
                yield None


def _segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document (its place), first window and number of windows of each segment."""
    _, _, hashes, before = words_of(data, starts, ends)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    doc = np.repeat(np.arange(len(starts)), np.diff(before))
    low = sequence_hashes(hashes, ANCHOR) >> np.uint64(64 - ANCHOR_BITS)
    left, reach = WINDOW - ANCHOR + 1, 1
    while reach < left:
        step = min(reach, left - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    whole = doc[:n] == doc[WINDOW - 1 :]
    new = whole.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1] | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    gaps = np.append(np.cumsum(~whole), 0)
    count = stop - first - (gaps[stop - 1] - gaps[first])
    return low[first], doc[first], first - before[doc[first]], count


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, at) of all segments: at holds the first window, the number of windows and a kind in its last two bits.

    Kind 0 asks whether its anchor is shared, kind 1 knows it is, as another document of the batch has it, and kind 2 says so to other batches:
    of an anchor's segments in many documents, one goes to the shard to tell, and the others pass anywhere.
    """
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for at, to, data, starts, ends in batches_of_text(batch, "text"):
            anchor, doc, first, count = _segments(data, starts, ends)
            parts.append((anchor, ids[at:to][doc], first << 32 | count << 2))
        if not parts:
            continue
        anchor, doc, where = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(anchor):
            order = np.argsort(anchor, kind="stable")
            sorted_anchor, sorted_doc = anchor[order], doc[order]
            head = np.flatnonzero(np.append(True, sorted_anchor[1:] != sorted_anchor[:-1]))
            shared = np.minimum.reduceat(sorted_doc, head) != np.maximum.reduceat(sorted_doc, head)
            where[order] |= np.repeat(shared, np.diff(np.append(head, len(anchor))))
            tell = order[head[shared]]
            anchor, doc, where = np.append(anchor, anchor[tell]), np.append(doc, doc[tell]), np.append(where, where[tell] & ~3 | 2)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(where)], ["anchor", "doc_id", "at"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with anchors that several documents have, of rows in the order of anchors. Keeps back only the run that's still open."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in _and_end(batches):
        if batch is None:
            rows = held
            final = True
        else:
            new = tuple(batch.column(k).to_numpy() for k in range(3))
            rows = tuple(np.concatenate(x) for x in zip(held, new, strict=True)) if held is not None else new
            final = False
        if rows is None or not len(rows[0]):
            continue
        anchor, doc, at = rows
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        ask = (at & 3) != 1
        low = np.minimum.reduceat(np.where(ask, doc, np.iinfo(np.int64).max), head)
        high = np.maximum.reduceat(np.where(ask, doc, np.iinfo(np.int64).min), head)
        shared = (low < high) | (np.maximum.reduceat(at & 3, head) == 2)
        known = np.repeat(shared, np.diff(np.append(head, len(anchor)))) | (at & 3 == 1)
        if final:
            keep_back = len(anchor)
            held = None
        else:
            # Of the open run, rows whose answer is known leave at once, but for one that stands for its document.
            keep_back = head[-1]
            if shared[-1]:
                held = (anchor[-1:], doc[-1:], at[-1:] & ~3 | 2)
                keep_back = len(anchor)
            else:
                held = tuple(x[keep_back:] for x in rows)
        out = np.flatnonzero(known[:keep_back] & (at[:keep_back] & 3 != 2))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], ["anchor", "doc_id", "at"])


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, first, words) of segments to look up; words null for those that equal a segment of a smaller document in the batch."""
    for batch in batches:
        least: dict[tuple[int, bytes], int] = {}
        rows: list[tuple[int, int, int, bytes]] = []
        ids, texts, lists = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("segments")
        for k, doc in enumerate(ids):
            words = _words(texts[k].as_py())
            for anchor, at in sorted({(s["anchor"], s["at"]) for s in lists[k].as_py()}):
                first, count = at >> 32, (at & 0xFFFFFFFF) >> 2
                content = b" ".join(words[first : first + count + WINDOW - 1])
                rows.append((anchor, doc, first, content))
                key = anchor, content
                if least.get(key, doc) >= doc:
                    least[key] = doc
        out = []
        for anchor, doc, first, content in rows:
            own = least[anchor, content]
            if own < doc:
                out.append((anchor, doc, first, content.count(b" ") + 2 - WINDOW, None))
            else:
                out.append((anchor, doc, first, 0, content))
        if out:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "doc_id", "first", "known", "words"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, span) of windows that a smaller document has: first window and number of windows in one value. Rows come in the order of anchors."""
    out: list[tuple[int, int]] = []
    group: list[tuple[int, int, bytes]] = []
    anchor = None

    def close() -> None:
        if len({d for d, _, _ in group}) > 1:
            automaton = SuffixAutomaton()
            least: dict[bytes, int] = {}
            for doc, _, content in group:
                if least.get(content, doc) >= doc:
                    least[content] = doc
            for content, doc in least.items():
                automaton.add(content.split(b" "), doc)
            automaton.finish()
            owners = {content: [*automaton.matches(content.split(b" "), WINDOW)][WINDOW - 1 :] for content in least}
            for doc, first, content in group:
                begin = None
                for k, owner in enumerate([*owners[content], None]):
                    if owner is not None and owner < doc:
                        begin = k if begin is None else begin
                    elif begin is not None:
                        out.append((doc, first + begin << 32 | k - begin))
                        begin = None
        group.clear()

    for batch in _and_end(batches):
        if batch is None:
            close()
        else:
            for a, doc, first, known, content in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if content is None:
                    out.append((doc, first << 32 | known))
                    continue
                if a != anchor:
                    close()
                    anchor = a
                group.append((doc, first, content))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["doc_id", "span"])
            out.clear()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of documents (doc_id, text) with windows that also start in a document with a smaller doc_id.

    A span is the first window and the number of windows, in the upper and lower half of a long; spans may meet or overlap.
    """
    n = partitions(docs.sparkSession)

    def shared() -> DataFrame:
        own = F.when((F.col("at").bitwiseAND(3)) == 1, F.col("doc_id")).otherwise(F.col("anchor"))
        asked = docs.mapInArrow(_anchors, "anchor long, doc_id long, at long").repartition(n, own).sortWithinPartitions("anchor")
        return asked.mapInArrow(_shared, "anchor long, doc_id long, at long").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at")).alias("segments"))

    def covered(segments: DataFrame) -> DataFrame:
        contents = docs.join(segments, "doc_id").mapInArrow(_contents, "anchor long, doc_id long, first int, known int, words binary")
        own = F.when(F.col("words").isNull(), F.col("doc_id")).otherwise(F.col("anchor"))
        dealt = contents.repartition(n, own).sortWithinPartitions("anchor", "doc_id")
        return dealt.mapInArrow(_covered, "doc_id long, span long").groupBy("doc_id").agg(F.collect_list("span").alias("spans"))

    return covered(cut(shared()))


def keep(words: list[bytes], spans: Iterable[int]) -> list[bytes]:
    """Words outside the spans."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for span in spans:
        first, count = span >> 32, span & 0xFFFFFFFF
        gone[first] += 1
        gone[min(first + count + WINDOW - 1, len(words))] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist(), strict=True) if s]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is what is left of each text, its words joined by single spaces.

    Each word of a window of WINDOW words that also starts in a document with a smaller id goes; windows are those of the given texts. A null
    text has no words, a text with fewer than WINDOW words stays, and so does a document without an id. Ids should be unique: rows with one id don't cover one another, and where
    one of them has a repeated window at a place, it is cut from all of them. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _cut(docs, "kept", "string", lambda kept: kept.decode())


def _cut(docs: DataFrame, name: str, kind: str, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, lists = batch.column("text"), batch.column("spans")
            for k in range(len(batch)):
                words = _words(texts[k].as_py())
                spans = lists[k].as_py()
                kept = keep(words, spans) if spans else words
                rows.append((len(words), len(words) - len(kept), of(b" ".join(kept))))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", name])

    # With the same filter on both sides of its use, the texts' shuffle is one.
    known = docs.where(F.col("doc_id").isNotNull())
    spans = known.join(repeated_spans(known), "doc_id", "left").unionByName(docs.where(F.col("doc_id").isNull()).withColumn("spans", F.lit(None).cast("array<long>")))
    return spans.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} {kind}")


def remove_reference(docs: DataFrame, reference: list[str], text_col: str = "text") -> DataFrame:
    """docs with each word in a window of WINDOW words that a reference text holds cut from the text; words are joined by single spaces.

    The reference's automaton is broadcast, so it has at most MAX_BROADCAST_WORDS words (ValueError beyond). A null text stays null.
    """
    lists = [_words(t) for t in reference]
    if sum(map(len, lists)) > MAX_BROADCAST_WORDS:
        raise ValueError(f"the reference has more than {MAX_BROADCAST_WORDS} words")
    sent = docs.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for k, words in enumerate(sent.value):
            automaton.add(words, k)
        automaton.finish()
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                words = _words(text)
                found = [k - WINDOW + 1 for k, owner in enumerate(automaton.matches(words, WINDOW)) if owner is not None]
                out.append(b" ".join(keep(words, [k << 32 | 1 for k in found])).decode() if found else text)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _cut(docs, "kept_sha256", "string", lambda kept: hashlib.sha256(kept).hexdigest())


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
hit AS (SELECT s.doc_id, s.i FROM s JOIN m USING (g) WHERE least < s.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM hit),
g AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id),
k AS (
  SELECT doc_id, len(w) AS n_words, CASE WHEN l IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l, i)) END AS kept
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(kept))::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256
FROM k
"""
