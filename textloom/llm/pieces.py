"""SentencePiece encoding and decoding of merge-type (BPE) models, in one pass over each text.

A sequence of pieces is the encoding of a text just when each piece encodes to itself and each pair of neighbours does too. So every prefix
of a text has one last piece: the one that ends there and goes with the last piece of the prefix before it. An Aho-Corasick automaton tells the
pieces that end at a place, a table of pairs whether two go together, and the ids are read backwards from the end.

No piece of such models holds the space mark after another character or a line feed beside another one (the model is asked), so texts fall into
units, each a word with the spaces before it, whose encodings are kept from one document to the next in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import extended

SPACE = "▁"
#: Units that a worker process remembers, and the most characters of one that it does.
MEMORY_UNITS = 350_000
MEMORY_CHARS = 40
MEMORY_PAIRS = 500_000

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores and rules of a merge-type model file."""

    def __init__(self, content: bytes):
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for field, value in _fields(content):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24):
            raise ValueError("only merge-type models with byte fallback and no normalisation are read")
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.end = self.pieces.index("</s>")
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in long):
            raise ValueError("pieces reach over the ends of words")
        self.runs = {len(p): self.ids[p] for p in self.ids if not p.strip(SPACE)}
        lowest = min((self.scores[i] for p, i in self.ids.items() if p.strip(SPACE) and len(p) > 1), default=0.0)
        if 1 not in self.runs or any(self.scores[i] >= lowest for n, i in self.runs.items() if n > 1):
            raise ValueError("runs of spaces don't merge last")


class Coder:
    """Encodes and decodes; remembers pairs and units, of these the last MEMORY_UNITS to twice as many."""

    _UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def __init__(self, model: Model):
        self.model = model
        self._pairs: dict[int, bool] = {}
        self._units: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._odd: dict[str, str] = {}  # decodings of units that aren't the unit's own text
        self._long: list[str] = []  # units of the text in hand that are too long to remember
        #: Pieces that are their own encoding; no other ever occurs.
        self._alone = {p: i for p, i in model.ids.items() if (p == SPACE or p.strip(SPACE)) and self._merged(p) == [i]}
        self._automaton = ahocorasick.Automaton()
        for p, i in self._alone.items():
            self._automaton.add_word(p, (i, len(p)))
        self._automaton.make_automaton()

    def _merged(self, text: str) -> list[int]:
        """Ids by merging the best pair again and again: the definition, for short texts."""
        ids, scores = self.model.ids, self.model.scores
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in ids:
                heapq.heappush(heap, (-scores[ids[both]], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ids.get(p, -1) for p in parts if p is not None]

    def _goes(self, left: int, right: int) -> bool:
        """Whether two pieces are the encoding of their text."""
        if len(self._pairs) >= MEMORY_PAIRS:
            self._pairs.clear()
        known = self._pairs[left << 20 | right] = self._merged(self.model.pieces[left] + self.model.pieces[right]) == [left, right]
        return known

    def _word(self, text: str) -> list[int]:
        """Ids of a word with at most one space mark, at its start; characters that no piece holds become bytes."""
        if (whole := self._alone.get(text)) is not None:
            return [whole]
        # last[n]: the last piece of the first n characters; -1 at the start and after a character that no piece holds.
        last, length = [-1] * (len(text) + 1), [1] * (len(text) + 1)
        known = self._pairs.get
        for at, (piece, size) in self._automaton.iter(text):  # the longest of those that end together comes first
            n = at + 1
            if last[n] < 0:
                left = last[n - size]
                if left >= 0:
                    good = known(left << 20 | piece)
                    if not (self._goes(left, piece) if good is None else good):
                        continue
                last[n], length[n] = piece, size
        ids, n = [], len(text)
        while n:
            if last[n] < 0:
                ids.extend(self.model.bytes[b] for b in reversed(text[n - 1].encode()))
                n -= 1
            else:
                ids.append(last[n])
                n -= length[n]
        return ids[::-1]

    def _unit(self, text: str) -> list[int]:
        marks = len(text) - len(text.lstrip(SPACE))
        ids: list[int] = []
        if marks < len(text):
            ids = self._word(text[max(0, marks - 1) :])
            # Runs of marks merge after all else; the word's own mark joins them unless it has merged with the word.
            if marks and ids[0] == self.model.runs[1]:
                ids = ids[1:]
            else:
                marks = max(0, marks - 1)
        return self._merged(SPACE * marks) + ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with the end id."""
        return [int(x) for unit in self._split(text) for x in self._known(unit).split()] + [self.model.end]

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        return self._UNIT.findall((SPACE if self.model.prefix else "") + text.replace(" ", SPACE))

    def _known(self, unit: str) -> str:
        """Ids of a unit as text."""
        known = self._units.get(unit)
        if known is None:
            known = self._older.get(unit)
            if known is None:
                ids = self._unit(unit)
                known = " ".join(map(str, ids))
                if (plain := self._plain(ids)) != unit.replace(SPACE, " "):
                    self._odd[unit] = plain
                if len(unit) > MEMORY_CHARS:
                    self._long.append(unit)
                    return known
            if len(self._units) >= MEMORY_UNITS:
                self._older, self._units = self._units, {}
            self._units[unit] = known
        return known

    def _plain(self, ids: list[int]) -> str:
        """Text of ids, spaces for marks; bytes that aren't UTF-8 become U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, self.model.end]:
            kind = self.model.kinds[i]
            if kind == BYTE:
                raw.append(int(self.model.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if kind == NORMAL:
                out.append(self.model.pieces[i].replace(SPACE, " "))
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._plain(ids)
        return text[1:] if self.model.prefix and text[:1] == " " else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the decoded text."""
        for unit in self._long:
            self._odd.pop(unit, None)
        self._long.clear()
        if len(self._odd) > MEMORY_UNITS:  # between texts, so that a text's own units stay
            self._units, self._older, self._odd = {}, {}, {}
        units = self._split(text or "")
        held, known = self._units.get, self._known
        ids = " ".join([held(u) or known(u) for u in units] + [str(self.model.end)])
        odd = self._odd
        plain = "".join([odd.get(u, u) for u in units] if odd else units).replace(SPACE, " ")
        if self.model.prefix and plain[:1] == " ":
            plain = plain[1:]
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


_coders: dict[str, Coder] = {}


def coder(model_file: str) -> Coder:
    """The coder of a model file; one for each process."""
    if model_file not in _coders:
        with open(model_file, "rb") as f:
            _coders[model_file] = Coder(Model(f.read()))
    return _coders[model_file]


def _with(docs: DataFrame, model_file: str, text_col: str, names: list[str], kinds: list[str], of) -> DataFrame:
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_file)
        types = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[k] for k in kinds]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [of(own, t.as_py()) for t in part.column(part.schema.get_field_index(text_col))]
                more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])

    return docs.mapInArrow(run, extended(docs.schema, **dict(zip(names, kinds, strict=True))))


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of each text, with the end id, to docs; null and empty texts have that alone. A column of the name is replaced.

    The model file must be at the same path on every machine; each worker process reads it once.
    """
    return _with(docs, model_file, text_col, [ids_col], ["array<int>"], lambda own, t: (own.encode(t or ""),))


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids to rows; null is the empty text. A column of the name is replaced."""
    return _with(rows, model_file, ids_col, [text_col], ["string"], lambda own, ids: (own.decode(ids or []),))


def digests(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to docs: of the encoding of each text and the decoding of that."""
    return _with(docs, model_file, text_col, ["n_tokens", "ids_sha256", "decoded_sha256"], ["long", "string", "string"], Coder.digests)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, default_model()).drop("text")
