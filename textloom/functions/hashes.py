"""Sets of shingle hashes and signatures of minimums, for use inside Arrow functions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
#: What a canonical token is, and words that stand for themselves.
SHAPE_TOKEN = r"""[a-z_$][a-z0-9_$]*|0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?[fdl]?|[(){}\[\];,.<>=+\-*/%!&|^?:]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""
KEYWORDS = sorted(set((
    "if else for while do switch case default break continue return goto function class interface struct enum trait def fn fun func var let const val mod use pub impl package module lambda public private "
    "protected static abstract final sealed override virtual readonly async await synchronized volatile transient native strictfp inline external export import type record object data match select when where "
    "try catch finally throw throws raise rescue ensure except and or not in is as instanceof typeof delete void new this super self yield with without pass assert mut move ref out params operator sizeof "
    "typedef union register extern elif global nonlocal del unless until begin next then end alias defined suspend lateinit companion internal open unsafe dyn box crate guard defer repeat init deinit "
    "extension protocol rethrows weak unowned lazy"
).split()))
_KEYWORDS, _SHAPE = frozenset(KEYWORDS), re.compile(SHAPE_TOKEN)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
#: Words whose hashes are remembered.
MEMORY = 1_000_000
class _Known(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Known()


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > MEMORY:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Ascending distinct hashes of the runs of k; of fewer, that of all; of none, none."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    width = min(k, len(h))
    total = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for j in range(width):
        total += h[j : j + len(total)]
        total *= np.uint64(0xD1342543DE82EF95)
        total ^= total >> np.uint64(29)
    total += np.uint64(width)
    out = total.view(np.int64)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def shingle_set(low: str, k: int = 5) -> np.ndarray:
    """Of the words of a lower-cased text."""
    return runs(word_hashes(WORD.findall(low)), k)


def shape(low: str) -> list[str]:
    """Canonical tokens: names are id but for keywords, literals num, str and bool, and marks themselves."""
    out = []
    for t in _SHAPE.findall(_COMMENT.sub("", low)):
        c = t[0]
        if c.isdigit():
            out.append("num")
        elif c in "\"'`":
            out.append("str")
        elif c.isalpha() or c in "_$":
            out.append("bool" if t in ("true", "false", "null", "none", "nil") else t if t in _KEYWORDS else "id")
        else:
            out.append(t)
    return out


def shape_set(low: str, k: int = 8, least: int = 60) -> np.ndarray:
    """Of the canonical tokens of a lower-cased text; none where there are fewer than least."""
    tokens = shape(low)
    return runs(word_hashes(tokens), k) if len(tokens) >= least else np.zeros(0, dtype=np.int64)


def sha1_set(low: str, k: int = 5) -> np.ndarray:
    """The first four bytes of SHA-1 of each shingle of a lower-cased text, distinct."""
    w = WORD.findall(low)
    some = {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return np.unique(np.array([int.from_bytes(hashlib.sha1(s.encode()).digest()[:4], "big") for s in some], dtype=np.uint64))


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for c in text.encode("utf-16-le")[::2] if text.isascii() else [ord(c) & 0xFFFFFFFF for c in text]:
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return h


_PRIME = 2**61 - 1


def _mix(x: int) -> int:
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 33


def parameters(i: int) -> tuple[int, int]:
    """Factor and term of the i-th hash, (1, 0) for the first."""
    return _mix(i * 0x9E3779B97F4A7C15) | 1, _mix(i * 0xBF58476D1CE4E5B9)


_family: dict[int, tuple[np.ndarray, ...]] = {}
#: Values that are hashed at once, by all hashes.
STEP = 2048


def signature(x: np.ndarray, n: int = 128) -> np.ndarray:
    """Of 32-bit values, the least of (a x + b) mod (2^61 - 1) in its low 32 bits, for each of n hashes; all bits set where there are no values."""
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint64)
    if n not in _family:
        a, b = (np.array([v % _PRIME for v in column], dtype=np.uint64)[:, None] for column in zip(*map(parameters, range(n)), strict=True))
        _family[n] = a >> np.uint64(32), a & np.uint64(0xFFFFFFFF), b
    high, low, term = _family[n]
    prime = np.uint64(_PRIME)
    for at in range(0, len(x), STEP):
        part = x[None, at : at + STEP]
        top = high * part  # below 2^61; times 2^32 it goes round the prime
        total = low * part
        total = (total & prime) + (total >> np.uint64(61)) + term + (top >> np.uint64(29)) + ((top & np.uint64(2**29 - 1)) << np.uint64(32))
        total = (total & prime) + (total >> np.uint64(61))
        total[total >= prime] -= prime
        np.minimum(out, (total & np.uint64(0xFFFFFFFF)).min(axis=1), out=out)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Part of two signatures of one length that agrees; 1 for those without any."""
    if len(a) != len(b):
        raise ValueError("signatures differ in length")
    return float((a == b).mean()) if len(a) else 1.0
