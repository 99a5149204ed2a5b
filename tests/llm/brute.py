"""Plain versions of what the operators compute, for small inputs."""

import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components_of(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def spark_hash(value):
    """xxhash64 of bytes or of a long, as Spark has it."""
    import xxhash

    data = value if isinstance(value, bytes) else int(value).to_bytes(8, "little", signed=True)
    return int.from_bytes(xxhash.xxh64(data, seed=42).digest(), "big", signed=True)


def sets_of(text):
    return shingles(text.translate({c: c + 32 for c in range(65, 91)}) if text else "")


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    terms = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in terms) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0):
    """[(doc, (target, rate))] for docs (id, size, source): targets by resharing, rates by bisection."""
    by, n = defaultdict(int), defaultdict(int)
    for _, size, source in docs:
        by[source] += size
        n[source] += 1
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = share * sum(by.values()), {}, set(names)
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * by[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = most * by[s]
            left -= most * by[s]
        open_ -= over
    x = {}
    for s in names:
        sizes = [size for _, size, source in docs if source == s]
        low, high = -1e6, 1e6
        for _ in range(200):
            middle = (low + high) / 2
            due = sum(v * min(most, math.exp(min(1.0, middle * v / max(1, max(sizes))))) for v in sizes)
            low, high = (middle, high) if due < target[s] else (low, middle)
        x[s] = (high, max(1, max(sizes)))
    return [((i, size, s), (target[s], min(most, math.exp(min(1.0, x[s][0] * size / x[s][1]))) if size else 0.0)) for i, size, s in docs]
