"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re

import xxhash

BLANK = re.compile("[\x20\x09-\x0d]+")


def simhash(text):
    words = [w for w in BLANK.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """Number of the first item of each item's component."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def drop_lines(docs):
    """{row: kept text} of [(doc_id, text)], and {row: lines dropped}."""
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 40:
                held.setdefault(line_key(line), set()).add(doc)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 5}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in keeper or keeper[line_key(x)] == doc]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return out


def xxh(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode() if isinstance(text, str) else text, seed & (1 << 64) - 1)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def passages(text, cuts):
    """Passages of a text; ``cuts`` is the module with the settings."""

    def inside(token):
        out = ""
        for i, c in enumerate(token):
            h = 42
            for x in token[max(i - 3, 0) : i + 1]:
                h = xxh(x, h)
            out += "\n" + c if i > 2 and signed(h) % cuts.CHARS_A_CUT == 0 else c
        return out

    tokens, out = text.split(" "), []
    for i, w in enumerate(tokens):
        h = signed(xxh(w, xxh(tokens[i - 1]) if i else 42))
        one_in = cuts.WORDS_A_CUT * (1 if i < cuts.DENSE_WORDS else cuts.SPARSER)
        out.append("\n" * (h % one_in == 0) + (inside(w) if len(w.encode()) > cuts.LONG_TOKEN else w))
    most = "[^\n]{1,%d}" % cuts.PASSAGE_CHARS
    return re.findall(f"{most}(?:(?<= )|(?=\n)|\\Z)|{most}", " ".join(out))


def digests(text, cuts):
    return {xxh(p) for p in passages(text, cuts)}


def fingerprint(text, cuts):
    items = digests(text, cuts)
    groups = 2 ** math.ceil(math.log2(max(len(items), cuts.GROUP_LOAD) / cuts.GROUP_LOAD))
    cells = [[0, 0] for _ in range(groups * 3 * cuts.WIDTH)]
    for d in items:
        group = d % groups
        check = xxh((77).to_bytes(4, "little"), xxh(d.to_bytes(8, "little")))
        for t in range(3):
            cell = cells[(group * 3 + t) * cuts.WIDTH + (check >> 20 * t) % (1 << 20) % cuts.WIDTH]
            cell[0] ^= d
            cell[1] += ((check & 0xFFFFFFFF) << 16) + 1
    return f"{groups:x}:" + "".join(f"{k:016x}{m:016x}" for k, m in cells)
