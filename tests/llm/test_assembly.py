"""Fill-in-the-middle, packing and hard negatives, held against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import hostile
from tracewarden.llm import fill_middle, hard_negatives, packing, queries


# ---------------------------------------------------------------- fill-in-the-middle

def plain_fill(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    told = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(told[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text or ""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(3)
    odd = ["\n", "\n\n\n", "a", "a\n", "<P", "<<S", "<S>", "P>x\nM>\n<", "é🙂\r\nx\x0by z\n", "", None, "<\n>" * 40]
    odd += ["".join(rng.choice("ab<PSM>\n🙂") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return odd + ["line of words\n" * 9000 + "end", "x" * 100_000 + "\n" + "<" * 70_000, "\n" * 40_000]


@pytest.mark.parametrize("frame_chars", [7, 32_768])
def test_frames_hold_cuts_and_texts(frame_chars, monkeypatch):
    """Frames so small that markers, cuts and lines lie across them."""
    monkeypatch.setattr(fill_middle, "FRAME_CHARS", frame_chars)
    for doc_id, text in enumerate(fim_texts()):
        if len(text or "") > 1000 and frame_chars == 7:
            continue
        frames = fill_middle.Frames.of(text or "")
        *told, out = fill_middle.filled(frames, doc_id, fill_middle.has_marker(text or ""), 100, 50, "7")
        output = "".join(out.stream(0, out.n_chars))
        assert (*told, output) == plain_fill(doc_id, text), repr(text)
        assert "".join(fill_middle.restored(out, told[1])) == (text or "")


def test_only_cut_frames_are_opened(monkeypatch):
    monkeypatch.setattr(fill_middle, "FRAME_CHARS", 100)
    text = "".join(f"line {i}\n" for i in range(2000))
    frames = fill_middle.Frames.of(text)
    opened = []
    monkeypatch.setattr(fill_middle.Frames, "text", lambda self, i, plain=fill_middle.Frames.text: opened.append((id(self), i)) or plain(self, i))
    *told, out = fill_middle.filled(frames, 5, False, 100, 50, "7")
    assert told[1] != "plain" and len({i for s, i in opened if s == id(frames)}) <= 3  # two cuts and the last line's end
    taken = set(map(id, frames.frames)) & set(map(id, out.frames))
    assert len(taken) >= len(frames.frames) - 2  # the others move as they are


def test_fill_middle_of_tables(spark):
    texts = fim_texts() + [t for _, t in hostile.TEXTS]
    df = spark.createDataFrame([(i if i != 4 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, frames string")
    filled = fill_middle.fill_middle(fill_middle.store_frames(df))
    told = {r.doc_id: r for r in fill_middle.with_digests(filled).collect()}
    shown = {r.doc_id: r for r in fill_middle.with_texts(filled).collect()}
    for i, text in enumerate(texts):
        i = i if i != 4 else None
        *want, output = plain_fill(i, text)
        r = told[i]
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want and shown[i].output == output
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and shown[i].restored == (text or "")
    hostile_rows = fill_middle.with_digests(fill_middle.fill_middle(fill_middle.store_frames(hostile.docs(spark))))
    assert hostile_rows.count() == len(hostile.TEXTS)
    assert fill_middle.fill_middle(fill_middle.store_frames(hostile.no_docs(spark))).count() == 0
    none = fill_middle.fill_middle(fill_middle.store_frames(df), rate=0)
    assert {r.form for r in none.select("form").distinct().collect()} == {"plain"}


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary_file()


def check_pieces(rows, docs, vocabulary, window):
    """Every id in one piece, sequences gapless and without padding. ``docs`` have ids of their own."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(own.tobytes())
        assert r.ids == own.tolist()
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, total in [(pieces[d], len(x)) for d, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        if total is None:
            assert at <= window and at & (at - 1) == 0
        else:
            assert at == total
    return sequences


@pytest.mark.parametrize("window", [4096, 64])
def test_pieces_cover_all_documents(spark, vocabulary, window):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 400)))) for i in range(300)]
    docs += [(500 + i, t) for i, (_, t) in enumerate(hostile.TEXTS)] + [(600 + i, docs[0][1]) for i in range(50)]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, code string, ids string")
    rows = packing.pack_documents(df, vocabulary, window=window).collect()
    sequences = check_pieces(rows, docs, vocabulary, window)
    assert sum(sum(n for _, n in s) < window for s in sequences.values()) <= 3 * window.bit_length()  # tails of three tasks


def test_packing_of_odd_tables(spark, vocabulary):
    assert packing.pack_documents(hostile.no_docs(spark), vocabulary).count() == 0
    rows = packing.pack_documents(hostile.docs(spark), vocabulary, keep_ids=False).collect()
    assert sum(r.start == 0 for r in rows) == len(hostile.TEXTS)
    with pytest.raises(ValueError):
        packing.pack_documents(hostile.docs(spark), vocabulary, window=1000)


def test_scores_are_bm25():
    rng, size = np.random.default_rng(4), 60
    units = [rng.zipf(1.5, rng.integers(1, 40)).clip(0, size - 1).astype("<u2") for _ in range(30)]
    holders = np.array([sum(t in u for u in units) for t in range(size)])
    stats = packing.Stats(np.log1p((30 - holders + 0.5) / (holders + 0.5)), float(np.mean([len(u) for u in units])))
    shard = packing.Shard(units, stats)
    for seed in range(30):
        want = [
            sum(
                stats.idf[t] * (n := int((u == t).sum())) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(u) / stats.average))
                for t in set(units[seed].tolist()) & set(u.tolist())
            )
            for u in units
        ]
        assert np.allclose(shard.scores(seed), want)
    shard.unused[[3, 5]] = False
    best = shard.neighbours(3)
    assert 3 not in best and 5 not in best and np.all(np.diff(shard.scores(3)[best]) <= 0)


def test_neighbours_share_a_window():
    """Two subjects in turn: each window keeps to one of them as long as it lasts."""
    units = [np.array([10 * (i % 2) + j for j in range(1, 9)], "<u2") for i in range(32)]
    stats = packing.Stats(np.ones(40), 8.0)
    windows = packing.Windows(64)
    packing.fill(packing.Shard(units, stats), list(range(32)), windows)
    assert [{p.unit % 2 for p in w} for w in windows.full] == [{0}, {0}, {1}, {1}] or [
        {p.unit % 2 for p in w} for w in windows.full
    ] == [{0}, {1}, {0}, {1}]
    windows.put("x", 0, 13)
    assert [[(p.begin, p.length) for p in s] for s in windows.tail()] == [[(0, 8)], [(8, 4)], [(12, 1)]]


# ---------------------------------------------------------------- hard negatives

def plain_mine(rows, positives=5, negatives=3):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    out = set()

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    for anchor in (r for r in rows if r[0] % 50 == 0):
        scored = sorted((-score(anchor[2], r[2]), r[0], r[1]) for r in rows if r != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            fits = [s for s in scored if s[2] != anchor[1] and -50 * minus <= -100 * s[0] <= -95 * minus][:negatives]
            for rank, s in enumerate(fits, 1):
                out.add((anchor[0], positive, rank, s[1], -minus, -s[0]))
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "same_label", "small"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    n, d = 900, 19
    vectors = rng.normal(0, 40, (n, d)).astype(int)
    labels = rng.integers(0, 4, n)
    if kind == "copies":  # a third of all rows are one vector
        vectors[::3] = vectors[0]
    if kind == "same_label":
        labels[rng.random(n) < 0.9] = 1
    if kind == "small":  # many ties, many zeros
        vectors = rng.integers(-1, 2, (n, d))
    rows = [(int(i), int(lab), v.tolist()) for i, lab, v in zip(range(n), labels, vectors)]
    rows[7] = (7, 1, [50] * 25)  # longer than the others
    rows[50] = (50, 2, [])
    monkeypatch.setattr(hard_negatives, "BATCH_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 6)
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:40]], "vec_id long, label int, vector array<long>, limits string")
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain_mine(rows))


def test_join_finds_all_pairs():
    rng = np.random.default_rng(1)
    for scale in (1, 50):
        a, b = rng.normal(0, scale, (40, 21)).astype(int), rng.normal(0, scale, (200, 21)).astype(int)
        scores = a @ b.T
        for share in (0.0, 0.5, 0.99, 1.0):
            threshold = np.quantile(scores, share, axis=1)
            pairs = hard_negatives.threshold_join(a, b, threshold)
            want = set(zip(*np.nonzero(scores >= threshold[:, None])))
            assert set(zip(pairs.anchor.tolist(), pairs.row.tolist())) == {(int(x), int(y)) for x, y in want}
            assert np.array_equal(pairs.score, scores[pairs.anchor, pairs.row])


def test_hard_negatives_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, label2 int, row string"
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25], 1, 0, "clash"), (1, [0.5, 0.2], 1, 0, "clash"), (2, [0.4, 0.1], 2, 0, "clash"), (3, None, 2, 0, "clash"),
        (4, [0.4, None], 2, 0, "clash"), (5, [nan, 0.1], 2, 0, "clash"), (6, [inf, 0.1], 2, 0, "clash"), (7, [0.4, 0.1], None, 0, "clash"),
        (None, [0.4, 0.1], 2, 0, "clash"), (8, [], 2, 0, "clash"), (2, [0.4, 0.1], 2, 0, "clash"), (50, [-1.0, -1.0], 3, 0, "clash"),
    ]
    usable = hard_negatives.usable(spark.createDataFrame(rows, schema), 256)
    got = hard_negatives.mine(usable, F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 128 * 128 + 64 * 51, 128 * 102 + 64 * 25)]
    empty = hard_negatives.usable(spark.createDataFrame([], schema), 256)
    assert hard_negatives.mine(empty, F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, 1, [1 << 30] * 8), (1, 1, [1 << 30] * 8)], "vec_id long, label int, vector array<long>")
    with pytest.raises(Exception, match="2\\^53"):
        hard_negatives.mine(big, F.col("vec_id") % 50 == 0).collect()
