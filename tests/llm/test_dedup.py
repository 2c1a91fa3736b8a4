"""Near-dedup, exact dedup, line dedup."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm import brute, hostile
from tracewarden.llm import components, exact_dedup, line_dedup, simhash


def test_fingerprints_equal_brute_force():
    for _, text in hostile.TEXTS:
        if text is None or len(text) < 1000:
            assert simhash.fingerprint(text or "") == brute.simhash(text)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = prints[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    prints = np.unique(np.concatenate((prints, near, near ^ np.uint64(6))))
    tree = simhash.BKTree.build(prints)
    assert sorted(tree.prints.tolist()) == sorted(prints.tolist()) and np.all(np.diff(tree.keys) > 0)
    found = {(int(prints[p]), int(tree.prints[n])) for ps, ns in tree.within(prints, 3) for p, n in zip(ps, ns)}
    assert found == {(int(a), int(b)) for a in prints for b in prints if (int(a) ^ int(b)).bit_count() <= 3}


@pytest.mark.parametrize("n, radius", [(10, 3), (10_000_000, 3), (1 << 60, 3), (1 << 50, 5)])
def test_some_mask_keeps_near_prints_together(n, radius):
    masks = simhash.shard_masks(n, radius, 2048)
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), radius))
        assert any((a & m & (1 << 64) - 1) == (b & m & (1 << 64) - 1) for m in masks)


@pytest.mark.parametrize("tree_size", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, tree_size):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(150)]
        docs += [(3 * i, " ".join(text)), (3 * i + 1, " ".join([*text[:-1], "end"])), (3 * i + 2, " ".join(text).upper())]
    docs += [(900, None), (901, ""), (902, " \n")]
    rng.shuffle(docs)
    prints = [brute.simhash(t) for _, t in docs]
    first = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    smallest = {}
    for (doc, _), root in zip(docs, first):
        smallest[root] = min(doc, smallest.get(root, doc))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = simhash.near_duplicates(df, tree_size=tree_size).select("doc_id", simhash.shown(), "component_id").collect()
    want = {(d, f"{p:016x}", smallest[r]) for (d, _), p, r in zip(docs, prints, first)}
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_near_duplicates_of_hostile_rows(spark):
    got = simhash.near_duplicates(hostile.docs(spark)).collect()
    assert len(got) == len(hostile.TEXTS)
    of = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {c for (d, f), c in of.items() if f == 0} == {2}
    kept = simhash.drop_near_duplicates(hostile.docs(spark))
    assert kept.columns == hostile.docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 6, 8, 9, 9, 10, 11] and ids.count(None) == 2  # both texts of id 9
    assert simhash.drop_near_duplicates(hostile.no_docs(spark)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(chain)
    edges = chain + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (5000, 4000)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000], *(got[2000 + i] for i in range(50))}) == 1
    assert got[5000] == got[4000] and len(set(got.values())) == 3 and len(got) == 201 + 51 + 2


def test_exact_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CAPACITY", 3)
    rng = random.Random(2)
    docs = [(i, rng.choice(["a  b", "a b", "a\tb", f"t{i % 9}", f"u{i}", None, ""])) for i in range(300)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(brute.BLANK.sub(" ", t or ""), []).append(i)
    want = {
        (i, min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items() for i in ids
    }
    assert {tuple(r) for r in got} == want and len(got) == 300


def test_exact_duplicates_of_hostile_rows(spark):
    got = exact_dedup.exact_duplicates(hostile.docs(spark)).collect()
    same = [r for r in got if r.group_size == 4]
    assert len(got) == len(hostile.TEXTS) and {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1
    assert all(sum(r.kept for r in got if r.text_sha256 == s) == 1 for s in {r.text_sha256 for r in got})
    assert exact_dedup.exact_duplicates(hostile.no_docs(spark)).count() == 0


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [f"  This is a Line that repeats, number {i:04}, long enough " for i in range(12)] + ["short", "", "x" * 39, "y" * 40]
    docs = [(rng.choice([i, i, i // 2]), "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 150)))) for i in range(60)]
    docs += [(None, pool[0]), (None, pool[0] + "\n" + pool[1].upper()), (3, None), (4, ""), (5, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((d if d is not None else -1, t) for (d, _), (t, _) in zip(docs, brute.drop_lines(docs)))
    got = line_dedup.drop_repeated_lines(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got) == want


def test_lines_of_hostile_rows(spark):
    docs = hostile.docs(spark)
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))  # nothing is in five documents
    assert line_dedup.drop_repeated_lines(hostile.no_docs(spark)).count() == 0


def test_line_dedup_runs_no_python(spark):
    docs = hostile.docs(spark)
    plan = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
