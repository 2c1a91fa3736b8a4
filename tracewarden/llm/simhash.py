"""Near-duplicates by SimHash, linked through BK-trees.

A fingerprint has a bit set where over half the hashes of a text's word shingles have it.
Fingerprints within ``RADIUS`` bits are linked, components of links are groups.

Equal fingerprints are made one row first, so a group of copies of any size costs one row.
Two fingerprints within 3 bits agree on at least one of four blocks of bits, and on two of
five, so a shard is a choice of blocks and (the first bits of) their value, and every link
lies within some shard. How many bits grows with the number of fingerprints, so that shards
hold about ``TREE_SIZE`` at any scale. A shard that has more is cut into
pieces of at most about ``TREE_SIZE`` nodes; each piece becomes a BK-tree, whose children
are keyed by their Hamming distance to the parent, and the tree is sent to the slices of the
probes of its own shard. A search follows only the edges within the radius of the probe's
distance to the node. A shard that many near copies share has many pieces, and each pair of
pieces is a task's work of fixed size. A search returns no pairs but the groups they make:
at most one connection for each fingerprint that took part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import checkpointed, free_prefix, text_of
from tracewarden.llm.components import connected

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TREE_SIZE = 2048
#: Probes searched at once.
_PROBES = 512
#: Shingles counted at once.
_SHINGLES = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text; 0 if it has no words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the ASCII blanks
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle_words, len(words))
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))[: len(words) - size + 1]
    ends = np.concatenate((blanks, [len(joined)]))[size - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES):
        spans = zip(starts[at : at + _SHINGLES].tolist(), ends[at : at + _SHINGLES].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.dtype(">u8"))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_hash, fp`` (a signed long with the 64 bits) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle_words) for t in batch.column(1)], np.uint64)
            out = {"doc_id": batch.column(0), "text_hash": batch.column(2), "fp": pa.array(found.view(np.int64))}
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash())
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def _text_hash() -> Column:
    """Tells rows with the same id and different texts apart; null and empty texts are alike."""
    return F.xxhash64(text_of()).alias("text_hash")


class BKTree:
    """A BK-tree in two arrays. Nodes are numbered level by level, and ``keys`` (65 times the
    parent's number plus the distance to it) ascend, so children within a range of distances
    are neighbours."""

    def __init__(self, prints: np.ndarray, keys: np.ndarray) -> None:
        self.prints, self.keys = prints, keys

    @classmethod
    def build(cls, prints: np.ndarray) -> BKTree:
        """From distinct prints: at each node, the first print at a distance becomes the child, the others go on below it."""
        nodes, keys = [prints[:1]], [np.array([-1], np.int64)]
        waiting, parent, made = prints[1:], np.zeros(len(prints) - 1, np.int64), 1
        while len(waiting):
            known = np.concatenate(nodes) if len(nodes) > 1 else nodes[0]
            key = 65 * parent + np.bitwise_count(waiting ^ known[parent])
            children, first, child_of = np.unique(key, return_index=True, return_inverse=True)
            nodes.append(waiting[first])
            keys.append(children)
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, parent, made = waiting[rest], made + child_of[rest], made + len(children)
        return cls(np.concatenate(nodes), np.concatenate(keys))

    def within(self, probes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the probe, number of the node) at most ``radius`` apart, a level at a time."""
        probe, node = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        while len(probe):
            far = np.bitwise_count(probes[probe] ^ self.prints[node]).astype(np.int64)
            hit = far <= radius
            yield probe[hit], node[hit]
            low = np.searchsorted(self.keys, 65 * node + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.keys, 65 * node + np.minimum(far + radius, 64), "right")
            n = high - low
            probe = np.repeat(probe, n)
            node = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(probe))


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make labels equal along the pairs (a, b): the smallest label of each component."""
    a, b = labels[a], labels[b]
    while True:
        open_pairs = a != b
        a, b = a[open_pairs], b[open_pairs]
        if not len(a):
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further
        a, b = labels[a], labels[b]


def connections(tree: BKTree, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that links between probes and nodes make, as connections (print, print)."""
    n = len(tree.prints)
    labels = np.arange(n + len(probes))
    for at in range(0, len(probes), _PROBES):
        for probe, node in tree.within(probes[at : at + _PROBES], radius):
            _merge(labels, n + at + probe, node)
    prints = np.concatenate((tree.prints, probes))
    joined = np.flatnonzero(prints != prints[labels])
    return prints[joined], prints[labels[joined]]


def _grow_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = BKTree.build(np.sort(pdf["fp"].to_numpy()).view(np.uint64))
    head = pdf[["block", "value", "piece", "pieces"]].iloc[:1].reset_index(drop=True)
    return head.assign(prints=[tree.prints.tobytes()], keys=[tree.keys.tobytes()])


def _search(radius: int):
    def search(trees: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(probes):
            return pd.DataFrame({"a": [], "b": []})
        tree = BKTree(np.frombuffer(trees["prints"][0], np.uint64), np.frombuffer(trees["keys"][0], np.int64))
        a, b = connections(tree, probes["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return search


def shard_masks(n: int, radius: int, tree_size: int) -> list[int]:
    """Masks (signed) such that prints within ``radius`` bits are equal under at least one.

    Of ``radius + c`` blocks, c are free of differences. c is 1 until a block has too few
    bits to bring ``n`` prints down to ``tree_size`` in a shard.
    """
    bits, c = (n // tree_size).bit_length(), 1
    while c < 4 and bits > c * (64 // (radius + c)):
        c += 1
    width = 64 // (radius + c)
    used = min(width, -(-bits // c))
    block = [((1 << used) - 1) << (64 - width * k - used) for k in range(radius + c)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(x) for x in combinations(block, c))]


def links(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Connections ``a, b`` between the distinct fingerprints ``fp``; their components are those of all links."""
    shards = F.array(
        *[
            F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value"))
            for k, mask in enumerate(shard_masks(prints.count(), radius, tree_size))
        ]
    )
    members = prints.select("fp", F.explode(shards).alias("s")).select("fp", "s.block", "s.value")
    sizes = members.groupBy("block", "value").agg(F.ceil(F.count("*") / tree_size).cast("int").alias("pieces"))
    members = members.join(sizes, ["block", "value"])
    members = members.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    members = checkpointed(members.where(F.col("fp").isNotNull()))
    trees = members.groupBy("block", "value", "piece").applyInPandas(
        _grow_tree, "block int, value long, piece int, pieces int, prints binary, keys binary"
    )
    own = ["block", "value", "tree", "slice"]
    sent = trees.withColumn("tree", F.col("piece")).withColumn("slice", F.explode(F.sequence("piece", F.col("pieces") - 1)))
    probing = members.withColumn("slice", F.col("piece")).withColumn("tree", F.explode(F.sequence(F.lit(0), "piece")))
    return (
        sent.select(*own, "prints", "keys")
        .groupBy(*own)
        .cogroup(probing.select(*own, "fp").groupBy(*own))
        .applyInPandas(_search(radius), "a long, b long")
    )


def _grouped(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row, and ``root``, one fingerprint of its group."""
    marked = checkpointed(fingerprints(docs, shingle_words))
    prints = checkpointed(marked.select("fp").distinct())
    roots = connected(links(prints, radius, tree_size)).select(F.col("node").alias("fp"), "root")
    placed = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return marked.join(placed, "fp")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_size: int = TREE_SIZE
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``component_id`` is the smallest id of the group.

    Defined cases: a null or empty text, or one of blanks only, has fingerprint 0 and links
    like any other; a text of fewer words than a shingle is one shingle; null ids are no
    group's smallest (a group of null ids only has a null ``component_id``); repeated rows all
    come out; an empty table gives no rows. Other columns are not read.
    """
    placed = _grouped(docs, shingle_words, radius, tree_size)
    smallest = placed.groupBy("fp", "root").agg(F.min("doc_id").alias("id")).groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(smallest, "root").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id.

    Rows are told apart by id and text: of rows with one id in one group, that with the smallest text
    hash stays; in different groups each stays. Exact repeats are one row. A row without an id can't be
    named as anyone's copy and stays. Columns may have any name.
    """
    prefix = free_prefix(docs)
    id_, hash_, nth = (prefix + n for n in ("id", "hash", "nth"))
    placed = _grouped(docs, **settings).where("doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_hash"))
    stays = placed.groupBy("fp", "root").agg(first.alias("first")).groupBy("root").agg(F.min("first").alias("first"))
    stays = stays.select(F.col("first.doc_id").alias(id_), F.col("first.text_hash").alias(hash_))
    same = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hash_))
    named = docs.join(stays, same, "left_semi")
    again = Window.partitionBy("doc_id", F.xxhash64(text_of())).orderBy(F.xxhash64("text"))
    named = named.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).drop(nth)
    return named.unionByName(docs.where("doc_id is null"))


def shown(fp: str = "fp") -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
