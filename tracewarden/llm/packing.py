"""Packing documents into windows of tokens with their lexical neighbours.

1. Every text is encoded and cut into units: windows of ``WINDOW`` ids that a long document fills
   alone, and what is left of it. Units go to the shared folder, with the number of documents
   that hold each id beside them, a row for each task.
2. Units that fill no window are range-partitioned by a short content code (a SimHash of the
   distinct ids), then by a hash, so texts of one kind come to lie near each other and a group of
   copies of any size is dealt over many tasks.
3. A task reads its units in order, a shard of up to ``SHARD_UNITS`` units and ``SHARD_IDS`` ids at a time,
   and builds the shard's inverted index: postings with BM25 weights by corpus-wide
   document frequencies. The first unused unit is the seed of a window; the index scores all
   units that share an id with it, and the unused ones fill the window in order of score. The
   last one is cut at the window's end, and its rest is the next window's seed.
4. The window open at the end of a shard goes on in the next one. At the end of a task it is
   cut into sequences of powers of two, so nothing is padded at all.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.chunks import LibraryEncoder, load_vocabulary, runs, slices, table_of
from tracewarden.llm.common import checkpoint_folder, text_of

WINDOW = 4096
END_ID = 2
#: A shard is closed when it has so many units or ids.
SHARD_UNITS, SHARD_IDS = 2048, 1_500_000
#: BM25's usual settings.
K1, B = 1.2, 0.75
CODE_BITS = 16

UNITS = "doc_id long, start long, length int, doc_tokens long, crc long, code int, ids binary, hold_ids array<int>, hold_n array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Stats:
    """What BM25 needs of the corpus: document frequency of every id, documents, and ids a unit has on average."""

    idf: np.ndarray
    average: float


def vocabulary_size(file: str) -> int:
    told = load_vocabulary(file)
    return 1 + max([*told["model"]["vocab"].values(), *[t["id"] for t in told["added_tokens"]]])


def id_type(size: int) -> str:
    """How ids are stored: in two bytes where the vocabulary allows it."""
    return "<u2" if size <= 1 << 16 else "<u4"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@lru_cache(maxsize=1)
def signs(size: int) -> np.ndarray:
    """Of each id, a fixed random sign for each bit of the content code."""
    return np.random.default_rng(12).choice(np.array([-1, 1], np.int8), (size, CODE_BITS))


def distinct(ids: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of every text in order, their numbers, and where each text's begin (with the total at the end)."""
    kind = np.uint32 if len(ends) * size < 1 << 32 else np.int64  # short keys are sorted much faster
    firsts = np.arange(len(ends)).astype(kind) * kind(size)
    keys, counts = np.unique(np.repeat(firsts[:-1], np.diff(ends)) + ids.astype(kind), return_counts=True)
    return (keys % kind(size)).astype(np.int64), counts, np.searchsorted(keys, firsts)


def codes(terms: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The content code of every text: which way most of its ids point, bit by bit. No text here is without ids."""
    sums = np.add.reduceat(signs(size)[terms], starts[:-1], axis=0, dtype=np.int32)
    return (sums > 0) @ (1 << np.arange(CODE_BITS))


def _encode(file: str, size: int, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, stored = table_of(LibraryEncoder, file), id_type(size)
        holders = np.zeros(size, np.int64)
        names = [c.split()[0] for c in UNITS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                sizes, ids = table.encode_texts(texts)
                ends = np.concatenate(([0], np.cumsum(sizes + 1)))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                terms, _, starts = distinct(ids, ends, size)
                holders += np.bincount(terms, minlength=size)
                code = codes(terms, starts, size).tolist()
                docs = batch.column(0).slice(begin, len(texts)).to_pylist()
                rows = []
                for i, (doc, first, last) in enumerate(zip(docs, ends[:-1].tolist(), ends[1:].tolist())):
                    for at in range(first, last, window):
                        unit = ids[at : min(at + window, last)]
                        rows.append((doc, at - first, len(unit), last - first, crc(unit), code[i], unit.astype(stored).tobytes(), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        held = np.flatnonzero(holders)
        row = [None] * 7 + [held.astype(np.int32), holders[held]]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return run


def store_units(docs: DataFrame, path: str, file: str, end_id: int = END_ID, window: int = WINDOW) -> None:
    """Encode every text and write its units to ``path``; the last row of each task counts the holders of ids."""
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .mapInArrow(_encode(file, vocabulary_size(file), end_id, window), UNITS)
        .write.parquet(path)
    )


def corpus_stats(units: DataFrame, size: int) -> Stats:
    """Statistics over all documents. The driver sees one row for each id of the vocabulary, and totals."""
    held = units.where("hold_ids IS NOT NULL").select(F.explode(F.arrays_zip("hold_ids", "hold_n")).alias("h"))
    n = np.zeros(size)
    for row in held.groupBy("h.hold_ids").agg(F.sum("h.hold_n").alias("n")).collect():  # at most the vocabulary
        n[row["hold_ids"]] = row["n"]
    own = units.where("hold_ids IS NULL")
    docs, average = own.agg(F.expr("count_if(start = 0)"), F.avg("length")).first()
    return Stats(np.log1p((docs - n + 0.5) / (n + 0.5)).astype(np.float32), average or 1.0)


class Shard:
    """An inverted index over some units. Units are handed out once."""

    def __init__(self, units: list[np.ndarray], stats: Stats) -> None:
        self.units, size = units, len(stats.idf)
        self.lengths = np.array([len(u) for u in units])
        ends = np.concatenate(([0], np.cumsum(self.lengths)))
        self.terms, counts, self.starts = distinct(np.concatenate(units).astype(np.int64), ends, size)
        owner = np.repeat(np.arange(len(units)), np.diff(self.starts))
        weight = stats.idf[self.terms] * (counts * (K1 + 1) / (counts + K1 * (1 - B + B * self.lengths[owner] / stats.average)))
        order = np.argsort(self.terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order].astype(np.float32)
        self.begin = np.searchsorted(self.terms[order], np.arange(size + 1))
        self.unused = np.ones(len(units), bool)

    def scores(self, unit: int) -> np.ndarray:
        """BM25 of every unit for the distinct ids of one."""
        asked = self.terms[self.starts[unit] : self.starts[unit + 1]]
        first, n = self.begin[asked], self.begin[asked + 1] - self.begin[asked]
        postings, _ = runs(first, n)
        return np.bincount(self.owner[postings], self.weight[postings], len(self.units))

    def neighbours(self, unit: int) -> np.ndarray:
        """The unused units, best first, ties by place."""
        rest = np.flatnonzero(self.unused)
        return rest[np.argsort(-self.scores(unit)[rest], kind="stable")]


@dataclass
class Piece:
    """``length`` ids of a unit from ``begin`` on."""

    unit: object
    begin: int
    length: int


class Windows:
    """Windows being filled. ``emit`` takes the pieces of every full one."""

    def __init__(self, window: int) -> None:
        self.window, self.pieces, self.room = window, [], window
        self.full: list[list[Piece]] = []

    def put(self, unit, begin: int, length: int) -> bool:
        """Add the ids of a unit from ``begin`` on; whether a window got full, whose rest opens the next one."""
        closed = False
        while length:
            n = min(length, self.room)
            self.pieces.append(Piece(unit, begin, n))
            self.room, begin, length = self.room - n, begin + n, length - n
            if not self.room:
                self.full.append(self.pieces)
                self.pieces, self.room, closed = [], self.window, True
        return closed

    def tail(self) -> list[list[Piece]]:
        """What is left, as sequences of powers of two."""
        left, pieces, out = self.window - self.room, self.pieces, []
        self.pieces, self.room = [], self.window
        for power in (1 << p for p in range(left.bit_length() - 1, -1, -1)):
            if left & power:
                sequence, need = [], power
                while need:
                    head = pieces[0]
                    n = min(need, head.length)
                    sequence.append(Piece(head.unit, head.begin, n))
                    need -= n
                    pieces = pieces[1:] if n == head.length else [Piece(head.unit, head.begin + n, head.length - n), *pieces[1:]]
                out.append(sequence)
        return out


def fill(shard: Shard, rows: list, windows: Windows) -> None:
    """Hand out all units of a shard: seeds in order, each followed by its neighbours until a window is full."""
    seed, following = None, 0
    while True:
        if seed is None:
            while following < len(rows) and not shard.unused[following]:
                following += 1
            if following == len(rows):
                return
            seed, shard.unused[following] = following, False
            windows.put(rows[seed], 0, int(shard.lengths[seed]))
        for unit in shard.neighbours(seed).tolist():
            shard.unused[unit] = False
            if windows.put(rows[unit], 0, int(shard.lengths[unit])):
                break
        else:
            return
        seed = unit if windows.pieces else None  # the rest of the cut unit goes on


def _pack(stats, stored: str, window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, part, number = Windows(window), 0, 0
        rows: list[tuple] = []
        held = 0

        def shown(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[tuple] = []
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    doc_id, start, doc_tokens, ids = p.unit
                    own = ids[p.begin : p.begin + p.length]
                    # odd numbers: documents that fill a window alone have the even ones
                    row = (doc_id, start + p.begin, p.length, crc(own), doc_tokens, 2 * (part << 33 | number) + 1, offset)
                    out.append((*row, own.astype(np.int32)) if keep_ids else row)
                    offset += p.length
                number += 1
            if out:
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out))[:7]]
                columns += [pa.array([r[7] for r in out], pa.list_(pa.int32()))] if keep_ids else []
                names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if rows:
                fill(Shard([r[3] for r in rows], stats.value), rows, windows)
            full, windows.full, rows, held = windows.full, [], [], 0
            yield from shown(full)

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                for r in batch.slice(begin, 500).to_pylist():
                    part = r["part"]
                    rows.append((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], stored)))
                    held += len(rows[-1][3])
                    if len(rows) >= SHARD_UNITS or held >= SHARD_IDS:
                        yield from close()
        yield from close()
        yield from shown(windows.tail())

    return run


def own_folder(spark: SparkSession) -> str:
    """A new folder for units in the shared folder."""
    return f"{checkpoint_folder(spark)}/packing-{uuid.uuid4().hex}"


def pack_documents(docs: DataFrame, file: str, end_id: int = END_ID, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece and, if wanted, its ``ids``.

    Every id of every document (with ``end_id`` behind its text) lies in exactly one piece;
    sequences have ``window`` ids or a smaller power of two, so ``window`` must be one itself.
    Defined cases: a null text is empty and consists of the end id, rows of one id (or of none) are
    documents of their own, an empty table has no pieces. Other columns are not read.
    ``file`` is a path that every executor has.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark, path, size = docs.sparkSession, own_folder(docs.sparkSession), vocabulary_size(file)
    store_units(docs, path, file, end_id, window)
    stored = spark.read.schema(UNITS).parquet(path)
    stats = spark.sparkContext.broadcast(corpus_stats(stored, size))  # one number for each id of the vocabulary
    units = stored.where("hold_ids IS NULL")
    kept = ", ids array<int>" if keep_ids else ""
    order = [F.col("code"), F.xxhash64("doc_id", "start", "crc")]
    packed = (
        units.where(F.col("length") < window)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "doc_id", "start", "crc")
        .select("doc_id", "start", "doc_tokens", "ids", F.spark_partition_id().alias("part"))
        .mapInArrow(_pack(stats, id_type(size), window, keep_ids), PIECES + kept)
    )
    alone = units.where(F.col("length") == window).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (2 * F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *[_as_ids(size).alias("ids")] * keep_ids,
    )
    return alone.unionByName(packed)


def _as_ids(size: int):
    """Stored ids as numbers: hexadecimal digits of each, with their bytes turned round."""
    width = 2 * int(id_type(size)[-1])
    digits = F.regexp_extract_all(F.hex("ids"), F.lit("." * width), F.lit(0))
    turned = F.transform(digits, lambda d: F.concat(*[F.substring(d, i, 2) for i in range(width - 1, 0, -2)]))
    return F.transform(turned, lambda d: F.conv(d, 16, 10).cast("int"))
