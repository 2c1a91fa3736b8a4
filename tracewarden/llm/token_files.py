"""Token ids in files, as frequency ranks in byte-aligned variable-length code.

Documents are range-partitioned and sorted by id, so files follow one another in ascending
``doc_id``. A file is a sequence of blocks; a block holds whole documents up to about
``BLOCK_IDS`` ids and carries its own rank table, which lists its distinct ids from the most
frequent to the rarest (ties: smaller id first). Each id is written as its rank: a byte if
below 2^8, else two, three or four. How many is told by two bits in the control bytes, four
ids to a byte, kept apart from the data bytes, so a reader finds all lengths by looking the
control bytes up in a table and never tests a byte of data.

Files are parquet with one row for each block, because Spark commits them whole or not at
all when executors are lost: ``part, block, doc_ids, counts, ranks, control, data``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.chunks import SLICE_BYTES, LibraryEncoder, slices, table_of
from tracewarden.llm.common import checkpoint_folder, text_of

END_ID = 2
#: Ids after which a block is closed. A longer document is a block of its own.
BLOCK_IDS = 1_000_000
BLOCK = "part int, block int, doc_ids array<long>, counts array<long>, ranks binary, control binary, data binary"
#: Lengths of the four values that a control byte stands for.
LENGTHS = np.array([[(b >> s & 3) + 1 for s in (0, 2, 4, 6)] for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rank table, control bytes and data bytes of some ids."""
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")
    distinct = order[: np.count_nonzero(counts)]
    rank_of = np.empty(len(counts), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[ids]
    lengths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) < lengths[:, None]]
    return distinct.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(n: int, ranks: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids back. Lengths come from the control bytes by table, values by shifted look-ups of data."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = np.zeros(n, np.uint32)
    for place in range(int(lengths.max(initial=0))):
        values |= np.where(lengths > place, raw[starts + place], 0).astype(np.uint32) << np.uint32(8 * place)
    return np.frombuffer(ranks, "<u4")[values]


def _blocks(file: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number, part = table_of(LibraryEncoder, file), 0, -1
        docs, counts = [], []
        ids, size = np.empty(block_ids + SLICE_BYTES, np.uint32), 0

        def block() -> pa.RecordBatch:
            ranks, control, data = pack(ids[:size])
            row = [part], [number], [pa.concat_arrays(docs)], [np.concatenate(counts)], [ranks], [control], [data]
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)],
                names=["part", "block", "doc_ids", "counts", "ranks", "control", "data"],
            )

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for begin, texts in slices(batch.column(1)):
                sizes, new = table.encode_texts(texts)
                total = len(new) + len(sizes)
                if size + total > len(ids):  # a text longer than a slice
                    ids = np.concatenate((ids[:size], np.empty(total, np.uint32)))
                # every id moves by the number of end ids before it
                ends = np.cumsum(sizes + 1)
                room = ids[size : size + total]
                room[ends - 1] = end_id
                taken = np.ones(total, bool)
                taken[ends - 1] = False
                room[taken] = new
                docs.append(batch.column(0).slice(begin, len(texts)))
                counts.append(sizes + 1)
                size += total
                if size >= block_ids:
                    yield block()
                    docs, counts, size, number = [], [], 0, number + 1
        if docs:
            yield block()

    return write


def write_tokens(docs: DataFrame, path: str, file: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text with the tokenizer ``file`` and write the token files to ``path``.

    Defined cases: a null text is empty (only the end id is written), a null ``doc_id`` comes
    last, rows with the same id follow one another by a hash of their texts, an empty table
    writes no block. Other columns are not read.
    """
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(_blocks(file, end_id, block_ids), BLOCK)
        .write.parquet(path)
    )


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the number of ids in all blocks before."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    n_ids = F.aggregate("counts", F.lit(0).cast("long"), lambda total, n: total + n)
    sizes = blocks.select("part", "block", n_ids.alias("n"))
    starts, total = [], 0
    for row in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row per file
        starts.append((row["part"], total))
        total += row["n"]
    starts = spark.createDataFrame(starts, "part int, part_start long")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "part")
    return blocks.join(placed.select("part", "block", (F.col("part_start") + F.col("before")).alias("start")), ["part", "block"])


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files and, if wanted, ``ids``."""
    wanted = ", ids array<int>" if keep_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = unpack(int(counts.sum()), row["ranks"], row["control"], row["data"])
                ends = np.cumsum(counts)
                split = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                out = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["start"] + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in split], pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in split], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    blocks = read_blocks(spark, path).select("doc_ids", "counts", "ranks", "control", "data", "start")
    return blocks.mapInArrow(read, f"doc_id long, start long, n_tokens long, ids_crc32 long{wanted}")


def own_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
