"""Hard negatives by threshold joins of anchors and rows.

Scores are inner products of whole-number vectors. A join finds the pairs that reach a threshold
of their anchor. Anchors are dealt into blocks, rows into slices; a task has one block and one
slice, sorted by id, and reads its rows in batches. Within a batch the dimensions are in the
order of the anchors' energy, and an inverted index holds, dimension by dimension, the rows for
which the dimension can still matter: what the norm of a row's remaining dimensions times that of
any anchor's keeps below the lowest threshold is left out. Partial scores are
accumulated along the index; pairs whose partial score and remaining norms miss the threshold
are pruned, the others are scored exactly.

An anchor has windows: its best positives in the first join, the best negatives below
each positive's limit in the second. Thresholds begin high and are lowered, for the anchors
whose windows are not full, until they are or until nothing lower counts; from then on the
worst entry of a full window is the threshold. Results of slices are ranked once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import checkpointed

#: Anchors of a block, rows of a slice and of a batch in it (the first one is smaller, because thresholds begin there).
ANCHOR_BLOCK, SLICE_ROWS, BATCH_ROWS, FIRST_ROWS = 2048, 1_000_000, 2048, 256
#: Tasks of a join at least.
LEAST_TASKS = 16
#: Dimensions that are accumulated at once.
STEP = 8
#: Where thresholds stand between the highest possible score and the lowest that counts, round by round.
LEVELS = (0.75, 0.5, 0.25, 0.1, 0.0)
LOWEST = -float(1 << 62)
#: Below this, scores and all their parts are exact in a double.
LARGEST = float(1 << 53)


def usable(rows: DataFrame, scale: float) -> DataFrame:
    """``vec_id, label, vector`` of ``vec_id, label, embedding``: components floor(scale * x).

    Rows with a null id, label, vector or component, or a component that is not finite, are left out.
    """
    number = F.col("embedding").cast("array<double>")
    whole = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))).select(
        "vec_id", "label", F.transform(number, lambda x: F.floor(x * scale)).alias("vector")
    )


class Side:
    """Vectors as a matrix, shorter ones filled up with zeros, with what goes with each."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.id = np.asarray(batch.column("vec_id"))
        self.row = np.asarray(batch.column("row"))
        self.label = np.asarray(batch.column("label"))
        lists = batch.column("vector")
        bounds = np.asarray(lists.offsets)
        sizes, values = np.diff(bounds), np.asarray(lists.values[bounds[0] : bounds[-1]])
        self.vector = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
        self.vector[np.arange(self.vector.shape[1]) < sizes[:, None]] = values


def _widened(vector: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vector, ((0, 0), (0, width - vector.shape[1])))


@dataclass
class Pairs:
    """Anchors, rows (as places in the batch) and scores."""

    anchor: np.ndarray
    row: np.ndarray
    score: np.ndarray


def norms_from(vectors: np.ndarray) -> np.ndarray:
    """Of every vector, the norms of its dimensions from each step on, and zero behind the last."""
    squares = np.pad(vectors * vectors, ((0, 0), (0, -vectors.shape[1] % STEP))).reshape(len(vectors), -1, STEP).sum(axis=2)
    left = np.sqrt(squares[:, ::-1].cumsum(axis=1)[:, ::-1])
    # rounding must never make a bound too low
    return np.pad(left * (1 + 1e-12), ((0, 0), (0, 1)))


def threshold_join(anchors: np.ndarray, rows: np.ndarray, threshold: np.ndarray) -> Pairs:
    """All pairs that score ``threshold`` of their anchor or more."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = _widened(anchors, width).astype(float), _widened(rows, width).astype(float)
    largest = np.sqrt((anchors**2).sum(axis=1).max(initial=0) * (rows**2).sum(axis=1).max(initial=0))
    if largest >= LARGEST:
        raise ValueError("scores of 2^53 and more are not exact")
    order = np.argsort(-(anchors**2).sum(axis=0), kind="stable")
    anchors, rows = anchors[:, order], rows[:, order]
    of_anchor, of_row = norms_from(anchors), norms_from(rows)
    # The index: of each row, the steps before the first whose remaining norms can't reach the lowest threshold.
    open_ = of_row * of_anchor.max(axis=0) >= threshold.min()
    steps = np.where(open_.all(axis=1), of_row.shape[1] - 1, open_.argmin(axis=1))
    place = np.argsort(-steps, kind="stable")
    place = place[: np.count_nonzero(steps)] if threshold.min() > 0 else place
    steps, rows, of_row = steps[place], rows[place], of_row[place]
    partial = np.zeros((len(anchors), len(rows)))
    for step in range(int(steps.max(initial=0))):
        n, dims = int(np.searchsorted(-steps, -step, "left")), slice(step * STEP, (step + 1) * STEP)
        partial[:, :n] += anchors[:, dims] @ rows[:n, dims].T
    missing = of_row[np.arange(len(rows)), steps] * of_anchor[:, steps]
    anchor, row = np.nonzero(partial + missing >= threshold[:, None])
    score = partial[anchor, row].astype(np.int64)
    for i in np.unique(steps[row]).tolist():  # what the index left out, for the pairs that may still reach it
        at = np.flatnonzero(steps[row] == i)
        if i * STEP < width:
            for part in np.array_split(at, len(at) // 100_000 + 1):
                rest = anchors[anchor[part], i * STEP :] * rows[row[part], i * STEP :]
                score[part] += rest.sum(axis=1).astype(np.int64)
    reached = score >= threshold[anchor]
    return Pairs(anchor[reached], place[row[reached]], score[reached])


class Windows:
    """The best ``size`` entries of each window: scores between ``low`` and ``high``, ties to what came first."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> None:
        self.anchor, self.low, self.high, self.size = anchor, low, high, size
        empty = np.zeros(0, np.int64)
        self.window, self.score, self.id, self.row = empty, empty, empty, empty

    def floors(self) -> np.ndarray:
        """The lowest score that a window would still take: a tie comes too late, because rows come by id."""
        floor = self.low.copy()
        full = np.flatnonzero(np.bincount(self.window, minlength=len(floor)) >= self.size)
        worst = np.full(len(floor), np.inf)
        np.minimum.at(worst, self.window, self.score)
        floor[full] = np.maximum(floor[full], worst[full] + 1)
        return floor

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Rows of one batch, which come by id; entries from before stay ahead of them."""
        if not len(window):
            return
        window, score = np.concatenate((self.window, window)), np.concatenate((self.score, score))
        id_, row = np.concatenate((self.id, id_)), np.concatenate((self.row, row))
        order = np.lexsort((row, id_, -score, window))
        window = window[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window, "left")
        kept = order[rank < self.size]
        self.window, self.score, self.id, self.row = window[rank < self.size], score[order][rank < self.size], id_[kept], row[kept]


def fill_windows(anchors: Side, rows: Side, windows: Windows, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Take a batch of rows into the windows, by joins with thresholds that fall.

    ``fits(anchor, row)`` says which pairs may count at all.
    """
    bound = np.sqrt((anchors.vector.astype(float) ** 2).sum(axis=1) * (rows.vector.astype(float) ** 2).sum(axis=1).max(initial=0)) + 1
    top = np.minimum(windows.high, bound[windows.anchor])
    above = np.full(len(top), np.inf)
    waiting = np.arange(len(top))
    for level in LEVELS:
        floor = windows.floors()
        lowest = np.where(floor > LOWEST, floor, -bound[windows.anchor])
        # full windows, and those that nothing lower would fill, go down to their floor at once
        now = np.where(floor > windows.low, lowest, np.maximum(lowest, lowest + (top - lowest) * level))
        waiting = waiting[(above[waiting] > lowest[waiting]) & (top[waiting] >= lowest[waiting])]
        if not len(waiting):
            return
        threshold = np.full(len(anchors.id), np.inf)
        np.minimum.at(threshold, windows.anchor[waiting], now[waiting])
        asked = np.flatnonzero(threshold < np.inf)
        pairs = threshold_join(anchors.vector[asked], rows.vector, threshold[asked])
        pairs.anchor = asked[pairs.anchor]
        good = fits(pairs.anchor, pairs.row)
        _take(windows, waiting, now, above, Pairs(pairs.anchor[good], pairs.row[good], pairs.score[good]), rows)
        above[waiting] = now[waiting]


def _take(windows: Windows, waiting: np.ndarray, now: np.ndarray, above: np.ndarray, pairs: Pairs, rows: Side) -> None:
    """Pairs between this round's threshold and the last one's, for each window of their anchor."""
    by_anchor = waiting[np.argsort(windows.anchor[waiting], kind="stable")]
    owners = windows.anchor[by_anchor]
    first, last = np.searchsorted(owners, pairs.anchor, "left"), np.searchsorted(owners, pairs.anchor, "right")
    for nth in range(int((last - first).max(initial=0))):  # an anchor has a handful of windows
        has = np.flatnonzero(first + nth < last)
        window, score = by_anchor[first[has] + nth], pairs.score[has]
        inside = (score >= now[window]) & (score < above[window]) & (score <= windows.high[window])
        at = has[inside]
        windows.add(window[inside], pairs.score[at], rows.id[pairs.row[at]], rows.row[pairs.row[at]])


def _search(size: int, same_label: bool):
    """One task's share: keys by turns, of each the anchors, then the rows by id."""
    fields = [("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("limit", pa.int64()),
              ("found_id", pa.int64()), ("found_row", pa.int64()), ("score", pa.int64())]

    class Share:
        def __init__(self) -> None:
            self.heads: list[pa.RecordBatch] = []
            self.rows: list[pa.RecordBatch] = []
            self.held, self.most, self.anchors = 0, FIRST_ROWS, None

        def start(self) -> None:
            heads = pa.Table.from_batches(self.heads).combine_chunks().to_batches()[0]
            self.anchors = Side(heads)
            limits = heads.column("limits")
            bounds = np.asarray(limits.offsets)
            self.limit = np.asarray(limits.values[bounds[0] : bounds[-1]])
            owner = np.repeat(np.arange(len(self.anchors.id)), np.diff(bounds))
            if same_label:  # one window for each anchor, whatever it scores
                low, high = np.full(len(owner), LOWEST), np.full(len(owner), np.inf)
            else:
                low, high = (-(-self.limit // 2)).astype(float), (self.limit * 95 // 100).astype(float)
            self.windows = Windows(owner, low, high, size)

        def flush(self) -> None:
            if self.heads and self.rows:
                if self.anchors is None:
                    self.start()
                rows = Side(pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0])
                a = self.anchors

                def fits(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
                    if same_label:
                        return (a.id[anchor] != rows.id[row]) | (a.row[anchor] != rows.row[row])
                    return a.label[anchor] != rows.label[row]

                fill_windows(a, rows, self.windows, fits)
            self.rows, self.held, self.most = [], 0, BATCH_ROWS

        def add(self, part: pa.RecordBatch, anchors: bool) -> None:
            if anchors:
                self.heads.append(part)
                return
            at = 0
            while self.heads and at < part.num_rows:
                taken = part.slice(at, self.most - self.held)
                self.rows.append(taken)
                self.held, at = self.held + taken.num_rows, at + taken.num_rows
                if self.held == self.most:
                    self.flush()

        def result(self) -> Iterator[pa.RecordBatch]:
            self.flush()
            if self.anchors is not None and len(self.windows.window):
                w = self.windows
                owner = w.anchor[w.window]
                columns = (self.anchors.id[owner], self.anchors.row[owner], self.limit[w.window], w.id, w.row, w.score)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, key = Share(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [np.asarray(batch.column(c)) for c in ("group", "block", "slice", "kind")]
            changes = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            borders = [0, *changes.tolist(), batch.num_rows]
            for begin, end in zip(borders, borders[1:]):
                own = tuple(int(m[begin]) for m in marks[:3])
                if own != key:
                    yield from share.result()
                    share, key = Share(), own
                share.add(batch.slice(begin, end - begin), anchors=marks[3][begin] == 0)
        yield from share.result()

    return run, "anchor_id long, anchor_row long, limit long, found_id long, found_row long, score long"


def _join(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, size: int, same_label: bool) -> DataFrame:
    """What each (block of anchors, slice of rows) finds: ``size`` entries of every window at most.

    Rows meet every block once; anchors meet every slice once. Where labels must be equal they are part of the key.
    """
    blocks = max(1, -(-n_anchors // ANCHOR_BLOCK))
    slices = max(-(-LEAST_TASKS // blocks), -(-n_rows // SLICE_ROWS))
    group = F.col("label") if same_label else F.lit(0)
    dealt = F.xxhash64("vec_id", "row", F.lit(5))

    def side(df: DataFrame, kind: int, block: Column, slice_: Column, limits: Column) -> DataFrame:
        return df.select(
            group.cast("long").alias("group"), block.cast("long").alias("block"), "vec_id", "row",
            F.col("label").cast("long").alias("label"), "vector", limits.cast("array<long>").alias("limits"), F.lit(kind).alias("kind"),
            slice_.cast("long").alias("slice"),
        )

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    heads = side(anchors, 0, F.pmod(dealt, F.lit(blocks)), F.lit(0), F.col("limits")).withColumn("slice", every(slices))
    bodies = side(rows, 1, F.lit(0), F.pmod(F.shiftright(dealt, 20), F.lit(slices)), F.lit(None)).withColumn("block", every(blocks))
    run, schema = _search(size, same_label)
    keys = ["group", "block", "slice"]
    return (
        heads.unionByName(bodies)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "kind", "vec_id", "row")
        .mapInArrow(run, schema)
    )


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, vector`` (whole numbers). An anchor's positives are its best
    ``positives`` other rows of the same label; for each, the best ``negatives`` rows of other labels are returned
    whose score is between 50 and 95 percent of the positive's. Higher scores come first, then smaller ids.

    Defined cases: rows with a null in any of the three columns, or in a vector, take no part; exact repeats count
    once, other rows of one id are rows of their own (ties between them go by a hash); missing
    components of shorter vectors count as zero; anchors without positives, and positives without
    negatives, give no rows; components that no int holds, and scores of 2^53 and more, end the job with a message. Other columns are not read.
    """
    own = F.xxhash64("label", "vector").alias("row")
    rows = rows.select("vec_id", "label", F.col("vector").cast("array<int>").alias("vector"))
    rows = rows.dropna().where(F.forall("vector", lambda x: x.isNotNull())).distinct()
    rows = checkpointed(rows.select("vec_id", "label", "vector", own))
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()

    def best(df: DataFrame, n: int) -> DataFrame:
        by = Window.partitionBy("anchor_id", "anchor_row", "limit").orderBy(F.desc("score"), "found_id", "found_row")
        return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)

    any_score = F.array(F.lit(0).cast("long"))
    found = best(_join(anchors.withColumn("limits", any_score), rows, n_anchors, n_rows, positives, True), positives)
    found = checkpointed(found.select("anchor_id", "anchor_row", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a limit below zero leaves no scores between its half and its 95 percent
    limits = found.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row"))
    limited = anchors.join(limits.agg(F.sort_array(F.collect_set("positive_score")).alias("limits")), ["vec_id", "row"])
    hard = best(_join(limited, rows, n_anchors, n_rows, negatives, False), negatives)
    hard = hard.select(
        "anchor_id", "anchor_row", F.col("limit").alias("positive_score"), F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    return found.join(hard, ["anchor_id", "anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
