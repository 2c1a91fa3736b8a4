"""Live reputation: running state per address, and the addresses of a batch scored anew.

State is two tables in hash buckets of the address: totals per (address, agent), and the rhythm
of requests. Of the rhythm, time slices that the watermark has passed are one row per address;
open slices have a row for each instant, with the number of requests at it. A batch
reads the buckets of its addresses, merges its own totals and instants into them, closes
what the watermark has passed, and scores its addresses. It never reads the requests of earlier
batches; those are stored for the analysis of the whole log.

Rows that come later than the delay count in all totals, but no longer in the rhythm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators import profile
from tracewarden.plans.analysis import Dims, Result, analyze
from tracewarden.plans.reputation import ip_reputation
from tracewarden.streaming import tables
from tracewarden.streaming.state import BucketedState

_PARTS = ("first", "last", "low", "high", "squares")
_RHYTHM = ("ip", "slice", "us", "n", *_PARTS)


def slices_of_instants(instants: DataFrame) -> DataFrame:
    """Rhythm per (address, slice) from its instants (``us``) and how many requests (``n``) each has."""
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("ip", "slice").orderBy("us"))
    repeated = "if(max(n) > 1, 0L, NULL)"  # requests at one instant are no time apart
    return (
        instants.withColumn("gap", gap)
        .groupBy("ip", "slice")
        .agg(
            F.expr("sum(n) AS n"),
            F.expr("min(us) AS first"),
            F.expr("max(us) AS last"),
            F.expr(f"least(min(gap), {repeated}) AS low"),
            F.expr(f"greatest(max(gap), {repeated}) AS high"),
            F.expr("coalesce(sum(power(gap / 1e6D, 2)), 0D) AS squares"),
        )
    )


def joined_slices(slices: DataFrame) -> DataFrame:
    """All slices of an address as one: its number is that of the last, gaps between them count."""
    between = F.col("first") - F.lag("last").over(Window.partitionBy("ip").orderBy("slice"))
    return (
        slices.withColumn("gap", between)
        .groupBy("ip")
        .agg(
            F.expr("max(slice) AS slice"),
            F.expr("sum(n) AS n"),
            F.expr("min(first) AS first"),
            F.expr("max(last) AS last"),
            F.expr("least(min(low), min(gap)) AS low"),
            F.expr("greatest(max(high), max(gap)) AS high"),
            F.expr("sum(squares) + coalesce(sum(power(gap / 1e6D, 2)), 0D) AS squares"),
        )
    )


def segments(rhythm: DataFrame) -> DataFrame:
    """The rows of a rhythm as slices: the closed one of each address, and its open ones."""
    closed = rhythm.where("us IS NULL").select("ip", "slice", "n", *_PARTS)
    return closed.unionByName(slices_of_instants(rhythm.where("us IS NOT NULL").select("ip", "slice", "us", "n")))


def closed_before(rhythm: DataFrame, border: int) -> DataFrame:
    """The same rhythm with all slices before ``border`` in one row per address."""
    old = joined_slices(segments(rhythm.where(F.col("slice") < border)))
    old = old.withColumn("us", F.lit(None).cast("bigint")).select(*_RHYTHM)
    return old.unionByName(rhythm.where(F.col("slice") >= border).select(*_RHYTHM))


def with_instants(old: DataFrame | None, batch: DataFrame, border: int, cfg: Config) -> DataFrame:
    """The rhythm of a batch's addresses after it. Its rows before ``border`` come too late."""
    nothing = {name: F.lit(None).cast("double" if name == "squares" else "bigint") for name in _PARTS}
    new = profile.instants(batch, cfg).where(F.col("slice") >= border).groupBy("ip", "slice", "us").agg(F.count("*").alias("n"))
    new = new.withColumns(nothing).select(*_RHYTHM)
    if old is None:
        return new
    open_ = new.unionByName(old.where("us IS NOT NULL").select(*_RHYTHM))
    open_ = open_.groupBy("ip", "slice", "us").agg(F.sum("n").alias("n")).withColumns(nothing).select(*_RHYTHM)
    return open_.unionByName(old.where("us IS NULL").select(*_RHYTHM))


class _Clock:
    """The latest time seen, and the border that it sets: the first slice that is still open."""

    def __init__(self, spark: SparkSession, folder: str, delay_seconds: int, cfg: Config) -> None:
        self._spark, self._folder, self._delay, self._cfg = spark, f"{folder}/clock", delay_seconds, cfg

    def _border(self, us: int | None) -> int:
        if us is None:
            return -(1 << 62)
        return (us - self._delay * 1_000_000) // (self._cfg.slice_seconds * 1_000_000)

    def borders(self, batch: DataFrame, batch_id: int) -> tuple[int, int]:
        """Before and after a batch."""
        (last,) = batch.agg(F.max(F.unix_micros("timestamp"))).first()
        old = tables.before(self._spark, self._folder, batch_id, ("name",))
        before = old.agg(F.max("us")).first()[0] if old is not None else None
        after = max(t for t in (before, last) if t is not None)
        now = self._spark.createDataFrame([("latest", after)], "name string, us bigint").coalesce(1)
        tables.write_updates(now, self._folder, batch_id, ("name",))
        return self._border(before), self._border(after)


def states(spark: SparkSession, folder: str, buckets: int = 64, fold_every: int = 64) -> tuple[BucketedState, BucketedState]:
    """Totals per (address, agent), and rhythms per address."""
    return (
        BucketedState(spark, f"{folder}/agents", ("ip", "user_agent"), buckets, fold_every),
        BucketedState(spark, f"{folder}/rhythm", ("ip",), buckets, fold_every),
    )


def follow(
    requests: DataFrame, folder: str, checkpoint: str, cfg: Config = DEFAULT, refresh_seconds: int | None = 5,
    delay_seconds: int = 3600, buckets: int = 64, fold_every: int = 64,
):
    """Store requests under ``folder/requests``, state under ``agents`` and ``rhythm``, and scores under ``scores``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tables.write_batch(batch, f"{folder}/requests", batch_id)
        batch = spark.read.schema(batch.schema).parquet(f"{folder}/requests/batch_id={batch_id}")
        if batch.isEmpty():
            return
        agents, rhythm = states(spark, folder, buckets, fold_every)
        late, border = _Clock(spark, folder, delay_seconds, cfg).borders(batch, batch_id)
        agents.fold(batch_id)
        rhythm.fold(batch_id, lambda rows: closed_before(rows, border))
        touched, ips = agents.touched(batch), batch.select("ip").distinct()

        def theirs(state: BucketedState) -> DataFrame | None:
            rows = state.read(touched, below=batch_id)
            return None if rows is None else rows.join(ips, "ip", "left_semi")

        old, new = theirs(agents), profile.agent_profile(batch)
        if old is not None:
            changed = old.join(new.select("ip", "user_agent"), ["ip", "user_agent"], "left_semi")
            new = profile.merged_agents(new.unionByName(changed.select(*new.columns)))
        agents.write(new, batch_id)
        rhythm.write(closed_before(with_instants(theirs(rhythm), batch, late, cfg), border), batch_id)
        totals = profile.totals_of_agents(theirs_now(agents, touched, batch_id, ips))
        gaps = profile.rhythm_of_slices(segments(theirs_now(rhythm, touched, batch_id, ips)), cfg)
        scores = ip_reputation(profile.profile_of(totals, gaps), cfg)
        tables.write_updates(scores, f"{folder}/scores", batch_id, ("ip",))

    return tables.start(requests, checkpoint, handle, "append", refresh_seconds)


def theirs_now(state: BucketedState, touched: list[int], batch_id: int, ips: DataFrame) -> DataFrame:
    """The rows of a batch's addresses with the batch in them."""
    return state.read(touched, below=batch_id + 1).join(ips, "ip", "left_semi")


def current_scores(spark: SparkSession, folder: str) -> DataFrame:
    return tables.latest(tables.read_batches(spark, f"{folder}/scores"), ("ip",))


def current_analysis(spark: SparkSession, folder: str, dims: Dims | None = None, cfg: Config = DEFAULT) -> Result:
    """The whole analysis over everything stored so far, as each refresh shows it."""
    return analyze(tables.read_batches(spark, f"{folder}/requests").drop("batch_id"), dims, cfg)
