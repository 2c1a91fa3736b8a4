"""One registered query for each operator, over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import (
    bpe,
    chat,
    exact_dedup,
    fill_middle,
    hard_negatives,
    line_dedup,
    mixing,
    packing,
    secrets,
    simhash,
    sketches,
    token_files,
    toxicity,
)
from tracewarden.llm.common import text_of

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The tokenizer of op4, op10 and op12: a file that every executor has.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.shown("fp").alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(
        spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    )
    formatted = chat.format_conversations(turns)
    read = formatted.select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.own_folder(spark)
    token_files.write_tokens(_table(spark, folder, "documents"), path, vocabulary_file())
    return token_files.read_tokens(spark, path, keep_ids=False)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    marked = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    lines = line_dedup.lines_of(text_of())
    return marked.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.array_join(line_dedup.kept_lines(lines, F.col("_bitmap")), "\n"), 256).alias("kept_sha256"),
    )


def op8_sketches(spark: SparkSession, folder: str) -> DataFrame:
    rows = sketches.with_next(_table(spark, folder, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    return sketches.compare_versions(rows.select("doc_id", "text", "next_text", edited.alias("edited")))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.with_score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, folder, "documents"), vocabulary_file(), keep_ids=False, keep_decoded=False)


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    framed = fill_middle.store_frames(_table(spark, folder, "documents"))
    return fill_middle.with_digests(fill_middle.fill_middle(framed))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), vocabulary_file(), keep_ids=False)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.usable(_table(spark, folder, "embeddings"), scale=256)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), is_anchor=F.col("vec_id") % 50 == 0)


QUERIES: tuple[Query, ...] = (
    op1_simhash_dedup, op2_exact_dedup, op3_chat_format, op4_token_files, op5_mixing, op6_secrets, op7_line_dedup,
    op8_sketches, op9_toxicity, op10_bpe, op11_fill_middle, op12_packing, op13_hard_negatives,
)


def all_queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
