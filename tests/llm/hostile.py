"""Rows that break careless operators: nulls, empty and long texts, repeats, names that clash."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x" for i in range(60_000)) + "\n" + "line " * 30
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp string, hash string, at string, size string, "
    "score string, spans string, digest string, rank string, rate string, target string, place string, part string, "
    "run string, block string, a string, b string, node string, root string, toxic string, line string, copies string, "
    "_kept_id string, _nth string, _bitmap string, _source string, _toxicity string, _copy string, _rate string, _n_dropped string, "
    "_id string, __id string, text_hash string"
)
TEXTS = [
    (1, "one two three four five"), (2, None), (3, ""), (4, " \t\n "), (5, "one two three four five"), (5, "one two three four five"),
    (None, "one two three four five"), (None, None), (6, LONG), (7, LONG), (8, "Ünïcödé 🙂 text\r\nwith\x0bblanks\x0c"),
    (9, "password = \"hunter2hunter2\""), (9, "another text under the same id"), (10, "<|endoftext|>\n" * 3), (11, "a"),
]


def rows():
    return [
        (i, t, None if n % 4 == 0 else "en", None if n % 5 == 0 else f"s{n % 3}", None, *["clash"] * 32)
        for n, (i, t) in enumerate(TEXTS)
    ]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write_tables(spark, folder, documents, labels=(), conversations=()):
    """The tables that queries read, as parquet."""
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    return str(folder)


def sample(spark, folder, n=120):
    """A folder with a small fixture of the given tables, by id order (tests only)."""
    base = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "conversations"):
        key = "conv_id" if name == "conversations" else "doc_id"
        spark.read.parquet(f"{base}/{name}.parquet").where(f"{key} < {n}").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
