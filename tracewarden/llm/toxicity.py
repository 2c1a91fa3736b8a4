"""Toxicity by way of the noisy channel.

A writer's word reaches the text through a channel that swaps letters for look-alikes
("1d10t"), puts marks or blanks between letters ("i.d.i.o.t", "i d i o t") and repeats letters
("idiooot"). A suspicious token becomes a lattice of what each character may stand for, and
Viterbi search finds the likeliest path under a character trigram model and the channel's
costs. All other tokens have one path and stand for themselves. The restored words are
scored by a lexicon of words and word beginnings learned from labels, and a logistic
regression turns a document's evidence into a score.

The character model counts the trigrams of all documents; its table is bounded by the
alphabet. Lexicon and regression are fitted on at most ``TRAIN_ROWS`` labelled rows, two
thirds for the lexicon and one third for the regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.chunks import slices
from tracewarden.llm.common import checkpointed, free_prefix, remembered

#: Labelled rows that lexicon and regression are fitted on, and entries of the lexicon, at most.
TRAIN_ROWS = 10_000
LEXICON_SIZE = 1000
LEAST_TOXIC_DOCS, LEAST_EVIDENCE = 3, 15.0
BEGINNINGS = range(4, 9)
THRESHOLD = 0.5

#: The model's alphabet: 0 for whatever is no letter, then the small letters of Latin-1.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_CODE = {letter: i + 1 for i, letter in enumerate(LETTERS)}
_CODES = np.array([_CODE.get(chr(b), 0) for b in range(256)], np.int32)

#: What a character may stand for, besides itself.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_BETWEEN = ".-_*~'`,:/\\^=#"
SWAP_COST, MARK_COST, REPEAT_COST, GAP_COST = 0.5, 0.2, 0.2, 1.0
_HEAD, _TAIL = "\"'([{<*#%&.,;:!?-_|+=/\\~`^", "\"')]}>*#%&.,;:!?-_|+=/\\~`^$@"
_RUN = re.compile(r"(\w)\1\1")
#: Blank-separated single characters from which on they may spell a word.
LEAST_SPACED = 4
_REMEMBERED = 200_000


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``code, n`` of every character trigram of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                joined = " ".join(pc.utf8_lower(texts).to_pylist()).encode("latin-1", "replace")
                c = _CODES[np.frombuffer(b"  " + joined + b" ", np.uint8)]
                total += np.bincount(c[:-2] << 12 | c[1:-1] << 6 | c[2:], minlength=1 << 18)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int32()), "n": total[code]})

    return docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_model(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities [first, second, third], trigrams interpolated with bigrams and letters."""
    three = np.zeros((64, 64, 64))
    three.reshape(-1)[codes] = counts
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + 64)
    p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
    p3 = (three + 8 * p2) / (three.sum(axis=2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: character model, lexicon, regression. A few megabytes whatever the corpus."""

    log_p: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    base: float = 0.0


def lattice(core: str, gap_cost: float | None = None) -> list[list[tuple[str, float]]]:
    """For each place of ``core`` what it may stand for, with costs. A word end is ' '."""
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(core):
        c, end = core[at], at + 1
        while end < len(core) and core[end] == c:
            end += 1
        if c in _CODE:
            options = [(c, 0.0)]
        else:
            options = [(x, SWAP_COST) for x in LOOKS_LIKE.get(c, "")]
            if c in _BETWEEN:
                options.append(("", MARK_COST))
            options.append((" ", GAP_COST))
        if end - at >= 3 and len(options[0][0].strip()):
            options = [(x * n, cost + REPEAT_COST) for x, cost in options for n in ((1, 2) if x.strip() else (1,))]
            places.append(options)
        else:
            places += [options] * (end - at)
        if gap_cost is not None and end < len(core):
            places.append([("", 0.0), (" ", gap_cost)])
        at = end
    return places


def viterbi(places: list[list[tuple[str, float]]], log_p: np.ndarray) -> str:
    """The cheapest path; states are the last two letters."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in [*places, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, extra in options:
                x, y, total = a, b, cost + extra
                for letter in letters:
                    code = _CODE.get(letter, 0)
                    if not (code == 0 and y == 0):
                        total -= float(log_p[x, y, code])
                        x, y = y, code
                known = after.get((x, y))
                if known is None or total < known[0]:
                    after[x, y] = (total, (path, letters))
        states = after
    _, path = min(states.values(), key=lambda s: s[0])
    letters = []
    while path:
        path, last = path
        letters.append(last)
    return "".join(reversed(letters)).strip()


class Reader:
    """Restores and weighs tokens; remembers them within a Python worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.places, self.weights, self.single = model, {}, [], []

    def restore(self, token: str) -> list[str]:
        core = token.lstrip(_HEAD).rstrip(_TAIL)
        if core.isalpha() and not _RUN.search(core):
            return [core]
        if not any(c.isalpha() for c in core):
            return []
        return viterbi(lattice(core), self.model.log_p).split()

    def restore_spaced(self, letters: str) -> list[str]:
        if len(set(letters)) == 1:
            return []
        return viterbi(lattice(letters, GAP_COST), self.model.log_p).split()

    def weight(self, words: list[str]) -> float:
        lexicon = self.model.lexicon
        return max((lexicon[f] for w in words for f in features(w) if f in lexicon), default=0.0)

    def place(self, token: str) -> int:
        found = self.places.get(token)
        if found is None:
            found = self.places[token] = len(self.weights)
            core = token.strip(_BETWEEN + "\"")
            self.weights.append(self.weight(self.restore(token)))
            self.single.append(len(core) == 1 and (core.isalpha() or core in LOOKS_LIKE))
        return found

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        bounds = np.asarray(lists.offsets)
        return bounds - bounds[0], lists.values[bounds[0] : bounds[-1]].dictionary_encode()

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: log sum, rate, strongest and log number of the tokens with weight."""
        if len(self.places) > _REMEMBERED:
            self.places, self.weights, self.single = {}, [], []
        bounds, words = self.tokens(texts)
        shown = words.dictionary.to_pylist()
        places = np.array([self.place(t) for t in shown], np.int64)
        index = np.asarray(words.indices)
        found = (np.array(self.weights)[places] if len(places) else np.zeros(0))[index]
        ends = np.concatenate(([0.0], np.cumsum(found)))
        hits = np.concatenate(([0], np.cumsum(found > 0)))
        total, number = ends[bounds[1:]] - ends[bounds[:-1]], hits[bounds[1:]] - hits[bounds[:-1]]
        strongest, size = np.zeros(len(texts)), np.diff(bounds)
        some = np.flatnonzero(size)
        if len(some):
            strongest[some] = np.maximum.reduceat(found, bounds[some])
        single = (np.array(self.single)[places] if len(places) else np.zeros(0, bool))[index]
        for doc, letters in self._spaced(single, bounds, shown, index):
            w = self.weight(self.restore_spaced(letters))
            if w > 0:
                total[doc] += w
                number[doc] += 1
                strongest[doc] = max(strongest[doc], w)
        total = np.maximum(total, 0)
        return np.column_stack([np.log1p(total), 100 * total / np.maximum(size, 1), strongest, np.log1p(number)])

    @staticmethod
    def _spaced(single: np.ndarray, bounds: np.ndarray, shown: list[str], index: np.ndarray) -> Iterator[tuple[int, str]]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin < LEAST_SPACED:
                continue
            doc = int(np.searchsorted(bounds, begin, "right")) - 1
            while begin < end:
                stop = min(end, int(bounds[doc + 1]))
                if stop - begin >= LEAST_SPACED:
                    yield doc, "".join(shown[i].strip(_BETWEEN + "\"") for i in index[begin:stop].tolist())
                begin, doc = stop, doc + 1

    def words(self, text: str) -> set[str]:
        """All restored words of a text."""
        bounds, found = self.tokens(pa.array([text]))
        shown, index = found.dictionary.to_pylist(), np.asarray(found.indices)
        single = np.array([len(t) == 1 and (t.isalpha() or t in LOOKS_LIKE) for t in shown], bool)[index] if shown else np.zeros(0, bool)
        out = {w for t in shown for w in self.restore(t)}
        for _, letters in self._spaced(single, bounds, shown, index):
            out.update(self.restore_spaced(letters))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        model = self.model
        if model.weights is None:
            return np.full(len(texts), model.base)
        z = (self.evidence(texts) - model.mean) / model.scale
        return 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ model.weights[1:], -30, 30)))


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def held_out(ids: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counts(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(shared.value), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                found[toxic.as_py()].update({f for w in reader.words(text.as_py() or "") for f in features(w)})
        names = list(found[0] | found[1])
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array(names, pa.string()),
                "clean": pa.array([found[0][f] for f in names], pa.int64()),
                "toxic": pa.array([found[1][f] for f in names], pa.int64()),
            }
        )

    return count


def _lexicon(counts: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """The features that speak most surely for toxic documents, by log odds."""
    gain = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    # Likelihood ratio of the observed counts against the same share in both classes.
    share = toxic / (toxic + clean)
    seen = F.col("toxic") + F.col("clean")
    evidence = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (seen * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * (1 - share)))).otherwise(0)
    )
    best = (
        counts.groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= LEAST_TOXIC_DOCS)
        .select("feature", gain.alias("gain"), evidence.alias("evidence"))
        .where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("gain") > 0))
        .orderBy(F.desc("evidence"), "feature")
        .limit(LEXICON_SIZE)
    )
    return {r["feature"]: r["gain"] for r in best.collect()}


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for ``docs`` from ``labels`` (``doc_id, toxic``); several labels of a document count as their largest."""
    spark = docs.sparkSession
    rows = trigram_counts(docs).collect()  # at most 2^18, bounded by the alphabet
    model = Model(log_model(np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)))
    picked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .withColumn("_draw", F.xxhash64("doc_id"))
        .orderBy("_draw", "doc_id")
        .limit(TRAIN_ROWS)
    )
    known = checkpointed(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(checkpointed(picked)), "doc_id")
    )
    known = known.select("text", "toxic", (F.pmod("_draw", F.lit(3)) == 0).alias("_last"))
    sizes = {(r["_last"], r["toxic"]): r["count"] for r in known.groupBy("_last", "toxic").count().collect()}
    clean, toxic = sizes.get((False, 0), 0), sizes.get((False, 1), 0)
    seen = sum(sizes.values())
    model.base = min(0.49, sum(n for (_, t), n in sizes.items() if t) / seen) if seen else 0.0
    if not toxic or not sizes.get((True, 1)) or not sizes.get((True, 0)):
        return model  # nothing to learn from: every text gets the share of toxic labels, at most 0.49
    shared = spark.sparkContext.broadcast(model)
    counts = known.where("not _last").select("text", "toxic").mapInArrow(_counts(shared), "feature string, clean long, toxic long")
    model.lexicon = _lexicon(counts, clean, toxic)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for begin, texts in slices(batch.column(0)):
                x = reader.evidence(texts)
                out = {f"x{i}": x[:, i] for i in range(4)}
                yield pa.RecordBatch.from_pydict({"toxic": batch.column(1).slice(begin, len(texts)), **out})

    found = known.where("_last").select("text", "toxic").mapInArrow(
        weigh, "toxic int, x0 double, x1 double, x2 double, x3 double"
    )
    data = np.array([tuple(r) for r in found.collect()], float)  # at most about TRAIN_ROWS / 3
    model.mean, model.scale, model.weights = _regression(data[:, 1:], data[:, 0])
    return model


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` (0 to 1) as last column.

    Defined cases: a null or empty text gets the score of a text without evidence; repeated
    rows get equal scores; an empty table stays empty. Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = shared._jbroadcast.id()
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = remembered(("reader", number), lambda: Reader(shared.value))
        for batch in batches:
            for begin, texts in slices(batch.column(at)):
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(reader.scores(texts), pa.float64())], names=names)

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model, score = train(docs.select("doc_id", "text"), labels), free_prefix(docs) + "toxicity"
    return with_score(docs, model, score).where(F.col(score) < threshold).drop(score)
