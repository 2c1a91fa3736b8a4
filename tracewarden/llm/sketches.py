"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into passages: lines, cut further before words that a hash of the word and the one
before it picks, one in ``WORDS_A_CUT`` of the first ``DENSE_WORDS`` and fewer behind them. So a cut depends on
the words next to it alone, an insertion moves a bounded number of cuts, and short texts have several
passages. Passages are hashed; the distinct digests are dealt by their lowest bits into groups of
about ``GROUP_LOAD``, and each group is a small table of cells with three places for a digest. A cell
holds the XOR of its digests and the sum of their marks, which count them in the lowest bits
and check them in the others. That is the fingerprint. Two of them are brought to one number of
groups by adding up cells, and subtracted cell by cell; what both hold is gone, and peeling recovers the
digests in which the texts differ: a cell with one digest gives it away, and taking it out of
its other places uncovers more. Where peeling gets stuck, the texts are sketched anew, larger.

All of it is column functions within a row: no shuffle, and work in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import checkpointed, text_of

#: One word in so many starts a passage, of the words behind the first ones only one in ``SPARSER`` of these. Tokens
#: of more bytes than ``LONG_TOKEN`` (texts without blanks) are cut at one character in ``CHARS_A_CUT``, by a hash of
#: four characters. Without any cut, as in a text that repeats one word, a passage ends at the last
#: blank within ``PASSAGE_CHARS`` code points.
WORDS_A_CUT = 6
DENSE_WORDS, SPARSER = 30, 5
LONG_TOKEN = 60
CHARS_A_CUT = 80
PASSAGE_CHARS = 1200
_PASSAGE = "[^\\n]{1,%d}(?:(?<= )|(?=\\n)|\\z)|[^\\n]{1,%d}" % (PASSAGE_CHARS, PASSAGE_CHARS)
GROUP_LOAD = 8
#: Digests of both texts in a group, where they are sketched anew.
LOAD_ANEW = 12
#: Cells in each of a group's three sub-tables: of a fingerprint, and when texts are sketched anew, with more groups.
WIDTH = 8
WIDTHS = (8, 24)
#: Rounds of peeling; a difference that needs more is retried.
ROUNDS = 8
_CHECK_SEED = 77
_CELL = "array<struct<k:bigint,m:bigint>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def passages(text: Column) -> Column:
    """The passages of a text in order: lines, cut further where the neighbouring words say so."""

    def inside(token: Column) -> Column:
        """A long token, cut by its characters."""

        def cut(chars: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                near = F.slice(chars, F.greatest(i - 2, F.lit(1)), F.lit(4))
                return F.when((i > 2) & (F.pmod(F.xxhash64(near), F.lit(CHARS_A_CUT)) == 0), F.concat(F.lit("\n"), c)).otherwise(c)

            return F.array_join(F.transform(chars, char), "")

        return _let(F.split(token, ""), cut)

    def marked(tokens: Column) -> Column:
        def token(w: Column, i: Column) -> Column:
            whole = F.when(F.octet_length(w) > LONG_TOKEN, inside(w)).otherwise(w)
            one_in = F.when(i < DENSE_WORDS, WORDS_A_CUT).otherwise(WORDS_A_CUT * SPARSER)
            starts = F.pmod(F.xxhash64(F.get(tokens, i - 1), w), one_in) == 0
            return F.when(starts, F.concat(F.lit("\n"), whole)).otherwise(whole)

        return F.array_join(F.transform(tokens, token), " ")

    return F.regexp_extract_all(_let(F.split(text, " "), marked), F.lit(_PASSAGE), F.lit(0))


def passage_digests(text: Column) -> Column:
    """The distinct digests of a text's passages, in no order."""
    return F.array_distinct(F.transform(passages(text), lambda p: F.xxhash64(p)))


def n_groups(n: Column, load: int = GROUP_LOAD) -> Column:
    """The power of two that brings ``n`` digests down to the load of a group."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(load)) / load))).cast("int")


def grouped(items: Column, groups: Column) -> Column:
    """Digests by their lowest bits, in the order of these.

    They are dealt by the upper half of the bits first, then each part by the lower half, so a digest is
    met about twice the root of the number of groups.
    """
    bits = F.floor(F.log2(groups) / 2).cast("int")

    def parts(s: Column) -> Column:
        def part(h: Column) -> Column:
            own = F.filter(items, lambda d: F.call_function("shiftrightunsigned", d, s["bits"]).bitwiseAND(s["upper"] - 1) == h)
            return _let(
                own,
                lambda own: F.transform(
                    F.sequence(F.lit(0).cast("long"), s["lower"] - 1), lambda l: F.filter(own, lambda d: d.bitwiseAND(s["lower"] - 1) == l)
                ),
            )

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), s["upper"] - 1), part))

    lower = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return _let(F.struct(bits.alias("bits"), lower.alias("lower"), (groups / lower).cast("long").alias("upper")), parts)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(_CHECK_SEED))


def _mark(check: Column) -> Column:
    """32 bits of the check above 16 bits for the number of digests, here one; sums of 32,767 marks fit a long."""
    return F.shiftleft(check.bitwiseAND(F.lit((1 << 32) - 1)), 16) + 1


def _place(check: Column, table: int, width: int) -> Column:
    """The cell of a digest in one of the three sub-tables."""
    return F.shiftrightunsigned(check, 20 * table).bitwiseAND(F.lit((1 << 20) - 1)) % width


def cells(items: Column, width: int) -> Column:
    """The table of a group: three times ``width`` cells."""
    nothing = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("m"))

    def placed(digest: Column) -> Column:
        def entry(h: Column) -> Column:
            return F.struct(digest.alias("k"), _mark(h).alias("m"), *[_place(h, t, width).alias(f"c{t}") for t in range(3)])

        return _let(_check(digest), entry)

    def table(entries: Column, t: int) -> Column:
        def taken(cell: Column, e: Column) -> Column:
            return F.struct(cell["k"].bitwiseXOR(e["k"]).alias("k"), (cell["m"] + e["m"]).alias("m"))

        own = F.sequence(F.lit(0), F.lit(width - 1))
        return F.transform(
            own, lambda j: F.aggregate(entries, nothing, lambda cell, e: F.when(e[f"c{t}"] == j, taken(cell, e)).otherwise(cell))
        )

    def tables(entries: Column) -> Column:
        return F.concat(*[table(entries, t) for t in range(3)])

    return _let(F.transform(items, placed), tables)


def _cellwise(left: Column, right: Column, marks) -> Column:
    return F.zip_with(
        left, right, lambda a, b: F.struct(a["k"].bitwiseXOR(b["k"]).alias("k"), marks(a["m"], b["m"]).alias("m"))
    )


def subtract(left: Column, right: Column) -> Column:
    return _cellwise(left, right, lambda a, b: a - b)


def _empty(cell: Column) -> Column:
    return (cell["k"] == 0) & (cell["m"] == 0)


def peel(difference: Column, width: int) -> Column:
    """The digests in which two tables differ, or null if peeling got stuck."""

    def pure(table: Column) -> Column:
        def entry(c: Column) -> Column:
            def found(h: Column) -> Column:
                places = [_place(h, t, width).cast("int").alias(f"c{t}") for t in range(3)]
                return F.when(F.abs(c["m"]) == _mark(h), F.struct(c["k"].alias("k"), c["m"].alias("m"), *places))

            return _let(_check(c["k"]), found)

        # one digest, on one side: its number is 1 or -1
        single = F.filter(table, lambda c: F.abs(c["m"]).bitwiseAND(F.lit(0xFFFF)) == 1)
        return F.array_distinct(F.array_compact(F.transform(single, entry)))

    def without(found: Column, table: Column) -> Column:
        def less(cell: Column, p: Column) -> Column:
            return F.struct(cell["k"].bitwiseXOR(p["k"]).alias("k"), (cell["m"] - p["m"]).alias("m"))

        def part(t: int) -> Column:
            def take(c: Column, j: Column) -> Column:
                rest = F.aggregate(found, c, lambda cell, p: F.when(p[f"c{t}"] == j, less(cell, p)).otherwise(cell))
                return F.when(_empty(c), c).otherwise(rest)

            return F.transform(F.slice(table, t * width + 1, width), take)

        return F.concat(*map(part, range(3))).cast(_CELL)

    def peeled(state: Column) -> Column:
        return _let(
            pure(state["cells"]),
            lambda found: F.struct(
                F.when(F.size(found) == 0, state["cells"]).otherwise(without(found, state["cells"])).alias("cells"),
                F.concat(state["out"], F.transform(found, lambda p: p["k"])).cast("array<bigint>").alias("out"),
                (F.size(found) > 0).alias("more"),
            ),
        )

    def round_(state: Column, _: Column) -> Column:
        return F.when(state["more"], peeled(state)).otherwise(state)

    none = F.array().cast("array<bigint>")

    def whole(cells_: Column) -> Column:
        start = F.struct(cells_.cast(_CELL).alias("cells"), none.alias("out"), F.lit(True).alias("more"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
        peeled_ = _let(done, lambda s: F.when(F.forall(s["cells"], _empty), s["out"]))
        return F.when(F.forall(cells_, _empty), none).otherwise(peeled_)

    return _let(difference, whole)


def differing(left: Column, right: Column) -> Column:
    """The digests that only one of two groups has. The first width that peels counts; the last resort is a plain set difference."""
    attempts = [peel(subtract(cells(left, w), cells(right, w)), w) for w in WIDTHS]
    return F.coalesce(*attempts, F.concat(F.array_except(left, right), F.array_except(right, left)))


def sketch(items: Column) -> Column:
    """The fingerprint of a text's digests: an array of groups, each a table of cells."""
    groups = n_groups(F.size(items))
    return F.transform(_let(groups, lambda g: grouped(items, g)), lambda group: cells(group, WIDTH))


def fingerprint(tables: Column) -> Column:
    """A sketch as hexadecimal text: the number of groups, then digests and marks of each cell."""

    def shown(c: Column) -> Column:
        return F.concat(F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["m"]), 16, "0"))

    told = F.array_join(F.transform(F.flatten(tables), shown), "")
    return F.lower(F.concat(F.hex(F.size(tables)), F.lit(":"), told))


def stored(print_: Column) -> Column:
    """The sketch behind a fingerprint's text."""
    number = lambda text: F.conv(text, 16, -10).cast("bigint")

    def table(group: Column) -> Column:
        words = F.regexp_extract_all(group, F.lit(".{32}"), F.lit(0))
        return F.transform(words, lambda w: F.struct(number(F.substring(w, 1, 16)).alias("k"), number(F.substring(w, 17, 16)).alias("m")))

    groups = F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(".{%d}" % (3 * WIDTH * 32)), F.lit(0))
    return F.transform(groups, table)


def folded(tables: Column, groups: Column) -> Column:
    """A sketch brought to fewer groups (a smaller power of two), as if it had been made with these."""
    none = F.array_repeat(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("m")), 3 * WIDTH)

    def sum_of(g: Column) -> Column:
        own = F.filter(tables, lambda _, i: i % groups == g)
        return F.aggregate(own, none, lambda a, b: _cellwise(a, b, lambda x, y: x + y))

    return F.when(F.size(tables) == groups, tables).otherwise(F.transform(F.sequence(F.lit(0), groups - 1), sum_of))


def n_digests(tables: Column) -> Column:
    """How many digests a sketch holds: each counts in three cells."""
    per_cell = F.transform(F.flatten(tables), lambda c: c["m"].bitwiseAND(F.lit(0xFFFF)))
    return F.aggregate(per_cell, F.lit(0).cast("long"), lambda a, n: a + n) / 3


def n_differing(left: Column, right: Column) -> Column:
    """How many digests two sketches do not share; null where peeling gets stuck, or a size says that it would."""

    def at(groups: Column) -> Column:
        parts = F.zip_with(
            folded(left, groups), folded(right, groups), lambda a, b: F.size(_found(peel(subtract(a, b), WIDTH)))
        )
        return F.aggregate(parts, F.lit(0), lambda total, n: total + n)

    alike = F.greatest(F.size(left), F.size(right)) < 4 * F.least(F.size(left), F.size(right))
    return F.when(alike, _let(F.least(F.size(left), F.size(right)), at))


def _found(peeled: Column) -> Column:
    """Keeps the size of a null list null."""
    return F.when(peeled.isNotNull(), peeled)


def n_differing_anew(left: Column, right: Column) -> Column:
    """The same from digests: sketches with as many groups as both texts' digests need."""

    def at(groups: Column) -> Column:
        parts = F.zip_with(grouped(left, groups), grouped(right, groups), lambda a, b: F.size(differing(a, b)))
        return F.aggregate(parts, F.lit(0), lambda total, n: total + n)

    return _let(n_groups(F.size(left) + F.size(right), LOAD_ANEW), at)


def _likeness(all_: Column, differ: Column) -> Column:
    """Shared digests over all digests, from the number in both texts and the number of differing ones."""

    def shared(n: Column) -> Column:
        both = (all_ - n) / 2
        return F.when(all_ + n == 0, F.lit(1.0)).otherwise(both / (both + n))

    return _let(differ, shared)


def likeness(left: Column, right: Column) -> Column:
    """Shared digests over all digests of two stored fingerprints (text), without their documents.

    Two empty texts are alike. Null where peeling gets stuck, as it does when the texts
    differ in most of their passages; ``compare_versions`` then sketches them anew.
    """
    return _let(
        F.struct(stored(left).alias("l"), stored(right).alias("r")),
        lambda p: _likeness(n_digests(p["l"]) + n_digests(p["r"]), n_differing(p["l"], p["r"])),
    )


#: Rows of a run of neighbours, and ranges that ids are first cut into.
RUN_ROWS = 2000
RANGES = 64


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document by descending id, after the last the first.

    Ids are cut into ranges by quantiles and these evenly into runs of about ``RUN_ROWS``
    rows, so texts are shuffled once, by run; only one row of each run meets another's.
    Null ids come after all others; equal ids go by a hash of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    inner = [i / RANGES for i in range(1, RANGES)]
    n, low, high, cuts = rows.agg(
        F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", inner, 10_000)
    ).first()
    bounds = sorted({low, *(cuts or [])} - {None}) or [0]
    ends = F.array(*map(F.lit, [*bounds[1:], (high or 0) + 1]))
    starts, parts = F.array(*map(F.lit, bounds)), max(1, -(-n // (RANGES * RUN_ROWS)))
    range_ = F.size(F.filter(starts, lambda b: b <= F.col("doc_id")))
    rows = rows.withColumn("range", F.coalesce(range_, F.lit(0)))
    begin, end = F.element_at(starts, F.greatest("range", F.lit(1))), F.element_at(ends, F.greatest("range", F.lit(1)))
    part = F.floor((F.col("doc_id") - begin) / (end - begin) * parts)
    rows = rows.withColumn("run", F.col("range") * (parts + 1) + F.coalesce(part, F.lit(0))).drop("range")
    order = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), F.desc("hash"))
    inner = rows.select("doc_id", "text", F.lead("text").over(order).alias("next_text")).where("next_text IS NOT NULL")
    # The last row of a run goes on with the first row of the run below; the lowest run with the
    # highest. Firsts and lasts are picked before the shuffle, so a few rows of each task move.
    upward = Window.partitionBy("run").orderBy(F.col("doc_id").asc_nulls_first(), F.asc("hash"))
    picked = rows.select("run", "doc_id", "text", "hash")
    heads = picked.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    lasts = picked.withColumn("nth", F.row_number().over(upward)).where("nth = 1")
    down = Window.orderBy(F.desc("run"))  # one row for each run
    first = F.first("run").over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = rows.select("run").distinct().select("run", F.coalesce(F.lead("run").over(down), first).alias("below"))
    heads = heads.select(F.col("run").alias("below"), F.col("text").alias("next_text"))
    ends = lasts.join(below, "run").join(heads, "below").select("doc_id", "text", "next_text")
    return inner.unionByName(ends)


def compare_versions(rows: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` from
    ``doc_id, text, edited, next_text``.

    ``near_…`` are the likeness of the fingerprints. Defined cases: a null text, edited or next text is empty;
    an empty text has a fingerprint of empty cells; two empty texts have likeness 1; repeated
    passages count once; a text's fingerprint depends on nothing else.
    """
    texts = {"own": "text", "edit": "edited", "next": "next_text"}
    # Digests, then sketches are stored before they are used, so that the long expressions are planned once.
    hashed = rows.select(
        "doc_id",
        F.length(text_of()).cast("long").alias("n_chars"),
        F.sha2(text_of("edited"), 256).alias("edited_sha256"),
        *[passage_digests(text_of(column)).alias(name) for name, column in texts.items()],
    )
    sketched = checkpointed(hashed).withColumns({f"{name}_print": sketch(F.col(name)) for name in ("own", "edit")})

    def near(name: str, differ: Column) -> Column:
        return _likeness((F.size("own") + F.size(name)).cast("double"), differ)

    # Versions of a text share most, so their fingerprints are subtracted first. The next document mostly shares
    # nothing: no table of a fingerprint's size would peel, so both are sketched as large as both need.
    edited = F.coalesce(n_differing(F.col("own_print"), F.col("edit_print")), n_differing_anew(F.col("own"), F.col("edit")))
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own_print")).alias("fingerprint"),
        fingerprint(F.col("edit_print")).alias("edited_fingerprint"),
        near("edit", edited).alias("near_edited"),
        near("next", n_differing_anew(F.col("own"), F.col("next"))).alias("near_next"),
    )
