"""Fill-in-the-middle over texts in seekable compressed frames.

A text is stored as independent zstandard frames of up to ``FRAME_CHARS`` code points; beside
each stand the line ends and code points up to its end. Units are lines with their line ends. A cut
after so many units is found in these numbers, and only the frame it falls into is decompressed.
The output is a text of frames, too: whole frames between the cuts move as they are, the two cut
frames are split, markers are frames of their own. Digests and texts are read frame by frame, so
no step after the first holds a whole text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewarden.llm.chunks import slices

FRAME_CHARS = 32_768
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Markers in the order of the output.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_FRAMES = "units array<long>, chars array<long>, frames array<binary>"
FRAMED = f"doc_id long, has_marker boolean, {_FRAMES}"
FILLED = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {_FRAMES}"

_DEFLATE, _INFLATE = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


class Frames:
    """A text as frames, with the line ends and code points up to the end of each."""

    def __init__(self, units: list[int], chars: list[int], frames: list[bytes]) -> None:
        self.units, self.chars, self.frames = units, chars, frames
        self._open, self._text = -1, ""

    @classmethod
    def of(cls, text: str) -> Frames:
        made = cls([], [], [])
        made.add(text)
        return made

    @property
    def n_chars(self) -> int:
        return self.chars[-1] if self.chars else 0

    def n_units(self) -> int:
        """Lines, the last one with or without a line end."""
        ends = self.units[-1] if self.units else 0
        return ends + bool(self.frames and not self.text(len(self.frames) - 1).endswith("\n"))

    def text(self, i: int) -> str:
        """The text of one frame; the last one looked at is kept."""
        if self._open != i:
            self._open, self._text = i, _INFLATE.decompress(self.frames[i]).decode()
        return self._text

    def _put(self, frame: bytes, units: int, chars: int) -> None:
        self.frames.append(frame)
        self.units.append(units + (self.units[-1] if self.units else 0))
        self.chars.append(chars + self.n_chars)

    def add(self, text: str) -> None:
        for begin in range(0, len(text), FRAME_CHARS):
            piece = text[begin : begin + FRAME_CHARS]
            self._put(_DEFLATE.compress(piece.encode()), piece.count("\n"), len(piece))

    def _before(self, i: int) -> tuple[int, int]:
        return (self.units[i - 1], self.chars[i - 1]) if i else (0, 0)

    def place(self, cut: int) -> int:
        """Code points before the cut that lies after ``cut`` units."""
        i = bisect_left(self.units, cut)
        if not cut:
            return 0
        if i == len(self.units):  # the last unit has no line end
            return self.n_chars
        (units, chars), at = self._before(i), -1
        for _ in range(cut - units):
            at = self.text(i).index("\n", at + 1)
        return chars + at + 1

    def _parts(self, begin: int, end: int) -> Iterator[tuple[int, slice | None]]:
        """Frames that hold the code points from ``begin`` to ``end``, and what is meant of a cut one."""
        i = bisect_right(self.chars, begin)
        while begin < end:
            first, last = self._before(i)[1], self.chars[i]
            whole = first == begin and last <= end
            yield i, None if whole else slice(begin - first, min(end, last) - first)
            begin, i = last, i + 1

    def stream(self, begin: int, end: int) -> Iterator[str]:
        """The text from ``begin`` to ``end``, a frame at a time."""
        for i, cut in self._parts(begin, end):
            yield self.text(i) if cut is None else self.text(i)[cut]

    def add_span(self, other: Frames, begin: int, end: int) -> None:
        """Code points of another text; its whole frames are taken as they are."""
        for i, cut in other._parts(begin, end):
            if cut is None:
                units, chars = other._before(i)
                self._put(other.frames[i], other.units[i] - units, other.chars[i] - chars)
            else:
                self.add(other.text(i)[cut])

    def find(self, marks: tuple[str, ...]) -> list[int]:
        """Where each mark first occurs behind the one before it; marks may lie across frames."""
        found: list[int] = []
        held, longest = "", max(map(len, marks))
        for i in range(len(self.frames)):
            base = self._before(i)[1] - len(held)
            text, at = held + self.text(i), 0
            while len(found) < len(marks) and (place := text.find(marks[len(found)], at)) >= 0:
                found.append(base + place)
                at = place + len(marks[len(found) - 1])
            held = text[max(at, len(text) - longest + 1) :]
        return found


def has_marker(text: str) -> bool:
    return PREFIX in text or SUFFIX in text or MIDDLE in text


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers that only the seed and the id decide."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]


def filled(text: Frames, doc_id: int | None, marked: bool, rate: int, spm_rate: int, seed: str):
    """``n, form, prefix_chars, middle_chars`` and the output."""
    n, (h1, h2, h3, h4) = text.n_units(), draws(doc_id, seed)
    if not n or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    begin, end = text.place(first), text.place(last)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    spans = {PREFIX: (0, begin), SUFFIX: (end, text.n_chars), MIDDLE: (begin, end)}
    out = Frames([], [], [])
    for marker in ORDERS[form]:
        out.add(marker)
        out.add_span(text, *spans[marker])
    return n, form, begin, end - begin, out


def restored(out: Frames, form: str) -> Iterator[str]:
    """The text behind an output, a frame at a time."""
    if form == "plain":
        return out.stream(0, out.n_chars)
    order = ORDERS[form]
    places = [*out.find(order), out.n_chars]
    spans = {m: (places[i] + len(m), places[i + 1]) for i, m in enumerate(order)}
    return (piece for m in (PREFIX, MIDDLE, SUFFIX) for piece in out.stream(*spans[m]))


def _digest(pieces: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece.encode())
    return digest.hexdigest()


def _by_row(df: DataFrame, schema: str, row_of: Callable[[dict], tuple]) -> DataFrame:
    """Rows of ``df`` turned into rows of ``schema``, a hundred at a time."""

    told = to_arrow_schema(StructType.fromDDL(schema))
    types, names = told.types, told.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                rows = [row_of(r) for r in batch.slice(begin, 100).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return df.mapInArrow(run, schema)


def store_frames(docs: DataFrame) -> DataFrame:
    """``doc_id, has_marker, units, chars, frames``: every text of ``docs`` as frames, one row per input row.

    Defined cases: a null text is empty and has no frame; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                texts = texts.to_pylist()
                made = [Frames.of(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.array(map(has_marker, texts), pa.bool_()),
                        pa.array([f.units for f in made], pa.list_(pa.int64())),
                        pa.array([f.chars for f in made], pa.list_(pa.int64())),
                        pa.array([f.frames for f in made], pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "has_marker", "units", "chars", "frames"],
                )

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, FRAMED)


def fill_middle(framed: DataFrame, rate: int = 100, spm_rate: int = 50, seed: str = "7") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the output as ``units, chars, frames``.

    ``rate`` and ``spm_rate`` are percentages of texts: cut at all, and of these with the
    suffix first. Cuts and forms hang on seed and id alone, so reruns agree and rows of one
    id and length are cut alike. Defined cases: empty texts and texts that contain a marker stay plain, with null
    ``prefix_chars`` and ``middle_chars``; a null id is drawn for like an id without digits.
    """

    def row(r: dict) -> tuple:
        text = Frames(r["units"], r["chars"], r["frames"])
        *told, out = filled(text, r["doc_id"], r["has_marker"], rate, spm_rate, seed)
        return r["doc_id"], *told, out.units, out.chars, out.frames

    return _by_row(framed, FILLED, row)


def with_digests(rows: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` with the digests of the output and of the text restored from it."""

    def row(r: dict) -> tuple:
        out = Frames(r["units"], r["chars"], r["frames"])
        digests = _digest(out.stream(0, out.n_chars)), _digest(restored(out, r["form"]))
        return r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], *digests

    named = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _by_row(rows, named, row)


def with_texts(rows: DataFrame) -> DataFrame:
    """``doc_id, form, output, restored``: outputs as plain text, and the texts restored from them."""

    def row(r: dict) -> tuple:
        out = Frames(r["units"], r["chars"], r["frames"])
        return r["doc_id"], r["form"], "".join(out.stream(0, out.n_chars)), "".join(restored(out, r["form"]))

    return _by_row(rows, "doc_id long, form string, output string, restored string", row)
