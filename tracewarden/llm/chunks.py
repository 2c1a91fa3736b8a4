"""Token ids of texts by way of their distinct words.

A text is cut at ASCII blanks, which no pre-token of the tokenizer crosses, so the ids of
a text are the ids of its chunks in order. The distinct chunks of a slice of texts are cut
into marks, a word and marks, each a pre-token, by one regular expression over all of them.
A worker encodes each pre-token it meets once and remembers those that come again; texts
are put together by array operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewarden.llm.common import remembered

#: What one Python worker handles at once and how much it remembers between slices, in bytes of text and
#: ids. A remembered pre-token takes some 200 bytes beside them, hence the bound on their number.
SLICE_BYTES = 4_000_000
REMEMBERED_PIECES = 250_000
REMEMBERED_BYTES = 32_000_000

#: A chunk of Latin-1 letters with ASCII marks around: its pre-tokens are the marks, the word and the marks.
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
SIMPLE = f"^(?P<before>{_MARKS})(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<after>{_MARKS})$"
#: Begins the key of a chunk that is no such chunk; no chunk has a blank.
_ODD = "\n"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def letters_of(piece: str) -> str:
    return piece if piece.isascii() else "".join(BYTE_LETTERS[b] for b in piece.encode())


class ChunkEncoder:
    """Encodes pre-tokens; a subclass says how a pre-token and how any other chunk is encoded."""

    def pre_token(self, letters: str) -> Sequence[int]:
        raise NotImplementedError

    def any_chunk(self, chunk: str) -> Sequence[int]:
        raise NotImplementedError

    def pieces(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each key of a table (a pre-token or an odd chunk), and all ids."""
        return joined([self.any_chunk(k[1:]) if k[0] == _ODD else self.pre_token(letters_of(k)) for k in keys])


def joined(lists: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))


class LibraryEncoder(ChunkEncoder):
    """The tokenizers library: its model for simple pre-tokens, its whole chain for all else."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model

    def pre_token(self, letters: str) -> Sequence[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def any_chunk(self, chunk: str) -> Sequence[int]:
        return self.whole.encode(chunk, add_special_tokens=False).ids


def runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of an array one after the other, and where each begins among them (with the total at the end)."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1]), ends


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` one after the other, and where each begins."""
    places, ends = runs(starts, sizes)
    return ids[places], ends


class ChunkTable:
    """Ids of the pre-tokens met so far, one after the other in one array."""

    def __init__(self, encode: ChunkEncoder) -> None:
        self.encode = encode
        self._keep([])

    def _keep(self, places: list[int]) -> None:
        """Forget all but the pre-tokens at ``places``; place 0 is the empty one."""
        places = [0, *places]
        if len(places) == 1:
            keys, sizes, ids = [""], np.zeros(1, np.int64), np.zeros(0, np.uint32)
        else:
            keys = list(self.places)
            keys = [keys[p] for p in places]
            ids, ends = gathered(self.ids, self.starts[places], self.sizes[places])
            sizes = np.diff(ends)
        self.places: dict[str, int] = {k: i for i, k in enumerate(keys)}
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes
        self.met_again = np.zeros(len(keys), bool)
        self.letters = sum(map(len, keys))

    def _trim(self) -> None:
        """Pre-tokens that came again since the last time stay; where these are many, only half of the bound."""
        if len(self.places) > REMEMBERED_PIECES or self.letters + self.ids.nbytes > REMEMBERED_BYTES:
            again = np.flatnonzero(self.met_again)
            again = again[again > 0][: REMEMBERED_PIECES // 2]
            sizes = self.sizes[again].cumsum() * self.ids.itemsize
            self._keep(again[: np.searchsorted(sizes, REMEMBERED_BYTES // 2)].tolist())

    def _learn(self, keys: list[str]) -> None:
        sizes, ids = self.encode.pieces(keys)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
        self.met_again = np.concatenate((self.met_again, np.zeros(len(keys), bool)))
        self.places.update(zip(keys, range(len(self.places), len(self.places) + len(keys))))
        self.letters += sum(map(len, keys))

    def _places(self, keys: pa.Array) -> np.ndarray:
        """The place of every key; unknown ones get theirs."""
        listed = keys.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.places.get, listed, repeat(-1)), np.int64, len(listed))
        self.met_again[places[places >= 0]] = True
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            places[unknown] = np.arange(len(self.places), len(self.places) + len(unknown))
            self._learn([listed[i] for i in unknown.tolist()])
        return places

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        self._trim()
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets)
        words = lists.values[bounds[0] : bounds[-1]].dictionary_encode()
        if not len(words):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        chunks = words.dictionary
        parts = pc.extract_regex(chunks, SIMPLE)
        simple = pc.and_(parts.is_valid(), pc.invert(pc.match_substring(chunks, "<|")))
        before, word, after = (parts.field(i) for i in range(3))
        keys = pa.concat_arrays([
            pc.if_else(simple, before, ""),
            pc.if_else(simple, pc.utf8_lower(word), pc.binary_join_element_wise(pa.scalar(_ODD), chunks, "")),
            pc.if_else(simple, after, ""),
        ]).dictionary_encode()
        places = self._places(keys.dictionary)[np.asarray(keys.indices)].reshape(3, -1).T.ravel()
        chunk_ids, chunk_ends = gathered(self.ids, self.starts[places], self.sizes[places])
        chunk_starts = chunk_ends[::3]
        at = np.asarray(words.indices)
        ids, ends = gathered(chunk_ids, chunk_starts[at], np.diff(chunk_starts)[at])
        return np.diff(ends[bounds - bounds[0]]), ids


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in runs of about ``most`` bytes (a longer text is a run of its own), nulls as empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    begin, n = 0, len(texts)
    while begin < n:
        limit = (ends[begin - 1] if begin else 0) + most
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def load_vocabulary(file: str) -> dict:
    with open(file, encoding="utf-8") as f:
        return json.load(f)


def table_of(kind: type[ChunkEncoder], file: str) -> ChunkTable:
    """One table for each Python worker, kept from task to task."""
    return remembered((kind.__name__, file), lambda: ChunkTable(kind(file)))
