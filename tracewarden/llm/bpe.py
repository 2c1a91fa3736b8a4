"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has one last token: the token that ends there, and whose pair
with the last token of the shorter prefix before it is one that the merge rules would leave
standing. Tokens ending at a character come from the vocabulary's suffix automaton (its
suffix links lead from the longest token that ends there to all shorter ones), so a
pre-token is read once, whatever its length, and back-pointers give the ids.

The merges are those of the given vocabulary file; nothing is trained here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewarden.llm.chunks import SLICE_BYTES, ChunkEncoder, load_vocabulary, slices, table_of

#: Added to the code of a word's last letter, so that it is a letter of its own.
_LAST = 0x1000
#: Answers of the pair test remembered by one Python worker.
_REMEMBERED_PAIRS = 200_000
_NEVER = 1 << 40


class PrefixEncoder(ChunkEncoder):
    """Encodes as the merge rules of a vocabulary file with word ends do."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        told, library = load_vocabulary(file), Tokenizer.from_file(file)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model = told["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.shown = [""] * size
        for token, number in [*vocabulary.items(), *self.special.items()]:
            self.shown[number] = token
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            first, second = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (vocabulary[first], vocabulary[second]), vocabulary[first + second]
            self.merge_rank[pair] = self.rank[made] = rank
            self.left[made], self.right[made] = pair
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            if number not in self.special.values():
                ends = token.endswith(suffix)
                letters = token.removesuffix(suffix)
                if letters:
                    self.automaton.add_word(self._word(letters) if ends else letters, (number, len(letters)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.stable = lru_cache(maxsize=None)(self._stable)  # at most one answer for each token

    @staticmethod
    def _word(letters: str) -> str:
        return letters[:-1] + chr(_LAST + ord(letters[-1]))

    def _pair_stands(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens across their border.

        Goes back in time along the border: at each moment the neighbours are a token on
        the right edge of ``left`` and one on the left edge of ``right``. They would be joined
        if their merge came before those that took them into larger tokens. Equal merges go
        from left to right, so the left token's own merge wins a tie, the right one's loses.
        """
        rank, until_left, until_right = self.rank, _NEVER, _NEVER
        while True:
            joined = self.merge_rank.get((left, right), _NEVER)
            if joined < until_left and joined <= until_right and joined != _NEVER:
                return False
            if rank[left] > rank[right]:
                until_left, left = rank[left], self.right[left]
            elif rank[right] >= 0:
                until_right, right = rank[right], self.left[right]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= _REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self._pair_stands(left, right)
        return known

    def _stable(self, token: int) -> bool:
        """Whether a text that is this token is encoded as this token."""
        left, right = self.left[token], self.right[token]
        if left < 0:
            return True
        # Its halves must be stable, and nothing may join across their border before the token's own merge.
        rank, until_left, until_right = self.rank, self.rank[token], self.rank[token]
        if not (self.stable(left) and self.stable(right)):
            return False
        while True:
            joined = self.merge_rank.get((left, right), _NEVER)
            if joined < until_left and joined <= until_right and joined < self.rank[token]:
                return False
            if rank[left] > rank[right]:
                until_left, left = rank[left], self.right[left]
            elif rank[right] >= 0:
                until_right, right = rank[right], self.left[right]
            else:
                return True

    def pre_token(self, letters: str) -> Sequence[int]:
        word = self._word(letters)
        last: list[int] = [-1] * (len(word) + 1)
        back = [0] * (len(word) + 1)
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if self.stable(token) if begin == 0 else last[begin] >= 0 and self.stable(token) and self.compatible(last[begin], token):
                last[end], back[end] = token, begin
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _ordinary(self, text: str) -> list[int]:
        ids: list[int] = []
        for letters, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text)):
            ids += self.pre_token(letters)
        return ids

    def any_chunk(self, chunk: str) -> Sequence[int]:
        ids: list[int] = []
        while True:
            found = min(((chunk.find(s), s) for s in self.special if s in chunk), default=None)
            if found is None:
                return ids + (self._ordinary(chunk) if chunk else [])
            at, token = found
            if at:
                ids += self._ordinary(chunk[:at])
            ids.append(self.special[token])
            chunk = chunk[at + len(token) :]


def decode(ids: np.ndarray, shown: list[str]) -> str:
    """The tokens with a space between them, as a vocabulary without decoder is read."""
    return " ".join(map(shown.__getitem__, ids.tolist()))


#: Ids whose decoded text is held at once.
DECODE_IDS = 1_000_000


def decoded_sha256(ids: np.ndarray, shown: list[str]) -> str:
    """Digest of the decoded text, made from runs of it."""
    digest = hashlib.sha256()
    for begin in range(0, len(ids), DECODE_IDS):
        if begin:
            digest.update(b" ")
        digest.update(decode(ids[begin : begin + DECODE_IDS], shown).encode())
    return digest.hexdigest()


def encode_documents(docs: DataFrame, file: str, keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` and ``decoded``.

    One row per input row, whatever its other columns. Digests are of the ids as
    little-endian unsigned 32-bit numbers and of the decoded text in UTF-8. Defined cases:
    a null or empty text has no ids and an empty decoded text, a null id stays null.
    ``file`` is a path that every executor has.
    """
    wanted = ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(PrefixEncoder, file)
        shown = table.encode.shown
        for batch in batches:
            for begin, texts in slices(batch.column(1), SLICE_BYTES // 2):
                sizes, ids = table.encode_texts(texts)
                split = np.split(ids, np.cumsum(sizes)[:-1])
                out = {
                    "doc_id": batch.column(0).slice(begin, len(texts)),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in split],
                    "decoded_sha256": [decoded_sha256(x, shown) for x in split],
                }
                if keep_ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                    out["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                if keep_decoded:
                    out["decoded"] = [decode(x, shown) for x in split]
                yield pa.RecordBatch.from_pydict(out)

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(
        encode, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{wanted}"
    )
