"""Token ids and counts of whole texts, equal to the tokenizer library's.

The word-level tokenizer never joins characters across white space: its added
tokens hold none, its normalizer maps each run to one space and its
pre-tokenizer drops it.  So a batch of texts is cut at ASCII white space and
its distinct pieces are found by Arrow, without a Python object a piece.
Pieces that are plain Latin letters, with or without one punctuation mark
behind, are folded to lower case and looked up in the worker's store; what the
store lacks goes to the library many to a call, the ends being found by the
vocabulary's end-of-word mark.  All other pieces go to the library as they are.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .caches import keep_only, register

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters whose normal form and lower case are one character: Latin-1 and Latin Extended-A without the dotted I.
_MARKS = ".,;:!?"
_PLAIN = rf"^[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+[{_MARKS}]?$"
END_OF_WORD = "</w>"
#: Bytes of text that are cut together.
STEP = 8 << 20

_ENCODERS: dict[tuple, "BatchEncoder"] = {}
register("tokens", _ENCODERS.clear)


def encoder(path: str, limit: int = 1_000_000) -> "BatchEncoder":
    """The encoder that this Python worker keeps between tasks."""
    keep_only("tokens")
    key = (path, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = BatchEncoder(path, limit)
    return _ENCODERS[key]


def steps(texts: pa.Array, size: int = STEP):
    """Slices ``(start, stop)`` of a string array, each of about ``size`` bytes or one row."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, stop
        start = stop


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]``, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class BatchEncoder:
    """Keeps ids of folded words and of odd pieces; ``limit`` bounds both stores.

    A full store is emptied, which costs time and never changes a result.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For folded letters the normalizer has nothing to do and words end at spaces only.
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.limit = limit
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.is_end = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.is_end[i] = token.endswith(END_OF_WORD)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.odd: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)
        self.entries = self.used = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Append entries to the store and return their numbers."""
        def room(array: np.ndarray, need: int) -> np.ndarray:
            return array if need <= len(array) else np.concatenate([array, np.zeros(max(need, 2 * len(array)) - len(array), dtype=array.dtype)])

        n = len(sizes)
        self.flat = room(self.flat, self.used + len(ids))
        self.start, self.size = room(self.start, self.entries + n), room(self.size, self.entries + n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.entries : self.entries + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.entries : self.entries + n] = sizes
        numbers = range(self.entries, self.entries + n)
        self.used, self.entries = self.used + len(ids), self.entries + n
        return numbers

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [done.ids for done in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in found], dtype=np.int64)
        return np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> np.ndarray:
        """Store numbers of distinct folded words."""
        known = self.known
        new = [word for word in words if word not in known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.lean.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            sizes = np.diff(ends, prepend=0)
            if len(ends) != len(part):  # a piece that isn't one pre-token after all: let the library cut
                ids, sizes = self._library(part)
            known.update(zip(part, self._add(ids, sizes)))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def _odd(self, pieces: list[bytes]) -> np.ndarray:
        new = [piece for piece in pieces if piece not in self.odd]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            self.odd.update(zip(part, self._add(*self._library([piece.decode(errors="replace") for piece in part]))))
        return np.fromiter(map(self.odd.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Store numbers of distinct pieces: of the word (or whole piece), and of the mark behind it or -1."""
        if len(self.known) + len(self.odd) > self.limit:
            self._empty()
        plain = pc.match_substring_regex(pieces, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        head, tail = np.zeros(len(pieces), dtype=np.int64), np.full(len(pieces), -1, dtype=np.int64)
        letters = pieces.filter(plain)
        if len(letters):
            words = pc.utf8_lower(pc.utf8_rtrim(letters, characters=_MARKS)).dictionary_encode()
            head[is_plain] = self._words(words.dictionary.to_pylist())[words.indices.to_numpy()]
            marks = pc.utf8_slice_codeunits(letters, start=-1).dictionary_encode()
            listed = marks.dictionary.to_pylist()
            numbers = np.array([self._words([mark])[0] if mark in _MARKS else -1 for mark in listed], dtype=np.int64)
            tail[is_plain] = numbers[marks.indices.to_numpy()]
        rest = pieces.filter(pc.invert(plain))
        if len(rest):
            head[~is_plain] = self._odd(rest.cast(pa.binary()).to_pylist())
        return head, tail

    def _cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of all texts as one dictionary array, and where each text's begin (one more than texts)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        return lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each text's end."""
        pieces, bounds = self._cut(texts)
        if not len(pieces):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        head, tail = self._pieces(pieces.dictionary)
        # Ids of distinct pieces first, then of all pieces.
        parts = np.stack([head, tail], axis=1).ravel()
        sizes = np.where(parts >= 0, self.size[parts], 0)
        distinct = gathered(self.flat, self.start[parts], sizes)
        size = sizes.reshape(-1, 2).sum(1)
        codes = pieces.indices.to_numpy()
        of_piece = size[codes]
        ids = gathered(distinct, (np.cumsum(size) - size)[codes], of_piece)
        return ids, np.concatenate([[0], np.cumsum(of_piece)])[bounds[1:]]

    def counts(self, texts: pa.Array, table: dict[bytes, int] | None = None) -> np.ndarray:
        """Number of tokens of each text; ``table`` has lengths of pieces that need no other look-up."""
        pieces, bounds = self._cut(texts)
        if not len(pieces):
            return np.zeros(len(texts), dtype=np.int64)
        distinct = pieces.dictionary
        size = np.full(len(distinct), -1, dtype=np.int64)
        if table:
            size = np.fromiter((table.get(piece, -1) for piece in distinct.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(distinct))
        missing = size < 0
        head, tail = self._pieces(distinct.filter(pa.array(missing)))
        size[missing] = self.size[head] + np.where(tail >= 0, self.size[tail], 0)
        return np.diff(np.concatenate([[0], np.cumsum(size[pieces.indices.to_numpy()])])[bounds])
