"""Jaro-Winkler similarity, which Spark lacks: of two strings, and of many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np

#: Tokens or classes that are compared with a block at once, letters of a product, pairs that are returned at once, and the longest tokens that are scored together.
ROWS, WIDE, PAIRS, SHORT = 256, 256, 200_000, 32
#: Pairs whose characters are matched at once, few enough to stay near the processor, and letters whose places are kept.
STEP, KEPT = 1 << 15, 512


@lru_cache(maxsize=1 << 18)
def jaro_winkler(a: str, b: str) -> float:
    """1 for equal strings, 0 without a common character; a common start of up to 4 counts more once Jaro exceeds 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    from_a, hits = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                from_a.append(c)
                hits.append(j)
                break
    m = len(from_a)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(from_a, sorted(hits))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + 0.1 * start * (1 - jaro)


def _letters(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, letter, sizes)``: each character of each token with its number among equal ones of the token, so that common ones can be counted as a set."""
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    row = np.repeat(np.arange(len(tokens)), sizes)
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(codes, prepend=-1))
    number = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
    return row, codes << 32 | number, sizes


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, k: int) -> np.ndarray:
    """Common letters of ``n`` and ``k`` tokens, given as rows and letters; letters are taken WIDE at a time."""
    out = np.zeros((n, k), dtype=np.float32)
    shared = np.intersect1d(a[1], b[1])
    for at in range(0, len(shared), WIDE):
        some = shared[at : at + WIDE]
        held = []
        for (row, letter), size in ((a, n), (b, k)):
            place = np.minimum(np.searchsorted(some, letter), len(some) - 1)
            there = some[place] == letter
            held.append(np.zeros((size, len(some)), dtype=np.float32))
            held[-1][row[there], place[there]] = 1
        out += held[0] @ held[1].T
    return out


@lru_cache(maxsize=None)
def _scores(size: int) -> np.ndarray:
    """Similarities of a token of ``size`` to one of up to SHORT: by start, swaps, common characters and the other's size."""
    start, swaps, m, other = np.ogrid[0:5, 0 : SHORT // 2 + 1, 0 : SHORT + 1, 0 : SHORT + 1]
    jaro = np.where((m > 0) & (swaps <= m) & (other > 0), (m / size + m / np.maximum(other, 1) + (m - swaps) / np.maximum(m, 1)) / 3, 0.0)
    return np.where(jaro <= 0.7, jaro, jaro + 0.1 * start * (1 - jaro))


def _rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded as Spark does: the decimal that a double is printed as, halves away from 0."""
    if digits is None:
        return values
    some, which = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in some.tolist()])[which].reshape(values.shape)


@lru_cache(maxsize=None)
def _rounded_scores(size: int, digits: int | None) -> np.ndarray:
    return _rounded(_scores(size), digits)


class _Block:
    """Tokens of at most SHORT characters, those of the same letters next to each other.

    ``order`` has their places in the list given, ``kind`` the number of their letters' class, ``ends`` where classes
    end and ``sorts`` a token of each class; ``heads[n]`` numbers their first ``n`` characters by ``numbers[n]``.
    """

    def __init__(self, tokens: list[str], at: list[int]):
        keys = ["".join(sorted(tokens[x])) for x in at]
        by = sorted(range(len(at)), key=keys.__getitem__)
        self.order = np.array([at[x] for x in by], dtype=np.int64)
        self.tokens = [tokens[at[x]] for x in by]
        keys = [keys[x] for x in by]
        first = [x for x in range(len(by)) if not x or keys[x] != keys[x - 1]]
        self.sorts = [keys[x] for x in first]
        self.ends = [*first[1:], len(by)]
        self.kind = np.repeat(np.arange(len(first)), np.diff(first, append=len(by)))
        self.sizes = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(by))
        self.heads, self.numbers = [np.zeros(len(by), dtype=np.int32)], [{"": 0}]
        for n in range(1, 5):
            # A token shorter than n has no such start.
            number: dict[str, int] = {}
            self.heads.append(np.array([number.setdefault(t[:n], len(number)) if len(t) >= n else -1 for t in self.tokens], dtype=np.int32))
            self.numbers.append(number)
        row = np.repeat(np.arange(len(by)), self.sizes)
        codes = np.frombuffer("".join(self.tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        places = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        by_code = np.argsort(codes, kind="stable")
        self._codes, self._rows, self._bits = codes[by_code], row[by_code], np.uint32(1) << places[by_code].astype(np.uint32)
        self._kept: dict[int, np.ndarray] = {}

    def places(self, letter: str) -> np.ndarray:
        """Where the tokens have a letter, a bit a place."""
        code = ord(letter)
        if code not in self._kept:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            lo, hi = np.searchsorted(self._codes, [code, code + 1])
            self._kept[code] = np.zeros(len(self.tokens), dtype=np.uint32)
            np.bitwise_or.at(self._kept[code], self._rows[lo:hi], self._bits[lo:hi])
        return self._kept[code]


@lru_cache(maxsize=None)
def _windows(size: int) -> np.ndarray:
    """For each place of a token of ``size`` and each size of the other, the places where an equal character is common, as bits."""
    out = np.zeros((size, SHORT + 1), dtype=np.uint32)
    for other in range(1, SHORT + 1):
        reach = max(0, max(size, other) // 2 - 1)
        for i in range(size):
            out[i, other] = sum(1 << j for j in range(max(0, i - reach), min(other, i + reach + 1)))
    return out


def _class_alike(words: list[str], block: _Block, at: np.ndarray, starts: list[np.ndarray], cut: float, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, similarity)`` above ``cut`` of words of the same letters and the tokens of a block at ``at``; ``starts`` has the words' numbers of heads.

    Words go through their characters in step, each taking the first free place of an equal one in reach, as :func:`jaro_winkler` does.
    """
    size = len(words[0])
    letters = {c: n for n, c in enumerate(dict.fromkeys(words[0]))}
    sizes = block.sizes[at]
    kind = np.uint16 if max(size, sizes.max()) <= 16 else np.uint32
    where = np.stack([block.places(c)[at] for c in letters]).astype(kind)
    spelt = np.array([[letters[c] for c in w] for w in words])
    window = _windows(size)[:, sizes].astype(kind)
    scores = _scores(size)
    least = np.where(scores[:, 0] > cut, np.arange(SHORT + 1)[:, None], SHORT + 1).min(axis=1).astype(np.uint8)
    shape = len(words), len(at)
    free = np.full(shape, -1, dtype=np.int64).astype(kind)
    hit = np.empty((size, *shape), dtype=bool)
    less = np.empty(shape, dtype=kind)
    for i in range(size):
        new = where[spelt[:, i]]
        new &= window[i]
        new &= free
        np.negative(new, out=less)
        new &= less
        free ^= new
        np.not_equal(new, 0, out=hit[i])
    taken = np.invert(free, out=free)
    m = np.bitwise_count(taken)
    # Starts are looked at where the longest would do.
    passed = m >= least[4, sizes]
    if not passed.any():
        return (none := np.zeros(0, dtype=np.int64)), none, np.zeros(0)
    # Common characters of the words in their order against those of the tokens in theirs.
    swaps, other = np.zeros(shape, dtype=np.uint8), np.empty(shape, dtype=bool)
    for i in range(size):
        np.negative(taken, out=less)
        less &= taken
        less *= hit[i]
        taken ^= less
        less &= where[spelt[:, i]]
        np.equal(less, 0, out=other)
        other &= hit[i]
        swaps += other
    x, y = np.divmod(np.flatnonzero(passed), len(at))
    m, swaps, start = m[passed], swaps[passed], np.zeros(len(x), dtype=np.uint8)
    for n in range(1, 5):
        start += block.heads[n][at][y] == starts[n][x]
    place = start, swaps // 2, m, sizes[y]
    above = scores[place] > cut
    return x[above], at[y[above]], _rounded_scores(size, digits)[place][above]


def _short_alike(left: _Block, right: _Block, cut: float, digits: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`alike` of two blocks, class by class: only the classes whose common letters suffice for a start that a word and a token have are gone through."""
    (row, letter, sizes), n = _letters(right.sorts), len(right.sorts)
    begin = 0
    for at in range(0, len(left.sorts), ROWS):
        part = left.sorts[at : at + ROWS]
        own, own_letter, own_sizes = _letters(part)
        common = _common((own, own_letter), (row, letter), len(part), n)
        most = (common * (1.0 / own_sizes[:, None] + 1.0 / sizes[None, :]) + 1) / 3
        # The least common start with which a pair of these classes may pass; 5: none does.
        needs = np.full(most.shape, 5, dtype=np.int8)
        for start in range(4, -1, -1):
            needs[(most + 0.1 * start * (1 - most) > cut - 1e-6) & (common > 0)] = start
        for k in range(len(part)):
            end = left.ends[at + k]
            words = left.tokens[begin:end]
            starts = [np.array([right.numbers[s].get(w[:s], -2) if len(w) >= s else -2 for w in words]) for s in range(5)]
            need = needs[k][right.kind]
            some = need == 0
            for s in range(1, 5):
                shared = np.zeros(len(right.numbers[s]) + 1, dtype=bool)
                shared[starts[s][starts[s] >= 0]] = True
                some |= (need <= s) & shared[right.heads[s]]
            some = np.flatnonzero(some)
            for lo in range(0, len(some), STEP):
                few = some[lo : lo + STEP]
                step = max(1, STEP // len(few))
                for x in range(0, len(words), step):
                    i, j, similarity = _class_alike(words[x : x + step], right, few, [h[x : x + step] for h in starts], cut, digits)
                    if len(i):
                        yield left.order[begin + x + i], right.order[j], similarity
            begin = end


def alike(tokens: list[str], others: list[str], cut: float, digits: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, similarity)`` of all ``tokens[i]`` and ``others[j]``, none empty, above ``cut``, rounded to ``digits`` if given, a bounded number of pairs at a time.

    ``m`` common letters bound Jaro by ``(m / |a| + m / |b| + 1) / 3``, and ``cut``, 0.82 at
    least, needs a Jaro above 0.7, to which a common start adds.  Letters are common to all tokens that are
    orders of the same ones, so that the bound is taken once for each two such classes.
    """
    left, right = ([[n for n, t in enumerate(side) if (len(t) > SHORT) == long] for long in (False, True)] for side in (tokens, others))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for some in _short_alike(_Block(tokens, left[0]), _Block(others, right[0]), cut, digits) if left[0] and right[0] else ():
        found.append(some)
        held += len(some[0])
        if held >= PAIRS:
            yield tuple(map(np.concatenate, zip(*found)))
            found, held = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))
    for a, b in ((left[1], right[0] + right[1]), (left[0], right[1])):
        for i, j, similarity in _long_alike([tokens[x] for x in a], [others[x] for x in b], cut):
            yield np.array(a)[i], np.array(b)[j], _rounded(similarity, digits)


def _long_alike(tokens: list[str], others: list[str], cut: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`alike` a pair at a time where the bound is passed, for tokens of any length."""
    if not tokens or not others:
        return
    heads = [np.array([ord(t[n]) if n < len(t) else -1 - side for t in side_tokens], dtype=np.int64).reshape(1, -1) for side, side_tokens in enumerate((tokens, others)) for n in range(4)]
    heads = [np.concatenate(heads[:4]), np.concatenate(heads[4:])]
    row, letter, size_b = _letters(others)
    for at in range(0, len(tokens), ROWS):
        part = tokens[at : at + ROWS]
        own, own_letter, size_a = _letters(part)
        common = _common((own, own_letter), (row, letter), len(part), len(others))
        bound = common * (1.0 / size_a[:, None] + 1.0 / size_b[None, :])
        # A start of four at the most.
        i, j = np.nonzero(bound > 3 * (cut - 0.4) / 0.6 - 1 - 1e-6)
        most = (bound[i, j] + 1) / 3
        same = np.cumprod(heads[0][:, at + i] == heads[1][:, j], axis=0).sum(axis=0)
        left = most + 0.1 * same * (1 - most) > cut - 1e-6
        i, j = i[left], j[left]
        similarity = np.array([jaro_winkler(part[x], others[y]) for x, y in zip(i, j)], dtype=float)
        above = similarity > cut
        if above.any():
            yield at + i[above], j[above], similarity[above]
