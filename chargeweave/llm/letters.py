"""Words one edit apart, by range searches in k-d trees over letter counts.

One replaced letter changes the vector of letter counts by 2 in L1 distance, one inserted letter by 1.
Per pair of lengths (equal, or one more) the vectors of the shorter words are searched in k-d trees
over the vectors of the longer; a subtree is left out when its bounding box is farther than that.
Vectors of whole counts whose sums are equal (or differ by one) have L1 distance 2 (or 1) exactly
when their squared Euclidean distance is, so a leaf is one matrix product. The letters in which two
vectors differ then say which edits can lead from one word to the other: only these are tried, so words of
the same letters are never compared all with all.

Letters are one byte each in Latin-1: a-z and À-ÿ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 256
_LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint8)
DIMS = len(_LETTERS)
_DIM = np.zeros(256, dtype=np.int64)
_DIM[_LETTERS] = np.arange(DIMS)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 2048
_CELLS = 1 << 21


def spell(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(-1, length)


def letter_counts(spelled: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(spelled), DIMS), dtype=np.float32)
    rows = np.arange(len(spelled))
    for column in spelled.T:
        counts[rows, _DIM[column]] += 1
    return counts


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)


def split_point(values: np.ndarray) -> tuple[int, float] | None:
    """Letter of the largest variance and the count up to which a vector goes left."""
    low, high = values.min(0), values.max(0)
    if not (high > low).any():
        return None
    letter = int(np.argmax(values.var(0)))
    at = np.floor(min(np.median(values[:, letter]), high[letter] - 1))
    return letter, float(max(at, low[letter]))


def _distance(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """L1 distance of points from a box."""
    return (np.maximum(low - points, 0) + np.maximum(points - high, 0)).sum(1)


class Tree:
    """A k-d tree over different vectors."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.nodes: list[list] = []
        self._grow(vectors, 0, len(vectors))
        self.points = vectors[self.order]
        self.squares = (self.points**2).sum(1)

    def _grow(self, vectors: np.ndarray, first: int, end: int) -> int:
        inside = vectors[self.order[first:end]]
        node, place = [inside.min(0), inside.max(0), first, end, -1, -1], len(self.nodes)
        self.nodes.append(node)
        cut = split_point(inside) if end - first > LEAF else None
        if cut:
            left = inside[:, cut[0]] <= cut[1]
            part = self.order[first:end]
            self.order[first:end] = np.concatenate([part[left], part[~left]])
            middle = first + int(left.sum())
            node[4] = self._grow(vectors, first, middle)
            node[5] = self._grow(vectors, middle, end)
        return place

    def near(self, sought: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (row of sought, row of the tree's vectors) at exactly this distance."""
        squares = (sought**2).sum(1)
        stack = [(0, np.arange(len(sought)))]
        while stack:
            place, active = stack.pop()
            low, high, first, end, left, right = self.nodes[place]
            active = active[_distance(low, high, sought[active]) <= distance]
            if not len(active):
                continue
            if left >= 0:
                stack += [(left, active), (right, active)]
                continue
            for k in range(0, len(active), _ROWS):
                rows = active[k : k + _ROWS]
                apart = squares[rows][:, None] + self.squares[first:end] - 2 * sought[rows] @ self.points[first:end].T
                i, j = np.nonzero(np.rint(apart) == distance)
                yield rows[i], self.order[first + j]


class Index:
    """Words of one length, searchable for words one edit away."""

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        self.spelled = spell(words, self.length)
        self.vectors = np.unique(letter_counts(self.spelled), axis=0)
        self.tree = Tree(self.vectors)
        self.hashes = self._hash(self.spelled)
        self.by_hash = np.argsort(self.hashes)
        self.sorted = self.hashes[self.by_hash]

    @staticmethod
    def _hash(spelled: np.ndarray) -> np.ndarray:
        powers = _powers(spelled.shape[1])
        total = np.zeros(len(spelled), dtype=np.uint64)
        for k, column in enumerate(spelled.T):
            total += column.astype(np.uint64) * powers[k]
        return total

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in hashes, word) of equal hashes; equal hashes of different words all count."""
        low = np.searchsorted(self.sorted, hashes, "left")
        n = np.searchsorted(self.sorted, hashes, "right") - low
        place = np.repeat(np.arange(len(hashes)), n)
        within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.by_hash[low[place] + within]

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (word given, word held) one edit apart, each once.

        The words given have one length, the held ones' or one less.
        """
        length = len(words[0])
        spelled = spell(words, length)
        vectors, of = np.unique(letter_counts(spelled), axis=0, return_inverse=True)
        members = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=len(vectors))
        start = np.cumsum(n) - n
        at_once = max(1, _CELLS // (length + 1))
        for i, j in self.tree.near(vectors, 2 if length == self.length else 1):
            change = self.vectors[j] - vectors[i]
            gained = _LETTERS[change.argmax(1)]
            lost = _LETTERS[change.argmin(1)]
            row = np.repeat(np.arange(len(i)), n[i])
            within = np.arange(len(row)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            word = members[start[i][row] + within]
            for k in range(0, len(word), at_once):
                w, r = word[k : k + at_once], row[k : k + at_once]
                if length == self.length:
                    yield self._replaced(spelled, w, lost[r], gained[r])
                else:
                    yield self._inserted(spelled, w, gained[r])

    def _replaced(self, spelled, word, lost, gained):
        powers = _powers(self.length)
        base = self._hash(spelled[word])
        k, at = np.nonzero(spelled[word] == lost[:, None])
        step = gained[k].astype(np.uint64) - lost[k].astype(np.uint64)  # modulo 2**64
        place, held = self._found(base[k] + step * powers[at])
        given = word[k[place]]
        right = (spelled[given] != self.spelled[held]).sum(1) == 1
        return given[right], held[right]

    def _inserted(self, spelled, word, gained):
        length = self.length - 1
        letters = spelled[word]
        powers = _powers(self.length)
        terms = letters.astype(np.uint64) * powers[:length]
        zero = np.zeros((len(word), 1), dtype=np.uint64)
        before = np.concatenate([zero, np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        after = (before[:, -1:] - before) * _BASE
        hashes = before + gained[:, None].astype(np.uint64) * powers[: length + 1] + after
        # a letter inserted behind an equal one gives the same word as before it
        k, at = np.nonzero(np.c_[np.ones(len(word), dtype=bool), letters != gained[:, None]])
        place, held = self._found(hashes[k, at])
        k, at = k[place], at[place]
        given = word[k]
        column = np.arange(self.length)
        source = column[None, :] - (column[None, :] > at[:, None])
        made = np.take_along_axis(spelled[given], np.minimum(source, length - 1), axis=1)
        made[np.arange(len(at)), at] = gained[k]
        right = (made == self.spelled[held]).all(1)
        return given[right], held[right]


class Shards:
    """The upper part of the k-d tree of one length: which shard holds a vector, which are in reach.

    Splits are fitted to a sample of vectors until a shard is expected to hold ``most`` words.
    """

    def __init__(self, sample: np.ndarray, n: int, most: int):
        self.nodes: list[tuple] = []  # (letter, at, left, right) or the shard's number
        self.count = 0
        self._grow(sample, n, most)

    def _grow(self, sample: np.ndarray, n: float, most: int) -> int:
        place = len(self.nodes)
        cut = split_point(sample) if n > most and len(sample) > 1 else None
        if cut is None:
            self.nodes.append((self.count,))
            self.count += 1
            return place
        self.nodes.append(())
        left = sample[:, cut[0]] <= cut[1]
        share = n / len(sample)
        low = self._grow(sample[left], share * left.sum(), most)
        high = self._grow(sample[~left], share * (~left).sum(), most)
        self.nodes[place] = (*cut, low, high)
        return place

    def within(self, vectors: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the vectors whose distance from its box is at most this one.

        At distance 0 each vector is in one shard.
        """
        low = np.full(DIMS, -np.inf, dtype=np.float32)
        stack = [(0, np.arange(len(vectors)), low, -low)]
        while stack:
            place, active, low, high = stack.pop()
            active = active[_distance(low, high, vectors[active]) <= distance]
            if not len(active):
                continue
            node = self.nodes[place]
            if len(node) == 1:
                yield node[0], active
                continue
            letter, at, left, right = node
            up, down = low.copy(), high.copy()
            up[letter], down[letter] = max(low[letter], at + 1), min(high[letter], at)
            stack += [(left, active, low, down), (right, active, up, high)]
