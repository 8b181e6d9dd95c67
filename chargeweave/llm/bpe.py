"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of every byte prefix of a pre-token exactly one token can be the last of its encoding: the longest
way to see it is that a token may follow the last token of the shorter prefix only if the two,
merged on their own, stay the same two tokens. So one token per prefix is stored, the encoding is
read from the end, bytes can be appended without looking back, and an edit keeps the prefixes before
it. Pre-tokens that a worker has not met before are sorted, so that each starts from the prefixes it
shares with the one before. A worker keeps those met lately, in two generations of about ``CACHE``,
and works through its batches in pieces of about ``TOGETHER`` bytes, which bounds its memory.

Null texts count as empty; invalid UTF-8 is read with replacement characters. Other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os.path
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens in a generation of a worker's cache, and the characters from which on it forgets one
#: after use.
CACHE = 200_000
LONG = 256
#: Pairs of tokens whose verdict a worker keeps.
PAIRS = 250_000
#: Characters (bytes of a batch) whose new pre-tokens are encoded together.
TOGETHER = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        v = self.vocabulary
        self.data += more
        data, last, rank, pairs, n = self.data, self.last, v.ranks.get, v.pairs.get, v.size
        for end in range(len(last) + 1, len(data) + 1):
            # One token fits, so the order is free; the short ones fit most often.
            for start in range(end - 1, max(0, end - v.longest) - 1, -1):
                b = rank(data[start:end])
                if b is None:
                    continue
                if start == 0:
                    fits = v.whole(b)
                else:
                    pair = last[start - 1] * n + b
                    fits = pairs(pair)
                    if fits is None:
                        fits = v.fits(pair)
                if fits:
                    last.append(b)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {data!r}")

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Put ``by`` in place of [start, end); prefixes before ``start`` are kept."""
        rest = self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(by + rest)

    def ids(self) -> list[int]:
        out, end, sizes = [], len(self.data), self.vocabulary.sizes
        while end:
            out.append(self.last[end - 1])
            end -= sizes[out[-1]]
        return out[::-1]

    def tokens(self) -> list[bytes]:
        return [self.vocabulary.tokens[x] for x in self.ids()]


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {b: a for a, b in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.sizes = {a: len(b) for b, a in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}  # by id * size + id
        self.wholes: dict[int, bool] = {}
        self.split_at: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the generation before

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The merges in order of rank, down to ``until`` parts; only for one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best = min(
                (self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i)
                for i in range(len(parts) - 1)
            )
            if best[0] == len(self.ranks):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def whole(self, token: int) -> bool:
        found = self.wholes.get(token)
        if found is None:
            data = self.tokens[token]
            self.wholes[token] = found = self.merge(data) == [data]
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two ids whose merge is the last one of a token; a byte and itself for a byte. None if
        some merge on the way has a lower rank than one before it, so that ranks tell no order."""
        if token not in self.split_at:
            data, found = self.tokens[token], (token, token)
            if len(data) > 1:
                a, b = (self.ranks[x] for x in self.merge(data, 2))
                kept = max(a, b) < token and self.halves(a) and self.halves(b)
                found = (a, b) if kept else None
            self.split_at[token] = found
        return self.split_at[token]

    def fits(self, pair: int) -> bool:
        """Whether two tokens side by side stay as they are. Their merges are undone, the latest
        first; at no moment may the parts at the border merge before the next one of either side."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        left, right = divmod(pair, self.size)
        if not self.whole(right):
            found = False
        elif self.halves(left) is None or self.halves(right) is None:
            both = [self.tokens[left], self.tokens[right]]
            found = self.merge(both[0] + both[1]) == both
        else:
            found = self._apart(left, right)
        self.pairs[pair] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        tokens, sizes = self.tokens, self.sizes
        limit = self.size
        while True:
            if self.ranks.get(tokens[left] + tokens[right], self.size) < limit:
                return False
            if sizes[left] == 1 and sizes[right] == 1:
                return True
            # Of two equal merges the left one comes first.
            if sizes[right] == 1 or (sizes[left] > 1 and left > right):
                limit, left = left, self.halves(left)[1]
            else:
                limit, right = right + 1, self.halves(right)[0]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pre-tokens not met before in order of their bytes, each from the prefix it
        shares with the one before."""
        if len(self.pieces) >= CACHE:
            self.older, self.pieces = self.pieces, {}
        new = pieces - self.pieces.keys()
        known = new & self.older.keys()
        for piece in known:
            self.pieces[piece] = self.older.pop(piece)
        new -= known
        before = Prefixes(self)
        for data in sorted(x.encode() for x in new):
            if data in self.ranks:
                found = (self.ranks[data],)
            else:
                same = len(os.path.commonprefix((before.data, data)))
                before.replace(same, len(before.data), data[same:])
                found = tuple(before.ids())
            self.pieces[data.decode()] = found

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; texts are taken together up to ``TOGETHER`` characters."""
        split, size = [], 0
        for text in texts:
            split.append(self.split(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._joined(split)
                split, size = [], 0
        yield from self._joined(split)

    def _joined(self, split: list[list[str]]) -> Iterator[list[int]]:
        distinct = set(chain.from_iterable(split))
        self.learn(distinct)
        for pieces in split:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
        for long in (x for x in distinct if len(x) > LONG):
            del self.pieces[long]

    def encode(self, text: str) -> list[int]:
        (ids,) = self.encode_all([text])
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: A worker serves encoding and decoding tasks in turn; each finds its vocabulary and cache again.
_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(shared, pattern: str) -> Vocabulary:
    key = (id(shared.value), pattern)
    if key not in _loaded:
        if len(_loaded) >= 2:
            _loaded.clear()
        _loaded[key] = Vocabulary(shared.value, pattern)
    return _loaded[key]


def _with_fields(df: DataFrame, drop: str, **fields: T.DataType) -> T.StructType:
    kept = [f for f in df.schema if f.name not in (drop, *fields)]
    return T.StructType([*kept, *(T.StructField(k, v) for k, v in fields.items())])


def _map(df: DataFrame, column: str, fields: dict[str, T.DataType], work) -> DataFrame:
    """Arrow batches, cut to ``TOGETHER`` bytes of the column (or one row), through
    ``work(list of column values) -> arrays in order of fields``."""
    schema = _with_fields(df, column, **fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, column):
                made = dict(zip(fields, work(part.column(column)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [made[f.name] if f.name in made else part.column(f.name) for f in schema],
                    schema.names,
                )

    return df.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    values = batch.column(column)
    binary = pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)
    length, width = (pc.binary_length, 1) if binary else (pc.list_value_length, 4)
    upto = np.cumsum(width * length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(upto // TOGETHER)) + 1
    for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(first), int(last - first))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``n_tokens`` instead of the text."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # as large as the vocabulary

    def work(column: pa.Array) -> list[pa.Array]:
        v = _vocabulary(shared, pattern)
        offsets, flat = [0], []
        for ids in v.encode_all((x.as_py() or b"").decode("utf-8", "replace") for x in column):
            flat.append(np.array(ids, np.int32))
            offsets.append(offsets[-1] + len(ids))
        values = np.concatenate(flat) if flat else np.empty(0, np.int32)
        return [
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
            pa.array(np.diff(offsets).astype(np.int64)),
        ]

    raw = df.withColumn(text, F.col(text).cast("binary"))
    return _map(raw, text, {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}, work)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary) and ``ids_sha256`` instead of the ids."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(column: pa.Array) -> list[pa.Array]:
        v = _vocabulary(shared, "")
        out, digests = [], []
        for row in column:
            values = np.empty(0, "<u4")
            if row.is_valid:
                values = row.values.to_numpy(zero_copy_only=False).astype("<u4")
            out.append(v.decode(values.tolist()))
            digests.append(hashlib.sha256(values.tobytes()).hexdigest())
        return [pa.array(out, pa.binary()), pa.array(digests)]

    return _map(df, ids, {"decoded": T.BinaryType(), "ids_sha256": T.StringType()}, work)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the bytes decoded from them."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern)
    return decode(encoded, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
