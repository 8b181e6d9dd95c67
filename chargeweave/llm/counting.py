"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word mark before it; its segmentation into pieces of a public
vocabulary is the one with the highest sum of piece scores, the shortest of these. The best score of
every prefix is kept at its node of the trie, so words that share a prefix share the work, and the
count of a finished word is kept at its end. A character in no piece costs more than any piece and
counts as its UTF-8 bytes. A worker drops its trie when it has ``MAX_NODES`` nodes and its finished
words when there are ``MAX_WORDS``; results do not depend on that.

Null and empty texts have no tokens; invalid UTF-8 is read with replacement characters. Rows are
counted one by one. Other columns pass through, but for ones named like the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Nodes and finished words a worker keeps, and the bytes from which on it forgets a word after use.
MAX_NODES = 1_000_000
MAX_WORDS = 1_000_000
LONG = 256
#: Scores are whole numbers; a value is score * UNIT - tokens.
UNIT = 1 << 24


def read_scores(path: str) -> dict[str, int]:
    """Score of every piece that stands for text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): round(model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class Trie:
    def __init__(self, scores: dict[str, int]):
        self.read = scores  # held, so that no other vocabulary takes its place in memory
        self.scores = {piece: score * UNIT - 1 for piece, score in scores.items()}
        self.longest = max(map(len, scores), default=1)
        self.unknown = (min(scores.values(), default=0) - 10) * UNIT
        self.counts: dict[bytes, int] = {}  # at the ends of words
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.values = [0]  # of the best segmentation of the prefix that ends at the node

    def count(self, words: list[bytes]) -> int:
        """The tokens of all words together."""
        counts = self.counts
        new = set(words).difference(counts)
        if len(counts) + len(new) > MAX_WORDS:
            counts.clear()
            new = set(words)
        for word in new:
            counts[word] = self.insert(MARK + word.decode("utf-8", "replace"))
        total = sum(map(counts.__getitem__, words))
        for word in new:
            if len(word) > LONG:
                del counts[word]
        return total

    def insert(self, word: str) -> int:
        if len(self.values) > MAX_NODES:
            self.clear()
        children, values, scores = self.children, self.values, self.scores
        node, path = 0, [0]
        for end in range(1, len(word) + 1):
            char = word[end - 1]
            child = children.get((node, char))
            if child is None:
                best = None
                for start in range(max(0, end - self.longest), end):
                    score = scores.get(word[start:end])
                    if score is not None and (best is None or path[start] + score > best):
                        best = path[start] + score
                if char not in scores:
                    other = path[-1] + self.unknown - len(char.encode("utf-8", "replace"))
                    best = other if best is None else max(best, other)
                child = children[node, char] = len(values)
                values.append(best)
            node = child
            path.append(values[node])
        return -path[-1] % UNIT


_tries: dict[int, Trie] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_pretokens and n_tokens instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_scores(path))  # as large as the vocabulary
    made = ("n_pretokens", "n_tokens")
    kept = [f for f in docs.schema if f.name not in (text, *made)]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _tries:
            _tries.clear()
            _tries[key] = Trie(shared.value)
        trie = _tries[key]
        for batch in batches:
            words, tokens = [], []
            for value in batch.column(text):
                # On bytes, split() cuts at space and \\x09-\\x0D only.
                found = (value.as_py() or b"").split()
                words.append(len(found))
                tokens.append(trie.count(found))
            arrays = [batch.column(f.name) for f in kept] + [pa.array(x, pa.int64()) for x in (words, tokens)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.withColumn(text, F.col(text).cast("binary")).mapInArrow(run, schema)
