"""Spelling variants: words, their more frequent near words, and the roots these lead to.

Runs of letters (A-Z, a-z, À-ÿ) are counted with A-Z lowered. Words of ``MIN_LETTERS`` letters or more
that occur ``MIN_COUNT`` times or more are searched for words one inserted, deleted or replaced
letter away (``letters.py``). The vocabulary is dealt out by length and by the upper part of a k-d tree
for lengths with over ``SHARD`` words, whose splits are fitted to ``SAMPLE`` words (those of least hash;
the sample only decides how evenly shards are filled). Every word is held by one shard and sought
in all shards whose box is in reach, of its own length and the next, so that no pair is lost.

Null and empty texts have no words. Repeated rows count each. A null doc_id counts as empty text in
the hash that decides on deletions. Ties between near words of equal count go to the first in
code-point order. Without words the result is empty. Runs may be of any length. Other columns are
ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.llm.letters import Index, Shards, letter_counts, spell
from chargeweave.llm.words import whole_text
from chargeweave.session import stage

MIN_LETTERS = 5
MIN_COUNT = 3
TIMES = 2
TYPO_EVERY = 97
SHARD = 50_000
SAMPLE = 20_000
MAX_ROUNDS = 8
_LONG_RUN = "[A-Za-zÀ-ÿ]{%d,}+" % MIN_LETTERS


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: runs of MIN_LETTERS letters or more with A-Z lowered."""
    found = docs.select(
        "doc_id", F.explode(F.regexp_extract_all(whole_text(), F.lit(_LONG_RUN), F.lit(0))).alias("run")
    )
    lowered = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    return found.select("doc_id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(lowered).alias("run"))


def with_typos(found: DataFrame) -> DataFrame:
    """word: the runs, of which one in TYPO_EVERY lacks a letter, by a hash of doc_id and run."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    made = found.select("run", h.alias("h")).select(
        F.when(F.col("h") % TYPO_EVERY == 0, without).otherwise(F.col("run")).alias("word")
    )
    return made.where(F.length("word") >= MIN_LETTERS)


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n of the words that occur MIN_COUNT times or more, written as a stage."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)
    return stage(counted, "vocabulary")


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for length, places in groupby(order, key=lambda k: len(words[k])):
        yield length, list(places)


def fit_shards(vocab: DataFrame, most: int = SHARD) -> dict[int, Shards]:
    """Upper trees of the lengths with more than ``most`` words; other lengths are one shard each."""
    sizes = vocab.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    large = {r["length"]: r["n"] for r in sizes.where(F.col("n") > most).collect()}
    if not large:
        return {}
    drawn = vocab.where(F.length("word").isin(list(large))).orderBy(F.xxhash64("word")).limit(SAMPLE).select("word")
    words = [r["word"] for r in drawn.collect()]
    return {
        length: Shards(letter_counts(spell([words[k] for k in places], length)), large[length], most)
        for length, places in _by_length(words)
    }


_DEALT = "length int, shard int, sought boolean, word string, n long"
_PAIRS = "word string, n long, near string, near_n long"


def _deal(shards: dict[int, Shards]):
    one = Shards(np.zeros((0, 1), dtype=np.float32), 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, places in _by_length(words):
                vectors = letter_counts(spell([words[k] for k in places], length))
                places = np.array(places)
                for held_in, distance, sought in ((length, 0, False), (length, 2, True), (length + 1, 1, True)):
                    for shard, rows in shards.get(held_in, one).within(vectors, distance):
                        own = batch.take(pa.array(places[rows]))
                        n = len(rows)
                        yield pa.record_batch(
                            [
                                pa.array(np.full(n, held_in, np.int32)),
                                pa.array(np.full(n, shard, np.int32)),
                                pa.array(np.full(n, sought)),
                                own.column(0).cast(pa.string()),
                                own.column(1),
                            ],
                            ["length", "shard", "sought", "word", "n"],
                        )

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, the held words first. Only one shard's held words are in memory."""
    now, held, counts, index = None, [], [], None
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(5)))
        for (shard, sought), group in groupby(rows, key=lambda r: (r[:2], r[2])):
            words, n = map(list, zip(*((r[3], r[4]) for r in group)))
            if shard != now:
                now, held, counts, index = shard, [], [], None
            if not sought:
                held += words
                counts += n
                continue
            if not held:
                continue
            if index is None:
                index, names, times = Index(held), np.array(held, dtype=object), np.array(counts)
            for length, places in _by_length(words):
                given = np.array([words[k] for k in places], dtype=object)
                given_n = np.array([n[k] for k in places])
                for i, j in index.near(given.tolist()):
                    ways = [(given[i], given_n[i], names[j], times[j])]
                    if length < index.length:
                        ways.append((names[j], times[j], given[i], given_n[i]))
                    for w, wn, x, xn in ways:
                        if len(w):
                            yield pa.record_batch(
                                [pa.array(w, pa.string()), pa.array(wn), pa.array(x, pa.string()), pa.array(xn)],
                                ["word", "n", "near", "near_n"],
                            )


def near_words(vocab: DataFrame, shards: dict[int, Shards]) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words one edit apart."""
    dealt = vocab.select("word", "n").mapInArrow(_deal(shards), _DEALT)
    ordered = dealt.repartition("length", "shard").sortWithinPartitions("length", "shard", "sought")
    return ordered.mapInArrow(_search, _PAIRS)


def forms(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest count, if it has TIMES as many."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    chosen = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocab.join(chosen, "word", "left")
    best_n = -F.col("best.less")
    enough = best_n >= TIMES * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, best_n).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` (word, form, ...) with ``root``, by doubling the steps taken each round.

    Counts at least double from a word to its form, so chains are short and end.
    """
    ahead = stage(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        following = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = ahead.join(following, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        further = stage(further, "roots")
        ahead = further.select("word", "root")
        if not further.where("moved").head(1):
            break
    else:
        raise RuntimeError(f"forms did not settle in {MAX_ROUNDS} rounds")
    return formed.join(ahead, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame, most: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of ``docs`` (doc_id, text)."""
    vocab = vocabulary(with_typos(runs(docs)))
    formed = stage(forms(vocab, near_words(vocab, fit_shards(vocab, most))), "formed")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
