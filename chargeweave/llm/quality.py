"""Quality rules with verdicts on hosts.

Every text is measured by built-in functions. Rule failures are then counted per host (the
``source`` column), the failure rate of each host and rule is shrunk towards all hosts by a beta
prior fitted to them by moments, and a host whose shrunk rate passes ``MAX_HOST_RATE`` for any rule
loses all its documents.

Null and empty texts have no words and fail ``short``. A null source is a host of its own. Repeated
rows count and return one by one. Other columns are ignored by ``measure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeweave.llm.words import SPACES, let, source_key, whole_text, words
from chargeweave.session import stage

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINES = 30
MAX_HOST_RATE = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("fails_short", "fails_repeat", "fails_symbols", "fails_lines")


def _covered(starts: Column) -> Column:
    """Words under windows of WINDOW words with these ascending starts."""
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts,
        first,
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
        ),
        lambda a: a["n"],
    )


def _starts_of_repeats(windows: Column) -> Column:
    """Positions of the windows that occur twice or more: neighbours after sorting."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(z: Column, k: Column, step: int) -> Column:
        return F.coalesce(F.get(z, k + step)["h"] == F.get(z, k)["h"], F.lit(False))

    def starts(z: Column) -> Column:
        at = F.transform(
            F.sequence(F.lit(0), F.size(z) - 1),
            lambda k: F.when(same(z, k, -1) | same(z, k, 1), F.get(z, k)["i"]),
        )
        return F.sort_array(F.array_compact(at))

    return let(tagged, starts)


def repeat_words(of: Column) -> Column:
    """Words in windows of five words found twice or more. Windows are compared as 64-bit hashes."""

    def count(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )
        return let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                _covered(_starts_of_repeats(h))
            ),
        )

    return let(of, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(count(w)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five measures (long); columns of these names are replaced."""
    whole = whole_text(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    n_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = let(
        words(whole),
        lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    found = docs.withColumn("_counts", counts).withColumns(
        {
            "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": n_lines.cast("long"),
        }
    )
    return found.withColumns(
        {k: F.col("_counts")[k].cast("long") for k in ("n_words", "n_repeat_words")}
    ).drop("_counts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def rule_failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "fails_short": n < MIN_WORDS,
        "fails_repeat": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "fails_symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "fails_lines": F.col("n_dup_lines") > MAX_DUP_LINES,
    }


def host_rates(measured: DataFrame, source: str = "source") -> DataFrame:
    """Per host key and rule: documents, failures and the shrunk failure rate.

    The prior's mean is the rate of all documents, its strength follows from the variance between
    hosts beyond the binomial one; without such variance the strength is the count of all documents,
    which leaves every host at the common rate.
    """
    fails = rule_failures()
    per_host = measured.groupBy(source_key(F.col(source)).alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c.cast("long")).alias(k) for k, c in fails.items()),
    )
    long = per_host.select(
        "host",
        "n",
        F.explode(
            F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("f")) for k in RULES))
        ).alias("r"),
    ).select("host", "n", "r.rule", "r.f")
    rate, mean = F.col("f") / F.col("n"), F.col("mean")
    means = long.groupBy("rule").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("hosts"),
        (F.sum("f") / F.sum("n")).alias("mean"),
        F.sum(F.col("f") * rate).alias("square"),
    )
    binomial = mean * (1 - mean)
    between = (
        F.col("square") / F.col("total") - mean * mean - binomial * F.col("hosts") / F.col("total")
    )
    prior = means.withColumn("between", between).select(
        "rule",
        "mean",
        F.when(
            F.col("between") > 1e-12,
            F.greatest(F.lit(1.0), F.least(F.col("total"), binomial / F.col("between") - 1)),
        )
        .otherwise(F.col("total").cast("double"))
        .alias("strength"),
    )
    return long.join(F.broadcast(prior), "rule").select(  # one row for each of the four rules
        "host", "rule", "n", "f",
        ((F.col("f") + mean * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"),
    )


def failed_hosts(measured: DataFrame, source: str = "source") -> DataFrame:
    """host, host_failed: written, so that its size decides whether the documents, of which one host
    may hold a third, are shuffled to it at all."""
    hosts = (
        host_rates(measured, source)
        .groupBy("host")
        .agg((F.max("rate") > MAX_HOST_RATE).alias("host_failed"))
    )
    return stage(hosts, "hosts")


def judge(measured: DataFrame, hosts: DataFrame, source: str = "source") -> DataFrame:
    """``measured`` with ``base_failed``, ``host_failed`` and ``kept``."""
    return (
        measured.withColumn("host", source_key(F.col(source)))
        .join(hosts, "host")
        .drop("host")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and verdicts of every document."""
    measured = stage(measure(docs.select("doc_id", "text", "source")).drop("text"), "measured")
    return judge(measured, failed_hosts(measured)).select(
        "doc_id", *MEASURES, "base_failed", "host_failed", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured twice, for the hosts and for
    the result, and not written in between."""
    names = docs.columns
    hosts = failed_hosts(measure(docs.select("text", "source")).drop("text"))
    packed = docs.select(F.struct(*names).alias("doc"), "text", "source")
    return judge(measure(packed), hosts).where("kept").select(*(F.col("doc")[c].alias(c) for c in names))
