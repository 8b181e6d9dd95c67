"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans come from strict patterns and checks and always stay. Candidates beyond them are matches
of the strict patterns that fail the checks, and matches of looser patterns in the text around the
base spans. Six labelers vote yes, no or not at all on every candidate: the strict pattern, the
checksum or range, the usual shape, a gazetteer, helpful context and contrary context. A model with
one hidden label per candidate is fitted by expectation-maximisation to the counts of vote patterns
per kind (at most 4 * 3^6 rows, counted over all documents), which gives each labeler's reliability.
A logistic regression is trained on the resulting soft labels. It sees the votes and the span itself,
each as a hashed feature per kind: length, character classes, separators, first and last characters
and the words around it. Candidates it gives ``ACCEPT`` or more become spans. It is fitted to a sample
of ``SAMPLE`` different candidates at most, by hash, with their counts; all other counts cover all
documents. Positions are code points, ends exclusive.

Null and empty texts have no spans; without any candidate, as in an empty table, nothing is trained.
Time is linear in the length of a text and, but for short copies inside blocks of ``BLOCK``, in its
spans, so very long texts are read whole. Rows are handled one by one, so repeated rows repeat; other
columns pass through ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeweave.llm.words import let, whole_text
from chargeweave.session import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "check", "shape", "gazetteer", "context", "contrary")
ACCEPT = 0.9
EM_STEPS = 12
NEAR = 32
YES, NO, NONE = 1, 2, 0
#: Hashed features of the classifier, and the different candidates it is fitted to at most (expected).
DIMENSIONS = 1024
SAMPLE = 100_000
#: Places summed up in one short array, and code points in one piece of a text that is cut up.
BLOCK = 256
PIECE = 1024

# The strict patterns. Possessive quantifiers and the look-behind (unless a match ends
# there) find the same matches without trying every start inside a long run.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HOLD: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
MAY_HOLD_LOOSE = {
    "email": r"[(\[]at[)\]]",
    "ip": r"[0-9]\[\.\][0-9]",
    "card": r"[0-9]{4}[._/][0-9]{4}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}.*[.)\]]\x20?[A-Za-z]{2,24}$",
    "ip": r"^[0-9]{1,3}(?:\D+[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{15,16}|[0-9]{4}(?:[ ._/-][0-9]{4}){3})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}$",
}
#: Top-level domains, first bytes of public addresses, issuer digits, calling codes.
GAZETTEER = {
    "email": r"[.)\]]\x20?(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|us|eu|ca|au|jp|cn|ru|br|in|nl|ch|at|be|se|pl)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\D",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mails?|contact|write to|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|ping|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
}
CONTRARY = r"(?i)\b(?:version|build|release|section|isbn|order|serial|invoice|page|sha|id)\b"

_SPAN = "struct<start:int,end:int,value:string,near:string>"


def _so_far(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(
        values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x)))
    )


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op``, a sum or a greatest value, gives for all that comes before each place of an array
    of whole numbers from 0, and, as one element more, for all of it. Arrays grow within blocks only."""
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: _so_far(F.slice(values, b * BLOCK + 1, BLOCK), op)
    )

    def joined(s: Column) -> Column:
        inner = F.zip_with(
            s["blocks"],
            F.slice(s["firsts"], F.lit(1), F.size(s["blocks"])),
            lambda b, f: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: op(f, x)),
        )
        return F.concat(F.flatten(inner), F.array(F.element_at(s["firsts"], -1)))

    return let(
        let(
            blocks,
            lambda b: F.struct(
                b.alias("blocks"), _so_far(F.transform(b, lambda x: F.element_at(x, -1)), op).alias("firsts")
            ),
        ),
        joined,
    )


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _cut(text: Column, pattern: str) -> Column:
    """m: the leftmost non-overlapping matches; g: what lies before, between and after them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g"))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places and the ``NEAR`` characters between them
    and the matches next to them."""

    def placed(s: Column) -> Column:
        lengths = F.zip_with(
            F.slice(s["g"], F.lit(1), F.size(s["m"])), s["m"], lambda g, m: F.length(g) + F.length(m)
        )

        def span(at: Column, m: Column, i: Column) -> Column:
            gap, after = F.get(s["g"], i), F.get(s["g"], i + 1)
            return let(
                F.get(at, i) + F.length(gap),
                lambda start: F.struct(
                    start.alias("start"),
                    (start + F.length(m)).alias("end"),
                    m.alias("value"),
                    F.concat(F.right(gap, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))).alias("near"),
                ),
            )

        return let(before(lengths, _sum), lambda at: F.transform(s["m"], lambda m, i: span(at, m, i)))

    return let(_cut(text, pattern), placed)


def _spans_or_none(text: Column, test: Column, pattern: str) -> Column:
    return F.when(test, matches(text, pattern)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        values = F.transform(
            F.array_remove(F.split(F.reverse(digits), ""), ""),
            lambda d, i: let(
                d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    return total(_digits(value)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a strict match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    n = F.length(_digits(value))
    return n.between(16, 19) & _luhn(value) if kind == "card" else n.between(8, 15)


def _masked(text: Column, pattern: str) -> Column:
    """The text with NUL characters in place of the matches."""

    def blank(s: Column) -> Column:
        parts = F.zip_with(
            F.slice(s["g"], F.lit(1), F.size(s["m"])),
            s["m"],
            lambda g, m: F.concat(g, F.repeat(F.lit("\0"), F.length(m))),
        )
        return F.concat(F.array_join(parts, ""), F.element_at(s["g"], -1))

    return let(_cut(text, pattern), blank)


def _vote(yes: Column, otherwise: int) -> Column:
    return F.when(yes, F.lit(YES)).otherwise(F.lit(otherwise))


def _features(kind: str, value: Column, near: Column, votes: Column) -> Column:
    """The places of a candidate's features among ``DIMENSIONS``."""
    classes = value
    for pattern, mark in (("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A")):
        classes = F.regexp_replace(classes, pattern, mark)
    separators = F.array_sort(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), "")))
    words = F.array_remove(F.split(F.lower(near), r"[^\p{L}]+", -1), "")
    names = F.concat(
        F.array(
            F.lit("kind"),
            F.concat(F.lit("length "), F.least(F.length(value), F.lit(40)).cast("string")),
            F.concat(F.lit("classes "), F.regexp_replace(classes, r"(.)\1+", "$1+")),
            F.concat(F.lit("separators "), F.array_join(separators, "")),
            F.concat(F.lit("first "), F.left(value, F.lit(2))),
            F.concat(F.lit("last "), F.right(value, F.lit(4))),
        ),
        F.transform(votes, lambda v, i: F.concat_ws(" ", F.lit("vote"), i.cast("string"), v.cast("string"))),
        F.transform(words, lambda w: F.concat(F.lit("near "), w)),
    )
    places = F.transform(names, lambda x: F.pmod(F.xxhash64(F.lit(kind), x), F.lit(DIMENSIONS)).cast("int"))
    return F.array_sort(F.array_distinct(places))


def _candidates(kind: str, spans: Column, strict: bool) -> Column:
    """Spans with kind, base flag, the votes of the labelers, in their order, and the features."""

    def judged(s: Column) -> Column:
        value, near = s["value"], s["near"]
        good = passes(kind, value) if strict else F.lit(False)
        plain = F.regexp_replace(value, r"\[\.\]|[\[(]dot[\])]", ".")
        votes = F.array(
            _vote(good, NO),
            _vote(passes(kind, plain), NO),
            _vote(value.rlike(SHAPE[kind]), NO),
            _vote(value.rlike(GAZETTEER[kind]), NO),
            _vote(near.rlike(CONTEXT[kind]), NONE),
            F.when(near.rlike(CONTRARY), F.lit(NO)).otherwise(F.lit(NONE)),
        )
        return let(
            votes,
            lambda v: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                (v[0] == YES).alias("base"),
                v.alias("votes"),
                _features(kind, value, near, v).alias("features"),
            ),
        )

    return F.transform(spans, judged)


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of kind, start, end, base, votes, features."""
    t = F.col("_text")
    strict = {f"_{kind}": _spans_or_none(t, MAY_HOLD[kind](t), STRICT[kind]) for kind in KINDS}
    loose = {kind: t.rlike(MAY_HOLD_LOOSE[kind]) for kind in KINDS}
    rest = F.when(loose["email"] | loose["ip"] | loose["card"] | loose["phone"], t)
    df = docs.withColumn("_text", whole_text(text)).withColumns({**strict, "_rest": rest})
    rest = F.col("_rest")
    for kind in KINDS:  # one after another, each on what the others left
        df = df.withColumn("_rest", F.when(F.size(f"_{kind}") > 0, _masked(rest, STRICT[kind])).otherwise(rest))
    df = df.withColumns(
        {
            f"_loose_{kind}": _spans_or_none(rest, F.coalesce(rest.rlike(MAY_HOLD_LOOSE[kind]), F.lit(False)), LOOSE[kind])
            for kind in KINDS
        }
    )
    made = F.concat(
        *(_candidates(kind, F.col(f"_{kind}"), True) for kind in KINDS),
        *(_candidates(kind, F.col(f"_loose_{kind}"), False) for kind in KINDS),
    )
    return df.select(*docs.columns, made.alias("spans"))


def _expect(patterns: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, labeler, vote with its (smoothed) probability given yes and given no, and the prior."""
    votes = patterns.join(labels, ["kind", "votes"]).select(
        "kind", "n", "q", F.posexplode("votes").alias("labeler", "vote")
    )
    sums = votes.groupBy("kind", "labeler", "vote").agg(
        F.sum(F.col("n") * F.col("q")).alias("y"), F.sum(F.col("n") * (1 - F.col("q"))).alias("z")
    )
    both = sums.groupBy("kind", "labeler").agg(F.sum("y").alias("ys"), F.sum("z").alias("zs"))
    return sums.join(both, ["kind", "labeler"]).select(
        "kind",
        "labeler",
        "vote",
        ((F.col("y") + 1) / (F.col("ys") + 3)).alias("given_yes"),
        ((F.col("z") + 1) / (F.col("zs") + 3)).alias("given_no"),
        ((F.col("ys") + 1) / (F.col("ys") + F.col("zs") + 2)).alias("prior"),
    )


def _label(patterns: DataFrame, reliabilities: DataFrame) -> DataFrame:
    """kind, votes, q: the probability of yes for every vote pattern."""
    odds = (
        patterns.select("kind", "votes", F.posexplode("votes").alias("labeler", "vote"))
        .join(reliabilities, ["kind", "labeler", "vote"])
        .groupBy("kind", "votes")
        .agg(
            F.sum(F.log(F.col("given_yes") / F.col("given_no"))).alias("s"),
            F.max("prior").alias("prior"),
        )
    )
    logit = F.col("s") + F.log(F.col("prior") / (1 - F.col("prior")))
    return odds.select("kind", "votes", (1 / (1 + F.exp(-logit))).alias("q"))


def reliabilities(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels per pattern and what each labeler's vote is worth, by EM from the share of votes."""
    yes, no = (
        F.aggregate("votes", F.lit(0), lambda a, v: a + (v == F.lit(k)).cast("int"))
        for k in (YES, NO)
    )
    labels = patterns.select(
        "kind",
        "votes",
        F.when(F.col("votes")[0] == YES, 0.95)
        .otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.9), 0.4 + 0.15 * (yes - no))))
        .alias("q"),
    )
    for _ in range(EM_STEPS):
        worth = stage(_expect(patterns, labels), "reliabilities")
        labels = stage(_label(patterns, worth), "labels")
    return labels, worth


Model = tuple[float, list[float]]


def trained(found: DataFrame) -> Model | None:
    """Intercept and ``DIMENSIONS`` weights of the classifier; none without candidates to decide on."""
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = stage(spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    if patterns.where("votes[0] <> 1").isEmpty():
        return None
    labels, _ = reliabilities(patterns)
    total = patterns.agg(F.sum("n")).first()[0]
    part = min(1.0, SAMPLE / total)
    drawn = F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 30)) < part * (1 << 30)
    sample = spans.where(drawn).groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    soft = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("q")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("q"))).alias("weight")),
        )
    ).alias("x")
    rows = (
        sample.join(labels, ["kind", "votes"])
        .select("kind", "votes", F.col("features").cast("array<string>").alias("terms"), soft)
        .select("kind", "votes", "terms", "x.*")
        .coalesce(1)  # bounded by SAMPLE; one order of sums, so that reruns agree
        .sort("kind", "votes", "terms", "label")
    )
    counted = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(DIMENSIONS)], inputCol="terms", outputCol="features", binary=True
    )
    model = LogisticRegression(
        weightCol="weight", regParam=1e-3, maxIter=50, standardization=False
    ).fit(counted.transform(stage(rows, "sample").coalesce(1)))
    return model.intercept, [float(x) for x in model.coefficients]


def log_odds(features: Column, model: Model) -> Column:
    # One string: as literals of their own the weights make up most of the plan, which the driver holds many times.
    weights = F.split(F.lit(",".join(map(repr, model[1]))), ",").cast("array<double>")
    return F.aggregate(features, F.lit(model[0]), lambda a, f: a + F.get(weights, f))


def final_spans(model: Model | None) -> Column:
    """Of ``spans``: base ones and those the classifier accepts, by kind and start."""
    least = math.log(ACCEPT / (1 - ACCEPT))

    def stays(s: Column) -> Column:
        return s["base"] if model is None else s["base"] | (log_odds(s["features"], model) >= least)

    return F.sort_array(F.filter("spans", stays))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, and all spans."""
    found = stage(find_candidates(docs.select("doc_id", "text")).drop("text"), "candidates")
    base = F.sort_array(F.filter("spans", lambda s: s["base"]))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = {
        f"n_{kind}": (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long")
        for i, kind in enumerate(KINDS)
    }
    return found.select(
        "doc_id",
        *(c.alias(k) for k, c in counts.items()),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(final_spans(trained(found))).alias("spans"),
    )


def _redacted(text: Column, spans: Column) -> Column:
    """The text with <KIND> in place of each run of overlapping spans, named after its first."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    by_start = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def piece(s: Column, n: Column) -> Column:
        return F.coalesce(F.get(s["pieces"], n), F.lit(""))

    def between(s: Column, a: Column, b: Column) -> Column:
        """The text from ``a`` to ``b``, of the pieces that hold it."""
        first, last = (F.floor(x / PIECE).cast("int") for x in (a, b))
        return F.when(first == last, F.substr(piece(s, first), a % PIECE + 1, b - a)).otherwise(
            F.concat(
                F.substr(piece(s, first), a % PIECE + 1),
                F.array_join(F.slice(s["pieces"], first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                F.left(piece(s, last), b % PIECE),
            )
        )

    def built(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s["spans"]) - 1)
        heads = F.filter(places, lambda i: F.get(s["spans"], i)["start"] >= F.get(s["upto"], i))
        body = F.transform(
            heads,
            lambda i: F.concat(
                between(s, F.get(s["upto"], i), F.get(s["spans"], i)["start"]),
                F.get(names, F.get(s["spans"], i)["kind"]),
            ),
        )
        return F.concat(F.array_join(body, ""), between(s, F.element_at(s["upto"], -1), s["n"]))

    return let(
        let(
            by_start,
            lambda x: F.struct(
                x.alias("spans"),
                before(F.transform(x, lambda y: y["end"]), F.greatest).alias("upto"),
                pieces.alias("pieces"),
                F.length(text).alias("n"),
            ),
        ),
        built,
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced; texts without spans, and null ones, stay as they are. Texts are
    searched twice, for the classifier and for the result, and not written in between."""
    names = docs.columns
    # Filtered after it is written: a filter above would be pushed down to the texts with the whole search in it.
    known = stage(find_candidates(docs.select("text")).select("spans"), "candidates").where(F.size("spans") > 0)
    spans = final_spans(trained(known))
    found = find_candidates(docs.select("text", F.struct(*names).alias("doc"))).withColumn("spans", spans)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(_redacted(F.col("text"), F.col("spans")))
    out = found.withColumn("text", text)
    replaced = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(
        *(
            (F.when(F.col("text") == F.col("doc.text"), F.col("doc")[c]).otherwise(replaced[c]) if c in replaced else F.col("doc")[c]).alias(c)
            for c in names
        )
    )
