"""Perspective rotation of dialogues with several parties.

For every participant (each distinct role but ``system``) a dialogue is rendered with that speaker as
assistant, the others as named users and system turns as they are; only the speaker's own turns are
trained on. A rendering is returned turn by turn, with the character range each turn takes in it and
the range of the mask (empty, at the turn's end, for the others), so that a dialogue of any length is never one row or one task: offsets are
running sums over chunks of ``CHUNK`` turn numbers, and inside these.

Turns are ordered by turn (null first), role and text; repeated rows are repeated turns. A null role
is the speaker ``unknown``, a null text is empty, rows without conv_id are one dialogue. A dialogue
with system turns only has no participant and no row, as an empty table has none. Markers inside texts
are broken up; names are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def speaker_name(role: Column) -> Column:
    """The role with every byte but those of letters, digits and ``_.-`` written as %XX, so that
    different speakers have different names."""
    name = F.url_encode(role)
    for was, by in (("+", "%20"), ("*", "%2A")):
        name = F.replace(name, F.lit(was), F.lit(by))
    return name


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, position, turn, role, rendered, start, end, mask_start, mask_end."""
    said = turns.select(
        F.col("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_"), F.lit("< |im_")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))).cast("long").alias("chunk"),
    )
    speakers = (
        said.where("role <> 'system'").select("key", F.col("role").alias("speaker")).distinct()
    )
    own = F.col("role") == F.col("speaker")
    name = speaker_name(F.col("role"))
    header = (
        F.when(own, F.lit("assistant"))
        .when(F.col("role") == "system", F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), name))
    )
    header = F.concat(F.lit(OPEN), header, F.lit("\n"))
    views = said.join(speakers, "key").withColumn("head", header)
    views = views.withColumn("size", (F.length("head") + F.length("text") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("key", "speaker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        views.groupBy("key", "speaker", "chunk")
        .agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
        .select(
            "key",
            "speaker",
            "chunk",
            F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        )
    )
    inside = Window.partitionBy("key", "speaker", "chunk").orderBy(
        F.col("turn").asc_nulls_first(), "role", "text"
    )
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        views.withColumn("at", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(chunks, ["key", "speaker", "chunk"])
        .withColumn("start", F.col("chars_before") + F.col("at"))
    )
    end = F.col("start") + F.col("size")
    return placed.select(
        "conv_id",
        "speaker",
        (F.col("n_before") + F.col("nth")).alias("position"),
        "turn",
        "role",
        F.concat("head", "text", F.lit(CLOSE)).alias("rendered"),
        "start",
        end.alias("end"),
        F.when(own, F.col("start") + F.length("head")).otherwise(end).alias("mask_start"),
        end.alias("mask_end"),
    )
