"""Text of the tag taxonomy and of scoring prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag dimensions, in the order they are listed.
DIMENSIONS = ("scope", "topic", "mood")
TAXONOMY, PROFILE, ARTICLE = "{taxonomy}", "{profile}", "{article}"


def format_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """One row, one column ``taxonomy``: ``dimension:`` and a line ``- tag: description`` per tag.

    ``taxonomy`` has dimension, ord, tag, description. Dimensions without tags are listed too.
    """
    line = F.concat(F.lit("- "), F.col("tag"), F.lit(": "), F.col("description"))
    lines = (
        taxonomy.where(F.col("dimension").isin(*DIMENSIONS))
        .select("dimension", "ord", line.alias("line"))
        .groupBy("dimension")
        .agg(F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY ord)").alias("lines"))
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(d).alias("dimension")) for i, d in enumerate(DIMENSIONS)])
    spark = taxonomy.sparkSession
    listed = spark.range(1).select(F.inline(wanted)).join(lines, "dimension", "left")
    block = F.concat("dimension", F.lit(":\n"), F.coalesce("lines", F.lit("")))
    return listed.select("at", block.alias("block")).agg(
        F.expr(r"listagg(block, '\n') WITHIN GROUP (ORDER BY at)").alias("taxonomy")
    )


def build_prompt(template: str, taxonomy: Column, profile: Column, article: Column) -> Column:
    """Fill ``{taxonomy}``, ``{profile}`` and ``{article}`` of the caller's template.

    Inserted text is taken as it is; placeholders inside it are not filled.
    """
    values = {TAXONOMY: taxonomy, PROFILE: profile, ARTICLE: article}
    pieces = [p for p in re.split(r"(\{taxonomy\}|\{profile\}|\{article\})", template) if p]
    return F.concat(*[values.get(p, F.lit(p)) for p in pieces], F.lit(""))
