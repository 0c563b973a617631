"""Explicit schemas of the tables and structs the package works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.FloatType())

ARTICLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField("media", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("publication", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("agent", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("embedding2", VECTOR),
        T.StructField("ai_score", T.IntegerType()),
        T.StructField("ai_score2", T.IntegerType()),
        T.StructField("tags_topic", STRINGS),
        T.StructField("tags_mood", STRINGS),
        T.StructField("tags_scope", STRINGS),
    ]
)

# A feed entry before normalisation. A key the feed did not carry is NULL.
ENTRY = T.StructType(
    [
        T.StructField("feed_publication", T.StringType()),
        T.StructField("feed_url", T.StringType()),
        T.StructField("pub_ord", T.IntegerType()),
        T.StructField("url_ord", T.IntegerType()),
        T.StructField("entry_ord", T.LongType()),
        T.StructField("entry_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("published_parsed", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("feed_tags", STRINGS),
        T.StructField("wsj_articletype", T.StringType()),
    ]
)

PUBLICATION = T.StructType(
    [
        T.StructField("publication", T.StringType()),
        T.StructField("urls", STRINGS),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("pub_ord", T.IntegerType()),
    ]
)

TAGGING_RESULT = T.StructType(
    [
        T.StructField("scope", STRINGS),
        T.StructField("topic", STRINGS),
        T.StructField("mood", STRINGS),
        T.StructField("score", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``: cast what is there, typed NULL for what is missing."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def conform_entries(df: DataFrame) -> DataFrame:
    """``ENTRY``, with whatever orderable type ``entry_ord`` has."""
    own = df.schema["entry_ord"].dataType
    return conform(
        df, T.StructType([T.StructField("entry_ord", own) if f.name == "entry_ord" else f for f in ENTRY.fields])
    )
