"""JSON payloads with update rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_ROWS = "array<struct<id:string,agent:string,score:string,reason:string>>"


def explode_payloads(payloads: DataFrame, payload: str = "payload", order: str = "batch_ord") -> DataFrame:
    """One row per array element with its place; values come out as text, missing ones as NULL.

    A payload that is not a JSON array of objects fails the job.
    """
    rows = F.from_json(F.col(payload), RULE_ROWS, {"mode": "FAILFAST"})
    return payloads.select(F.col(order).alias("batch_ord"), F.posexplode(rows).alias("pos", "row")).select(
        "batch_ord", "pos", "row.*"
    )


def typed_updates(rows: DataFrame) -> DataFrame:
    """Cast id and score; text that is not an integer fails the job."""
    return rows.select(
        "batch_ord", "pos", F.col("id").cast("long").alias("id"), "agent", F.col("score").cast("int").alias("score"), "reason"
    )
