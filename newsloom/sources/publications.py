"""Publication configuration: which feeds to read, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enabled_publications(config: DataFrame) -> DataFrame:
    """Enabled rows; a row that does not say whether it is enabled fails the job."""
    stop = F.raise_error(F.concat(F.lit("publication without enabled flag: "), F.col("publication")))
    return config.where(F.when(F.col("enabled").isNull(), stop.cast("boolean")).otherwise(F.col("enabled")))


def feed_key(url):
    """Name of the landing folder of a feed."""
    return F.sha2(url, 256)


def publication_feeds(config: DataFrame) -> DataFrame:
    """One row per feed: feed_publication, pub_ord, url_ord, feed_url, feed_key.

    ``config`` has publication, urls, enabled and pub_ord, its position in the configuration.
    """
    return (
        enabled_publications(config)
        .select(F.col("publication").alias("feed_publication"), "pub_ord", F.posexplode("urls").alias("url_ord", "feed_url"))
        .withColumn("feed_key", feed_key(F.col("feed_url")))
    )
