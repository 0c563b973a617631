"""Landed feed documents as entries.

A fetcher outside Spark puts the documents of a feed below ``<root>/feed_key=<key>/``, with the
key of :func:`newsloom.sources.publications.feed_key`, one fetched document a file. Every file is read
once, whatever its format: the document is cut at the start of each RSS ``item`` and Atom ``entry``, and
each piece is parsed on its own, so damage stays where it is. What cannot be parsed is mended if that is
plain (bare ampersands, entities of HTML, control characters, a missing end tag); the rest comes out as a
record with its reason and its text instead of an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_published
from newsloom.schema import conform_entries
from newsloom.session import broadcast_if_small, materialize

DOCUMENT = "path string, modificationTime timestamp, length long, content binary, feed_key string"
RSS_ITEM = (
    "title string, link string, guid struct<_VALUE string, _isPermaLink string>, comments string, description string, "
    "`content:encoded` string, pubDate string, author string, `dc:creator` string, category array<string>, "
    "`wsj:articletype` string"
)
ATOM_ENTRY = (
    "title string, id string, link array<struct<_href string, _rel string>>, summary string, content string, "
    "published string, author array<struct<name string>>, category array<struct<_term string>>"
)
CORRUPT = "_corrupt_record"
# Reasons of records that are no entry.
UNCLOSED, MALFORMED, NO_ENTRIES, UNREADABLE = "unclosed", "malformed", "no_entries", "unreadable"

_CDATA = r"<!\[CDATA\["
_START = r"<(?:item|entry)(?=[\s/>])"
# Stands for "<" where it is text; the code point belongs to nobody.
_HIDDEN = "\ue000"


def _outside_cdata(text: Column, change) -> Column:
    """Apply ``change`` to what is not a CDATA section, and hide ``<`` inside the sections."""
    parts = F.split(text, rf"(?s)(?={_CDATA})|(?<=\]\]>)")
    inside = lambda p: F.startswith(p, F.lit("<![CDATA["))
    return F.array_join(F.transform(parts, lambda p: F.when(inside(p), F.translate(p, "<", _HIDDEN)).otherwise(change(p))), "")


def _decoded(content: Column) -> Column:
    """Text of a document: UTF-16 by its mark, Latin-1 where it says so, else UTF-8 with bad bytes replaced."""
    marked = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    prolog = F.lower(F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, 200).cast("string")), r"(?s)\?>.*$", ""))
    latin = prolog.rlike(r"encoding\s*=\s*['\"](?:iso-8859-1|latin-?1|windows-1252|us-ascii)['\"]")
    return (
        F.when(marked, F.decode(F.when(marked, content), "UTF-16"))
        .when(latin, F.decode(F.when(latin, content), "ISO-8859-1"))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def _pieces(text: Column) -> Column:
    """The records of a document, each from its start tag to the next one; the head of the document is left out."""
    shown = _outside_cdata(text, lambda p: F.regexp_replace(p, r"(?s)<!--.*?-->", ""))
    pieces = F.split(shown, f"(?={_START})")
    return F.filter(pieces, lambda p: p.rlike(f"^{_START}"))


def _closed(piece: Column, tag: Column) -> Column:
    end = F.concat(F.lit("</"), tag, F.lit(">"))
    whole = F.regexp_extract(piece, r"(?s)^(.*?</(?:item|entry)\s*>)", 1)
    alone = F.regexp_extract(piece, r"(?s)^(<(?:item|entry)(?:\s[^<>]*)?/>)", 1)
    return F.when(whole != "", whole).when(alone != "", alone).otherwise(F.concat(F.rtrim(F.regexp_replace(piece, r"(?s)</(?:channel|rss|feed|rdf:RDF)\s*>.*$", "")), end))


def _mended(record: Column) -> Column:
    """The record with bare ampersands and names XML does not know written out, and without control characters."""
    bare = r"&(?!(?:amp|lt|gt|quot|apos);|#\d+;|#[xX][0-9A-Fa-f]+;)"
    clean = F.regexp_replace(record, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.translate(_outside_cdata(clean, lambda p: F.regexp_replace(p, bare, "&amp;")), _HIDDEN, "<")


def _parsed(record: Column, ddl: str) -> Column:
    return F.from_xml(record, f"{ddl}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def _rss_to_entry(r: Column) -> dict[str, Column]:
    guid, permanent = r["guid"]["_VALUE"], F.lower(F.coalesce(r["guid"]["_isPermaLink"], F.lit("true"))) == "true"
    return {
        "entry_id": guid,
        "title": r["title"],
        "link": F.coalesce(r["link"], F.when(permanent, guid)),
        "comments": r["comments"],
        "summary": F.coalesce(r["description"], r["content:encoded"]),
        "published": r["pubDate"],
        "author": F.coalesce(r["author"], r["dc:creator"]),
        "authors": F.lit(None).cast("array<struct<name string>>"),
        "feed_tags": r["category"],
        "wsj_articletype": r["wsj:articletype"],
    }


def _atom_to_entry(r: Column) -> dict[str, Column]:
    page = F.filter(r["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return {
        "entry_id": r["id"],
        "title": r["title"],
        "link": F.get(page, F.lit(0))["_href"],
        "comments": F.lit(None).cast("string"),
        "summary": F.coalesce(r["summary"], r["content"]),
        "published": r["published"],
        "author": F.get(r["author"], F.lit(0))["name"],
        "authors": r["author"],
        "feed_tags": F.transform(r["category"], lambda x: x["_term"]),
        "wsj_articletype": F.lit(None).cast("string"),
    }


def _documents(reader, root: str, files: str) -> DataFrame:
    options = {"pathGlobFilter": files, "ignoreCorruptFiles": "true"}
    documents = reader.format("binaryFile").options(**options)
    return documents.load(root).select(F.col("feed_key").cast("string"), F.col("path").alias("file"), F.col("content"))


def feed_records(documents: DataFrame) -> DataFrame:
    """Every record of ``documents (feed_key, file, content)``, sound or not.

    ``entry_ord`` is (file, place in the file), ``damage`` why a record is no entry, ``mended`` whether it
    was parsed only after mending, ``record`` the text of a damaged one. A document without any record gives
    one with damage ``no_entries``, an empty or NULL content one with ``unreadable``.
    """
    text = documents.select("feed_key", "file", _decoded(F.col("content")).alias("text"))
    pieces = text.select("feed_key", "file", "text", F.posexplode_outer(_pieces(F.col("text"))).alias("place", "piece"))
    tag = F.regexp_extract("piece", r"^<(item|entry)", 1)
    cut = pieces.select(
        "feed_key",
        F.struct("file", F.coalesce("place", F.lit(0)).alias("place")).alias("entry_ord"),
        F.when(F.coalesce(F.btrim("text"), F.lit("")) == "", UNREADABLE).when(F.col("piece").isNull(), NO_ENTRIES).alias("nothing"),
        tag.alias("tag"),
        (~F.col("piece").rlike(r"(?s)</(?:item|entry)\s*>|^<(?:item|entry)(?:\s[^<>]*)?/>")).alias("unclosed"),
        F.translate("piece", _HIDDEN, "<").alias("raw"),
        F.translate(_closed(F.col("piece"), tag), _HIDDEN, "<").alias("record"),
    )
    rss, atom = F.col("tag") == "item", F.col("tag") == "entry"
    once = cut.withColumn("rss", F.when(rss, _parsed(F.col("record"), RSS_ITEM))).withColumn(
        "atom", F.when(atom, _parsed(F.col("record"), ATOM_ENTRY))
    )
    broken = F.coalesce(F.col(f"rss.{CORRUPT}"), F.col(f"atom.{CORRUPT}")).isNotNull()
    again = once.withColumn("broken", broken).withColumns(
        {
            "rss": F.when(F.col("broken") & rss, _parsed(_mended(F.col("record")), RSS_ITEM)).otherwise(F.col("rss")),
            "atom": F.when(F.col("broken") & atom, _parsed(_mended(F.col("record")), ATOM_ENTRY)).otherwise(F.col("atom")),
        }
    )
    still = F.coalesce(F.col(f"rss.{CORRUPT}"), F.col(f"atom.{CORRUPT}")).isNotNull()
    damage = F.coalesce("nothing", F.when(still & F.col("unclosed"), UNCLOSED).when(still, MALFORMED))
    marked = again.withColumn("damage", damage)
    of_rss, of_atom = _rss_to_entry(F.col("rss")), _atom_to_entry(F.col("atom"))
    sound = F.col("damage").isNull()
    return marked.select(
        "feed_key",
        "entry_ord",
        *[F.when(sound & rss, of_rss[n]).when(sound & atom, of_atom[n]).alias(n) for n in of_rss],
        "damage",
        (sound & (F.col("broken") | F.col("unclosed"))).alias("mended"),
        F.when(~sound, F.col("raw")).alias("record"),
    )


def read_feed_records(spark: SparkSession, root: str, files: str = "*") -> DataFrame:
    """:func:`feed_records` of all landed documents; each file is read once."""
    return feed_records(_documents(spark.read, root, files))


def split_damaged(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that are entries, and those that are not. Store ``records`` first to parse them once."""
    damaged = F.col("damage").isNotNull()
    return records.where(~damaged).drop("damage", "mended", "record"), records.where(damaged).select("feed_key", "entry_ord", "damage", "record")


def attach_feeds(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Add publication and feed order; rows of feeds that are not enabled are left out."""
    feeds, _ = broadcast_if_small(feeds)
    return rows.join(feeds, "feed_key")


def with_dates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("published_parsed", parse_published(F.col("published")))


def read_feed_files(spark: SparkSession, root: str, feeds: DataFrame, files: str = "*") -> DataFrame:
    """Entries of all landed documents of the enabled ``feeds``; damaged records are left to :func:`read_feed_output`."""
    entries, _ = split_damaged(read_feed_records(spark, root, files))
    return conform_entries(with_dates(attach_feeds(entries, feeds)))


def read_feed_output(spark: SparkSession, root: str, feeds: DataFrame, files: str = "*") -> tuple[DataFrame, DataFrame]:
    """Entries and damaged records of the enabled ``feeds``, from one reading of the files."""
    records = materialize(attach_feeds(read_feed_records(spark, root, files), feeds), "feed-records")
    entries, damaged = split_damaged(records)
    return conform_entries(with_dates(entries)), damaged


def stream_feed_documents(spark: SparkSession, root: str, files_per_batch: int = 1000, files: str = "*") -> DataFrame:
    """Newly landed documents, to be parsed batch by batch with :func:`feed_records`."""
    return _documents(spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch), root, files)
