"""Article, tag and feed-entry frames derived from the given tables by fixed expressions.

The same expressions are written as SQL in ``SQL_VIEWS`` for the cross-check engine.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
HACKER_NEWS = "HackerNews"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    e = table(spark, sf_dir, "embeddings").alias("e")
    joined = d.join(lab, d.doc_id == lab.doc_id, "left").join(e, d.doc_id == e.vec_id, "left")
    return joined.selectExpr(
        "d.doc_id AS id",
        r"substring_index(d.text, '\n', 1) AS title",
        "concat('https://', d.source, '.example.com/a/', d.doc_id) AS link",
        r"""CASE WHEN d.doc_id % 11 = 0 THEN NULL
                 WHEN d.doc_id % 13 = 0 THEN substring_index(d.text, '\n', 1)
                 ELSE d.text END AS summary""",
        "CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE array(d.source, d.lang) END AS tags",
        "CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('author-', d.lang) END AS author",
        "d.source AS publication",
        f"{AS_OF_SQL} - make_dt_interval(0, cast(d.doc_id % 240 AS int)) AS created_at",
        """CASE WHEN l.doc_id IS NULL THEN NULL
                WHEN d.doc_id % 5 = 0 THEN 'USER'
                WHEN d.doc_id % 5 = 1 THEN 'user' ELSE 'AI' END AS agent""",
        "CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality * 10 - l.toxic * 15 END AS score",
        "CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE e.embedding END AS embedding2",
        "cast(NULL AS string) AS reason",
        "cast(NULL AS timestamp) AS updated_at",
        "cast(NULL AS int) AS ai_score",
        "cast(NULL AS int) AS ai_score2",
        "cast(NULL AS array<string>) AS tags_topic",
        "cast(NULL AS array<string>) AS tags_mood",
        "cast(NULL AS array<string>) AS tags_scope",
    )


def tags(spark: SparkSession) -> DataFrame:
    """A small tag table, as a user would keep it; always used together with the articles."""
    names = ["src1", "src2", "src3", "src4", "src5", "en", "fr", "Therhe", "Ouon", "Ingth", "AI", "Elle"]
    scores = [-1, 1, 0, 2, -3, 1, -1, 3, -2, 1, 5, -1]
    rows = [(i + 1, n, s) for i, (n, s) in enumerate(zip(names, scores))]
    return spark.createDataFrame(rows, "tag_id long, name string, score int")


def word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag table that grows with the data: the first word of every title, with a score."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id", r"substring_index(substring_index(text, '\n', 1), ' ', 1) AS name")
        .where("name <> ''")
        .groupBy("name")
        .agg({"doc_id": "min", "*": "count"})
        .selectExpr(
            "`min(doc_id)` AS tag_id", "name", "cast((`count(1)` + `min(doc_id)`) % 5 - 2 AS int) AS score"
        )
    )


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication configuration: two feeds for every source, one source switched off."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .count()
        .selectExpr(
            "source AS publication",
            "array(concat('https://', source, '.example.com/rss'), concat('https://', source, '.example.com/atom')) AS urls",
            "source <> 'src3' AS enabled",
            "cast(substring(source, 4) AS int) AS pub_ord",
        )
    )


def entries(spark: SparkSession, sf_dir: str, html_summary: bool = False) -> DataFrame:
    """Raw feed entries made from web pages; ``html_summary`` uses the page as summary."""
    summary = (
        "html" if html_summary else "CASE WHEN page_id % 9 = 0 THEN NULL ELSE concat('Points: ', page_id, ' Points: 7') END"
    )
    return table(spark, sf_dir, "pages").selectExpr(
        """CASE page_id % 4 WHEN 0 THEN 'HackerNews' WHEN 1 THEN 'FT' WHEN 2 THEN 'Guardian'
           ELSE 'Other' END AS feed_publication""",
        "concat('https://feeds.example.com/', page_id % 4, '/', page_id % 8 DIV 4) AS feed_url",
        "cast(page_id % 4 AS int) AS pub_ord",
        "cast(page_id % 8 DIV 4 AS int) AS url_ord",
        "page_id AS entry_ord",
        """CASE WHEN page_id % 7 = 0 THEN concat('https://news.ycombinator.com/item/', page_id)
           ELSE concat('urn:x:', page_id) END AS entry_id""",
        "CASE WHEN page_id % 23 = 0 THEN NULL ELSE concat('Title ', page_id) END AS title",
        """concat(CASE page_id % 7 WHEN 0 THEN 'https://example.org/' WHEN 1 THEN 'https://www.wsj.com/a/'
                  WHEN 2 THEN 'https://www.ft.com/content/' WHEN 3 THEN 'https://www.theguardian.com/world/'
                  WHEN 4 THEN 'https://www.nytimes.com/x/' WHEN 5 THEN 'https://blog.microsoft.com/p/'
                  ELSE 'https://news.example.net/n/' END,
                page_id % 28,
                CASE page_id % 5 WHEN 0 THEN '?ref=rss' WHEN 1 THEN '#top' WHEN 2 THEN ';p=1?x=2' ELSE '' END) AS link""",
        "concat('https://news.ycombinator.com/item?id=', page_id % 28) AS comments",
        f"{summary} AS summary",
        f"""concat(date_format({AS_OF_SQL} - make_dt_interval(cast(page_id % 10 AS int)),
                   'EEE, dd MMM yyyy HH:mm:ss'), ' GMT') AS published""",
        f"{AS_OF_SQL} - make_dt_interval(cast(page_id % 10 AS int)) AS published_parsed",
        "concat('author-', url) AS author",
    )


SQL_VIEWS = {
    "article": f"""
        SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title,
          concat('https://', d.source, '.example.com/a/', d.doc_id) AS link,
          CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 13 = 0 THEN split_part(d.text, chr(10), 1)
               ELSE d.text END AS summary,
          CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE list_value(d.source, d.lang) END AS tags,
          CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('author-', d.lang) END AS author,
          d.source AS publication,
          {AS_OF_SQL} - (d.doc_id % 240) * interval '1' hour AS created_at,
          CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 5 = 0 THEN 'USER'
               WHEN d.doc_id % 5 = 1 THEN 'user' ELSE 'AI' END AS agent,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality * 10 - l.toxic * 15 END AS score,
          CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE e.embedding END AS embedding2
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
    "tag": """
        SELECT * FROM (VALUES (1,'src1',-1),(2,'src2',1),(3,'src3',0),(4,'src4',2),(5,'src5',-3),(6,'en',1),
          (7,'fr',-1),(8,'Therhe',3),(9,'Ouon',-2),(10,'Ingth',1),(11,'AI',5),(12,'Elle',-1)) t(tag_id, name, score)""",
    "word_tag": """
        SELECT min(doc_id) AS tag_id, name, CAST((count(*) + min(doc_id)) % 5 - 2 AS INTEGER) AS score
        FROM (SELECT doc_id, split_part(split_part(text, chr(10), 1), ' ', 1) AS name FROM documents)
        WHERE name <> '' GROUP BY name""",
    "publication_config": """
        SELECT source AS publication, unnest([concat('https://', source, '.example.com/rss'),
               concat('https://', source, '.example.com/atom')]) AS feed_url,
               unnest([0, 1]) AS url_ord, source <> 'src3' AS enabled,
               CAST(substr(source, 4) AS INTEGER) AS pub_ord
        FROM (SELECT DISTINCT source FROM documents)""",
    "entry": f"""
        SELECT CASE page_id % 4 WHEN 0 THEN 'HackerNews' WHEN 1 THEN 'FT' WHEN 2 THEN 'Guardian' ELSE 'Other' END
                 AS feed_publication,
          concat('https://feeds.example.com/', page_id % 4, '/', page_id % 8 // 4) AS feed_url,
          page_id % 4 AS pub_ord, page_id % 8 // 4 AS url_ord, page_id AS entry_ord,
          page_id % 7 = 0 AS is_hn,
          CASE WHEN page_id % 23 = 0 THEN NULL ELSE concat('Title ', page_id) END AS title,
          concat(CASE page_id % 7 WHEN 0 THEN 'https://example.org/' WHEN 1 THEN 'https://www.wsj.com/a/'
                  WHEN 2 THEN 'https://www.ft.com/content/' WHEN 3 THEN 'https://www.theguardian.com/world/'
                  WHEN 4 THEN 'https://www.nytimes.com/x/' WHEN 5 THEN 'https://blog.microsoft.com/p/'
                  ELSE 'https://news.example.net/n/' END, page_id % 28,
                CASE page_id % 5 WHEN 0 THEN '?ref=rss' WHEN 1 THEN '#top' WHEN 2 THEN ';p=1?x=2' ELSE '' END) AS link,
          concat('https://news.ycombinator.com/item?id=', page_id % 28) AS comments,
          CASE WHEN page_id % 9 = 0 THEN NULL ELSE concat('Points: ', page_id, ' Points: 7') END AS summary,
          {AS_OF_SQL} - (page_id % 10) * interval '1' day AS published_parsed,
          concat('author-', url) AS author, html
        FROM pages""",
}


def sql_with(*names: str) -> str:
    """``WITH`` prefix that defines the named views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + " "
