from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from newsloom import session
from newsloom.operators import merges
from newsloom.schema import ARTICLE, conform
from newsloom.sources import payloads, tables

AS_OF = datetime(2024, 1, 31)


@pytest.fixture(params=["broadcast", "by key"])
def path(request, monkeypatch):
    """Run a test with a broadcast incoming side and with a join by key."""
    if request.param == "by key":
        monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", -1)
        never = lambda df, *a, **k: (df, False)
        monkeypatch.setattr(merges, "broadcast_if_small", never)


@pytest.fixture
def articles(spark):
    rows = [(i, f"t{i}", f"l{i}", f"s{i}", "AI", 1) for i in range(1, 6)]
    return conform(spark.createDataFrame(rows, "id long, title string, link string, summary string, agent string, score int"), ARTICLE)


def payload_frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "batch_ord long, payload string")


def test_payload_values_come_as_text(spark):
    df = payload_frame(spark, '[{"id": 1, "agent": "TAG", "score": "-10", "reason": "x"}, {"id": "2", "score": null}]')
    rows = payloads.explode_payloads(df)
    assert sorted(values(rows)) == [(0, 0, "1", "TAG", "-10", "x"), (0, 1, "2", None, None, None)]
    assert sorted(values(payloads.typed_updates(rows), "id", "score")) == [(1, -10), (2, None)]


@pytest.mark.parametrize("text", ['[{"id": 1, "score": "7.5"}]', '[{"id": "x"}]', "not json"])
def test_bad_payloads_stop_the_job(spark, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        payloads.typed_updates(payloads.explode_payloads(payload_frame(spark, text))).collect()


def test_last_update_wins_and_nulls_are_values(spark, articles, path):
    df = payload_frame(
        spark,
        '[{"id": 1, "agent": "TAG", "score": 5, "reason": "a"}, {"id": 1, "agent": "TITLE", "score": 6}]',
        '[{"id": 2, "agent": null, "score": null}, {"id": 99, "agent": "X"}]',
    )
    got = merges.apply_payloads(articles, df, AS_OF)
    assert got.columns == articles.columns
    assert sorted(values(got, "id", "title", "agent", "score", "reason", "updated_at")) == [
        (1, "t1", "TITLE", 6, None, AS_OF),
        (2, "t2", None, None, None, AS_OF),
        (3, "t3", "AI", 1, None, None),
        (4, "t4", "AI", 1, None, None),
        (5, "t5", "AI", 1, None, None),
    ]


def test_insert_if_absent_twice_is_once(spark, articles, path):
    new = spark.createDataFrame([("l1", "x", 0), ("n1", "first", 1), ("n1", "second", 2), ("n2", "y", 3)], "link string, title string, entry_ord long")
    first = merges.insert_absent(articles, new, AS_OF)
    assert sorted(values(first, "link", "title", "created_at")) == [("n1", "first", AS_OF), ("n2", "y", AS_OF)]
    assert sorted(values(first, "id")) == [(6,), (7,)]
    again = merges.insert_absent(articles.unionByName(first), new, AS_OF)
    assert again.count() == 0


def test_upsert_changes_title_and_summary_only(spark, articles, path):
    new = spark.createDataFrame([("l1", "T", None, "other"), ("n", "N", "S", "other")], "link string, title string, summary string, agent string")
    got = merges.upsert_title_and_summary(articles, new, AS_OF)
    assert sorted(values(got.where("link in ('l1', 'l2', 'n')"), "link", "title", "summary", "agent", "score"), key=str) == [
        ("l1", "T", None, "AI", 1),
        ("l2", "t2", "s2", "AI", 1),
        ("n", "N", "S", "other", None),
    ]


def test_column_updates_keep_rows_and_other_columns(spark, articles):
    new = spark.createDataFrame([(2, [1.0, 2.0])], "id long, embedding2 array<float>")
    got = merges.save_embeddings(articles, new)
    assert got.count() == 5
    assert values(got.where("embedding2 is not null"), "id", "embedding2", "title") == [(2, [1.0, 2.0], "t2")]
    assert sorted(values(got.drop("embedding2"))) == sorted(values(articles.drop("embedding2")))


def test_ids_are_dense_over_partitions(spark):
    rows = spark.range(1000).repartition(7).select(F.monotonically_increasing_id().alias("_at"))
    got = merges.number_from(session.materialize(rows), 41)
    assert sorted(v for (v,) in values(got, "id")) == list(range(42, 1042))


def test_a_repeated_id_in_a_third_of_all_updates(spark, articles):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).cast("long").alias("id"),
        F.lit(0).alias("batch_ord"), F.col("id").alias("pos"),
        F.lit("TAG").alias("agent"), F.col("id").cast("int").alias("score"), F.lit(None).cast("string").alias("reason"),
    )
    got = merges.apply_rule_results(articles, rows, AS_OF)
    assert values(got.where("id = 1"), "score") == [(8997,)]


def test_versions(spark, articles):
    base = session.scratch_path(spark, "test-versions")
    assert tables.latest_version(spark, base) == 0
    assert tables.write_version(articles, base) == 1
    assert tables.write_version(tables.read_version(spark, base).where("id > 2"), base) == 2
    assert tables.read_version(spark, base).count() == 3
    assert tables.read_version(spark, base, 1).count() == 5


def test_only_touched_partitions_are_replaced(spark, articles):
    path = session.scratch_path(spark, "test-partitions")
    tables.append_rows(articles.withColumn("publication", F.concat(F.lit("p"), F.col("id") % 3)), path, ["publication"])
    table = tables.read_articles(spark, path)
    before = {f for f in table.inputFiles() if "publication=p1" not in f}
    updates = spark.createDataFrame([(4, "TAG", -10, "r")], "id long, agent string, score int, reason string")
    touched = tables.touched_rows(table, updates, "publication")
    assert sorted(values(touched, "id")) == [(1,), (4,)]
    tables.replace_partitions(merges.apply_rule_results(touched, updates, AS_OF), path, ["publication"])
    after = tables.read_articles(spark, path)
    assert sorted(values(after, "id", "agent")) == [(1, "AI"), (2, "AI"), (3, "AI"), (4, "TAG"), (5, "AI")]
    assert before <= set(after.inputFiles())


def test_new_links_with_a_third_of_all_rows_on_one(spark, articles, path):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("link"),
        F.col("id").cast("string").alias("title"), F.col("id").alias("entry_ord"),
    )
    got = merges.insert_absent(articles, rows, AS_OF)
    assert got.count() == 6001
    assert values(got.where("link = 'hot'"), "title") == [("0",)]
    assert values(got.agg(F.min("id"), F.max("id"), F.countDistinct("id"))) == [(6, 6006, 6001)]


def test_two_writers_cannot_take_one_version(spark, articles):
    base = session.scratch_path(spark, "two-writers")
    tables.write_version(articles, base)
    current = tables.read_version(spark, base, 1)
    # both read version 1 and write what they made of it
    assert tables.write_version(current.where("id > 1"), base, expected=1) == 2
    with pytest.raises(tables.VersionTaken):
        tables.write_version(current.where("id > 2"), base, expected=1)
    assert tables.read_version(spark, base).count() == 4
    assert len([n for n in tables.names_in(spark, base) if n.startswith("data-")]) == 2
    # changes made at the same time both survive
    def rename(i):
        return tables.change_table(spark, base, lambda a: a.withColumn("title", F.when(F.col("id") == i, "new").otherwise(F.col("title"))), attempts=9)

    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(rename, [2, 3, 4]))
    assert sorted(versions) == [3, 4, 5]
    assert values(tables.read_version(spark, base).where("title = 'new'").agg(F.count("*"))) == [(3,)]
    with ThreadPoolExecutor(4) as pool:
        appended = list(pool.map(lambda i: tables.append_version(articles.where(F.col("id") == i), base), [1, 2, 3, 4]))
    assert sorted(appended) == [6, 7, 8, 9] and tables.read_version(spark, base).count() == 8


def test_repeated_updates_add_no_rows(spark, articles, path):
    updates = spark.createDataFrame([(1, "A", 1, 1, 1), (1, "B", 2, 2, 3), (1, "C", 3, 3, 2), (9, "X", 1, 1, 1), (None, "N", 1, 1, 1)],
                                    "id long, agent string, score int, ai_score int, at int")
    got = merges.save_records(articles, updates, order=["at"])
    assert got.count() == 5 and values(got.where("id = 1"), "agent", "score") == [("B", 2)]
    with pytest.raises(PySparkException, match="different updates for id 1"):
        merges.save_records(articles, updates).collect()
    same = updates.where("at = 3").unionByName(updates.where("at = 3"))
    got = merges.save_records(articles, same)
    assert got.count() == 5 and values(got.where("id = 1"), "agent", "score") == [("B", 2)]


def test_one_id_in_a_third_of_all_equal_updates(spark, articles):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).cast("long").alias("id"),
                                    F.array(F.lit(1.0), F.lit(2.0)).alias("embedding2"))
    got = merges.save_embeddings(articles, rows)
    assert got.count() == 5 and values(got.where("embedding2 is not null"), "id") == [(1,)]
