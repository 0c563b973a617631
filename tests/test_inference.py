import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from newsloom.functions.prompts import build_prompt, format_taxonomy
from newsloom.functions.replies import parse_reply
from newsloom.operators import counters, inference, selection
from newsloom.schema import ARTICLE, TAGGING_RESULT, conform

GOOD = {"scope": ["a"], "topic": ["b", "c"], "mood": ["d"], "score": 5}
TEXT = json.dumps(GOOD)
RESULT = (["a"], ["b", "c"], ["d"], 5, None)


def parsed(spark, *replies):
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    rows = df.withColumn("r", parse_reply(F.col("reply"))).orderBy("i").collect()
    return [tuple(r["r"]) for r in rows]


@pytest.mark.parametrize(
    "reply",
    [
        TEXT,
        f"  \n{TEXT}\n ",
        f"```json\n{TEXT}\n```",
        f"```\n{TEXT}\n``` and more",
        f"Sure:\n```json{TEXT}```",
        TEXT.replace('"', "'"),
        f'"{TEXT}"',
        TEXT.replace("c", "\\u0063").replace('["a"]', '[\n"a"\n]'),
    ],
)
def test_readable_replies(spark, reply):
    assert parsed(spark, reply) == [RESULT]


@pytest.mark.parametrize(
    "reply, error",
    [
        (None, "JSON Error: Empty input"),
        ("", "JSON Error: Empty input"),
        ("   ", "JSON Error: "),
        (TEXT + " thanks", "JSON Error: "),
        (TEXT.replace("d", "it's"), "JSON Error: "),
        ("```json" + TEXT, "JSON Error: "),
        ("[1]", "Unexpected Error: "),
        ("3", "Unexpected Error: "),
        ("\\x", "Unexpected Error: "),
        ('{"score": 7.5}', "Unexpected error: "),
        ('{"score": "5"}', "Unexpected error: "),
        ('{"scope": "a"}', "Unexpected error: "),
        ('{"topic": [1]}', "Unexpected error: "),
    ],
)
def test_unreadable_replies(spark, reply, error):
    *fields, message = parsed(spark, reply)[0]
    assert fields == [None] * 4
    assert message.startswith(error)


def test_reply_details(spark):
    assert parsed(spark, '{"score": 3}') == [(None, None, None, 3, None)]
    assert parsed(spark, '{"score": 300}')[0][3] == 300
    assert parsed(spark, '{"scope": ["é"]}')[0][0] == ["Ã©"]
    assert parsed(spark, '{"scope": ["\\u00e9"]}')[0][0] == ["é"]
    assert parsed(spark, '{"score": 1, "score": 2}')[0][3] == 2


def table(spark, *rows):
    schema = "id long, agent string, score int, combined string"
    return conform(spark.createDataFrame(list(rows), schema), ARTICLE).join(
        spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, combined string"), "id"
    )


def test_results_are_carried_over(spark):
    df = table(spark, (1, None, None, "x"), (2, "USER", 9, "x"), (3, "TAG", 1, "x"), (4, "TAG", 1, "x"))
    reply = F.when(F.col("id") == 4, "no").otherwise(F.lit(TEXT))
    got = inference.apply_results(df.withColumn("result", parse_reply(reply).cast(TAGGING_RESULT)))
    rows = sorted(values(got, "id", "agent", "score", "ai_score2", "tags_topic", "scoring_status"))
    assert rows[:3] == [
        (1, "AI", 5, 5, ["b", "c"], "SUCCESS"),
        (2, "USER", 9, 5, ["b", "c"], "SUCCESS"),
        (3, "AI", 5, 5, ["b", "c"], "SUCCESS"),
    ]
    assert rows[3][:5] == (4, "TAG", 1, None, None) and rows[3][5].startswith("FAILED: JSON Error: ")
    assert values(counters.scoring_counts(got)) == [(4, 3, 1)]


TAXONOMY = "dimension string, ord int, tag string, description string"


def test_taxonomy_text(spark):
    df = spark.createDataFrame(
        [("topic", 2, "t2", "second"), ("topic", 1, "t1", "first"), ("scope", 1, "s", "only"), ("other", 1, "x", "y")], TAXONOMY
    )
    assert values(format_taxonomy(df)) == [("scope:\n- s: only\ntopic:\n- t1: first\n- t2: second\nmood:\n",)]


def test_prompt_fills_placeholders_once(spark):
    df = spark.createDataFrame([("<{profile}>",)], "a string")
    prompt = build_prompt("T {taxonomy} P {profile} A {article}", F.lit("tax"), F.lit("me"), F.col("a"))
    assert values(df.select(prompt)) == [("T tax P me A <{profile}>",)]


def test_model_calls_fail_row_by_row(spark):
    def complete(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return TEXT

    df = table(spark, (1, None, None, "ok"), (2, None, None, "bad"))
    taxonomy = spark.createDataFrame([("scope", 1, "s", "d")], TAXONOMY)
    got = inference.tag_and_score(df, complete, taxonomy, "{}", "{taxonomy}{profile}{article}")
    assert sorted(values(got, "id", "scoring_status")) == [(1, "SUCCESS"), (2, "FAILED: LLM Error: down")]
    assert values(counters.mean_seconds(got))[0][0] >= 0
    assert values(counters.mean_seconds(got.where("id > 9"))) == [(0.0,)]


def test_embeddings_come_in_order_and_in_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 10 and all("\n" not in t for t in texts)
        sizes.add(1)
        return [[float(t.split()[0]), len(texts)] for t in texts]

    rows = [(i, None, None, f"{i}\nx") for i in range(95)]
    df = table(spark, *rows)
    got = inference.embed_articles(df, embed, batch_size=10)
    assert all(v[0] == i for i, v in values(got, "id", "embedding2"))
    assert values(counters.embedding_counts(got)) == [(95, 95)]


def test_one_failing_embedding_call_stops_the_job(spark):
    def embed(texts):
        raise RuntimeError("no vectors today")

    with pytest.raises(PySparkException, match="no vectors today"):
        inference.embed_articles(table(spark, (1, None, None, "x")), embed)
    with pytest.raises(ValueError, match="batch_size"):
        inference.embed_articles(table(spark, (1, None, None, "x")), embed, batch_size=4096)


def test_guards_dry_run_and_count(spark):
    df = table(spark, *[(i, None, None, "x") for i in range(5)])
    full = df.withColumn("embedding2", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(ValueError, match="5 values in embedding2"):
        inference.embed_articles(full, None)
    with pytest.raises(ValueError, match="tags_mood"):
        inference.tag_and_score(df.withColumn("tags_mood", F.array(F.lit("x"))), None, None, "", "")
    assert values(inference.embed_articles(df, None, dry_run=True).where("embedding2 is not null")) == []
    assert sorted(values(inference.embed_articles(df, None, dry_run=True, count=2), "id")) == [(0,), (1,)]
    assert selection.first_rows(df, None) is df
