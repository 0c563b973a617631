import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from newsloom.operators import rules
from newsloom.session import materialize

TAGS = "tag_id long, name string, score int"
ARTICLES = "id long, title string, summary string, tags array<string>, agent string, score int"


@pytest.fixture(params=["literals", "long table"])
def path(request, monkeypatch):
    """Run a test for the literal path and for the one used with long tag tables."""
    if request.param == "long table":
        monkeypatch.setattr(rules, "LITERAL_OWN_TAGS", 0)
        monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)


def articles(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ARTICLES)


@pytest.fixture
def tags(spark):
    return spark.createDataFrame(
        [(1, "bad", -1), (2, "good", 2), (3, "worse", -3), (4, "fine", 1), (5, "zero", 0), (6, "Both", -1), (7, "Both", 1),
         (8, "News", 1), (9, "Spam", -1), (10, "Ad", -1), (11, "AI", 5), (12, None, 1)],
        TAGS,
    )


def test_tag_polarity_filters(spark, tags):
    assert sorted(values(rules.negative_tags(tags))) == [("Ad",), ("Both",), ("Spam",), ("bad",), ("worse",)]
    assert ("zero",) not in values(rules.positive_tags(tags))


def test_marks_by_own_tags(spark, tags, path):
    rows = [
        (None, (0, None)),
        ([], (0, None)),
        (["bad", "x", "worse", "y"], (-10, "worse")),
        (["fine", "good"], (10, "good")),
        (["fine", "bad"], (0, None)),
        (["zero", None, "x"], (0, None)),
        (["Both"], (-10, "Both")),
    ]
    df = articles(spark, *[("t", "s", t, None, None) for t, _ in rows])
    assert [r[1:] for r in sorted(values(rules.mark_by_tags(df, tags)))] == [r for _, r in rows]


def test_marks_by_text(spark, tags, path):
    rows = [
        (None, "news", (0, None)),
        ("the news", None, (5, "News")),
        ("buy sp", "am now", (-5, "Spam")),
        ("a spam ad", "", (-5, "Spam")),
        ("an ad, spam", "", (-5, "Spam")),
        ("news and spam", "", (0, None)),
        ("AI", "ai", (0, None)),
        ("good", "bad", (-5, "bad")),
        ("they'ad", "", (-5, "Ad")),
    ]
    df = articles(spark, *[(t, s, None, None, None) for t, s, _ in rows])
    assert [r[1:] for r in sorted(values(rules.mark_by_text(df, tags)))] == [r for *_, r in rows]


def test_cascade_gives_one_row_per_article(spark, tags, path):
    df = articles(
        spark,
        ("news", "", ["bad"], None, None),
        ("news", "", ["bad", "good"], None, None),
        ("x", "y", None, None, None),
        ("news", "", ["bad"], "TAG", 5),
    )
    assert sorted(values(rules.run_rules(df, tags))) == [
        (0, "TAG", -10, "bad"),
        (1, "TITLE", 5, "News"),
        (2, "NONE", 0, None),
    ]


def test_rescoring_leaves_out_users_negatives_and_missing_agents(spark, tags):
    df = articles(
        spark,
        ("x", "", None, "USER", 10),
        ("x", "", None, "TAG", -1),
        ("x", "", None, None, 3),
        ("x", "", None, "AI", 0),
    )
    assert values(rules.run_rules(df, tags, rescore=True)) == [(3, "NONE", 0, None)]


def test_rows_of_users_in_other_spellings_stop_the_job(spark, tags):
    df = articles(spark, ("x", "", None, "User", 10))
    with pytest.raises(PySparkException, match="set by a user"):
        rules.run_rules(df, tags, rescore=True).collect()


@pytest.mark.parametrize("heads", [1000, 0])
def test_long_tables_agree_with_brute_force(spark, monkeypatch, heads):
    monkeypatch.setattr(rules, "LITERAL_HEADS", heads)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    tags = [(i, word().title(), rng.randrange(-2, 3)) for i in range(100)]
    texts = [(" ".join(word() for _ in range(6)), " ".join(word() for _ in range(4))) for _ in range(200)]
    df = articles(spark, *[(t, s, None, None, None) for t, s in texts])

    def expected(title, summary):
        text = (title + summary).title()
        neg = next((n for _, n, s in tags if s < 0 and n in text), None)
        pos = next((n for _, n, s in tags if s > 0 and n in text), None)
        return (-5, neg) if neg and not pos else (5, pos) if pos and not neg else (0, None)

    got = sorted(values(rules.mark_by_text(df, spark.createDataFrame(tags, TAGS))))
    assert [g[1:] for g in got] == [expected(*t) for t in texts]


def test_short_tables_need_no_shuffle(spark, tags):
    df = articles(spark, ("x", "", None, None, None))
    plan = rules.run_rules(df, tags)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_an_own_tag_on_every_article(spark, monkeypatch):
    monkeypatch.setattr(rules, "LITERAL_OWN_TAGS", 0)
    df = spark.range(20_000).select("id", F.array(F.lit("good"), F.col("id").cast("string")).alias("tags"))
    tags = spark.createDataFrame([(1, "good", 1), (2, "7", -1)], TAGS)
    got = rules.mark_by_tags(df, tags)
    assert sorted(values(got.groupBy("score").count())) == [(0, 1), (10, 19_999)]


def test_an_empty_name_is_in_every_text(spark, path):
    tags = spark.createDataFrame([(1, "News", -1), (2, "", -1), (3, "Late", -1), (4, "Fine", 1)], TAGS)
    df = articles(spark, ("news", "", ["x"], None, None), ("late", "", [""], None, None), ("fine", "", None, None, None), (None, "x", None, None, None))
    assert [r[1:] for r in sorted(values(rules.mark_by_text(df, tags)))] == [(-5, "News"), (-5, ""), (0, None), (0, None)]
    assert [r[1:] for r in sorted(values(rules.mark_by_tags(df, tags)))] == [(0, None), (-10, ""), (0, None), (0, None)]


def test_prefixes_of_all_lengths_and_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)
    names = ["A", "Ab", "Abc", "Abcd" * 3, "Thing", "\U0001f600 X", "B" * 40]
    tags = spark.createDataFrame([(i, n, 1) for i, n in enumerate(names[::-1])] + [(100 + i, f"Hot {i}", -1) for i in range(300)], TAGS)
    texts = ["zabcz", "x thing", "\U0001f600 x", "b" * 41, "abcd" * 3, "hot 299", "hot 300", ""]
    df = articles(spark, *[(t, None, None, None, None) for t in texts])

    def first(text, some):
        return next((n for n in some if n in text.title()), None)

    expected = []
    for t in texts:
        neg, pos = first(t, [f"Hot {i}" for i in range(300)]), first(t, names[::-1])
        expected.append((-5, neg) if neg and not pos else (5, pos) if pos and not neg else (0, None))
    assert [r[1:] for r in sorted(values(rules.mark_by_text(df, tags)))] == expected
    plan = rules.mark_by_text(df, tags)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # the title case is stored; nothing else leaves the JVM


def test_long_tables_search_each_distinct_word_once(spark, monkeypatch):
    monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)
    stored = {}

    def noted(df, name="stage"):
        stored.setdefault(name, []).append(materialize(df, name))
        return stored[name][-1]

    monkeypatch.setattr(rules, "materialize", noted)
    texts = [f"old news {i % 3} of the day" for i in range(300)]
    df = articles(spark, *[(t, "", None, None, None) for t in texts])
    tags = spark.createDataFrame([(1, "New", 1), (2, "2", -1), (3, "Ne", 1)], TAGS)
    got = sorted(values(rules.mark_by_text(df, tags)))
    assert [r[1:] for r in got] == [(0, None) if i % 3 == 2 else (5, "New") for i in range(300)]
    assert [v.count() for v in stored["vocabulary"]] == [8]  # not the 1,800 words of the texts


def test_names_with_blanks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 4)))
    tags = [(rng.randrange(40), " ".join(word() for _ in range(rng.randrange(1, 6))).title(), rng.randrange(-2, 3)) for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 8))) for _ in range(200)]
    df = articles(spark, *[(t, None, None, None, None) for t in texts])

    def expected(text):
        neg, pos = (next((n for _, n, s in sorted(tags) if s * side > 0 and n in text.title()), None) for side in (-1, 1))
        return (-5, neg) if pos is None and neg is not None else (5, pos) if neg is None and pos is not None else (0, None)

    tags = [t for t in tags if len(t[1]) > 1]
    got = sorted(values(rules.mark_by_text(df, spark.createDataFrame(tags, TAGS))))
    assert [g[1:] for g in got] == [expected(t) for t in texts]
    assert {g[1] for g in got} == {-5, 0, 5}


def test_cascade_with_many_tags_searches_the_words_of_undecided_texts_once(spark, monkeypatch):
    monkeypatch.setattr(rules, "LITERAL_OWN_TAGS", 0)
    monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)
    words = []

    def noted(df, name="stage"):
        stored = materialize(df, name)
        if name == "vocabulary":
            words.extend(r["window"] for r in stored.collect())
        return stored

    monkeypatch.setattr(rules, "materialize", noted)
    df = articles(spark, *[(f"news {i}" if i % 2 else "news today", "", ["bad"] if i % 2 else ["x"], None, None) for i in range(40)])
    tags = spark.createDataFrame([(1, "bad", -1), (2, "News", 1)], TAGS)
    got = sorted(values(rules.run_rules(df, tags)))
    assert [r[1:] for r in got] == [("TAG", -10, "bad") if i % 2 else ("TITLE", 5, "News") for i in range(40)]
    assert sorted(words) == ["news", "today"]


def test_names_with_one_prefix_are_met_by_equality(spark, monkeypatch):
    """A condition beside the equality would be tried on every name with the prefix of a piece."""
    monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)
    plans, search = [], rules._named_windows

    def noted(*args):
        found = search(*args)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(rules, "_named_windows", noted)
    tags = spark.createDataFrame([(i, f"Same{i}", 1 if i % 2 else -1) for i in range(300)], TAGS)
    df = articles(spark, *[(f"same{i}", "", None, None, None) for i in range(150)])
    got = [r[1:] for r in sorted(values(rules.mark_by_text(df, tags)))]
    names = [f"Same{i}" for i in range(300)]
    for i, g in enumerate(got):
        inside = [n for n in names if n in f"Same{i}"]
        bad, good = ([n for n in inside if int(n[4:]) % 2 == k] for k in (0, 1))
        assert g == ((-5, bad[0]) if bad and not good else (5, good[0]) if good and not bad else (0, None))
    joins = [line for line in "".join(plans).splitlines() if "Join Inner" in line]
    assert joins and not any("AND" in j or "StartsWith" in j for j in joins)


def test_a_tag_table_is_made_once(spark, monkeypatch):
    monkeypatch.setattr(rules, "LITERAL_OWN_TAGS", 0)
    monkeypatch.setattr(rules, "LITERAL_TEXT_TAGS", 0)
    made = spark.sparkContext.accumulator(0)

    def names(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    tags = spark.createDataFrame([(1, "bad", -1), (2, "News", 1)], TAGS).coalesce(1).mapInArrow(names, TAGS)
    df = articles(spark, ("news", "", ["x"], None, None), ("news", "", ["bad"], None, None))
    assert [r[1:] for r in sorted(values(rules.run_rules(df, tags)))] == [("TITLE", 5, "News"), ("TAG", -10, "bad")]
    assert made.value == 2
