import math
import re
from collections import Counter

import pytest

from promptbook.llm.term_census import mark_terms, term_census
from promptbook.llm.term_weights import log_entropy

TEXTS = ["Dagger dagger poison", "the the İstanbul abc1 café Dagger", "", None, "_x under_score ſtill naïve", "wee'l wee " + "long " * 3000, "the poison"]


def terms(text):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if re.fullmatch("[a-z]{3,}", w)]


def brute(texts):
    n, r = Counter(), Counter()
    for t in texts:
        n.update(terms(t))
        r.update(set(terms(t)))
    return {(w, n[w], r[w]) for w in n}


@pytest.mark.parametrize("budget", [1 << 26, 300])
def test_census_counts_all_terms_also_when_it_must_spill(spark, budget):
    df = spark.createDataFrame([(t, "x", 1) for t in TEXTS], "text string, term string, n int")
    tops = spark.createDataFrame([(" A, b ,,a\n,B ",), ("b",), (None,), (" , ",)], "words string")
    got = term_census({"speech": (df.select("text"), "words"), "top": (tops, "entries")}, budget).collect()
    assert {(r.term, r.n_total, r.n_records) for r in got if r.field == "speech"} == brute(TEXTS)
    assert {(r.term, r.n_total, r.n_records) for r in got if r.field == "top"} == {("a", 2, 1), ("b", 3, 2)}


@pytest.mark.parametrize("budget", [1 << 26, 20_000, 400])
def test_a_term_in_every_record_and_many_rare_ones(spark, budget):
    """A third of all occurrences are one term; the others are so many that they are split by hash bits again and again."""
    from pyspark.sql import functions as F

    rare = F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 8), 5, "0"), "01234567", "abcdefgh")
    df = spark.range(0, 6000, 1, 6).select(F.concat(F.lit("hot "), rare, F.lit(" common "), rare).alias("t"))
    got = {r.term: (r.n_total, r.n_records) for r in term_census({"x": (df, "words")}, budget).collect()}
    assert got.pop("hot") == got.pop("common") == (6000, 6000)
    assert len(got) == 6000 and set(got.values()) == {(2, 1)}


def test_what_exceeds_the_budget_is_split_and_one_term_is_not(tmp_path):
    import pyarrow as pa

    from promptbook.llm import term_census as c

    def spill(rows, budget):
        t = pa.table({"field": ["f"] * len(rows), "term": [r[0] for r in rows], "n": [1] * len(rows), "records": [1] * len(rows), "h": pa.array([r[1] for r in rows], pa.int64())})
        made = []
        out = []
        for part in c._spill(c._duck(), iter(t.to_batches(max_chunksize=50)), 0, str(tmp_path), budget):
            made.append(len(list(tmp_path.rglob("*"))))
            out += part.to_pylist()
        return out, max(made, default=0)

    many, files = spill([(f"t{i}", (i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63) for i in range(2000)], 2000)
    assert len(many) == 2000 and files > 10
    one, files = spill([("hot", 77)] * 5000, 2000)
    assert [(r["term"], r["n"]) for r in one] == [("hot", 5000)] and files == 0
    same, files = spill([(f"t{i}", 5) for i in range(500)], 2000)  # all of one hash
    assert len(same) == 500
    assert list(tmp_path.iterdir()) == []


def test_census_of_nothing(spark):
    assert term_census({"x": (spark.createDataFrame([], "text string"), "words")}).count() == 0


def test_marks_can_be_both_or_none(spark):
    census = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("g", "c", 1, 2)], "field string, term string, n_total long, n_records long")
    totals = spark.createDataFrame([("f", 100), ("g", 3)], "field string, total long")
    got = {(r.term, r.mark) for r in mark_terms(census, totals).collect()}
    assert got == {("a", "rare"), ("b", None), ("c", "rare"), ("c", "common")}


def test_log_entropy_equals_brute_force(spark):
    rows = [(f"r{i}", t) for i, t in enumerate(TEXTS) if t is not None]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows] + [(None, None, "x", 0)], "rid string, text string, term string, tf int")
    got = {(r.id, r.term): (r.tf, r.df, round(r.score, 9)) for r in log_entropy(df, "rid", "text").collect()}
    tf = {(i, w): c for i, t in rows for w, c in Counter(terms(t)).items()}
    want = {}
    for (i, w), c in tf.items():
        spread = [x for (_, v), x in tf.items() if v == w]
        g = sum(spread)
        h = -sum(x / g * math.log(x / g) for x in spread)
        want[(i, w)] = (c, len(spread), round(math.log(1 + c) * (1 - h / math.log(len(rows))), 9))
    assert got == want


def test_log_entropy_of_one_and_of_no_record(spark):
    one = spark.createDataFrame([("a", "dagger dagger")], "i string, t string")
    assert abs(log_entropy(one, "i", "t").first().score - math.log(3)) < 1e-12
    assert log_entropy(one.where("false"), "i", "t").count() == 0
