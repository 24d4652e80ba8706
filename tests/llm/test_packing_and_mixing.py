import numpy as np
import pytest
from pyspark.sql import functions as F

from promptbook.llm import source_mix, tokens
from promptbook.llm.containers import fill_containers, pack


def test_pack_keeps_all_limits_and_fills_well():
    rng = np.random.default_rng(4)
    t = np.minimum(rng.lognormal(5, 1, 4000).astype(int) + 1, 1000)
    loss = (t * rng.uniform(0.5, 1, 4000)).astype(int)
    c, p = pack(t, loss, 1024, 12, 1000)
    n = c.max() + 1
    assert (np.bincount(c, t) <= 1024).all() and (np.bincount(c, loss) <= 1000).all() and (np.bincount(c) <= 12).all()
    assert len({*zip(c, p)}) == 4000
    assert n <= 1.03 * max(t.sum() / 1024, loss.sum() / 1000, 4000 / 12) + 1


def test_containers_split_only_what_is_larger(spark):
    rows = [(1, 50, 40), (2, 250, 240), (3, 100, 100), (4, 0, 0), (5, None, None), (6, 100, 0), (7, 3, 3), (7, 3, 3)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "id long, n_tokens int, n_loss int, part string, container int")
    got = fill_containers(df, 100, 3, 90).collect()
    per = {}
    for r in got:
        per.setdefault(r.container, []).append(r)
    assert all(sum(x.n_tokens for x in v) <= 100 and len(v) <= 3 for v in per.values())
    assert all(sum(x.n_loss for x in v) <= 90 or [x.over_loss for x in v if x.n_loss] == [True] for v in per.values())
    assert {r.id for r in got if r.over_loss} == {2, 3}
    parts = {}
    for r in got:
        parts.setdefault(r.id, []).append(r)
    assert set(parts) == {1, 2, 3, 4, 5, 6, 7} and len(parts[1]) == len(parts[3]) == 1 and len(parts[6]) == 1 and len(parts[7]) == 2
    for i in (2,):
        v = sorted(parts[i], key=lambda r: r.part)
        assert [r.start_token for r in v] == list(np.cumsum([0] + [r.n_tokens for r in v[:-1]])) and v[0].n_parts == len(v) > 1
    assert sum(r.n_tokens for r in parts[2]) == 250 and sum(r.n_loss for r in parts[2]) == 240
    assert fill_containers(df.where("false"), 100, 3, 90).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, 0, 3, 90)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello there. General text follows"), (2, ""), (3, None), (4, "x" * 100_000)], "k long, t string")
    got = {r.id: (r.n_tokens, r.n_loss) for r in tokens.token_sizes(df, "k", "t").collect()}
    text = tokens.encoder().encode_ordinary("Hello there. General text follows")
    assert got[1] == (len(text), len(text) - len(tokens.encoder().encode_ordinary("Hello there."))) and got[2] == (0, 0) and 3 not in got and got[4][0] > 1000


def test_plan_reaches_the_shares_and_spreads_repeats():
    weights = {("a",): 1000, ("b",): 100, ("a", "b"): 300}
    plan = source_mix.plan_mix(weights, {"a": (0.5, 1), "b": (0.5, 4), "absent": (0.3, 9)})
    a = sum(v for (_, s), v in plan.items() if s == "a")
    b = sum(v for (_, s), v in plan.items() if s == "b")
    assert abs(a - b) <= 2 and a >= 999
    assert plan[(("b",), "b")] <= 400 and plan.get((("a", "b"), "a"), 0) <= 300 and plan.get((("a", "b"), "b"), 0) <= 1200
    assert source_mix.plan_mix({}, {"a": (1.0, 1)}) == {} and source_mix.plan_mix({("a",): 5}, {"a": (1.0, 0)}) == {}
    small = source_mix.plan_mix(weights, {"a": (0.5, 1), "b": (0.5, 4)}, total=400)
    assert 398 <= sum(small.values()) <= 400


def records(spark):
    texts = [(i, f" Src_{i % 3} ", f"text {i}", 10 + i % 5) for i in range(300)]
    texts += [(1000 + i, "src_1", f"text {3 * i}", 10 + (3 * i) % 5) for i in range(40)]  # copies of texts of src_0
    texts += [(2000, None, "x", 5), (2001, "src_0", None, 5), (2002, "src_0", "empty", 0), (2003, "other", "y", 5)]
    df = spark.createDataFrame(texts, "id long, source string, text string, n_tokens int")
    return df.withColumn("key", source_mix.text_key("text")).withColumn("class", F.lit("clash"))


def test_draws_keep_caps_and_shares(spark):
    targets = spark.createDataFrame([("SRC_0", 0.6, 2), ("src_1", 0.2, 1), ("src_2 ", 0.2, 3), ("gone", 0.4, 3), ("src_1", 0.2, 1)], "source string, target_share double, max_repeats int")
    draws = source_mix.mix_sources(records(spark), targets)
    rows = draws.collect()
    caps = {"src_0": 2, "src_1": 1, "src_2": 3}
    assert all(1 <= r.n_repeats <= caps[r.source] for r in rows)
    assert len({(r.source, r.id) for r in rows}) == len(rows)
    got = {r.source: r.actual_share for r in source_mix.shares(draws, targets).collect()}
    assert abs(got["src_0"] - 0.6) < 0.02 and abs(got["src_1"] - 0.2) < 0.02 and abs(got["src_2"] - 0.2) < 0.02 and got["gone"] == 0
    again = source_mix.mix_sources(records(spark), targets).collect()
    assert sorted(again) == sorted(rows)


def test_many_sets_of_sources_are_bounded_and_shares_still_reached(spark):
    rows = [(i * 8 + j, f"s{j}", f"text {i}", 10) for i in range(500) for j in range(8) if (i % 256) >> j & 1]
    df = spark.createDataFrame(rows, "id long, source string, text string, n_tokens int").withColumn("key", source_mix.text_key("text"))
    targets = spark.createDataFrame([(f"s{j}", 0.125, 1 + j % 3) for j in range(8)], "source string, target_share double, max_repeats int")
    for most in (0, 5, 2048):
        draws = source_mix.mix_sources(df, targets, max_classes=most)
        got = source_mix.shares(draws, targets).collect()
        assert all(abs(r.actual_share - 0.125) < 0.02 and r.most_repeats <= r.max_repeats for r in got), (most, got)


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert source_mix.mix_sources(records(spark).where("false"), targets).count() == 0
    assert source_mix.mix_sources(records(spark), targets.where("false")).count() == 0
    assert source_mix.mix_sources(records(spark), targets).count() == 0
