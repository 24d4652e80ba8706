import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptbook import config
from promptbook.operators import characters, clusters, density, documents, embedding, pipeline, reduction, reports, vectors
from promptbook.sources import files
from promptbook.streaming import late_rows


def test_resolution_and_rollup(spark):
    speeches = spark.createDataFrame(
        [("A1", 0, "Virg.", "first"), ("A1", 1, "Omnes.", "noise"), ("A1", 2, "VIRGINIA", "second  •"), ("A1", 3, "Zzz", None), ("A1", 4, "...", "gone"), ("A2", 0, "Nobody", "x")],
        "tcp string, pos int, prefix string, text string",
    )
    catalogue = spark.createDataFrame([("A1", "VIRGINIA, a maid; VIRGINIUS, her father"), ("A1", "ZZZ, later row"), ("A3", None)], "tcp string, roles string")
    assert characters.known_plays(speeches, catalogue).count() == 5
    rows = {r.prefix: r for r in characters.resolve(characters.known_plays(speeches, catalogue), catalogue).collect()}
    assert "..." not in rows
    assert rows["Omnes."].resolved == config.CROWD and rows["Omnes."].match_score == 100
    assert rows["VIRGINIA"].resolved == "VIRGINIA" and rows["VIRGINIA"].role_description == "a maid;"
    assert rows["Zzz"].route == "raw" and rows["Zzz"].role_description == ""
    rolled = {r.normalized_name: r for r in characters.rollup(characters.resolve(speeches, catalogue)).collect()}
    assert rolled["VIRGINIA"].speech_text == "second" and rolled["VIRGINIA"].n_words == 1


@pytest.mark.parametrize("score,route", [(92, "merge"), (91, "review"), (70, "review"), (69, "raw")])
def test_thresholds(score, route):
    assert ("merge" if score >= config.AUTO_MERGE else "review" if score >= config.REVIEW else "raw") == route


def test_length_split(spark):
    df = spark.createDataFrame([("a", 199), ("b", 200), (config.CROWD, 900)], "normalized_name string, n_chars int")
    kept, dropped = characters.split_short(df)
    assert [r[0] for r in kept.collect()] == ["b"] and dropped.count() == 2


def test_speeches_keep_the_last_of_a_repeated_prefix(spark, tmp_path):
    (tmp_path / "A1.json").write_text('{"tcp": "A1", "speeches": {"King": "one", "Fool": "two", "King": "three"}}')
    (tmp_path / "B1.json").write_text('{"tcp": "B1", "speeches": {"X": "y"}}')
    (tmp_path / "A2.json").write_text('{"tcp": "A2", "speeches": null}')
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    got = characters.speeches_of(files.read_plays(spark, str(tmp_path))).orderBy("pos").collect()
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")
    assert [(r.tcp, r.prefix, r.text) for r in got] == [("A1", "King", "three"), ("A1", "Fool", "two")]


def test_documents_do_not_fan_out(spark):
    chars = spark.createDataFrame([("A1", " Inf • ", "text", "mine")], "tcp string, normalized_name string, speech_text string, title string")
    meta = spark.createDataFrame([("A1", "T  1", 1600), ("A1", "T 1 ", 1600), (None, "x", 1)], "tcp string, title string, year int")
    got = documents.build_documents(chars, meta)
    assert got.columns[:3] == ["character_id", "tcp", "display_name"] and got.columns[-1] == "speech_text"
    assert got.count() == 1 and got.first().character_id == "A1::INF •" and got.first().title == "mine" and got.first().title_meta


def test_class_tfidf_keeps_terms_of_exactly_two_of_three(spark):
    df = spark.createDataFrame([("a", 0, "dagger poison ghost"), ("b", 1, "dagger poison lute lute"), ("c", -1, "dagger lute"), ("d", None, "x"), ("e", 2, None)], "character_id string, cluster int, speech_text string")
    got = {(r.cluster, r.term): r.tfidf for r in clusters.class_tfidf(df, stopwords=["ghost"]).collect()}
    assert set(got) == {(0, "poison"), (1, "poison"), (1, "lute"), (-1, "lute")}
    assert got[0, "poison"] == pytest.approx(1) and got[1, "poison"] ** 2 + got[1, "lute"] ** 2 == pytest.approx(1)
    assert clusters.class_tfidf(df.where("cluster = 0"), stopwords=[]).count() == 0


def test_stop_words_are_learnt_in_any_language(spark):
    rows = [(f"c{i}", i % 3, f"och det {'krona' if i % 3 else 'svärd'} {'lykta' if i in (1, 2) else ''}") for i in range(60)]
    df = spark.createDataFrame(rows, "character_id string, cluster int, speech_text string")
    left = {r.term for r in clusters.class_tfidf(df).collect()}
    assert left == {"lykta"}
    assert "krona" in {r.term for r in clusters.class_tfidf(df, stopwords=["och"]).collect()}


def test_summary_counts_outliers_as_the_published_rows_do(spark):
    rows = spark.createDataFrame([(-1,)] * 6 + [(0,)] * 3 + [(1,)], "cluster int")
    s = clusters.summary(rows, "p").first()
    assert (s["n_clusters_excl_-1"], s.n_outliers, s.outliers_pct, s.largest_cluster_size, s.largest_real_cluster) == (2, 6, 60.0, 6, 3)


def blobs(n=60, k=3, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, dim)) + 12 * c for c in range(k)])
    return x, np.repeat(np.arange(k), n)


def test_knn_is_exact_over_blocks(spark):
    x, _ = blobs(20)
    df = spark.createDataFrame([(f"v{i:02d}", [float(t) for t in r]) for i, r in enumerate(x)], "id string, v array<double>")
    got = {(r.id, r.neighbour) for r in vectors.knn(df, 4, "euclidean", block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(f"v{i:02d}", f"v{j:02d}") for i in range(len(x)) for j in np.argsort(d[i])[:4]}


def test_of_equal_neighbours_the_lesser_ids_are_kept(spark):
    df = spark.createDataFrame([(f"v{i:02d}", [1.0, 0.0]) for i in range(30)], "id string, v array<double>")
    got = {}
    for r in vectors.knn(df, 3, block=8).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    for i, pairs in got.items():
        assert [n for _, n in sorted(pairs)] == [f"v{j:02d}" for j in range(4) if f"v{j:02d}" != i][:3]
    assert len(got) == 30


def test_valid_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [0.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", None), (None, [1.0, 1.0]), ("e", [1.0])], "i string, e array<float>")
    assert [r.id for r in vectors.valid(df, "i", "e", 2).collect()] == ["a"]


def test_spanning_tree_weight_equals_kruskal():
    x, _ = blobs(15)
    c = density.core(x, 4)
    tree = density.spanning_tree(x, c)
    d = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.maximum(c[:, None], c[None]))
    edges = sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i))
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for w, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert abs(tree[:, 2].sum() - total) < 1e-9


@pytest.mark.parametrize("block,finish", [(1024, 50_000), (16, 50_000), (16, 4)])
def test_tree_of_blocks_and_rounds_equals_the_tree_of_all_rows(spark, block, finish):
    x, _ = blobs(15)
    x[3] = x[4] = x[5]
    df = spark.createDataFrame([(f"v{i:02d}", [float(t) for t in r]) for i, r in enumerate(x)], "id string, position array<double>")
    rows = density.mst_edges(df, 4, block, finish).collect()
    want = density.spanning_tree(x, density.core(x, 4))[:, 2]
    assert np.allclose(sorted(r.weight for r in rows), sorted(want)) and len(rows) == len(x) - 1
    root = {f"v{i:02d}": f"v{i:02d}" for i in range(len(x))}
    for r in rows:
        a, b = r.a, r.b
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        assert a != b and r.a < r.b
        root[a] = b
    assert density.mst_edges(df.where("false"), 4, block, finish).count() == 0 and density.mst_edges(df.limit(1), 4, block, finish).count() == 0


def test_hdbscan_over_blocks_equals_that_in_memory(spark):
    x, _ = blobs(40)
    df = spark.createDataFrame([(f"v{i:03d}", [float(t) for t in r]) for i, r in enumerate(x)], "id string, position array<double>")
    got = [r.cluster for r in density.hdbscan(df, 10, block=32).orderBy("id").collect()]
    assert got == list(density.cluster(x, 10))
    assert density.hdbscan(df.where("false"), 10).count() == 0


def test_density_clusters_find_blobs_and_noise(spark):
    x, y = blobs()
    x = np.concatenate([x, [[500.0] * 5]])
    labels = density.cluster(x, 20)
    assert labels[-1] == -1 and len(set(labels[:-1]) - {-1}) == 3
    for c in set(labels) - {-1}:
        assert (labels == c).sum() >= 20 and len(set(y[np.flatnonzero(labels == c)])) == 1
    assert (density.cluster(x[:5], 20) == -1).all()
    assert len(density.cluster(np.zeros((40, 2)), 5)) == 40


def test_reduction_keeps_neighbours_and_is_deterministic(spark):
    x, y = blobs(40)
    df = spark.createDataFrame([(f"v{i:03d}", [float(t) for t in r]) for i, r in enumerate(x)], "id string, v array<double>")
    graph = reduction.fuzzy_graph(vectors.knn(df, 10, "euclidean"), 10)
    one = {r.id: r.position for r in reduction.reduce(df, graph, 2, 0.05, epochs=60).collect()}
    two = {r.id: r.position for r in reduction.reduce(df, graph, 2, 0.05, epochs=60).collect()}
    assert one == two
    z = np.array([one[f"v{i:03d}"] for i in range(len(x))])
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (y[np.argsort(d, axis=1)[:, :5]] == y[:, None]).mean() > 0.95


def test_curve_and_weights():
    a, b = reduction.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02
    w = reduction.smooth_weights(np.array([[0.1, 0.2, 0.4, 0.5], [0.1, 0.2, np.nan, np.nan], [0.0, 0.0, 0.0, 0.0]]), 4)
    assert abs(w[0].sum() - 2) < 1e-3 and w[0, 0] == 1 and w[1, 2] == 0 and (w[2] == 1).all()


def test_layout_refuses_more_rows_than_a_task_takes(spark, monkeypatch):
    monkeypatch.setattr(density, "TREE_ROWS", 1)
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, position array<double>")
    with pytest.raises(ValueError):
        density.hdbscan(df, 2)


def test_embedding_marks_truncated_texts(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", None)], "i string, t string")
    got = {r.id: r for r in embedding.embed(df, "i", "t", instruction="Say", max_tokens=4).collect()}
    assert got["a"].truncated and not got["b"].truncated
    assert abs(sum(x * x for x in got["a"].embedding) - 1) < 1e-6
    assert embedding.run_metadata(embedding.embed(df, "i", "t"), "m", 64).first().n_rows == 2


def test_slugs_do_not_collide(spark):
    df = spark.createDataFrame([("A::X Y",), ("A::X_Y",), ("A::x y",)], "character_id string")
    assert len({r.slug.lower() for r in reports.unique_slugs(df).collect()}) == 3


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 'NIGHT | DELIGHT\n"GRACE"'), ("B", "NA")], "tcp string, names string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert [r.embedding for r in files.read_matrix(spark, str(tmp_path / "m.npy"), 2).orderBy("row").collect()][3] == [9.0, 10.0, 11.0]
    files.write_pages(spark.createDataFrame([("a/b.html", "<p>")], "path string, html string"), str(tmp_path / "site"))
    assert (tmp_path / "site/a/b.html").read_text() == "<p>"
    files.write_json(df, str(tmp_path / "j"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "j").glob("*.json")) == 2
    df.write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.rewrite(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        config.Paths(tmp_path).require("metadata.parquet")
    assert json.dumps(config.PRESETS[0].name)


def test_clustering_end_to_end(spark):
    x, _ = blobs(30, dim=8)
    df = spark.createDataFrame([(f"v{i:03d}", [float(t) for t in r]) for i, r in enumerate(x)], "id string, v array<double>")
    got = pipeline.cluster_vectors(df, config.Preset("p", 10, 0.05, 10), epochs=50).collect()
    assert len(got) == len(x)


def test_stream_counts_rows_once(spark, small):
    stream = late_rows.first_rows(late_rows.stream_table(spark, small, "character_table"), "row_id")
    q = stream.select("row_id").writeStream.format("memory").queryName("late").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT row_id) AS d FROM late").first()
    want = spark.read.parquet(f"{small}/character_table.parquet").select(F.countDistinct("row_id")).first()[0]
    assert got.n == got.d == want


def test_last_token_pooling_with_padding_on_either_side():
    states = np.arange(24.0).reshape(2, 4, 3)
    assert (embedding.last_token_pool(states, [[1, 1, 0, 0], [1, 1, 1, 1]]) == states[[0, 1], [1, 3]]).all()
    assert (embedding.last_token_pool(states, [[0, 1, 1, 1], [0, 0, 1, 1]]) == states[:, 3]).all()
    model = embedding.pooled_model(lambda: lambda texts: (np.ones((len(texts), 2, 3)), np.ones((len(texts), 2))))
    assert model()(["a", "b"]).shape == (2, 3)


def test_truncation_counts_the_tokens_of_the_given_tokenizer(spark):
    df = spark.createDataFrame([("a", "abcdef"), ("b", None)], "id string, t string")
    got = {r.id: r for r in embedding.embed(df, "id", "t", instruction="", max_tokens=24, tokens=lambda: (list, "".join)).collect()}
    assert got["a"].n_tokens == len("Instruct: \nQuery: abcdef") and not got["a"].truncated
    assert {r.truncated for r in embedding.embed(df, "id", "t", instruction="", max_tokens=5, tokens=lambda: (list, "".join)).collect()} == {True}


def test_matrix_round_trip_and_folders(spark, tmp_path):
    rows = [(f"v{i:03d}", [float(i), 0.5]) for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "id string, embedding array<double>")
    path = str(tmp_path / "m.npy")
    assert files.write_matrix(df, path, rows_per_batch=7) == 50
    assert np.array_equal(np.load(path), np.array([r[1] for r in rows], dtype=np.float32))
    with pytest.raises(ValueError):
        files.write_matrix(df.limit(0), path)
    made = config.Paths(tmp_path / "run").make()
    assert made.data.is_dir() and (made.site / "characters").is_dir()
    with pytest.raises(FileNotFoundError):
        made.require("missing.csv")


def test_a_play_in_several_files_is_read_in_their_order(spark):
    df = spark.createDataFrame([("A1", {"x": "late", "z": "last"}, "A1_2.json"), ("A1", {"x": "early", "y": "mid"}, "A1_1.json")], "tcp string, speeches map<string,string>, file string")
    assert [(r.prefix, r.text) for r in characters.speeches_of(df).orderBy("pos").collect()] == [("x", "late"), ("y", "mid"), ("z", "last")]


def test_figure_and_plots(spark, tmp_path):
    cols = "display_name normalized_name raw_names title author date_decade date_first_performance genre play_type theater theater_type company role_description".split()
    text = F.lit("word " * 80 + "dagger " + "word " * 400)
    rows = spark.range(12).select(F.format_string("A1::C%02d", "id").alias("character_id"), F.lit("A1").alias("tcp"), *[F.lit(c).alias(c) for c in cols], F.lit(1600).alias("year"), F.col("id").alias("n_words"), F.col("id").alias("n_chars"), F.lit(1).alias("brit_drama_number"), F.lit(3).alias("cluster"), F.lit("3: dagger").alias("topic_label"), F.lit("dagger, poison").alias("top_words"), F.when(F.col("id") > 0, F.col("id").cast("double")).alias("x"), F.lit(2.0).alias("y"), text.alias("speech_text"), text.alias("plot"))
    page = reports.cluster_pages(rows).first().html
    assert '<ul class="plays"><li>title (1600)</li></ul>' in page and "dagger, poison" in page and page.count('class="plot"') == 1
    assert all('class="plot"' in r.html for r in reports.character_pages(rows).collect())
    assert 'class="plot"' not in reports.cluster_pages(rows.drop("plot")).first().html
    traces = [json.loads(r.trace) for r in reports.figure_traces(rows, points=4).collect()]
    assert sorted(x for t in traces for x in t["x"]) == list(range(1, 12)) and len(traces) > 1
    reports.write_figure(rows, str(tmp_path / "f.html"))
    html = (tmp_path / "f.html").read_text()
    assert html.count("traces.push") == 1 and 'menus["Genre"] = ["genre"]' in html


def test_samples_hold_each_value_once(spark):
    from promptbook.plans.sampling import bounded_sample

    df = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"), F.lit(1).alias("other"))
    got = bounded_sample(df, "t", 100)
    assert len(got) == len(set(got)) == 100 and got == bounded_sample(df.repartition(7), "t", 100)
    assert bounded_sample(df.limit(0), "t", 5) == []


def float_vectors(spark, n, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    x[10:40] = x[10]
    return x, spark.createDataFrame([(f"v{i:04d}", [float(t) for t in r]) for i, r in enumerate(x)], "id string, v array<float>")


def test_f1_neighbours_are_found_without_copies_of_rows(spark):
    _, df = float_vectors(spark, 100)
    lists = vectors.knn_lists(df, 5, block=16)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    one = {(r.a, r.b): r.weight for r in reduction.graph_of_lists(lists, 5).collect()}
    two = {(r.a, r.b): r.weight for r in reduction.fuzzy_graph(vectors.knn(df, 5), 5).collect()}
    assert one == two and len(one) > 250


@pytest.mark.parametrize("dims", [5, 2])
def test_f3_f9_the_layout_takes_any_number_of_rows(spark, dims):
    ids = spark.range(50_010).select(F.format_string("v%06d", "id").alias("id"))
    edges = spark.range(50_009).select(F.format_string("v%06d", "id").alias("a"), F.format_string("v%06d", F.col("id") + 1).alias("b"), F.lit(1.0).alias("weight"))
    rows = reduction.reduce(ids, edges, dims, 0.05, epochs=1).agg(F.count_distinct("id").alias("n"), F.min(F.size("position")).alias("d")).first()
    assert (rows.n, rows.d) == (50_010, dims)


def test_f6_reachability_of_lists_equals_that_of_pairs(spark):
    _, df = float_vectors(spark, 120)
    near = vectors.knn(df, 7)
    want = {(r.a, r.b): round(r.weight, 12) for r in vectors.mutual_reachability(near, vectors.core_distances(near, 4)).collect()}
    got = vectors.reachability_of_lists(vectors.knn_lists(df, 7, block=32), 4).collect()
    assert {(r.a, r.b): round(r.weight, 12) for r in got} == want and len(got) == len(want)


def test_f5_distant_blocks_are_not_paired(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([c + r.normal(size=(60, 2)) for c in ((0, 0), (100, 0), (0, 100), (100, 100), (5, 5))])
    x[7] = x[8] = x[9]
    df = spark.createDataFrame([(i, [float(t) for t in p]) for i, p in enumerate(x)], "num bigint, position array<double>")
    placed, _ = density._placed(df, len(x), 32)
    got = {q.num: q.core for q in density._cores(placed, 6).collect()}
    want = density.core(x, 6)
    assert np.allclose([got[i] for i in range(len(x))], want)
    weights = sorted(q.weight for q in density._tree(df, 6, 32).collect())
    assert np.allclose(weights, sorted(density.spanning_tree(x, want)[:, 2])) and len(weights) == len(x) - 1
    boxes = pd.DataFrame({"own": range(5), "lo0": [0.0, 1, 2, 3, 4], "hi0": [0.5, 1.5, 2.5, 3.5, 4.5], "least": [0.1] * 5, "some": [{"position": [i + 0.2], "core": 0.1} for i in range(5)]})
    assert density._pairs_needed(boxes, dict.fromkeys(range(5), 0.3)) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_f7_few_rows_look_beyond_their_block(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([*(c + r.normal(size=(200, 2)) for c in ((0, 0), (30, 0), (0, 30), (12, 12))), r.uniform(-10, 40, size=(80, 2))])
    df = spark.createDataFrame([(i, [float(t) for t in p]) for i, p in enumerate(x)], "num bigint, position array<double>")
    want = density.spanning_tree(x, density.core(x, 5))
    assert np.allclose(sorted(q.weight for q in density._tree(df, 5, 64).collect()), sorted(want[:, 2]))
    num, gaps = density._leaves(np.arange(len(x)), want[:, 0].astype(int), want[:, 1].astype(int), want[:, 2])
    place = np.argsort(num)
    paths = {(0, 0): 0.0}
    for a, b, w in want[:100]:  # grown from row 0
        paths[0, int(b)] = max(paths[0, int(a)], w)
    spans = density._Spans(gaps, place)
    assert all(spans.most(place[:1], place[b : b + 1])[0] == w for (_, b), w in paths.items())
    rows = density._cores(density._placed(df, len(x), 64)[0], 5)
    known = rows.join(spark.createDataFrame([(i, int(p)) for i, p in enumerate(place)], "num bigint, pos bigint"), "num").select("num", "position", "core", "pos", "own").cache()
    boxes = density._boxes(known, F.min("core").alias("least"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    sent = density._sent(known, boxes, gaps)
    assert sent.count() < 3 * len(x)  # the 70 pairs of blocks that were needed had 10 times the rows
    assert density._met(known, sent, gaps - 1e-9).count() == 0  # nothing is lighter than the tree, but for rounding
