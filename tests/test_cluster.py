"""Clusters against brute force, and independence of the partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.operators import cluster, components, textfeat
from logmill.plans import runs


def labels(df):
    return {r["row_id"]: r["cluster_id"] for r in df.collect()}


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def sized(roots, size):
    count = {r: roots.count(r) for r in roots}
    return {i: r if count[r] >= size else -1 for i, r in enumerate(roots)}


@pytest.mark.parametrize("partitions, piece", [(1, 1 << 20), (5, 40)])
def test_components(spark, monkeypatch, partitions, piece):
    monkeypatch.setattr(components, "PIECE", piece)
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(300, 360)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(partitions)
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    roots = union(361, pairs)
    assert got == {i: roots[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_templates(spark):
    rows = [(i, "x") for i in range(5)] + [(i, "y") for i in range(5, 9)]
    got = labels(cluster.template_clusters(spark.createDataFrame(rows, "row_id long, cleaned string")))
    assert got == {**{i: 0 for i in range(5)}, **{i: -1 for i in range(5, 9)}}


TEXTS = (
    [f"connection timeout database unreachable host {w}" for w in ("alpha", "alpha", "beta", "gamma", "alpha")]
    + [f"user login accepted session opened token {w}" for w in ("red", "red", "red", "blue", "green")]
    + ["stray words only", "other thing entirely", "final lonely remark"]
)


@pytest.mark.parametrize("eps, tile", [(0.0, 1024), (0.7, 1024), (0.7, 3), (1.1, 7)])
def test_lines_against_all_pairs(spark, monkeypatch, eps, tile):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(9)] + ["zz"] * 4
    texts = TEXTS + [" ".join(rng.choice(words, size=rng.integers(1, 8))) for _ in range(60)] + ["", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(3)
    plain = cluster.line_links
    monkeypatch.setattr(cluster, "line_links", lambda points, e: plain(points, e, tile))
    found = [(r["row_id"], r["term"], round(r["weight"], 9)) for r in textfeat.tfidf(rows).collect()]
    terms = sorted({t for _, t, _ in found})
    x = np.zeros((len(texts), len(terms)))
    for i, t, w in found:
        x[i, terms.index(t)] = w
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps + 1e-6
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near[i, j]]
    assert labels(cluster.density_clusters_lines(rows, eps)) == sized(union(len(texts), pairs), 5)


def test_tiles_hold_only_rests_long_enough(spark):
    """Rests shorter than the cosine are in no list, and blocks of short ones never meet."""
    rng = np.random.default_rng(6)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [" ".join(rng.choice(words, size=rng.integers(2, 9), replace=False)) for _ in range(900)]
    vectors = textfeat.tfidf_vectors(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"))
    points = vectors.select(F.col("row_id").alias("point"), "terms")
    least = 0.755
    rows = cluster.line_tiles(points, least, tile_rows=20).collect()
    assert all(r["norm"] >= least and abs(sum(w * w for w in r["weights"]) - r["norm"] ** 2) < 1e-9 for r in rows)
    tiles = {}
    for r in rows:
        tiles.setdefault((r["key"], r["lo"], r["hi"]), []).append(r["norm"])
    assert all(max(norms) ** 2 >= least for norms in tiles.values())
    shared = {}
    for r in points.collect():
        for t in r["terms"]:
            shared[t["term"]] = shared.get(t["term"], 0) + 1
    every = sum(n * n for n in shared.values())  # all lists of all terms
    assert sum(len(n) ** 2 for n in tiles.values()) < 0.7 * every


def test_lines_that_share_most_words(spark):
    common = " ".join(f"common{i}" for i in range(16))
    texts = [f"{common} one{k} two{k}" for k in range(2) for _ in range(3)]
    texts = [f"{t} " for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    assert set(labels(cluster.density_clusters_lines(rows)).values()) == {0}


def test_near_equal_lines_form_two_clusters(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    got = labels(cluster.density_clusters_lines(rows, 1.3))
    assert [got[i] for i in range(13)] == [0] * 5 + [5] * 5 + [-1] * 3


def test_few_lines_are_noise(spark):
    rows = spark.createDataFrame([(i, "same text") for i in range(4)], "row_id long, text string")
    assert set(labels(cluster.density_clusters_lines(rows)).values()) == {-1}


@pytest.mark.parametrize("tile_rows, partitions", [(1024, 2), (7, 8)])
def test_vectors_against_brute_force(spark, tile_rows, partitions):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.15, size=(25, 3)) for c in ((0, 0, 0), (1, 1, 0), (0, 2, 1))] + [rng.uniform(-3, 3, size=(30, 3))])
    x = np.vstack([x, x[:4], x[:4], [[9, 9, 9]] * 3])  # copies, and a cluster of copies only
    eps = 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>").repartition(partitions)
    near = np.linalg.norm(x[:, None] - x[None, :], axis=-1) <= eps
    pairs = [(int(a), int(b)) for a, b in zip(*np.where(near))]
    got = labels(cluster.density_clusters_vectors(df, eps, tile_rows=tile_rows))
    assert got == sized(union(len(x), pairs), 3)
    assert len(set(got.values())) > 3


def test_crowded_cells_are_cut_into_bounded_tiles(spark):
    """A third of all points in one spot, nearly equal: no task gets them all."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1e-4, size=(400, 2)), rng.uniform(-50, 50, size=(800, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point long, embedding array<double>")
    links = cluster.vector_links(df, 0.5, tile_rows=50).collect()
    assert len(links) < 400 * 30  # a forest per tile, not 80,000 pairs
    assert len({tuple(sorted((r["a"], r["b"]))) for r in links}) == len(links)


def compared(spark, clusters, tile_rows=16):
    """(tiles, pairs in them) of vectors in as many clusters, 12 points each."""
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 12))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = (centres[:, None, :] + rng.normal(0, 0.01, size=(clusters, 12, 12))).reshape(-1, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point long, embedding array<double>")
    tiles, _ = cluster.vector_tiles(df, 0.1, tile_rows)
    sizes = [r["n"] for r in tiles.groupBy("cell", "lo", "hi").count().withColumnRenamed("count", "n").collect()]
    return len(sizes), sum(n * n for n in sizes)


def test_compared_pairs_grow_with_the_points_not_with_their_square(spark):
    few, many = compared(spark, 40), compared(spark, 160)
    assert many[1] < 4 * 1.6 * few[1]  # four times the points over four times the clusters
    assert many[1] < (160 * 12) ** 2 / 8


@pytest.mark.parametrize("fan", [2, 5])
def test_split_cells_against_brute_force(spark, fan):
    """Unit vectors, a dense ball, a chain across cells and far outliers, split over levels."""
    rng = np.random.default_rng(fan)
    unit = rng.normal(size=(150, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ball = unit[0] + rng.normal(0, 0.002, size=(90, 6))
    chain = np.array([[0.19 * i, 0, 0, 0, 0, 3] for i in range(60)])
    ring = unit[1] + 0.2 * unit[rng.permutation(150)[:40]]
    x = np.vstack([unit, ball, chain, ring, 1e4 * unit[:5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>").repartition(4)
    square = (x * x).sum(axis=1)
    near = square[:, None] + square[None, :] - 2 * (x @ x.T) <= 0.2 * 0.2
    pairs = [(int(a), int(b)) for a, b in zip(*np.where(near))]
    links = cluster.vector_links(df.withColumnRenamed("row_id", "point"), 0.2, tile_rows=6, fan=fan).collect()
    assert union(len(x), [(r["a"], r["b"]) for r in links]) == union(len(x), pairs)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "row_id long, embedding array<double>")
    assert cluster.density_clusters_vectors(df, 0.5).count() == 0


def test_top_terms_label_and_majority(spark):
    weights = spark.createDataFrame([(1, "cpu", 1.0), (2, "cpu", 0.5), (2, "login", 0.5), (3, "rapid", 1.0), (4, "x", 1.0)], "row_id long, term string, weight double")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, -1)], "row_id long, cluster_id long")
    top = cluster.cluster_top_terms(weights, clusters)
    got = {(r["cluster_id"], r["rank"]): (r["term"], r["mean_weight"]) for r in top.collect()}
    assert got == {(1, 1): ("cpu", 0.75), (1, 2): ("login", 0.25), (3, 1): ("rapid", 1.0)}
    named = {r["cluster_id"]: r["category"] for r in cluster.cluster_label(clusters, top).collect()}
    assert named == {1: "system_log", 3: "app_log", -1: "unstructured_log"}
    lines = spark.createDataFrame([("f", c) for c in ("system_log", "app_log") * 2] + [("g", "b")], "file_id string, category string")
    assert {r["file_id"]: r["category"] for r in cluster.majority_category(lines).collect()} == {"f": "app_log", "g": "b"}


def test_small_run(spark):
    texts = [f"2024-01-01 disk cpu kernel panic node {i}" for i in range(6)] + ["lonely remark"]
    rows = spark.createDataFrame([(i, "a.log", t) for i, t in enumerate(texts)], "row_id long, file_id string, line string")
    (row,) = runs.small_run(rows).collect()
    assert (row["stored_filename"], row["category"], row["cluster_id"]) == ("a.log", "system_log", "Line-Level")


def test_large_run_updates(spark):
    rows = [(i, f"f{i}.log", "kernel boot disk\nservice cpu\n" * 3) for i in range(1, 4)] + [(9, "g.log", "quarterly figures")]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    report = {r["file_name"]: r for r in runs.large_run(docs).collect()}
    assert {report[f"f{i}.log"]["cluster_id"] for i in (1, 2, 3)} == {1}
    assert (report["f1.log"]["category"], report["g.log"]["cluster_id"]) == ("system_log", -1)
    assert report["f1.log"]["final_path"] == "processed/system_log/f1.log"
    updates = runs.large_run_updates(runs.large_run(docs)).columns
    assert updates == ["stored_filename", "category", "final_path", "cluster_id", "summary", "update_no"]


def test_domains_are_complete():
    assert set(dims.DOMAIN_KEYWORDS) < set(dims.LOG_CATEGORIES)


def test_label_of_links_is_order_free(spark):
    df = spark.createDataFrame([(3, 1), (1, 2), (5, 5)], "a long, b long")
    got = components.connected_components(df.orderBy(F.rand())).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("tight", [False, True])
def test_vectors_that_no_index_parts_are_not_copied_to_every_tile(spark, tight):
    """Unit vectors all about as far from each other, or a crowd within eps with visitors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    eps = 0.85
    if tight:
        x, eps = np.vstack([x[0] + 0.01 * x[:300], x[0] + 0.6 * x[300:400], 5 * x[400:]]), 0.6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point long, embedding array<double>").repartition(3)
    square = (x * x).sum(axis=1)
    near = square[:, None] + square[None, :] - 2 * (x @ x.T) <= eps * eps
    tiles, _ = cluster.vector_tiles(df, eps, tile_rows=8)
    assert tiles.count() < 8 * len(x)
    links = [(r["a"], r["b"]) for r in cluster.vector_links(df, eps, tile_rows=8).collect()]
    assert union(len(x), links) == union(len(x), [(int(a), int(b)) for a, b in zip(*np.where(near))])
    assert len(set(union(len(x), links))) > 3


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e-3, 1e20, 1e-20])
def test_close_vectors_at_the_edge_of_eps(scale):
    """Distances a little below, at and above eps, which single precision does not tell apart."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    step = rng.normal(size=(300, 5))
    step /= np.linalg.norm(step, axis=1)[:, None]
    y = x + step * (0.5 * (1 + rng.choice([-1e-9, 1e-9], size=300)))[:, None]
    x, y = x * scale, y * scale
    got = {(int(i), int(j)) for a, b in cluster._close(x, y, 0.5 * scale) for i, j in zip(a, b)}
    far = np.linalg.norm(x[:, None] - y[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.where(far <= 0.5 * scale))}


def test_lines_are_cleaned_once(spark, sf_dir):
    """What the steps of the template clustering read is written, not rendered and cleaned anew."""
    from logmill.plans import queries

    rows, labels = queries._template_labels(spark, sf_dir)
    for df in (rows, labels, queries._clustered(spark, sf_dir)):
        assert "regexp_replace" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_lists_are_copied_to_few_blocks(spark):
    """A list of 3,000 rests met in blocks of 1,024 rows would be sent three times over."""
    rng = np.random.default_rng(11)
    rows = [(i, [("aa", 0.8), ("bb", float(w)), ("cc", float((0.36 - w * w) ** 0.5))]) for i, w in enumerate(rng.uniform(0.01, 0.59, 3000))]
    points = spark.createDataFrame(rows, "point long, terms array<struct<term:string,weight:double>>")
    tiles = cluster.line_tiles(points, 0.755)
    assert tiles.groupBy("key", "point").count().where("count > 1").isEmpty()
    links = [(r["a"], r["b"]) for r in cluster.line_links(points, 0.7).collect()]
    assert len(links) < 2 * 3000 and set(union(3000, links)) == {0}


@pytest.mark.parametrize("fold, two", [(4, False), (64, False), (8, True)])
def test_sets_of_a_list_against_all_products(monkeypatch, fold, two):
    """Short and long vectors, many strips, folded terms that fall together, one side or two."""
    for name, value in (("STRIP_ROWS", 16), ("CELLS", 1 << 11), ("FOLD", fold), ("SLICE_ROWS", 50)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(12)
    x = np.zeros((400, 30))
    for row in x:
        row[rng.choice(30, size=rng.integers(1, 13), replace=False)] = 1
    x *= rng.uniform(0.5, 2, size=x.shape)
    x[300:350] = x[200:250] * rng.uniform(0.8, 1.2, size=(50, 30))  # near copies of long ones
    x *= (rng.uniform(0.76, 1, size=400) / np.linalg.norm(x, axis=1))[:, None]
    side = (rng.random(400) < 0.3) if two else np.zeros(400, bool)
    row, column = np.nonzero(x)
    start = np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))])
    root = cluster._connected(start, column, x[row, column], side, 0.72)
    near = (x @ x.T >= 0.72) & ((side[:, None] != side[None]) | (not two))
    pairs = [(int(a), int(b)) for a, b in zip(*np.where(near))]
    assert root.tolist() == union(400, pairs)
    assert len(set(root.tolist())) > 20


def test_lists_of_many_thousands_are_not_copied(spark):
    """A list of 9,000 rests was cut into two blocks, and each row was sent twice."""
    weights = np.random.default_rng(13).uniform(0.01, 0.59, 9000)
    rows = [(i, [("aa", 0.8), ("bb", float(w)), ("cc", float((0.36 - w * w) ** 0.5))]) for i, w in enumerate(weights)]
    points = spark.createDataFrame(rows, "point long, terms array<struct<term:string,weight:double>>")
    tiles = cluster.line_tiles(points, 0.755)
    assert tiles.groupBy("key", "point").count().where("count > 1").isEmpty()
