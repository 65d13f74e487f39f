"""Operators against small fixtures worked out by hand or by brute force."""

import collections
import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.config import ENCODERS
from orrery.operators import (
    categories, clusters, density, embed, explore, graphs, items, layout, members, neighbours, numbers, positions, ratings,
    relate, spanning, taxonomy,
)
from orrery.sources import views

INTERACTIONS = "recipe_id long, user_id long, date date, rating int"


def test_month_spine_shows_empty_months(spark):
    rows = [(1, 1, dt.date(2020, 1, 5), 4), (1, 2, dt.date(2020, 3, 1), 2), (1, 3, None, 5)]
    found = ratings.monthly(spark.createDataFrame(rows, INTERACTIONS)).orderBy("month_end").collect()
    assert [tuple(row) for row in found] == [
        (dt.date(2020, 1, 31), 1, 4.0), (dt.date(2020, 2, 29), 0, None), (dt.date(2020, 3, 31), 1, 2.0)]


def test_lifecycle_of_one_year(spark):
    rows = [(1, user, dt.date(2020, 1, 1), rating) for user, rating in enumerate((0, 5, 5, 4))]
    row = ratings.lifecycle(spark.createDataFrame(rows, INTERACTIONS)).first()
    assert (row["n"], row["users"], row["avg_with"], row["avg_without"], row["pct5"], row["n_zeros"]) == (
        4, 4, 3.5, 4.6667, 50.0, 1)


def test_summary_invariants(spark, folder):
    found = ratings.summary_documents(views.recipes(spark, folder), views.interactions(spark, folder)).collect()
    assert any(row["empty"] for row in found)
    for row in found:
        if row["empty"]:
            assert row["n_reviews"] is None and row["n_per_year"] is None
            continue
        assert sum(row[f"count_{s}"] for s in ratings.STARS) == row["n_ratings"]
        assert sum((row["n_per_year"] or {}).values()) == row["n_dated"] <= row["n_reviews"]
        assert row["n_ratings"] + row["count_no_rating"] == row["n_reviews"]


def _hot_rows():
    source = random.Random(3)
    rows = [(0, source.randrange(10**6)) for _ in range(3000)]
    return rows + [(source.randrange(1, 400), source.randrange(10**6)) for _ in range(3000)]


def test_position_is_the_sorted_place(spark):
    rows = _hot_rows()
    placed = positions.with_position(spark.createDataFrame(rows, "g long, v long"), ["g", "v"]).collect()
    ordered = sorted(rows)
    assert sorted(row["position"] for row in placed) == list(range(len(rows)))
    assert all(ordered[row["position"]] == (row["g"], row["v"]) for row in placed)


def test_rank_in_a_group_that_spans_partitions(spark):
    rows = _hot_rows()
    spread = spark.createDataFrame(rows, "g long, v long").repartition(8)
    ranked = positions.with_rank_in_group(spread, ["g"], ["v"]).collect()
    expected = collections.defaultdict(list)
    for group, value in rows:
        expected[group].append(value)
    found = collections.defaultdict(dict)
    for row in ranked:
        assert row["position"] not in found[row["g"]]
        found[row["g"]][row["position"]] = row["v"]
    for group, held in expected.items():
        assert [found[group][i] for i in range(len(held))] == sorted(held)


def test_systematic_sample_positions(spark):
    frame = spark.createDataFrame([(i,) for i in range(7)], "id long")
    assert sorted(row["id"] for row in explore.systematic_sample(frame, ["id"], 3).collect()) == [0, 2, 4]
    assert explore.systematic_sample(frame, ["id"], 10).count() == 7


def test_samples_are_repeatable(spark):
    frame = spark.range(1000)
    first = {row["id"] for row in explore.sample(frame, 50, seed=1).collect()}
    assert first == {row["id"] for row in explore.sample(frame.repartition(7), 50, seed=1).collect()}
    assert len(first) == 50 and first != {row["id"] for row in explore.sample(frame, 50, seed=2).collect()}


def test_pairs_of_repeated_items_multiply(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "b")]
    frame = spark.createDataFrame(rows, "id long, ingredient string")
    listed = frame.select("ingredient").distinct()
    as_list = {(r["a"], r["b"]): r["n"] for r in items.pair_counts(frame, listed, "ingredient", as_set=False).collect()}
    as_set = {(r["a"], r["b"]): r["n"] for r in items.pair_counts(frame, listed, "ingredient").collect()}
    assert as_list[("a", "b")] == as_list[("b", "a")] == 3 and as_set[("a", "b")] == 2 and as_set[("a", "c")] == 1


def test_taxonomy_of_nested_tags(spark, folder):
    tags = views.recipe_tags(spark, folder)
    edges = taxonomy.immediate_parents(taxonomy.qualifying_pairs(tags, ("wide", "mid", "tiny")))
    assert {(r["child"], r["parent"]) for r in edges.collect()} == {("tiny", "mid"), ("mid", "wide")}
    above = {tuple(r) for r in taxonomy.closure(edges).select("child", "ancestor").collect()}
    assert above == {("tiny", "mid"), ("tiny", "wide"), ("mid", "wide")}
    exclusive = {r["tag"] for r in taxonomy.exclusive_tags(tags, "wide", 1).collect()}
    assert exclusive == {"mid", "tiny"}
    labels = taxonomy.training_labels(tags, ("wide", "mid", "tiny", "economy"), taxonomy.closure(edges))
    assert labels.filter("status = 'ambiguous'").count() > 0
    assert labels.filter("status = 'labelled' AND label IS NULL").count() == 0


def test_children_need_a_larger_parent(spark):
    rows = [(i, t) for i in range(10) for t in ("a", "b")]
    frame = spark.createDataFrame(rows, "id long, tag string")
    assert taxonomy.qualifying_pairs(frame, ("a", "b")).count() == 0


def _vectors(spark, count, dims=8, seed=0, copies=0):
    source = np.random.default_rng(seed)
    rows = source.normal(size=(count, dims))
    rows = np.concatenate([rows, np.repeat(rows[:1], copies, axis=0)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "id long, embedding array<double>")
    return rows, frame


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 17}])
def test_neighbours_against_brute_force(spark, sizes):
    rows, frame = _vectors(spark, 120, copies=15)
    found = collections.defaultdict(list)
    for row in neighbours.nearest(frame, frame, 7, skip_self=True, **sizes).collect():
        found[row["query_id"]].append((row["rank"], row["neighbour_id"]))
    distance = np.round(1.0 - rows @ rows.T, 12)
    for query in range(len(rows)):
        order = sorted((distance[query, i], i) for i in range(len(rows)) if i != query)[:7]
        assert [n for _, n in sorted(found[query])] == [i for _, i in order]


def test_fewer_training_rows_than_k(spark):
    _, frame = _vectors(spark, 4)
    assert neighbours.nearest(frame, frame, 10, skip_self=True).count() == 12
    assert neighbours.nearest(frame, frame, 10).count() == 16


def test_zero_distance_takes_the_vote(spark):
    rows = [(1, "x", 0.0), (1, "y", 0.5), (2, "x", 0.25), (2, "y", 0.5)]
    frame = spark.createDataFrame(rows, "query_id long, label string, distance double")
    shares = {(r["query_id"], r["label"]): r["p"] for r in neighbours.votes(frame).collect()}
    assert shares[(1, "x")] == 1.0 and shares[(1, "y")] == 0.0
    assert shares[(2, "x")] == pytest.approx(2 / 3)
    floored = {(r["query_id"], r["label"]): r["p"] for r in neighbours.votes(frame, True).collect()}
    assert 0.999 < floored[(1, "x")] < 1.0


def test_assignment_probabilities(spark):
    rows, frame = _vectors(spark, 60, seed=4)
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id long, label string")
    found = neighbours.assign(frame, labels, 9, min_score=0.6).collect()
    assert len(found) == 60
    for row in found:
        assert sum(row["proba"]) == pytest.approx(1.0)
        assert (row["category"] is not None) == (max(row["proba"]) >= 0.6)
        assert len(row["runners_up"]) == 1


@pytest.mark.parametrize("nodes, pairs", [
    (6, [(1, 2), (2, 3), (5, 6)]),
    (50, [(i, i + 1) for i in range(1, 49)]),
    (80, [(1, i) for i in range(2, 60)] + [(70, 71)]),
])
def test_components_against_union_find(spark, nodes, pairs):
    parent = list(range(nodes + 1))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    frame = spark.createDataFrame([(i,) for i in range(1, nodes + 1)], "id long")
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r["id"]: r["component"] for r in graphs.connected_components(frame, edges).collect()}
    assert found == {i: root(i) for i in range(1, nodes + 1)}


def test_components_without_edges(spark):
    frame = spark.createDataFrame([(1,), (2,)], "id long")
    none = spark.createDataFrame([], "a long, b long")
    assert {tuple(r) for r in graphs.connected_components(frame, none).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 20}])
def test_similar_edges_and_copies_hold_every_pair(spark, sizes):
    rows, frame = _vectors(spark, 60, dims=3, copies=10)
    edges = graphs.similar_edges(frame, 0.9, **sizes)
    found = [(r["a"], r["b"]) for r in graphs.all_pairs(edges, graphs.representatives(frame)).collect()]
    every = [r["embedding"] for r in sorted(frame.collect(), key=lambda r: r["id"])]
    similarity = np.array(every) @ np.array(every).T
    expected = {(i, j) for i, j in itertools.combinations(range(70), 2) if similarity[i, j] >= 0.9 - 1e-12}
    assert len(found) == len(set(found)) and set(found) == expected


def test_priors_count_labels_with_a_vector_only(spark):
    points = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(6)], "id long, embedding array<double>")
    labels = [(i, "x" if i < 2 else "y") for i in range(5)]
    more = labels + [(100 + i, "x") for i in range(5)]
    rows = [
        {r["id"]: (r["category"], r["score"]) for r in neighbours.assign(points, spark.createDataFrame(t, "id long, label string"), 3).collect()}
        for t in (labels, more)]
    assert rows[0] == rows[1]


def test_sketched_percentiles_weigh_repeated_values(spark):
    frame = spark.createDataFrame([(1.0,)] * 98 + [(50.0,), (100.0,)], "v double")
    row = numbers.describe(frame, "v", accuracy=10_000).first()
    assert row["p50"] == 1.0


def test_a_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        taxonomy.closure(edges)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 40}])
def test_linking_edges_have_the_components_of_all_pairs(spark, sizes):
    source = np.random.default_rng(9)
    crowd = source.normal(size=(1, 6)) + source.normal(scale=0.05, size=(150, 6))
    rows = np.concatenate([crowd, source.normal(size=(80, 6)), crowd[:5]])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "id long, embedding array<double>")
    edges = graphs.linking_edges(frame, 0.9, pivots=20, **sizes)
    assert edges.count() < 600  # the crowd alone has over 11000 similar pairs
    found = {r["id"]: r["component"] for r in graphs.connected_components(frame, edges).collect()}
    close = rows @ rows.T >= 0.9
    expected = {}
    for start in range(len(rows)):
        if start not in expected:
            stack, expected[start] = [start], start
            while stack:
                for near in np.nonzero(close[stack.pop()])[0]:
                    if near not in expected:
                        expected[near] = start
                        stack.append(near)
    assert found == expected


def test_merged_groups_keep_noise_aside(spark):
    rows = [(-1, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.99, 0.141]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert {(r["id"], r["group"]) for r in clusters.merged_groups(frame).collect()} == {(-1, -1), (0, 0), (1, 0), (2, 1)}


def _brute_dbscan(points, eps, min_samples, min_size):
    distance = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    close = distance <= eps
    core = close.sum(1) >= min_samples
    label = np.full(len(points), -1)
    for start in range(len(points)):
        if not core[start] or label[start] >= 0:
            continue
        stack, label[start] = [start], start
        while stack:
            for near in np.nonzero(close[stack.pop()] & core)[0]:
                if label[near] < 0:
                    label[near] = start
                    stack.append(near)
    for name in set(label[label >= 0]):
        if (label == name).sum() < min_size:
            label[label == name] = -1
    return label


@pytest.mark.parametrize("seed, budget", [(1, density.PAIR_BUDGET), (2, 0)])
def test_dbscan_against_brute_force(spark, seed, budget, monkeypatch):
    monkeypatch.setattr(density, "MAX_LEVEL", 2)
    source = np.random.default_rng(seed)
    blobs = [source.normal(centre, 0.15, size=(60, 3)) for centre in ((0, 0, 0), (1, 1, 0), (-1, 0.5, 1))]
    points = np.concatenate([*blobs, source.uniform(-2, 2, size=(60, 3)), np.tile([[1.9, 1.9, 1.9]], (40, 1))])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    found = {r["id"]: r["cluster"] for r in density.dbscan(frame, 0.3, 5, 8, pair_budget=budget).collect()}
    expected = _brute_dbscan(points, 0.3, 5, 8)
    pairs = {(found[i], int(expected[i])) for i in range(len(points))}
    assert len(found) == len(points)
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert all((a == -1) == (b == -1) for a, b in pairs)


def test_auto_sizes():
    assert density.auto_sizes(231_637) == (463, 50) and density.auto_sizes(100) == (10, 5)


def test_byte_chunks_close_before_the_limit(spark):
    rows = list(enumerate((6, 4, 1, 20, 3)))
    frame = spark.createDataFrame(rows, "id long, size long")
    found = layout.byte_chunks(frame, ["id"], "size", limit=10).orderBy("id").collect()
    assert [row["chunk"] for row in found] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("range_chunks", [2, 1000])
def test_byte_chunks_do_not_depend_on_partitions(spark, range_chunks):
    source = random.Random(range_chunks)
    rows = [(i, source.choice([0, 1, 5, 30, 90, 250]), "kept") for i in range(400)]
    expected, start, last, chunk, used, rows_in = [], 0, None, 0, 0, 0
    for i, size, _ in rows:
        own = start // (100 * range_chunks)
        if own != last:
            last, chunk, used, rows_in = own, 0, 0, 0
        elif used + size > 100 and rows_in:
            chunk, used, rows_in = chunk + 1, 0, 0
        used, rows_in, start = used + size, rows_in + 1, start + size
        expected.append((i, own, chunk))
    for parts in (1, 4, 37):
        frame = spark.createDataFrame(rows, "id long, size long, `range ` string").repartition(parts)
        found = layout.byte_chunks(frame, ["id"], "size", limit=100, range_chunks=range_chunks).orderBy("id").collect()
        assert [(r["id"], r["range"], r["chunk"]) for r in found] == expected
    nulls = spark.createDataFrame([(1, None), (2, 5)], "id long, size long")
    assert sorted((r["id"], r["size"], r["chunk"]) for r in layout.byte_chunks(nulls, ["id"], "size").collect()) == [(1, None, 0), (2, 5, 0)]
    assert layout.byte_chunks(nulls.limit(0), ["id"], "size").count() == 0


def test_chunks_are_full_but_the_last(spark, folder):
    sizes = collections.Counter(
        row["chunk_id"] for row in layout.z_ordered(views.points(spark, folder), 64).select("chunk_id").collect())
    assert set(list(sizes.values())[:-1]) <= {64} or sorted(sizes.values())[1:] == [64] * (len(sizes) - 1)


def test_exploration_table_keeps_every_point(spark, folder):
    points = views.points(spark, folder)
    records = views.recipes(spark, folder).join(ratings.contrib(views.interactions(spark, folder)), "id", "left")
    wide = layout.exploration_table(
        points, categories.assign_bins(records, ENCODERS), ["minutes"], views.recipes(spark, folder).select("id", "name"),
        ratings.contrib(views.interactions(spark, folder)))
    assert wide.count() == points.count() == wide.select("id").distinct().count()


def test_projection_signs_and_widths(spark, folder):
    vectors = views.embeddings(spark, folder).select("id", F.col("embedding").alias("vector"))
    placed = layout.project(vectors, 2)
    assert placed.columns == ["id", "x", "y"] and placed.count() == vectors.count()
    spread = placed.agg(F.var_pop("x").alias("x"), F.var_pop("y").alias("y")).first()
    assert spread["x"] >= spread["y"] > 0


def test_describe_matches_numpy(spark):
    values = [float(v) for v in (1, 2, 2, 3, 10, 50, 200, 1000)]
    row = numbers.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v", cap=100).first()
    assert row["p25"] == pytest.approx(np.percentile(values, 25)) and row["p99"] == pytest.approx(np.percentile(values, 99))
    assert row["std"] == pytest.approx(np.std(values)) and (row["n_above"], row["pct_above"]) == (2, 25.0)
    close = numbers.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v", accuracy=10_000).first()
    assert close["p50"] in values


def test_quantiles_from_sorted_ranges(spark):
    source = random.Random(5)
    values = [round(source.expovariate(0.01), 2) for _ in range(3000)] + [7.0] * 2000
    counted = numbers.value_counts(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    percents = (0, 1, 25, 50, 66.6, 99, 100)
    wanted = [pytest.approx(np.percentile(values, p)) for p in percents]
    assert list(numbers.quantiles(counted, percents).first()) == wanted
    assert list(numbers.quantiles(counted.limit(0), percents).first()) == [None] * 7


def test_values_at_ranks_of_uneven_ranges(spark):
    values = sorted([0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-52, 3.0, 3.0, 1e18, 1e300, -1e300, -7.0] * 3)
    counted = numbers.value_counts(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    assert numbers.at_ranks(counted, range(len(values))) == dict(enumerate(values))
    whole = [2**60 - 1, 2**60 - 2, 2**60 - 3, 0, 1, 2**53 + 1, 2**53]
    counted = spark.createDataFrame([(v, 2) for v in whole], "v long, n long")
    assert numbers.at_ranks(counted, range(14)) == dict(enumerate(sorted(whole * 2)))


def test_large_samples_and_repeated_keys(spark):
    frame = spark.range(500).repartition(6)
    for count in (0, 1, 250, 499, 500, 900):
        rows = explore.sample(frame, count, seed=3)
        assert rows.count() == min(count, 500) == rows.distinct().count()
    equal = spark.createDataFrame([(None, i) for i in range(9)] + [(1, 0)], "id long, v int")
    assert explore.sample(equal, 4, seed=1).count() == 4


def test_histogram_bins(spark):
    frame = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9, 10, 10)], "v double")
    assert [r["n"] for r in numbers.histogram(frame, "v", 5).orderBy("bin").collect()] == [2, 0, 1, 0, 3]
    clipped = numbers.histogram(frame, "v", 2, cap=4).orderBy("bin").collect()
    assert [r["n"] for r in clipped] == [2, 4]


def test_merge_keeps_earlier_values_a_later_table_lacks(spark):
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    later = spark.createDataFrame([(1, None, 9.5), (3, "c", 3.5)], "id long, name string, score double")
    found = {r["id"]: (r["name"], r["n"], r["score"]) for r in relate.merge_contribs([first, later]).collect()}
    assert found == {1: ("a", 1, 9.5), 2: ("b", 2, None), 3: ("c", None, 3.5)}


def test_zero_fill_lists_empty_classes(spark):
    classes = categories.class_table(spark, {"f": ("a", "b")})
    frame = spark.createDataFrame([(1, "f", "a"), (2, "f", None)], "id long, family string, category string")
    assert {(r["label"], r["n"]) for r in categories.facet(frame, classes, "f").collect()} == {("a", 1), ("b", 0)}


def test_names_are_filled(spark):
    frame = spark.createDataFrame([(-1,), (0,), (1,)], "cluster int")
    names = spark.createDataFrame([(1, "rings")], "cluster int, name string")
    assert {tuple(r) for r in clusters.filled_names(frame, names).collect()} == {
        (-1, "Unclustered"), (0, "Cluster 0"), (1, "rings")}


def test_meta_groups_of_similar_names(spark):
    rows = [(-1, "Unclustered"), (3, "red ring"), (4, "blue pan"), (7, "ring red"), (9, "green leaf"), (12, "leaf green")]
    names = spark.createDataFrame(rows, "cluster int, name string")
    grouped = clusters.meta_groups(names, 0.9)
    assert {tuple(r) for r in grouped.collect()} == {(0, 3), (0, 7), (1, 9), (1, 12), (-1, 4)}
    named = {tuple(r) for r in clusters.group_names(grouped, names).collect()}
    assert named == {(0, "red ring", 2), (1, "green leaf", 2), (-1, "Ungrouped", 1)}


def test_distinctive_terms(spark):
    rows = [(0, "red ring and red bolt"), (1, "blue pan and blue pot"), (-1, "noise noise")]
    found = {r["cluster"]: r["name"] for r in clusters.distinctive_terms(spark.createDataFrame(rows, "cluster int, text string"), 2).collect()}
    assert found == {0: "red bolt", 1: "blue pan"}


def test_embedding_is_unit_and_repeatable(spark):
    frame = spark.createDataFrame([(1, "a b b"), (2, "b a b"), (3, ""), (4, None)], "id long, text string")
    found = {r["id"]: np.array(r["embedding"]) for r in embed.embed_text(frame, 32).collect()}
    assert np.allclose(found[1], found[2]) and np.linalg.norm(found[1]) == pytest.approx(1.0, abs=1e-6)
    assert not found[3].any() and not found[4].any()


def test_own_encoder_is_loaded_in_the_worker(spark):
    def load():
        return lambda texts: np.array([[len(text), 1.0] for text in texts])

    frame = spark.createDataFrame([(i, "x" * i) for i in range(600)], "id long, text string")
    found = {r["id"]: r["embedding"] for r in embed.embed_with(frame, load, batch_size=7).collect()}
    assert len(found) == 600 and found[3] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_visible_points(spark):
    rows = [(0, 0.5), (0, -1.0), (1, 0.9), (-1, 0.5)]
    row = explore.visible_stats(spark.createDataFrame(rows, "cluster int, rating double"), 0.4, 0.6).first()
    assert tuple(row) == (4, 3, 2, 1)


def test_sim_edges_lists_the_links_of_copies(spark, tmp_path):
    from orrery.plans import similarity

    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.9, 0.1], 2), (5, [1.0, 0.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((r["kind"], r["a"], r["b"]) for r in similarity.sim_edges(spark, str(tmp_path)).collect())
    assert found == [("member", 1, 1), ("member", 1, 2), ("member", 1, 5), ("member", 3, 3), ("pair", 1, 3)]


def test_sim_edges_lists_every_pair_of_copies(spark, tmp_path):
    from compare import compare
    from orrery.plans.catalogue import QUERIES, SQL

    hot, near, apart = [1.0, 0.0], [0.9, 0.1], [-1.0, 0.0]
    rows = pd.DataFrame({"vec_id": range(1, 7), "embedding": [hot, hot, near, near, hot, apart], "label": 0})
    rows.to_parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((r["a"], r["b"]) for r in QUERIES["sim_edges"](spark, str(tmp_path)).collect())
    assert found == list(itertools.combinations(range(1, 6), 2))
    assert compare(spark, str(tmp_path), QUERIES["sim_edges"], SQL["sim_edges"]) is None


def _clustered(spark, groups=12, each=60, dims=16, odd=()):
    source = np.random.default_rng(11)
    centres = source.normal(size=(groups, dims))
    rows = np.repeat(centres, each, axis=0) + source.normal(scale=0.05, size=(groups * each, dims))
    rows = np.concatenate([rows, *[np.array([row]) for row in odd]]) if odd else rows
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "id long, embedding array<double>")
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(norms, 1e-9), frame


def test_bounds_leave_most_cells_out(spark):
    _, frame = _clustered(spark)
    visited = neighbours.visited_cells(frame, frame, 10, skip_self=True, block_rows=60).collect()
    assert len(visited) == 720
    met = sum(r["first"] + r["rest"] for r in visited)
    assert met < 0.5 * sum(r["cells"] for r in visited)


def test_searches_over_cells_with_copies_and_vectors_without_direction(spark):
    zero, hot = [0.0] * 16, [1.0] + [0.0] * 15
    rows, frame = _clustered(spark, groups=5, each=15, odd=[zero, zero, *[hot] * 40])
    found = collections.defaultdict(list)
    for row in neighbours.nearest(frame, frame, 6, skip_self=True, broadcast_bytes=0, block_rows=9).collect():
        found[row["query_id"]].append((row["rank"], row["neighbour_id"]))
    distance = np.round(1.0 - rows @ rows.T, 12)
    for query in range(len(rows)):
        order = sorted((distance[query, i], i) for i in range(len(rows)) if i != query)[:6]
        assert [n for _, n in sorted(found[query])] == [i for _, i in order]
    for threshold in (0.95, 0.2, -0.1):
        edges = graphs.similar_edges(frame, threshold, broadcast_bytes=0, block_rows=9)
        pairs = {(r["a"], r["b"]) for r in graphs.all_pairs(edges, graphs.representatives(frame)).collect()}
        close = np.round(rows @ rows.T, 12) >= threshold
        wanted = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if close[i, j]}
        # copies of a vector without direction are pairs, whatever their cosine
        assert pairs == wanted | {(75, 76)}


def test_copies_grow_in_proportion(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(300)], "id long, embedding array<double>")
    edges = graphs.similar_edges(frame, 0.5, broadcast_bytes=0, block_rows=10)
    assert edges.count() <= 3 and graphs.representatives(frame).count() == 300
    assert {r["representative"] for r in graphs.representatives(frame).collect()} == {0, 1, 2}


def test_straight_neighbours_over_cells(spark):
    source = np.random.default_rng(21)
    rows = np.concatenate([source.normal(scale=30, size=(90, 2)), np.zeros((5, 2)), np.full((20, 2), 7.5)])
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "id long, embedding array<double>")
    distance = np.round(np.sqrt(np.square(rows[:, None] - rows[None]).sum(axis=2)), 12)
    for sizes in ({}, {"broadcast_bytes": 0, "block_rows": 8}):
        found = collections.defaultdict(list)
        for row in neighbours.nearest(frame, frame, 5, skip_self=True, straight=True, **sizes).collect():
            found[row["query_id"]].append((row["rank"], row["neighbour_id"]))
        for query in range(len(rows)):
            order = sorted((distance[query, i], i) for i in range(len(rows)) if i != query)[:5]
            assert [n for _, n in sorted(found[query])] == [i for _, i in order]


def test_spanning_forest_against_kruskal(spark):
    source = random.Random(8)
    pairs = {tuple(sorted(source.sample(range(90), 2))) for _ in range(260)} | {(200, 201)}
    edges = sorted((source.choice([0.5, 1.0, 1.0, 2.0, source.random()]), a, b) for a, b in pairs)
    parent = {n: n for pair in pairs for n in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    expected = set()
    for weight, a, b in edges:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            expected.add((a, b, weight))
    frame = spark.createDataFrame([(a, b, w) for w, a, b in edges] + [(5, 5, 0.0)], "a long, b long, weight double")
    found = [tuple(r) for r in spanning.spanning_forest(frame).collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert spanning.spanning_forest(frame.limit(0)).count() == 0


def test_clusters_of_a_forest(spark):
    table = [(i, j, r + 1, abs(float(i - j))) for i in (0, 1, 2, 10, 11, 12, 50)
             for r, j in enumerate(sorted({0, 1, 2, 10, 11, 12, 50} - {i}, key=lambda j: (abs(i - j), j))[:3])]
    frame = spark.createDataFrame(table, "id long, neighbour long, rank int, distance double")
    forest = spanning.spanning_forest(spanning.reachability(frame, 3))
    points = frame.select("id").distinct()
    levels = collections.defaultdict(dict)
    for row in spanning.clusters_by_level(points, forest, [2.0, 1.0, 9.0, 40.0], 2).collect():
        levels[row["level"]][row["id"]] = row["cluster"]
    assert set(levels[0].values()) == {-1}
    assert levels[1] == {0: 0, 1: 0, 2: 0, 10: 1, 11: 1, 12: 1, 50: -1}
    assert levels[2] == {0: 0, 1: 0, 2: 0, 10: 0, 11: 0, 12: 0, 50: -1}
    assert set(levels[3].values()) == {0}


def test_members_by_bitmaps(spark):
    source = random.Random(12)
    every = [0, -1, -32_768, -32_769, 1, 32_768, 32_769, 5 * 10**9, *source.sample(range(-10**5, 10**5), 400)]
    rows = [(i, f, source.choice(labels)) for i in every for f, labels in (("a", "xyz"), ("b", "pq"), ("c", "m"))
            if f != "b" or source.random() < 0.8]
    frame = spark.createDataFrame(rows + rows[:50] + [(None, "a", "x")], "id long, family string, category string")
    classes = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("a", 3, "none"), ("b", 0, "p")], "family string, idx int, label string")
    maps = members.bitmaps(frame).cache()
    held = {(f, c): {i for i, g, d in rows if (g, d) == (f, c)} for _, f, c in rows}
    for chosen in ({"a": ["x"]}, {"a": ["x", "y"], "b": ["q"]}, {"a": ["none"]}, {"a": ["z"], "b": ["p"], "c": ["m"]}, {}):
        wanted = set(every)
        for family, labels in chosen.items():
            wanted &= set().union(*[held.get((family, label), set()) for label in labels])
        selection = members.selected(maps, chosen)
        found = [r["id"] for r in members.ids(selection).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
        assert members.count(selection).first()["n"] == len(wanted)
        facet = {r["label"]: r["n"] for r in members.facet_within(maps, classes, "a", selection).collect()}
        assert facet == {label: len(held.get(("a", label), set()) & wanted) for label in ("x", "y", "z", "none")}


def test_pairs_of_large_records_and_many_items(spark):
    source = random.Random(31)
    names = [f"i{n}" for n in range(20_000)]
    rows = [(0, name) for name in names[:300]] + [(0, "i5")] * 3
    rows += [(i, source.choice(names)) for i in range(1, 2500) for _ in range(8)]
    frame = spark.createDataFrame(rows, "id long, ingredient string")
    listed = spark.createDataFrame([(name,) for name in names], "ingredient string")
    held = collections.defaultdict(collections.Counter)
    for key, name in rows:
        held[key][name] += 1
    for as_set in (True, False):
        wanted = collections.Counter()
        for items_of in held.values():
            for a, b in itertools.permutations(items_of, 2):
                wanted[a, b] += 1 if as_set else items_of[a] * items_of[b]
        found = items.pair_counts(frame, listed, "ingredient", as_set=as_set, light=50)
        assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == wanted


def test_parents_against_all_pairs(spark):
    source = random.Random(13)
    rows = set()
    for i in range(900):
        tags = {f"t{source.randrange(12)}" for _ in range(source.choice([1, 2, 5]))}
        for low, high, share in (("t1", "w1", 1.0), ("t2", "w1", 0.99), ("t3", "w2", 0.97), ("w1", "all", 0.995)):
            if low in tags and source.random() < share:
                tags.add(high)
        if source.random() < 0.5:
            tags.add("all")
        rows |= {(i, tag) for tag in tags}
    rows |= {(5000, f"t{n}") for n in range(12)}
    held = collections.defaultdict(set)
    for key, tag in rows:
        held[tag].add(key)
    for threshold in (0.99, 0.95, 0.5, 1.0):
        wanted = {(a, b, len(held[a] & held[b])) for a, b in itertools.permutations(held, 2)
                  if len(held[b]) > len(held[a]) and len(held[a] & held[b]) / len(held[a]) >= threshold}
        found = taxonomy.qualifying_pairs(spark.createDataFrame(sorted(rows), "id long, tag string"), sorted(held), threshold)
        assert {(r["child"], r["parent"], r["n_both"]) for r in found.collect()} == wanted
    many = spark.createDataFrame([(f"x{n}",) for n in range(20_000)] + [("t1",), ("w1",)], "tag string")
    pairs = taxonomy.qualifying_pairs(spark.createDataFrame(sorted(rows), "id long, tag string"), many)
    assert {(r["child"], r["parent"]) for r in pairs.collect()} <= {("t1", "w1")}


def test_clusters_with_like_names_are_merged(spark):
    names = [(0, "red wine"), (1, "bread"), (2, "wine red"), (3, "red red wine"), (5, "soup")]
    named = spark.createDataFrame(names, "cluster int, name string")
    vectors = embed.embed_text(named.select(F.col("cluster").alias("id"), F.col("name").alias("text")), 64)
    rows = [(i, c) for i, c in enumerate([0, 1, 1, 2, 3, 3, -1, 5, -1])]
    points, table = clusters.merged_clusters(named, vectors, spark.createDataFrame(rows, "id long, cluster int"), 0.9)
    assert points.columns == ["id", "cluster"]
    assert {r["id"]: r["cluster"] for r in points.collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: -1, 7: 2, 8: -1}
    found = {r["cluster"]: (r["name"], r["merged_from"], r["n"]) for r in table.collect()}
    assert found == {0: ("red wine", [0, 2, 3], 4), 1: ("bread", [1], 2), 2: ("soup", [5], 1)}


def _scattered(spark, count, dims, copies=0, seed=31):
    """Vectors of which no pivot is near any more than the others, and some copies of the first."""
    rows = np.random.default_rng(seed).normal(size=(count, dims))
    rows[count - copies :] = rows[0]
    frame = spark.createDataFrame([(i, row.tolist(), None) for i, row in enumerate(rows)],
                                  "id long, embedding array<double>, carried string")
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), frame


def test_a_row_travels_once_per_bin(spark):
    from orrery.operators import cells as C

    _, frame = _scattered(spark, 300, 32)
    cells, members = C.around_pivots(frame, 300, 4)
    bounds = frame.select("id", F.lit(2.0).alias("farthest"))
    assert len(cells.pivots) > 100
    assert neighbours._visiting(frame, cells, 300, bounds).count() == 300
    assert graphs.visitors_within(members, cells, -1.0).count() == 300


def test_searches_over_several_bins_and_parts_of_a_bin(spark, monkeypatch):
    from orrery.operators import cells as C

    monkeypatch.setattr(C, "TASK_ROWS", 50)
    monkeypatch.setattr(C, "LEAST_ROWS", 20)
    rows, frame = _scattered(spark, 260, 6, copies=120)
    assert C.around_pivots(frame, 260, 5)[0].bins().max() > 0
    similarity = np.round(rows @ rows.T, 12)
    distance = np.round(1.0 - rows @ rows.T, 12)
    found = collections.defaultdict(list)
    for row in neighbours.nearest(frame, frame, 7, skip_self=True, broadcast_bytes=0, block_rows=5).collect():
        found[row["query_id"]].append((row["rank"], row["neighbour_id"]))
    for query in range(len(rows)):
        order = sorted((distance[query, i], i) for i in range(len(rows)) if i != query)[:7]
        assert [n for _, n in sorted(found[query])] == [i for _, i in order]
    edges = graphs.similar_edges(frame.select("id", "embedding"), 0.5, broadcast_bytes=0, block_rows=5)
    assert edges.count() == edges.distinct().count()
    pairs = {(r["a"], r["b"]) for r in graphs.all_pairs(edges, graphs.representatives(frame)).collect()}
    assert pairs == {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if similarity[i, j] >= 0.5}


def test_a_search_holds_one_tile_of_distances():
    import tracemalloc

    source = np.random.default_rng(5)
    side = lambda n: neighbours._Side(np.arange(n), source.normal(size=(n, 4)), np.full(n, None))
    queries, train = side(600), side(20_000)
    tracemalloc.start()
    found = sum(len(part) for part in neighbours._nearest(queries, train, 10, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 6000 and peak < 60e6


def test_tables_of_some_size_are_not_copied_into_every_worker():
    # 64 numbers a vector: a broadcast of more rows would be held whole by each Python worker
    assert neighbours.BROADCAST_BYTES // (64 * 8 + 64) < 30_000
