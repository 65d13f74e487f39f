"""Edge values of the Column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.config import BinEncoder, Missing, RangeEncoder
from orrery.functions import encode as E
from orrery.functions import geometry as G
from orrery.functions import tags as T
from orrery.functions import text as X
from orrery.functions import vectors as V
from orrery.operators import categories


def values(spark, rows, schema, column):
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    return [row[0] for row in frame.select(column).collect()]


def test_bin_edges_are_right_open(spark):
    found = values(spark, [(v,) for v in (14.0, 15.0, 29.0, 30.0, 31.0, None)], "v double", E.bin_index(F.col("v"), [15, 30]))
    assert found == [0, 1, 1, 2, 2, None]


def test_rank_hot_is_fractional_inside_a_bin_only(spark):
    found = values(spark, [(v,) for v in (5.0, 10.0, 15.0, 20.0, 99.0)], "v double", E.rank_hot(F.col("v"), [10, 20]))
    assert found == [[1, 0, 0], [1, 0, 0], [1, 0.5, 0], [1, 1, 1], [1, 1, 1]]
    assert all(a >= b for vector in found for a, b in zip(vector, vector[1:]))


@pytest.mark.parametrize("missing, vector, category, score", [
    (Missing(label="no rating"), [0, 0, 0, 1], "no rating", 0.0),
    (Missing(value=0), [1, 0, 0], "a", 1.0),
    (Missing(), [0.5, 0, 0], "a", 0.5),
])
def test_missing_values(spark, missing, vector, category, score):
    encoder = BinEncoder("v", (2, 3), ("a", "b", "c"), missing=missing)
    assert values(spark, [(None,)], "v double", E.bin_vector(F.col("v"), encoder)) == [vector]
    row = values(spark, [(None,)], "v double", E.bin_assignment(F.col("v"), encoder))[0]
    assert (row["category"], row["score"], row["bin"]) == (category, score, 0)


def test_labelled_missing_shifts_present_bins(spark):
    encoder = BinEncoder("v", (2, 3), ("a", "b", "c"), missing=Missing(label="none"))
    row = values(spark, [(2.5,)], "v double", E.bin_assignment(F.col("v"), encoder))[0]
    assert (row["category"], row["bin"]) == ("b", 2)
    assert values(spark, [(2.5,)], "v double", E.bin_vector(F.col("v"), encoder)) == [[1, 0.5, 0, 0]]


def test_scalar_bins_give_their_position(spark):
    encoder = BinEncoder("v", (2, 3), ("a", "b", "c"), scalar=True)
    assert values(spark, [(1.0,), (2.0,), (9.0,)], "v double", E.bin_vector(F.col("v"), encoder)) == [[0.0], [0.5], [1.0]]


def test_labels_must_match_edges():
    with pytest.raises(ValueError):
        BinEncoder("v", (1, 2), ("a", "b"))


def test_range_without_width_is_one_half(spark):
    frame = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "id long, v int")
    found = categories.scale_range(frame, RangeEncoder("v", "v")).collect()
    assert [row["vector"] for row in found] == [[0.5]] * 3


def test_range_is_taken_from_all_source_values(spark):
    frame = spark.createDataFrame([(1, 5)], "id long, v int")
    source = spark.createDataFrame([(1, 5), (2, 0), (3, 20)], "id long, v int")
    assert categories.scale_range(frame, RangeEncoder("v", "v"), source).first()["vector"] == [0.25]


def test_numeric_value_reads_a_year(spark):
    found = values(spark, [("2005-04-12",), ("ab",), (None,), ("12d",), ("1.5",)], "v string", E.numeric_value(F.col("v"), True))
    assert found == [2005.0, None, None, None, 1.5]


def test_rating_fraction(spark):
    found = values(spark, [("1",), ("3",), ("x",), (None,)], "v string", E.rating_fraction(F.col("v"), F.lit(1.0), F.lit(5.0)))
    assert found == [0.0, 0.5, -1.0, -1.0]


def test_slugs(spark):
    rows = [("4.5 stars",), ("<15 minutes",), ("4+ hours",), ("100+ ratings",), ("--a  b--",)]
    assert values(spark, rows, "v string", X.slug(F.col("v"))) == [
        "4.5-stars", "lt15-minutes", "4plus-hours", "100plus-ratings", "a-b"]


def test_shard_keys(spark):
    assert values(spark, [(228132,), (7,), (100,)], "v long", X.shard_key(F.col("v"))) == ["32", "07", "00"]


def test_template_joins_lists_and_skips_nulls(spark):
    frame = spark.createDataFrame([(None, ["a", None, "b"], "{tags}")], "name string, tags array<string>, other string")
    assert frame.select(X.template_text(frame, "{name}. {tags}")).first()[0] == ". a, b"
    # text that looks like a slot is not filled again
    assert frame.select(X.template_text(frame, "{other} {unknown}")).first()[0] == "{tags}"


def test_title_and_abstract(spark):
    found = values(spark, [("T", "A"), ("", "A"), ("T", ""), (None, "A")], "t string, a string", X.title_abstract(F.col("t"), F.col("a")))
    assert found == ["T [SEP] A", "A", None, "A"]


def test_links(spark):
    found = values(spark, [("10.1/x",), (" http://y ",), (None,), ("  ",)], "d string", X.doi_url(F.col("d"), F.lit(7)))
    assert found == ["https://doi.org/10.1/x", "http://y", "https://arxiv.org/abs/7", "https://arxiv.org/abs/7"]


def test_list_literals(spark):
    rows = [("['a', \"it's\", 'b']",), ("[]",), ("[broken",), (None,), ("['a', None]",), ("['it\\'s \"x\"']",)]
    found = values(spark, rows, "v string", X.parse_list(F.col("v")))
    assert found == [["a", "it's", "b"], [], [], None, ["a", None], ['it\'s "x"']]
    assert values(spark, rows, "v string", X.list_unreadable(F.col("v"))) == [False, False, True, False, False, False]


def test_one_decimal_rounds_the_binary_value(spark):
    shown = values(spark, [(3.15,), (2.65,), (3.25,), (4.96,), (5.0,)], "v double", X.one_decimal(F.col("v")))
    assert shown == ["3.1", "2.6", "3.3", "5.0", "5.0"]


def test_previews(spark):
    assert values(spark, [(["a", "b", "c"],)], "v array<string>", X.list_preview(F.col("v"), 2)) == ["a, b +1 more"]
    assert values(spark, [("abcdef",), ("abc",)], "v string", X.truncated(F.col("v"), 3)) == ["abc...", "abc"]
    assert values(spark, [(3.4,), (9.0,)], "v double", X.star_string(F.col("v"))) == ["★★★☆☆", "★★★★★"]


def test_year_of(spark):
    assert values(spark, [("2020-02-03",), ("soon",), (None,)], "v string", X.year_of(F.col("v"))) == [2020, None, None]


def test_searches_skip_null_names(spark):
    rows = [("Red Ring",), ("blue",), (None,)]
    assert values(spark, rows, "v string", X.name_matches(F.col("v"), "r.d")) == [True, False, False]
    assert values(spark, [("a.b",), ("axb",), (None,)], "v string", X.name_contains(F.col("v"), "A.B")) == [True, False, False]


def test_most_specific_tags(spark):
    above = {"tiny": ["mid", "wide"], "mid": ["wide"]}
    rows = [(["tiny", "wide"],), (["mid", "economy"],), (["wide"],)]
    found = values(spark, rows, "v array<string>", T.most_specific(F.col("v"), above))
    assert [sorted(tags) for tags in found] == [["tiny"], ["economy", "mid"], ["wide"]]


def test_first_matching_and_one_hot(spark):
    found = values(spark, [(["b", "a"],), (["z"],)], "v array<string>", T.first_matching(F.col("v"), ["a", "b"], "other"))
    assert found == ["a", "other"]
    assert values(spark, [("b",), (None,)], "v string", T.one_hot(F.col("v"), ["a", "b", "other"], "other")) == [[0, 1, 0], [0, 0, 1]]


def test_literal_arrays_keep_quotes(spark):
    odd = ["it's", 'say "x"', "back\\slash"]
    assert spark.range(1).select(T.text_array(odd)).first()[0] == odd


def test_prior_correction(spark):
    found = values(spark, [([0.5, 0.5],)], "p array<double>", V.prior_corrected(F.col("p"), [0.8, 0.2]))[0]
    assert found == pytest.approx([0.2, 0.8])


def test_top_classes_break_ties_by_name(spark):
    found = values(spark, [([0.4, 0.2, 0.4, 0.0],)], "p array<double>", V.top_classes(F.col("p"), ["d", "c", "a", "b"]))[0]
    assert [(row["category"], row["score"]) for row in found] == [("a", 0.4), ("d", 0.4), ("c", 0.2)]


def test_vector_helpers(spark):
    assert values(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>", V.l2_normalised(F.col("v"))) == [[0.6, 0.8], [0, 0]]
    assert values(spark, [([1.0, 3.0, 3.0],)], "v array<double>", V.argmax_index(F.col("v"))) == [1]
    families = {"b_features": F.col("v"), "a_proba": F.col("v")}
    weights = {"embeddings": 2.0, "default": 0.5, "a_proba": 3.0}
    assert values(spark, [([1.0],)], "v array<double>", V.weighted_concat(F.col("v"), families, weights, 0.5)) == [[2.0, 3.0, 0.5]]
    assert values(spark, [([1.0],)], "v array<double>", V.weighted_concat(F.col("v"), families, weights, 0.0)) == [[1.0]]


def test_morton_codes(spark):
    top = 2**21 - 1
    rows = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (5, 0, 0), (top, top, top), (top, 0, 0)]
    found = values(spark, rows, "x long, y long, z long", G.morton(F.col("x"), F.col("y"), F.col("z")))
    assert found == [0, 1, 2, 4, 65, 2**63 - 1, sum(1 << (3 * i) for i in range(21))]


def test_centred_uses_one_scale(spark):
    found = values(spark, [(0.0,), (5.0,)], "v double", G.centred(F.col("v"), F.lit(0.0), F.lit(5.0), F.lit(10.0)))
    assert found == [-0.25, 0.25]
    assert values(spark, [(3.0,)], "v double", G.centred(F.col("v"), F.lit(3.0), F.lit(3.0), F.lit(0.0))) == [0.0]
    assert math.isclose(values(spark, [(10.0,)], "v double", G.centred(F.col("v"), F.lit(0.0), F.lit(10.0), F.lit(10.0), 1.0))[0], 1.0)
