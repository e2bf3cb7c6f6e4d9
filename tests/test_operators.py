"""Hand-computed checks of formulas and decisions."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import columns as K
from kinweave.operators import clean as C
from kinweave.operators import encode as E
from kinweave.operators import fidelity as Q
from kinweave.operators import noise as N
from kinweave.operators import predict as P
from kinweave.operators import relational as R
from kinweave.operators.ordering import exact_quantiles, with_position, with_rank
from kinweave.specs import Domain, RelationalDataset, RelationGraph, TableSpec

PARENTS = [(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)]
CHILDREN = [(1, 0), (1, 1), (1, 1), (2, 2), (2, 0), (3, 1), (3, 1)]


@pytest.fixture(scope="module")
def family(spark):
    return (
        spark.createDataFrame(PARENTS, "p_id int, x double"),
        spark.createDataFrame(CHILDREN, "p_id int, cluster int"),
    )


def test_votes_sizes_and_childless_parents(family):
    parents, children = family
    labels = R.vote(children, "p_id", "cluster")
    # parent 2 is tied between 0 and 2: the smaller label wins; parent 4 has no child: max + 1
    labelled = R.label_parents(parents, "p_id", labels, "p_id")
    assert {r["p_id"]: r["label"] for r in labelled.collect()} == {1: 1, 2: 0, 3: 1, 4: 2}
    assert {r["p_id"]: r["n_children"] for r in R.children_per_parent(parents, "p_id", children, "p_id").collect()} == {
        1: 3, 2: 2, 3: 2, 4: 0,
    }
    sized = R.group_sizes(children, "p_id").join(labels, "p_id")
    dist = {(r["label"], r["group_size"]): r["prob"] for r in R.size_distribution(sized, "label").collect()}
    assert dist == {(1, 3): 0.5, (1, 2): 0.5, (0, 2): 1.0}
    rates = {r["p_id"]: r["agree_rate"] for r in R.agree_rates(children, "p_id", "cluster").collect()}
    assert rates[2] == 0.5 and rates[3] == 1.0


def test_orphans_stop_the_run(spark, family):
    parents, _ = family
    with pytest.raises(ValueError):
        R.assert_integrity(spark.createDataFrame([(9,)], "p_id int"), "p_id", parents, "p_id")


def test_added_columns_need_equal_row_ids(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    right = spark.createDataFrame([(1, 5)], "id int, y int")
    with pytest.raises(Exception, match="row ids"):
        R.add_columns(left, right, "id").collect()


def test_repeat_rows_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "EXPLODE_ROWS", 4)
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 4)], "k string, n int")
    got = sorted((r["k"], r["i"]) for r in R.repeat_rows(df, "n", "i", 10).collect())
    assert got == [("a", i) for i in range(1, 11)] + [("c", i) for i in range(1, 5)]


def test_positions_ranks_and_sums_do_not_depend_on_partitions(spark):
    rows = [("a", i % 7, i) for i in range(40)] + [("b", 1, 100)]
    for n in (1, 8):
        df = spark.createDataFrame(rows, "g string, v int, id int").repartition(n)
        placed = with_position(df, ["v", "id"], sums=["v"]).collect()
        order = sorted(rows, key=lambda r: (r[1], r[2]))
        want = {r[2]: (i, sum(x[1] for x in order[: i + 1])) for i, r in enumerate(order)}
        assert {r["id"]: (r["position"], r["run_v"]) for r in placed} == want
        ranked = with_rank(df, ["g"], ["id"], sums=["v"]).collect()
        assert {r["id"]: (r["rank"], r["run_v"]) for r in ranked if r["g"] == "b"} == {100: (1, 1)}
        assert [r["rank"] for r in sorted(ranked, key=lambda r: r["id"]) if r["g"] == "a"] == list(range(1, 41))


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2)], "x double")
    assert exact_quantiles(df, "x", [0, 0.5, 1]) == [1.0, 3.0, 5.0]


def test_graph_order_paths_and_cycles():
    graph = RelationGraph.from_children({"A": ["B", "C"], "B": ["D"], "C": ["D"], "D": []})
    assert graph.edges == ((None, "A"), ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"))
    assert graph.long_paths() == [("A", "B", "D"), ("A", "C", "D")]
    assert RelationGraph.from_meta(graph.to_meta()) == graph
    with pytest.raises(ValueError):
        RelationGraph.from_children({"A": ["B"], "B": ["A"]})


def test_domain_roles():
    domain = Domain({"a": (2, "discrete"), "b": (1200, "discrete"), "c": (9, "continuous")})
    assert [domain.task_type(c) for c in "abcz"] == ["binclass", "multiclass", "regression", None]
    assert domain.with_max_categories(1000).discrete == ["a"]
    assert Domain.from_json(domain.to_json()) == domain
    with pytest.raises(ValueError):
        Domain({"a": (2, "other")})
    spec = TableSpec.by_convention("t", ["t_id", "fluid_idx"], domain, ["p"])
    assert spec.key_columns == ["t_id", "p_id"]


def test_two_digit_years_and_packed_births(spark):
    df = spark.createDataFrame([("681231",), ("690101",), ("930101",)], "d string")
    assert [str(r[0]) for r in df.select(K.two_digit_date(F.col("d"))).collect()] == ["2068-12-31", "1969-01-01", "1993-01-01"]
    days, earliest = K.days_since_earliest(df, "d", "n")
    back = days.select("d", K.rebuild_date(F.col("n"), earliest).alias("b")).collect()
    assert all(r["d"] == r["b"] for r in back)
    births = spark.createDataFrame([("700512",), ("705512",)], "b string").select(K.packed_birth(F.col("b")).alias("p")).collect()
    assert [tuple(r["p"]) for r in births] == [(70, 5, 12, 0), (70, 5, 12, 1)]


def test_protected_rows_and_incomplete_rows(spark):
    df = spark.createDataFrame([(None, "test"), (1.0, "train")], "x double, split string")
    with pytest.raises(ValueError):
        C.drop_missing(df, ["x"], split="split")
    with pytest.raises(ValueError):
        C.discard_incomplete(df, ["x"])
    assert C.discard_incomplete(df, ["x"], max_share=0.5).count() == 1


def test_snap_prefers_the_smaller_level(spark):
    df = spark.createDataFrame([(1.5,), (2.6,), (-9.0,)], "x double")
    assert [r[0] for r in df.select(C.snap(F.col("x"), [1.0, 2.0, 3.0])).collect()] == [1.0, 3.0, 1.0]


def test_constant_columns(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    row = df.select(
        E.minmax(F.col("x"), 3.0, 3.0).alias("m"), E.standardise(F.col("x"), 3.0, 0.0).alias("z"), E.efficacy_scale(F.col("x"), 3.0, 3.0).alias("e")
    ).first()
    assert tuple(row) == (-1.0, 0.0, 0.0)


def test_efficacy_scale_branches(spark):
    row = spark.range(1).select(
        E.efficacy_scale(F.lit(0.0), 0.0, 1000.0).alias("a"), E.efficacy_scale(F.lit(5.0), 0.0, 10.0).alias("b")
    ).first()
    assert row["a"] == pytest.approx(math.log(0.01)) and row["b"] == 2.5


def test_normal_tables():
    p = np.array([0.001, 0.2, 0.5, 0.9])
    assert np.allclose(E.normal_quantile(p), [NormalDist().inv_cdf(x) for x in p], atol=1e-6)
    assert np.allclose(E.normal_cdf(np.array([-1.0, 0.0, 2.0])), [NormalDist().cdf(x) for x in (-1, 0, 2)], atol=1e-6)
    # ties take the middle of their lowest and highest level
    assert E.uniform_scores(np.array([1.0]), np.array([0.0, 1.0, 1.0, 2.0]))[0] == pytest.approx(0.5)


def test_cosine_schedule_is_consistent(spark):
    rows = N.schedule(spark, 50).orderBy("t").collect()
    product = 1.0
    for i, r in enumerate(rows):
        assert r["alpha_bar_prev"] == pytest.approx(product)
        product *= 1 - r["beta"]
        assert r["alpha_bar"] == pytest.approx(product)
    linear = N.schedule(spark, 1000, "linear").orderBy("t").collect()
    assert linear[0]["beta"] == pytest.approx(1e-4) and linear[-1]["beta"] == pytest.approx(0.02)


def test_divergence_of_equal_sides_is_zero(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "a")], "x double, c string")
    assert N.column_drift(df, df, ["x"]).first()["kl"] == pytest.approx(0)
    assert N.categorical_kl(df, df, "c").first()["kl"] == pytest.approx(0)


def test_leave_one_out_excludes_the_row(spark):
    df = spark.createDataFrame([("a", 1.0, "train"), ("a", 3.0, "train"), ("b", 5.0, "train"), ("a", 0.0, "val")], "c string, y double, split string")
    out = E.leave_one_out(df, "c", "y", F.col("split") == "train", "e")
    got = {(r["c"], r["y"]): r["e"] for r in out.collect()}
    assert got == {("a", 1.0): 3.0, ("a", 3.0): 1.0, ("b", 5.0): 3.0, ("a", 0.0): 2.0}


def _toy(spark, shift=0.0):
    frames = {
        "p": spark.createDataFrame([(1, 1.0 + shift, "u"), (2, 2.0, "v"), (3, 3.0, "u")], "p_id int, a double, b string"),
        "c": spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0), (3, 2, 7.0)], "c_id int, p_id int, z double"),
    }
    specs = {
        "p": TableSpec("p", "p_id", Domain.of(["b"], ["a"])),
        "c": TableSpec("c", "c_id", Domain.of([], ["z"]), {"p": "p_id"}),
    }
    return RelationalDataset(frames, specs, RelationGraph.from_children({"p": ["c"], "c": []}))


def test_a_copy_scores_one_everywhere(spark):
    data = _toy(spark)
    for scores in (Q.column_shapes(data, data), Q.cardinality_shapes(data, data), Q.coverage(data, data, "p"), Q.trend_scores(data, data)):
        rows = scores.collect()
        assert rows and all(r["score"] == pytest.approx(1.0) for r in rows)


def test_ks_by_hand(spark):
    real = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    fake = spark.createDataFrame([(3.0,), (4.0,), (5.0,), (None,)], "x double")
    counts = Q.value_counts(Q.stacked(real, fake, ["x"]), ["x"], "double")
    for few in (False, True):
        assert Q.ks_scores(counts, few).first()["score"] == pytest.approx(0.5)


def test_classification_metrics_by_hand(spark):
    truth, guess = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(truth, guess)), "t int, p int")
    m = P.classification_metrics(df, "t", "p").first()
    f1 = [2 / 3, 4 / 5, 0.0]
    share = [3 / 6, 2 / 6, 1 / 6]
    assert m["accuracy"] == pytest.approx(4 / 6) and m["macro_f1"] == pytest.approx(sum(f1) / 3)
    assert m["inverse_prevalence_f1"] == pytest.approx(sum(f * (1 - s) for f, s in zip(f1, share)) / 2)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert P.roc_auc(df, "y", "s") == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert P.roc_auc(df.where("y = 1"), "y", "s") is None
