"""Properties of clustering, synthesis, privacy scores, sources and stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import cluster as L
from kinweave.operators import privacy as V
from kinweave.operators import synth as Y
from kinweave.plans.synthesis import run
from kinweave.queries.star import SPECS, table
from kinweave.queries.synthesis import small_graph
from kinweave.session import cut
from kinweave.sources import tables as T
from kinweave.sources.stages import RunConfig, StageStore
from kinweave.specs import Domain, RelationalDataset, RelationGraph, TableSpec

SF = "/root/testdata/sf0.001"


def test_one_em_step_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(3)
    start = L.Mixture(np.array([0.4, 0.6]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.ones((2, 2)))
    got, _ = L.em_step(df, start)
    r, _ = start.responsibilities(x)
    mean = r.T @ x / r.sum(axis=0)[:, None]
    assert np.allclose(got.means, mean)
    assert np.allclose(got.weights, r.mean(axis=0))
    assert np.allclose(got.variances, r.T @ x**2 / r.sum(axis=0)[:, None] - mean**2 + L.VARIANCE_FLOOR)


def test_edges_without_numerics_or_with_wide_categories(spark):
    parent = spark.createDataFrame([(i, str(i)) for i in range(30)], "p_id int, w string")
    child = spark.createDataFrame([(i, i % 30, "xy"[i % 2]) for i in range(60)], "c_id int, p_id int, k string")
    p = TableSpec("p", "p_id", Domain.of(["w"]))
    c = TableSpec("c", "c_id", Domain.of(["k"]), {"p": "p_id"})
    rows = L.joint_features(child, c, parent, p, "p_id", max_categories=10)
    assert {len(r["features"]) for r in rows.collect()} == {3}  # two one-hots and the key


def test_copula_keeps_marginals_and_is_reproducible(spark):
    orders, domain = table(spark, SF, "orders"), SPECS["orders"].domain
    model = Y.CopulaSynthesizer().fit(orders.select(*domain.columns), domain)
    slots = spark.range(1500).withColumnRenamed("id", "slot_id")
    first = model.sample(slots.repartition(1)).orderBy("slot_id").collect()
    assert first == model.sample(slots.repartition(8)).orderBy("slot_id").collect()
    low, high = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    assert all(low <= r["o_totalprice"] <= high for r in first)
    real = {r["o_orderstatus"]: r["count"] / 1500 for r in orders.groupBy("o_orderstatus").count().collect()}
    for status, share in real.items():
        assert abs(sum(r["o_orderstatus"] == status for r in first) / 1500 - share) < 0.06


def test_smote_stays_between_neighbours(spark):
    df = spark.createDataFrame(
        [(i, float(i % 10), "ab"[i % 2], "xy"[(i // 2) % 2]) for i in range(40)], "id int, v double, y string, c string"
    )
    rows = Y.smote(df, "id", ["v"], ["c"], "y", k=3).collect()
    assert len(rows) == 40 and {r["y"] for r in rows} == {"a", "b"}
    assert all(r["v"] in set(map(float, range(10))) for r in rows)  # few whole levels: snapped
    assert all(r["v"] % 2 == (r["y"] == "b") for r in rows if r["v"] in (0.0, 9.0))


def test_dcr_of_a_train_copy_is_one(spark):
    rows = [(i, float(i), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v double, c string")
    train, test = df.where("id < 20"), df.where("id >= 20")
    score = V.dcr_score(V.closest_distances(train, train, test, "id", ["v"], ["c"])).first()
    assert score["score"] == 1.0 and score["n"] == 20


def test_prdc_against_brute_force(spark):
    rng = np.random.default_rng(4)
    r, f = rng.normal(size=(30, 2)), rng.normal(0.5, 1, size=(30, 2))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = V.prdc(frame(r), frame(f), "id", k=3).first()
    gap = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    rr, ff, rf = np.sort(gap(r, r), 1)[:, 3], np.sort(gap(f, f), 1)[:, 3], gap(r, f)
    inside = rf < rr[:, None]
    assert got["precision"] == pytest.approx(inside.any(0).mean())
    assert got["density"] == pytest.approx(inside.sum() / (3 * 30))
    assert got["recall"] == pytest.approx((rf < ff[None]).any(1).mean())
    assert got["coverage"] == pytest.approx((rf.min(1) < rr).mean())


def test_whole_chain_gives_valid_keys_and_resumes(spark, tmp_path):
    data = small_graph(spark, SF, ("customer", "orders"))
    config = RunConfig(workspace=str(tmp_path), num_clusters=3, clustering_method="kmeans")
    store = StageStore(spark, str(tmp_path), config.digest())
    made = run(data, config, store)
    people, orders = made.tables["customer"], made.tables["orders"]
    assert people.columns == data.tables["customer"].columns or set(people.columns) <= set(data.tables["customer"].columns)
    assert people.count() == 150 == people.select("c_custkey").distinct().count()
    assert orders.select("o_orderkey").distinct().count() == orders.count() > 0
    assert orders.join(people, orders["o_custkey"] == people["c_custkey"], "left_anti").count() == 0
    again = StageStore(spark, str(tmp_path), config.digest())
    run(data, config, again)
    assert "tables/customer" in again.reused and "cluster/customer-orders/sizes" in again.reused
    assert StageStore(spark, str(tmp_path), "other")._complete(store.path("tables/customer")) is False


def test_sources_round_trip(spark, tmp_path):
    folder = str(tmp_path / "data")
    (tmp_path / "data").mkdir()
    graph = RelationGraph.from_children({"p": ["c"], "c": []})
    (tmp_path / "data" / "dataset_meta.json").write_text(graph.to_meta())
    (tmp_path / "data" / "p.csv").write_text("p_id,a\n1,x\n2,y\n")
    (tmp_path / "data" / "c.csv").write_text("c_id,p_id,z\n")  # header only
    (tmp_path / "data" / "p_domain.json").write_text('{"a": {"size": 2, "type": "discrete"}}')
    (tmp_path / "data" / "c_domain.json").write_text('{"z": {"size": 0, "type": "continuous"}}')
    data = T.load_dataset(spark, folder)
    assert data.tables["c"].count() == 0 and data.tables["c"].schema["z"].dataType.typeName() == "double"
    for layout in T.LAYOUTS:
        T.save_synthetic(data, str(tmp_path / layout), layout)
        back = T.load_synthetic(spark, str(tmp_path / layout), data, layout)
        assert sorted(map(tuple, back.tables["p"].collect())) == [(1, "x"), (2, "y")]
    domain = T.encode_and_save(data.tables["p"], data.specs["p"], str(tmp_path / "enc"))
    assert domain.size("a") == 2
    T.save_splits(spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string"), str(tmp_path / "s"))
    assert [r["id"] for r in T.load_split(spark, str(tmp_path / "s"), "test").collect()] == [2]


def test_config_reads_the_json_settings():
    config = RunConfig.from_json('{"general": {"workspace_dir": "w"}, "clustering": {"num_clusters": {"c": 5}}, "matching": {"no_matching": true}}')
    assert config.num_clusters == {"c": 5} and config.matching_method == "shuffle"


def test_registered_efficacy_chooses_among_all_settings(spark, monkeypatch):
    """Every target of the registered query gets all 36 settings to choose among."""
    from kinweave.operators import learn
    from kinweave.queries import load_all
    from kinweave.queries.registry import QUERIES

    load_all()
    asked = []

    def one_target(fake, test, domain, target, grid=tuple(learn.FULL_GRID), **_):
        asked.append((target, list(grid)))
        return [dict(column=target, task="t", criterion="c", metric="m", value=1.0, setting="s")]

    monkeypatch.setattr(learn, "efficacy", one_target)
    QUERIES["l26_efficacy"](spark, "/root/testdata/sf0.001").collect()
    assert len(learn.FULL_GRID) == 36 and asked and all(grid == learn.FULL_GRID for _, grid in asked)


def test_too_many_segments_are_refused(spark, monkeypatch):
    import pytest

    from kinweave.queries import load_all, synthesis
    from kinweave.queries.registry import QUERIES

    load_all()
    monkeypatch.setattr(synthesis, "L_MAX", 2)
    for name in ("l2_assign", "l3_em_step"):
        with pytest.raises(ValueError, match="more than 2 segments"):
            QUERIES[name](spark, "/root/testdata/sf0.001")


def test_variational_steps_raise_the_bound_and_empty_components_shrink(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-0.6, 0.05, (150, 2)), rng.normal(0.5, 0.1, (90, 2))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(3)
    centres = x[rng.choice(len(x), 6, replace=False)]
    start = L.Mixture(np.full(6, 1 / 6), centres, np.tile(x.var(axis=0), (6, 1)))
    prior = L.Prior(0.01, 1.0, x.mean(axis=0), 1.0, x.var(axis=0))
    r, _ = start.responsibilities(x)
    now, bounds = prior.after(r.sum(axis=0), r.T @ x, r.T @ x**2), []
    for _ in range(12):
        r, like = now.responsibilities(x)
        plain = prior.after(r.sum(axis=0), r.T @ x, r.T @ x**2)
        bound = like.sum() - now.divergence()
        if not bounds:
            got, sent = L.variational_step(df, now)
            assert np.isclose(sent, bound) and np.allclose(got.alpha, plain.alpha) and np.allclose(got.means, plain.means) and np.allclose(got.b, plain.b)
        bounds.append(bound)
        now = plain
    assert all(b >= a - 1e-7 for a, b in zip(bounds, bounds[1:]))
    fitted = L.fit_variational(df, 6, concentration=0.01)
    assert sorted(np.round(fitted.weights, 2))[-1] <= 0.65 and (fitted.weights > 0.05).sum() < 6 and np.isclose(fitted.weights.sum(), 1)


def test_digamma_is_the_slope_of_log_gamma():
    import math

    for x in (0.01, 0.3, 1.0, 2.5, 7.9, 8.0, 40.0, 1e6):
        h = 1e-5 * x
        assert np.isclose(L.digamma(np.array(x)), (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rtol=1e-5, atol=1e-5)
    assert np.isclose(L.digamma(np.array(1.0)), -0.5772156649015329, atol=1e-12)


def test_guided_draws_equal_scanned_ones(spark, monkeypatch):
    from kinweave.operators import relational as R

    rng = np.random.default_rng(6)
    dist = []
    for label in range(4):
        sizes = np.sort(rng.choice(50, 1 + 9 * label, replace=False))
        p = rng.random(len(sizes)) ** 4 * (rng.random(len(sizes)) > 0.2) + (np.arange(len(sizes)) == 0)
        dist += [(label, int(s), float(q)) for s, q in zip(sizes, p / p.sum())]
    dist = spark.createDataFrame(dist, "label int, group_size bigint, prob double")
    parents = spark.range(3_000).select(F.col("id").alias("pk"), F.when(F.col("id") % 6 < 5, (F.col("id") % 6).cast("int")).alias("label"))
    one = dist.where("label = 3").select("group_size", "prob")

    def drawn():
        children = R.expand_children(parents, "pk", "label", dist, "t").groupBy("pk", "label").count().collect()
        keys = R.synthetic_keys(one, 900, spark, "k").collect()
        return sorted(map(tuple, children), key=str), sorted(map(tuple, keys))

    scanned = drawn()
    monkeypatch.setattr(R, "GUIDE_SIZES", 1)
    assert drawn() == scanned and len(scanned[0]) > 500


def test_a_hundred_thousand_sizes_do_not_grow_the_plan(spark):
    from kinweave.functions.hashing import hash_uniform
    from kinweave.operators import relational as R

    n = 100_000
    dist = spark.range(n).select(F.lit(0).alias("all"), (F.col("id") + 1).alias("size"), F.lit(1.0 / n).alias("prob"))
    guide = cut(R.guide_table(dist, ["all"], "size"))
    assert guide.agg(F.max(F.size("steps"))).first()[0] <= 4
    rows = spark.range(5_000).withColumn("all", F.lit(0))
    out = R.draw_guided(rows, hash_uniform("id", salt="g"), guide, ["all"], "drawn")
    assert len(out._jdf.queryExecution().toString()) < 40_000
    far = out.withColumn("u", hash_uniform("id", salt="g")).where(F.abs(F.col("drawn") - F.col("u") * n) > 1.001)
    assert out.where("drawn is null").count() == 0 and far.count() == 0
