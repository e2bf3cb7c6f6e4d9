"""Generated rows keep rare, wide and missing categories; SMOTE keeps classes, counts and types."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.operators import synth
from kinweave.operators.knn import distances, knn_join
from kinweave.operators.sampling import cover_split, covering_split
from kinweave.operators.synth import CopulaSynthesizer, SmoteSynthesizer, smote
from kinweave.sources.stages import RunConfig
from kinweave.specs import Domain


def slots(spark, n):
    return spark.range(n).withColumnRenamed("id", "slot_id")


@pytest.mark.parametrize("table", [100_000, 10])
def test_copula_keeps_every_category_and_the_missing_share(spark, monkeypatch, table):
    monkeypatch.setattr(synth, "SHARE_TABLE", table)  # the smaller bound sends the column through the range join
    rows = [(f"v{k % 40}" if k < 2_000 else f"rare{k}", None if k % 4 == 0 else "x", float(k), None) for k in range(2_020)]
    df = spark.createDataFrame(rows, "wide string, holes string, x double, none double")
    domain = Domain.of(["wide", "holes"], ["x", "none"])
    made = CopulaSynthesizer().fit(df, domain).sample(slots(spark, 40_000)).cache()
    counts = Counter(r.wide for r in made.select("wide").collect())
    assert set(counts) == {r[0] for r in rows}
    assert all(abs(counts[f"v{k}"] / 40_000 - 50 / 2_020) < 0.01 for k in range(40))
    holes = made.where("holes is null").count() / 40_000
    assert abs(holes - 0.25) < 0.02 and made.where("none is not null").count() == 0


def test_copula_with_many_labels_agrees_with_few(spark, monkeypatch):
    rows = [(k % 7, float(k % 7) * 10 + k % 3) for k in range(700)]
    df = spark.createDataFrame(rows, "label int, x double")
    ask = slots(spark, 700).withColumn("label", (F.col("slot_id") % 7).cast("int"))
    made = lambda: sorted((r.slot_id, round(r.x, 6)) for r in CopulaSynthesizer().fit(df, Domain.of([], ["x"]), "label").sample(ask).collect())
    few = made()
    monkeypatch.setattr(synth, "MAX_LABELS", 2)
    assert made() == few


def test_smote_classes_types_and_single_rows(spark):
    rows = [(k, k % 5, float(k), "abc"[k % 3], "one" if k == 0 else f"c{k % 2}") for k in range(61)]
    df = spark.createDataFrame(rows, "id long, n int, x double, cat string, cls string")
    made = smote(df, "id", ["n", "x"], ["cat"], "cls", frac=2.0)
    assert dict(made.dtypes)["n"] == "int"
    assert Counter(r.cls for r in made.collect()) == {"one": 2, "c0": 60, "c1": 60}
    assert {(r.n, r.x, r.cat) for r in made.where("cls = 'one'").collect()} == {(0, 0.0, "a")}
    model = SmoteSynthesizer("cls").fit(df.drop("id"), Domain.of(["cat", "cls"], ["n", "x"]))
    got = Counter(r.cls for r in model.sample(slots(spark, 100)).collect())
    assert sum(got.values()) == 100 and got["c0"] in (49, 50) and got["c1"] in (49, 50) and got["one"] in (1, 2)


def test_codes_in_distances_are_one_hot_distances(spark):
    import numpy as np

    q, p = np.array([[1.0, 0], [2.0, -1]]), np.array([[1.0, 0], [0.0, 3], [2.0, -1]])
    assert distances(q, p, "l1+1").tolist() == [[0, 3, 2], [2, 3, 0]]
    assert distances(q, p, "l2+1").tolist() == [[0, 3, 2], [2, 5, 0]]
    rows = spark.createDataFrame([(k, [float(k % 10), float(k % 4)]) for k in range(40)], "id long, v array<double>")
    near = knn_join(rows, rows, "id", "id", "v", "v", 1, "l1+1", exclude_same_id=True).collect()
    for r in near:
        best = min((abs(r.id % 10 - k % 10) + 2 * (r.id % 4 != k % 4), k) for k in range(40) if k != r.id)
        assert (r.distance, r.neighbour_id) == best


def test_covering_split_goes_on_or_says_it_cannot(spark):
    df = spark.createDataFrame([(k, f"v{min(k, 8)}") for k in range(30)], "id long, c string")
    parts, _ = covering_split(df, "id", ["c"], 18, "t")
    assert parts.where("split = 'train'").select("c").distinct().count() == 9 and parts.count() == 30
    with pytest.raises(ValueError):
        covering_split(df, "id", ["c"], 7, "t")


def test_guidance_beyond_one_is_refused():
    with pytest.raises(ValueError):
        RunConfig.from_json('{"general": {"workspace_dir": "w"}, "sampling": {"classifier_scale": 2.0}}')


def test_cover_split_ends_where_seeds_do_not(spark):
    """500 values of one row each among 1,000 rows: a random train part of 60 % covers them with a chance of about 1e-130."""
    rows = [(i, f"v{i}" if i < 500 else "often", "ab"[i % 2], None if i % 3 else "c") for i in range(1_000)]
    df = spark.createDataFrame(rows, "id int, v string, w string, x string")
    parts, seed = covering_split(df, "id", ["v", "w", "x"], 600, "t", attempts=2)
    train = parts.where("split = 'train'")
    assert seed == 1234 and train.count() == 600 and parts.count() == 1_000
    assert train.select("v").distinct().count() == 501 and train.where("x is not null").count() > 0
    assert cover_split(df, "id", ["v"], 501, "t").where("split = 'train'").select("v").distinct().count() == 501
    assert cover_split(df, "id", [], 10, "t").where("split = 'train'").count() == 10
    with pytest.raises(ValueError, match="too small"):
        cover_split(df, "id", ["v"], 500, "t")
