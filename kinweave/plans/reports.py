"""Reports: all fidelity scores of a dataset, and per-table quality scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import fidelity as Q
from kinweave.operators.clean import codes_to_int
from kinweave.operators.learn import FULL_GRID, all_efficacies, detection_score
from kinweave.operators.predict import efficacy_summary
from kinweave.operators.privacy import alpha_beta, coded_features
from kinweave.operators.profile import infer_domain
from kinweave.operators.sampling import equalise
from kinweave.operators.ordering import with_position
from kinweave.sources.stages import StageStore
from kinweave.sources.tables import save_scores, save_summary
from kinweave.specs import RelationalDataset


def align_types(real: RelationalDataset, fake: RelationalDataset) -> RelationalDataset:
    """Synthetic whole-number categories get the type of the real column."""
    tables = {}
    for t, spec in real.specs.items():
        whole = [c for c in spec.domain.discrete if real.tables[t].schema[c].dataType.typeName() in ("integer", "long", "short", "byte")]
        tables[t] = codes_to_int(fake.tables[t], whole) if whole else fake.tables[t]
    return fake.replacing(tables)


def multi_table_report(
    real: RelationalDataset, fake: RelationalDataset, store: StageStore | None = None
) -> dict[str, DataFrame]:
    """Shapes, cardinality, coverage, trends per hop and their averages, each as flat rows."""
    if store is not None:
        store = store.for_inputs({f"{kind}/{t}": df for kind, data in (("real", real), ("fake", fake)) for t, df in data.tables.items()})
    fake = align_types(real, fake)
    keep = store.keep if store is not None else (lambda name, build: build())
    trends = keep("report/trends", lambda: Q.trend_scores(real, fake))
    covered = None
    for t in real.graph.tables:
        if real.specs[t].domain.columns:
            part = Q.coverage(real, fake, t)
            covered = part if covered is None else covered.unionByName(part)
    return {
        "shapes": keep("report/shapes", lambda: Q.column_shapes(real, fake)),
        "cardinality": keep("report/cardinality", lambda: Q.cardinality_shapes(real, fake)),
        "coverage": keep("report/coverage", lambda: covered),
        "trends": trends,
        "averages": keep("report/averages", lambda: Q.hop_averages(trends)),
    }


def single_table_report(
    real: RelationalDataset,
    fake: RelationalDataset,
    table: str,
    test: DataFrame | None = None,
    sample_size: int | None = None,
    grid: Sequence[dict] = tuple(FULL_GRID),
    store: StageStore | None = None,
) -> DataFrame:
    """(table_name, metric, value); single-column tables get the detection score only.

    The neighbour-based scores compare equally many rows of both tables, at most ``sample_size`` where it is given.
    """
    spark = real.tables[table].sparkSession

    def build() -> DataFrame:
        spec = real.specs[table]
        columns = list(spec.domain.columns)
        r, f = real.tables[table].select(*columns), fake.tables[table].select(*columns).dropna()
        rows: list[tuple[str, str, float]] = []
        if len(columns) > 1:
            keyed = [with_position(df, columns, position="row_id") for df in (r.dropna(), f)]
            left, right, _ = equalise(keyed[0], keyed[1], "row_id", sample_size if sample_size is not None else 1 << 62, salt="alpha-beta")
            numeric, categorical = spec.domain.split(columns)
            vectors, codes = coded_features([left, right], "row_id", numeric, categorical, None)
            scores = alpha_beta(*vectors, "row_id", codes=int(codes or 0))
            rows += [(table, name, float(v)) for name, v in scores.items()]
            if test is not None and test.limit(1).count():
                sized = infer_domain(r, spec)
                summary = efficacy_summary(all_efficacies(f, test.select(*columns), sized, grid))
                for s in summary.collect():
                    rows.append((table, f"efficacy_{s['kind']}", float(s["mean"])))
        rows.append((table, "detection", float(detection_score(r, f, spec.domain))))
        return spark.createDataFrame(rows, "table_name string, metric string, value double")

    if store is None:
        return build()
    inputs = {"real": real.tables[table], "fake": fake.tables[table], **({"test": test} if test is not None else {})}
    return store.for_inputs(inputs).keep(f"report/single/{table}", build)


def save_report(report: dict[str, DataFrame] | DataFrame, folder: str, form: str = "parquet") -> dict[str, float]:
    """Every score table of a report as flat rows, and ``summary``: the mean of each metric as one JSON object."""
    tables = report if isinstance(report, dict) else {"scores": report}
    for name, scores in tables.items():
        save_scores(scores, f"{folder}/{name}", form)
    spark, means = next(iter(tables.values())).sparkSession, {}
    for name, scores in tables.items():
        kinds = [c for c in ("metric", "hop") if c in scores.columns]
        figures = [f.name for f in scores.schema if f.dataType.typeName() == "double" and f.name in ("score", "value", "coverage", "mean")]
        for figure in figures:
            for r in scores.groupBy(*kinds).agg(F.avg(figure).alias("mean")).collect():  # one row per metric
                means["/".join([name, *[f"{r[k]}" for k in kinds], figure])] = r["mean"]
    save_summary(spark, means, f"{folder}/summary")
    return means


def report_averages(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
