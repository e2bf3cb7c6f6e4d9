"""Sources and sinks: tables written out in each layout and read back."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.clean import discard_incomplete
from kinweave.operators.relational import decode
from kinweave.operators.cluster import label_column
from kinweave.operators.encode import Transformations
from kinweave.plans.synthesis import fit_edges, model_stage
from kinweave.queries.encoding import split_parts
from kinweave.queries.registry import ORACLES, query
from kinweave.queries.star import SPECS, table
from kinweave.session import ensure_checkpoint_dir
from kinweave.sources import tables as T
from kinweave.sources.models import parameters
from kinweave.sources.stages import RunConfig, StageStore, cached_transform
from kinweave.specs import Domain, RelationalDataset, RelationGraph

_FORMS = ("parquet", "json", "csv")


def _folder(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _parts(spark: SparkSession, d: str) -> RelationalDataset:
    spec = SPECS["part"]
    frame = table(spark, d, "part").select("p_partkey", *spec.domain.columns)
    return RelationalDataset({"part": frame}, {"part": spec}, RelationGraph.from_children({"part": []}))


@query(
    "s4_layouts",
    " union all ".join(
        f"select '{layout}' as layout, p_partkey, p_brand, p_type, p_name, p_size, p_retailprice from part" for layout in T.LAYOUTS
    ),
)
def s4_layouts(spark, d) -> DataFrame:
    """The table written in each directory layout and loaded from there with the real types."""
    data = _parts(spark, d)
    found = []
    for layout in T.LAYOUTS:
        root = _folder(spark, f"layout-{layout}")
        T.save_synthetic(data, root, layout, {"part": data.tables["part"].columns})
        found.append(T.load_synthetic(spark, root, data, layout).tables["part"].withColumn("layout", F.lit(layout)))
    return reduce(DataFrame.unionByName, found)


@query(
    "s7_encode",
    """select p_partkey, p_brand, (dense_rank() over (order by p_brand) - 1)::INTEGER as p_brand_code, p_type,
    (dense_rank() over (order by p_type) - 1)::INTEGER as p_type_code, p_size, p_retailprice from part""",
)
def s7_encode(spark, d) -> DataFrame:
    """The label-encoded text file with its dictionaries, read back and decoded."""
    data, folder = _parts(spark, d), _folder(spark, "encoded")
    T.encode_and_save(data.tables["part"], data.specs["part"], folder)
    coded = spark.read.csv(f"{folder}/part.csv", header=True)
    rows = coded.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"), *[F.col(c).cast("int").alias(c) for c in ("p_brand", "p_type", "p_size")],
        F.col("p_retailprice").cast("double").alias("p_retailprice"),
    )
    for c in ("p_brand", "p_type"):
        rows = decode(rows.withColumn(f"{c}_code", F.col(c)), c, spark.read.parquet(f"{folder}/part_dictionaries/{c}"))
    return rows


@query("s8_splits", "select c_custkey, c_mktsegment, c_acctbal from customer where c_custkey % 5 = 1")
def s8_splits(spark, d) -> DataFrame:
    """One part of a stored split; the other folders are pruned."""
    path = _folder(spark, "splits")
    part = F.when(F.col("c_custkey") % 5 == 1, "test").otherwise("train")
    T.save_splits(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").withColumn("split", part), path)
    return T.load_split(spark, path, "test").drop("split")


@query(
    "s9_scores",
    " union all ".join(f"select '{f}' as form, o_orderstatus, count(*) as n, max(o_totalprice) as top from orders group by all" for f in _FORMS),
)
def s9_scores(spark, d) -> DataFrame:
    """Flat score rows stored in every form and read back."""
    scores = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    found = []
    for form in _FORMS:
        path = _folder(spark, f"scores-{form}")
        T.save_scores(scores, path, form)
        reader = spark.read.schema(scores.schema)
        back = reader.csv(path, header=True) if form == "csv" else getattr(reader, form)(path)
        found.append(back.withColumn("form", F.lit(form)))
    return reduce(DataFrame.unionByName, found)


@query("s6_stages", "select p_type, count(*) as n, 1 as reused from part group by 1")
def s6_stages(spark, d) -> DataFrame:
    """A finished stage is read again, not built again."""
    store = StageStore(spark, _folder(spark, "stages"), "digest")
    store.keep("types", lambda: table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")))

    def rebuilt() -> DataFrame:
        raise RuntimeError("the stage was built twice")

    return store.keep("types", rebuilt).withColumn("reused", F.lit(len(store.reused)))


@query("p12_discard", "select p_partkey, p_size::DOUBLE as p_size, p_retailprice from part where p_partkey % 7 <> 0 and p_partkey % 11 <> 0")
def p12_discard(spark, d) -> DataFrame:
    """Rows with a null or a NaN are dropped."""
    parts = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("p_size"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("p_retailprice"),
    )
    return discard_incomplete(parts, ["p_size", "p_retailprice"], max_share=1.0)


# --- fitted models and cached features ------------------------------------------------------------

_LABELS = 4


def labelled_chain(spark: SparkSession, d: str) -> RelationalDataset:
    """Customers, their orders and their lines, with relation labels taken from the parent's key."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": None}
    children = {"customer": ["orders"], "orders": ["lineitem"], "lineitem": []}
    specs, frames = {}, {}
    for t, pk in keys.items():
        df, spec, extra = table(spark, d, t), SPECS[t], {}
        for parent, below in children.items():
            if t == parent:
                extra |= {label_column(t, c): F.col(pk) for c in below}
            if t in below:
                extra[label_column(parent, t)] = F.col(spec.foreign_keys[parent])
        labels = {name: (key % _LABELS).cast("int") for name, key in extra.items()}
        links = {p: fk for p, fk in spec.foreign_keys.items() if t in children.get(p, [])}
        specs[t] = replace(spec, domain=Domain.of([*spec.domain.discrete, *labels], spec.domain.continuous), foreign_keys=links)
        frames[t] = df.withColumns(labels).select(*[c for c in (pk, *links.values()) if c], *specs[t].domain.columns)
    return RelationalDataset(frames, specs, RelationGraph.from_children(children))


def _parameter_sql() -> str:
    """Shares, missing rates, sizes, ends of the quantile grids and rows per label of the three models, by counting."""
    plans = [
        ("None-customer", "customer", None, {"c_mktsegment": "c_mktsegment", "customer_orders_cluster": f"c_custkey % {_LABELS}"}, ["c_acctbal"]),
        (
            "customer-orders", "orders", ("customer_orders_cluster", f"o_custkey % {_LABELS}"),
            {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "orders_lineitem_cluster": f"o_orderkey % {_LABELS}"}, ["o_totalprice"],
        ),
        (
            "orders-lineitem", "lineitem", ("orders_lineitem_cluster", f"l_orderkey % {_LABELS}"),
            {c: c for c in ("l_returnflag", "l_linestatus", "l_linenumber")}, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ),
    ]
    parts = []
    for edge, t, label, discrete, numeric in plans:
        head = f"select '{edge}' as edge"
        for c, x in discrete.items():
            parts.append(
                f"{head}, null::INTEGER as label, '{c}' as \"column\", 'share' as parameter, (row_number() over (order by v) - 1)::INTEGER as position, "
                f"(sum(n) over (order by v))::DOUBLE as value from (select ({x})::VARCHAR as v, count(*) as n from {t} group by 1)"
            )
            parts.append(f"{head}, null, '{c}', 'size', 0, count(distinct ({x}))::DOUBLE from {t}")
            parts.append(f"{head}, null, '{c}', 'gap', 0, 0.0::DOUBLE")
        for c in numeric:
            parts.append(f"{head}, null, '{c}', 'gap', 0, 0.0::DOUBLE")
            parts.append(f"{head}, null, '{c}', 'grid', 0, min({c})::DOUBLE from {t}")
            parts.append(f"{head}, null, '{c}', 'grid', (greatest(201, least(count(*) // 30, 1000)) - 1)::INTEGER, max({c})::DOUBLE from {t}")
        if label:
            parts.append(f"{head}, ({label[1]})::INTEGER, '{label[0]}', 'rows', 0, count(*)::DOUBLE from {t} group by 2")
        else:
            parts.append(f"{head}, 0, null, 'rows', 0, count(*)::DOUBLE from {t}")
    return " union all ".join(f"({p})" for p in parts)


@query("l11_parameters", f"select edge, label, \"column\", parameter, position, round(value, 6) as value from ({_parameter_sql()})")
def l11_parameters(spark, d) -> DataFrame:
    """The models of three edges fitted as stages, and their parameters read back from the stored tables."""
    data = labelled_chain(spark, d)
    store = StageStore(spark, _folder(spark, "models"), RunConfig(workspace="").digest()).for_inputs(data.tables)
    fit_edges(data, store=store)
    found = []
    for parent, child in data.graph.edges:
        rows = parameters(spark, store.path(model_stage(parent, child)))
        # the inner points of a grid are approximate quantiles; its ends are exact
        grids = rows.where((F.col("parameter") == "grid") & F.col("column").isin(data.specs[child].domain.continuous))
        last = grids.groupBy("column").agg(F.max("position").alias("last"))
        ends = grids.join(last, "column").where((F.col("position") == 0) | (F.col("position") == F.col("last"))).drop("last")
        counted = rows.where(F.col("parameter").isin("share", "size", "gap", "rows"))
        found.append(counted.unionByName(ends).withColumn("edge", F.lit(f"{parent}-{child}")))
    return reduce(DataFrame.unionByName, found).withColumn("value", F.round("value", 6))


@query("s10_cached_transform", f"select *, 1 as reused from ({ORACLES['l32_transform_minmax']})")
def s10_cached_transform(spark, d) -> DataFrame:
    """Features transformed once; the second call with the same policy and input reads the stored table."""
    store = StageStore(spark, _folder(spark, "features"), "")
    parts = split_parts(spark, d).select("p_partkey", "split", "p_size", "p_type", "p_retailprice")
    asked = (["p_size"], ["p_type"], "p_retailprice", "regression", Transformations(normalization="minmax"))
    cached_transform(store, parts, *asked)
    out = cached_transform(store, parts, *asked).withColumn("reused", F.lit(len(store.reused)))
    return out.withColumns({"p_size": F.round("p_size", 9), "p_retailprice": F.round("p_retailprice", 6)})
