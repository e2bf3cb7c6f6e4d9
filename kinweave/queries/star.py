"""Roles, keys and relations of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.specs import Domain, RelationalDataset, RelationGraph, TableSpec

CHILDREN = {
    "region": ["nation"],
    "part": ["lineitem"],
    "nation": ["customer", "supplier"],
    "customer": ["orders", "events"],
    "supplier": ["lineitem"],
    "orders": ["lineitem"],
    "events": [],
    "lineitem": [],
}
GRAPH = RelationGraph.from_children(CHILDREN)
SPECS = {
    "region": TableSpec("region", "r_regionkey", Domain.of(["r_name"])),
    "nation": TableSpec("nation", "n_nationkey", Domain.of(["n_name"]), {"region": "n_regionkey"}),
    "customer": TableSpec(
        "customer", "c_custkey", Domain.of(["c_mktsegment"], ["c_acctbal"]), {"nation": "c_nationkey"}
    ),
    "supplier": TableSpec("supplier", "s_suppkey", Domain.of([], ["s_acctbal"]), {"nation": "s_nationkey"}),
    "part": TableSpec("part", "p_partkey", Domain.of(["p_brand", "p_type", "p_name"], ["p_size", "p_retailprice"])),
    "orders": TableSpec(
        "orders",
        "o_orderkey",
        Domain.of(["o_orderstatus", "o_orderpriority"], ["o_totalprice"]),
        {"customer": "o_custkey"},
    ),
    "lineitem": TableSpec(
        "lineitem",
        None,
        Domain.of(
            ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        ),
        {"orders": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"},
    ),
    "events": TableSpec("events", "event_id", Domain.of(["event_type"], ["value"]), {"customer": "user_id"}),
}
# lineitem has no unique key; these four columns name a line, equal lines being interchangeable
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = "concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_key():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_KEY])


def star(spark: SparkSession, sf_dir: str) -> RelationalDataset:
    frames = {t: table(spark, sf_dir, t) for t in SPECS}
    return RelationalDataset(frames, SPECS, GRAPH)
