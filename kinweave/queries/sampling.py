"""Sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import gumbel_sql, uniform_sql
from kinweave.operators import noise as N
from kinweave.operators import relational as R
from kinweave.operators import sampling as S
from kinweave.operators.ordering import with_position
from kinweave.queries.registry import query
from kinweave.queries.star import GRAPH, SPECS, star, table


def customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "o1_sort_by_key",
    """select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) - 1 as position from customer""",
)
def o1(spark, d) -> DataFrame:
    return with_position(customers(spark, d).select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])


@query(
    "o2_sort_by_parent",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, o_orderpriority, o_totalprice,
    row_number() over (order by o_orderstatus, o_orderpriority, o_totalprice, l_orderkey, l_linenumber, l_partkey,
    l_suppkey) as child_id from lineitem join orders on l_orderkey = o_orderkey""",
)
def o2(spark, d) -> DataFrame:
    """Denormalised rows laid out by the parent's columns, then numbered."""
    from kinweave.operators.ordering import dense_ids

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    joined = R.pair_join(lines, "l_orderkey", orders, "o_orderkey")
    order = ["o_orderstatus", "o_orderpriority", "o_totalprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return dense_ids(joined, order, "child_id", start=1)


@query(
    "o3_sample_n",
    f"select c_custkey, c_acctbal from customer order by {uniform_sql('c_custkey', salt='o3')}, c_custkey limit 500",
)
def o3(spark, d) -> DataFrame:
    return S.sample_n(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 500, salt="o3")


@query(
    "o4_draw_with_replacement",
    f"""with r as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as at from orders),
    dr as (select range as draw, floor({uniform_sql('range', salt='o4')} * (select count(*) from orders)) as at
           from range((select count(*) from orders)))
    select draw, o_orderkey, o_totalprice from dr join r on dr.at = r.at""",
)
def o4(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.sample_with_replacement(orders, "o_orderkey", orders.count(), salt="o4")


@query(
    "o5_permutation",
    f"""select o_orderkey, row_number() over (order by {uniform_sql('o_orderkey', salt='o5')}, o_orderkey) - 1
    as position from orders""",
)
def o5(spark, d) -> DataFrame:
    return S.shuffled_order(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", salt="o5")


@query(
    "o7_covering_split",
    f"""with seeds as (select range + 1234 as seed from range(5)),
    placed as (select seed, p_partkey, p_brand, p_type, p_name, row_number() over (partition by seed order by
        (('0x' || substr(md5(concat_ws(':', p_partkey::VARCHAR, 'o7', seed::VARCHAR)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE),
        p_partkey) - 1 as pos from part, seeds),
    n as (select count(*) * 9 // 10 as n_train, count(distinct p_brand) as b, count(distinct p_type) as t,
          count(distinct p_name) as nm from part),
    good as (select min(seed) as seed from (select seed from placed, n where pos < n_train group by seed, b, t, nm
        having count(distinct p_brand) = b and count(distinct p_type) = t and count(distinct p_name) = nm))
    select p_partkey, case when pos < n_train then 'train' else 'test' end as split, seed::INTEGER as seed
    from placed join good using (seed), n""",
)
def o7(spark, d) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    n_train = parts.count() * 9 // 10
    split, seed = S.covering_split(parts, "p_partkey", ["p_brand", "p_type", "p_name"], n_train, salt="o7")
    return split.select("p_partkey", "split", F.lit(seed).alias("seed"))


@query(
    "o7_cover_split",
    f"""with t as (select p_partkey, p_brand, p_type, p_name, {uniform_sql('p_partkey', salt='o7c')} as u from part),
    a as (select arg_min(p_partkey, (u, p_partkey)) as p_partkey from t group by p_name),
    ra as (select t.* from t join a using (p_partkey)),
    b as (select arg_min(p_partkey, (u, p_partkey)) as p_partkey from t where p_type not in (select p_type from ra) group by p_type),
    rb as (select t.* from t join (select * from a union select * from b) using (p_partkey)),
    c as (select arg_min(p_partkey, (u, p_partkey)) as p_partkey from t where p_brand not in (select p_brand from rb) group by p_brand),
    r as (select p_partkey from rb union select * from c),
    o as (select p_partkey, row_number() over (order by (p_partkey not in (select p_partkey from r)), u, p_partkey) as pos from t)
    select p_partkey, case when pos <= (select count(*) // 10 from part) then 'train' else 'test' end as split from o""",
)
def o7_cover(spark, d) -> DataFrame:
    """A train part of a tenth of the rows that holds every name, type and brand, without a retry."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return S.cover_split(parts, "p_partkey", ["p_name", "p_type", "p_brand"], parts.count() // 10, salt="o7c").select("p_partkey", "split")


@query(
    "o8_three_way",
    f"""with t as (select o_orderkey, {uniform_sql('o_orderkey', salt='o8')} as u from orders)
    select o_orderkey, case when u < 0.99 then 'train' when u < 0.995 then 'val' else 'test' end as split from t""",
)
def o8(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    return S.ratio_split(orders, "o_orderkey", {"train": 0.99, "val": 0.005, "test": 0.005}, salt="o8")


@query(
    "o9_stratified",
    f"""with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment
    order by {uniform_sql('c_custkey', salt='o9')}, c_custkey) as rk, count(*) over (partition by c_mktsegment) as n from customer)
    select c_custkey, c_mktsegment, case when rk <= floor(n * 0.8::DOUBLE) then 'train' else 'val' end as split from r""",
)
def o9(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return S.stratified_split(rows, "c_custkey", "c_mktsegment", 0.2, salt="o9")


@query(
    "o10_hold_out",
    f"""with r as (select o_orderkey, row_number() over (order by {uniform_sql('o_orderkey', salt='o10')}, o_orderkey) - 1
    as pos from orders) select o_orderkey, case when pos < (select count(*) // 9 from orders) then 'val' else 'train' end
    as split from r""",
)
def o10(spark, d) -> DataFrame:
    return S.hold_out(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 9, salt="o10")


@query(
    "o11_weighted_draws",
    f"""with w as (select p_partkey, p_size as w, sum(p_size) over (order by p_partkey) as upto from part),
    tot as (select sum(p_size)::DOUBLE as mass, count(*)::DOUBLE as n from part),
    i as (select p_partkey, w, (upto - w) / mass as lo, upto / mass as hi, mass, n from w, tot),
    dr as (select range as draw, {uniform_sql('range', salt='o11')} as u from range((select count(*) from part)))
    select draw, p_partkey, round(mass / (n * w), 9) as importance from dr join i on u >= lo and u < hi""",
)
def o11(spark, d) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    drawn = S.weighted_draws(parts, "p_partkey", "p_size", parts.count(), salt="o11")
    return drawn.select("draw", "p_partkey", F.round("importance", 9).alias("importance"))


@query(
    "o11_weighted_sample",
    f"""select p_partkey, p_size from part
    order by ln(p_size) + {gumbel_sql(uniform_sql('p_partkey', salt='o11b'))} desc, p_partkey limit 150""",
)
def o11_sample(spark, d) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return S.weighted_sample(parts, "p_partkey", F.col("p_size"), 150, salt="o11b")


@query(
    "o12_scaled_rows",
    f"""select range as row_id, round({uniform_sql('range', salt='o12')}, 9) as u
    from range((select (count(*) * 1.5)::BIGINT from customer))""",
)
def o12(spark, d) -> DataFrame:
    """One and a half times the rows of a table, numbered without any shuffle."""
    from kinweave.functions.hashing import hash_uniform

    rows = S.generated_rows(spark, table(spark, d, "customer").count(), 1.5)
    return rows.withColumn("u", F.round(hash_uniform("row_id", salt="o12"), 9))


@query(
    "u2_resplit",
    f"""with t as (select p_partkey, p_type from part where {uniform_sql('p_partkey', salt='u2')} < 0.5
    union all select p_partkey, p_type from part where {uniform_sql('p_partkey', salt='u2')} >= 0.5),
    r as (select *, row_number() over (partition by p_type order by {uniform_sql('p_partkey', salt='u2s')}, p_partkey) as rk,
    count(*) over (partition by p_type) as n from t)
    select p_partkey, p_type, case when rk <= floor(n * 0.8::DOUBLE) then 'train' else 'val' end as split from r""",
)
def u2(spark, d) -> DataFrame:
    """Train and validation put together again and split anew, stratified by class."""
    parts = S.ratio_split(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey", {"train": 0.5, "val": 0.5}, salt="u2")
    both = parts.where("split = 'train'").drop("split").unionByName(parts.where("split = 'val'").drop("split"))
    return S.stratified_split(both, "p_partkey", "p_type", 0.2, salt="u2s")


@query(
    "w8_gumbel",
    f"""with p as (select o_orderkey, case o_orderstatus when 'F' then [0.7, 0.2, 0.1] when 'O' then [0.2, 0.6, 0.2]
    else [0.1, 0.1, 0.8] end as pr from orders),
    s as (select o_orderkey, {', '.join(f"ln(pr[{i + 1}]::DOUBLE) + {gumbel_sql(uniform_sql('o_orderkey', salt=f'w8-{i}'))} as s{i}" for i in range(3))} from p)
    select o_orderkey, case when s0 >= s1 and s0 >= s2 then 'F' when s1 >= s2 then 'O' else 'P' end as drawn from s""",
)
def w8(spark, d) -> DataFrame:
    status = F.col("o_orderstatus")
    probs = (
        F.when(status == "F", F.lit([0.7, 0.2, 0.1]))
        .when(status == "O", F.lit([0.2, 0.6, 0.2]))
        .otherwise(F.lit([0.1, 0.1, 0.8]))
    )
    logs = F.transform(probs, lambda p: F.log(p))
    return table(spark, d, "orders").select(
        "o_orderkey", N.gumbel_choice(["F", "O", "P"], logs, "o_orderkey", salt="w8").alias("drawn")
    )


_CHILD_COUNTS = " union all ".join(
    f"select '{c}' as child, '{p}' as parent, count({fk}) as n from {c}"
    for p, c in GRAPH.relations
    for fk in [SPECS[c].foreign_keys[p]]
)


@query(
    "w9_best_position",
    f"""select child, arg_min(parent, (n, parent)) as smallest_parent, arg_max(parent, (n, parent)) as largest_parent
    from (select child, parent, n // (1 + length(parent)) as n from ({_CHILD_COUNTS})) group by 1""",
)
def w9(spark, d) -> DataFrame:
    """Arg-min and arg-max with an explicit tie-break."""
    from functools import reduce

    data = star(spark, d)
    counts = reduce(
        DataFrame.unionByName,
        [
            data.tables[c].agg(F.count(SPECS[c].foreign_keys[p]).alias("n")).select(
                F.lit(c).alias("child"),
                F.lit(p).alias("parent"),
                F.floor(F.col("n") / (1 + len(p))).cast("bigint").alias("n"),
            )
            for p, c in GRAPH.relations
        ],
    )
    rank = F.struct("n", "parent")
    return counts.groupBy("child").agg(
        F.min_by("parent", rank).alias("smallest_parent"), F.max_by("parent", rank).alias("largest_parent")
    )
