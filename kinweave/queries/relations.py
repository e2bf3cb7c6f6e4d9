"""Joins along foreign keys, group sizes and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import bound, hash_uniform, uniform_sql
from kinweave.operators import relational as R
from kinweave.queries.registry import query
from kinweave.queries.star import CHILDREN, GRAPH, SPECS, star, table
from kinweave.session import cut

# deterministic stand-in for a fitted cluster of each line
CLUSTERS = 5


def lines_with_cluster(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % CLUSTERS).cast("int").alias("cluster")
    )


COUNTS_CTE = f"""
counts as (select l_orderkey, (l_partkey % {CLUSTERS})::INTEGER as cluster, count(*) as n from lineitem group by 1, 2),
votes as (select l_orderkey, arg_min(cluster, (-n, cluster)) as label, max(n) / sum(n)::DOUBLE as agree_rate,
          sum(n)::BIGINT as group_size from counts group by 1)
"""


def order_labels(spark, d):
    return R.vote(lines_with_cluster(spark, d), "l_orderkey", "cluster")


def labelled_sizes(spark, d):
    """One pass per order: its label and its number of lines."""
    return (
        lines_with_cluster(spark, d)
        .groupBy("l_orderkey")
        .agg(F.mode(F.col("cluster"), True).alias("label"), F.count(F.lit(1)).alias("group_size"))
    )


@query(
    "a5_group_size_by_label",
    f"""with {COUNTS_CTE}, d as (select label, group_size, count(*) as n from votes group by 1, 2)
    select label, group_size, n, round(n / sum(n) over (partition by label)::DOUBLE, 9) as prob from d""",
)
def a5(spark, d) -> DataFrame:
    dist = R.size_distribution(labelled_sizes(spark, d), "label")
    return dist.withColumn("prob", F.round("prob", 9))


@query(
    "a1_group_rows",
    """select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as total, min(o_orderkey) as first_order,
    max(o_orderkey) as last_order from orders group by o_custkey""",
)
def a1(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("o_orderkey").alias("first_order"),
        F.max("o_orderkey").alias("last_order"),
    )


@query(
    "a2_children_per_parent",
    """select o_orderkey, count(l_orderkey) as n_children
    from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
)
def a2(spark, d) -> DataFrame:
    return R.children_per_parent(
        table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey"
    )


@query("a3_group_sizes", "select l_orderkey, count(*) as group_size from lineitem group by 1")
def a3(spark, d) -> DataFrame:
    return R.group_sizes(table(spark, d, "lineitem"), "l_orderkey")


@query(
    "a4_group_size_prob",
    """with s as (select l_orderkey, count(*) as group_size from lineitem group by 1),
    d as (select group_size, count(*) as n from s group by 1)
    select group_size, n, round(n / (select count(*) from s)::DOUBLE, 9) as prob from d""",
)
def a4(spark, d) -> DataFrame:
    dist = R.size_distribution(R.group_sizes(table(spark, d, "lineitem"), "l_orderkey"))
    return dist.withColumn("prob", F.round("prob", 9))


@query("a6_majority_vote", f"with {COUNTS_CTE} select l_orderkey, label from votes")
def a6(spark, d) -> DataFrame:
    return order_labels(spark, d)


@query("a7_agree_rate", f"with {COUNTS_CTE} select l_orderkey, label, round(agree_rate, 9) as agree_rate from votes")
def a7(spark, d) -> DataFrame:
    rates = R.agree_rates(lines_with_cluster(spark, d), "l_orderkey", "cluster")
    return rates.withColumn("agree_rate", F.round("agree_rate", 9))


@query(
    "a7_mean_agree_rate",
    f"with {COUNTS_CTE} select round(avg(agree_rate), 9) as mean_agree_rate, count(*) as n_parents from votes",
)
def a7_mean(spark, d) -> DataFrame:
    rates = R.agree_rates(lines_with_cluster(spark, d), "l_orderkey", "cluster")
    return rates.agg(F.round(F.avg("agree_rate"), 9).alias("mean_agree_rate"), F.count(F.lit(1)).alias("n_parents"))


_PROBS = ", ".join(
    f"avg((1.0::DOUBLE + (l_partkey * {i + 1}) % 7) / w) as p{i}" for i in range(CLUSTERS)
)
_WEIGHT = " + ".join(f"(1.0::DOUBLE + (l_partkey * {i + 1}) % 7)" for i in range(CLUSTERS))
_CUM = [" + ".join(f"p{j}" for j in range(i + 1)) for i in range(CLUSTERS)]
_BELOW = " + ".join(f"({c} < u)::INTEGER" for c in _CUM)


@query(
    "a8_soft_vote",
    f"""with w as (select l_orderkey, l_partkey, {_WEIGHT} as w from lineitem),
    m as (select l_orderkey, {_PROBS} from w group by 1),
    t as (select *, {uniform_sql('l_orderkey', salt='soft')} as u from m)
    select l_orderkey, least({_BELOW}, {CLUSTERS - 1})::INTEGER as label,
    round(greatest({', '.join(f'p{i}' for i in range(CLUSTERS))}), 6) as agree_rate from t""",
)
def a8(spark, d) -> DataFrame:
    raw = F.array(*[F.lit(1.0) + (F.col("l_partkey") * (i + 1)) % 7 for i in range(CLUSTERS)])
    lines = table(spark, d, "lineitem").select("l_orderkey", raw.alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    probs = lines.select("l_orderkey", F.transform("raw", lambda x: x / total).alias("p"))
    out = R.soft_vote(probs, "l_orderkey", "p", CLUSTERS, salt="soft")
    return out.select("l_orderkey", "label", F.round("agree_rate", 6).alias("agree_rate"))


@query(
    "a16_label_domain",
    f"""with {COUNTS_CTE}, top as (select max(label) + 1 as childless from votes),
    p as (select coalesce(label, (select childless from top)) as label
          from orders left join votes on l_orderkey = o_orderkey)
    select count(distinct label) as n_labels, min(label) as low, max(label)::INTEGER as high from p""",
)
def a16(spark, d) -> DataFrame:
    labelled = R.label_parents(table(spark, d, "orders"), "o_orderkey", order_labels(spark, d), "l_orderkey")
    return labelled.agg(
        F.count_distinct("label").alias("n_labels"), F.min("label").alias("low"), F.max("label").alias("high")
    )


@query(
    "j1_denormalise",
    """select l_quantity, l_extendedprice, l_returnflag, o_orderstatus, o_totalprice, o_orderpriority
    from lineitem left join orders on l_orderkey = o_orderkey""",
)
def j1(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return R.denormalise(lines, "l_orderkey", orders, "o_orderkey", drop=["l_orderkey"])


@query(
    "j2_pair_join",
    """select o_orderkey, o_custkey, c_acctbal, c_mktsegment, o_totalprice
    from orders join customer on o_custkey = c_custkey""",
)
def j2(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return R.pair_join(orders, "o_custkey", customers, "c_custkey")


def _edge_list():
    return [(p, c, SPECS[c].foreign_keys[p], SPECS[p].primary_key) for p, c in GRAPH.relations]


@query(
    "j3_integrity",
    " union all ".join(
        f"""select '{p}' as parent, '{c}' as child,
        count(*) filter (where {fk} is not null and not exists (select 1 from {p} where {pk} = {fk})) as orphans,
        count(*) filter (where {fk} is null) as missing from {c}"""
        for p, c, fk, pk in _edge_list()
    ),
)
def j3(spark, d) -> DataFrame:
    data = star(spark, d)
    parts = []
    for p, c, fk, pk in _edge_list():
        owners = data.tables[p].select(F.col(pk).alias(fk), F.lit(True).alias("found"))
        joined = data.tables[c].select(fk).join(owners, fk, "left")
        parts.append(
            joined.agg(
                F.count_if(F.col(fk).isNotNull() & F.col("found").isNull()).alias("orphans"),
                F.count_if(F.col(fk).isNull()).alias("missing"),
            ).select(F.lit(p).alias("parent"), F.lit(c).alias("child"), "orphans", "missing")
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    "j4_chain_join",
    """select r_name as region__r_name, n_name as nation__n_name, c_mktsegment as customer__c_mktsegment,
    c_acctbal as customer__c_acctbal, o_orderstatus as orders__o_orderstatus,
    o_orderpriority as orders__o_orderpriority, o_totalprice as orders__o_totalprice
    from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey""",
)
def j4(spark, d) -> DataFrame:
    return R.chain_join(star(spark, d), ["region", "nation", "customer", "orders"])


@query(
    "j5_path_table_summary",
    """select r_name as region__r_name, s.s_nationkey as nation_key, count(*) as n_lines,
    round(avg(l_quantity), 6) as mean_quantity, round(avg(s_acctbal), 6) as mean_balance
    from lineitem left join supplier s on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey group by 1, 2""",
)
def j5(spark, d) -> DataFrame:
    wide = R.chain_join(
        star(spark, d),
        ["region", "nation", "supplier", "lineitem"],
        {"region": ["r_name"], "supplier": ["s_acctbal", "s_nationkey"], "lineitem": ["l_quantity"]},
    )
    return wide.groupBy("region__r_name", F.col("supplier__s_nationkey").alias("nation_key")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.avg("lineitem__l_quantity"), 6).alias("mean_quantity"),
        F.round(F.avg("supplier__s_acctbal"), 6).alias("mean_balance"),
    )


@query(
    "j6_child_label",
    f"""with {COUNTS_CTE} select l_orderkey, l_partkey, l_linenumber, l_quantity, label
    from lineitem left join votes using (l_orderkey)""",
)
def j6(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return R.label_children(lines, "l_orderkey", order_labels(spark, d))


@query(
    "j7_parent_label",
    f"""with {COUNTS_CTE} select o_orderkey, o_orderstatus,
    coalesce(label, (select max(label) + 1 from votes))::INTEGER as label
    from orders left join votes on l_orderkey = o_orderkey""",
)
def j7(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.label_parents(orders, "o_orderkey", order_labels(spark, d), "l_orderkey")


@query(
    "j14_add_columns",
    """select o_orderkey, o_totalprice, n_children from orders join
    (select o_orderkey, count(l_orderkey) as n_children
     from orders left join lineitem on l_orderkey = o_orderkey group by 1) using (o_orderkey)""",
)
def j14(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    sizes = R.children_per_parent(orders, "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")
    return R.add_columns(orders, sizes, "o_orderkey")


@query(
    "j15_decode",
    """select p_partkey, p_brand, p_type, (dense_rank() over (order by p_brand) - 1)::INTEGER as p_brand_code,
    (dense_rank() over (order by p_type) - 1)::INTEGER as p_type_code from part""",
)
def j15(spark, d) -> DataFrame:
    from kinweave.operators.encode import dictionary, encode

    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    for column in ("p_brand", "p_type"):
        codes = dictionary(parts, column)
        coded = encode(parts, column, codes).withColumn(f"{column}_code", F.col(column).cast("int"))
        parts = R.decode(coded, column, codes)
    return parts


_LABEL_DIST = f"""{COUNTS_CTE}, dist as (select label, group_size, count(*) as n from votes group by 1, 2),
upto as (select label, group_size, sum(n) over (partition by label order by group_size) /
         sum(n) over (partition by label)::DOUBLE as upto from dist)"""


@query(
    "l9_expand_children",
    f"""with {_LABEL_DIST}, top as (select max(label) + 1 as childless from votes),
    p as (select o_orderkey, coalesce(label, (select childless from top))::INTEGER as label,
          {uniform_sql('o_orderkey', salt='size')} as u from orders left join votes on l_orderkey = o_orderkey),
    drawn as (select o_orderkey, p.label, min(group_size) as size from p join upto on p.label = upto.label
              and upto.upto + 1e-12 >= u group by 1, 2)
    select o_orderkey, label, unnest(range(1, size + 1)) as slot from drawn""",
)
def l9(spark, d) -> DataFrame:
    sized = cut(labelled_sizes(spark, d))  # gives both the labels and the distribution
    parents = R.label_parents(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", sized, "l_orderkey")
    dist = R.size_distribution(sized, "label")
    return R.expand_children(parents, "o_orderkey", "label", dist, salt="size")


@query(
    "l14_synthetic_fk",
    f"""with s as (select l_orderkey, count(*) as group_size from lineitem group by 1),
    dist as (select group_size, count(*) as n from s group by 1),
    upto as (select group_size, sum(n) over (order by group_size) / sum(n) over ()::DOUBLE as upto from dist),
    ids as (select range as id, {uniform_sql('range', salt='fk-size')} as u
            from range((select count(*) from lineitem))),
    sized as (select id, min(group_size) as size from ids join upto on upto.upto + 1e-12 >= u group by 1),
    run as (select id, size, sum(size) over (order by id) - size as before from sized),
    kept as (select id as parent_key, unnest(range(1, size + 1)) as copy from run
             where before < (select count(*) from lineitem)),
    ranked as (select parent_key, row_number() over (order by {uniform_sql('parent_key', 'copy', salt='fk-shuffle')},
               parent_key, copy) - 1 as row_id from kept)
    select row_id, parent_key from ranked where row_id < (select count(*) from lineitem)""",
)
def l14(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    dist = R.size_distribution(R.group_sizes(lines, "l_orderkey"))
    return R.synthetic_keys(dist, lines.count(), spark, salt="fk")


_EDGE_VALUES = ", ".join(f"('{p}', '{c}', {o})" for p, cs in CHILDREN.items() for o, c in enumerate(cs))
_TABLE_VALUES = ", ".join(f"('{t}', {o})" for o, t in enumerate(CHILDREN))
_ROW_COUNTS = " union all ".join(f"select '{t}' as t, count(*) as n from {t}" for t in CHILDREN)


@query(
    "m8_relation_order",
    f"""with recursive e(p, c, o) as (values {_EDGE_VALUES}), t(name, o) as (values {_TABLE_VALUES}),
    roots as (select name, o from t where name not in (select c from e)),
    walk(step, ready) as (
        select 0, (select list(name order by o) from roots)
        union all
        select step + 1, list_concat(ready, coalesce((select list(e.c order by e.o) from e where e.p = ready[step + 1]
            and list_has_all(ready[1:step + 1], (select list(f.p) from e f where f.c = e.c))), []::VARCHAR[]))
        from walk where step < len(ready)),
    done as (select ready from walk order by step desc limit 1),
    turn as (select unnest(ready) as name, unnest(range(len(ready))) as k from done),
    n as ({_ROW_COUNTS})
    select (row_number() over (order by a.k nulls first, a.o) - 1)::BIGINT as position, a.parent, a.child, n.n as n_rows
    from (select null::VARCHAR as parent, name as child, -1 as k, o from roots
          union all select e.p, e.c, turn.k, e.o from e join turn on turn.name = e.p) a join n on n.t = a.child""",
)
def m8(spark, d) -> DataFrame:
    """Topological order of the relations next to the rows each step has to produce."""
    data = star(spark, d)
    parts = [
        data.tables[c].agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(p).cast("string").alias("parent"),
            F.lit(c).alias("child"),
            "n_rows",
        )
        for i, (p, c) in enumerate(GRAPH.edges)
    ]
    return reduce(DataFrame.unionByName, parts)


_RELATIONS = ", ".join(f"('{p}', '{c}')" for p, cs in CHILDREN.items() for c in cs)
_COUNTS = " union all ".join(f"select '{t}' as t, count(*) as n from {t}" for t in SPECS)


@query(
    "m9_long_paths",
    f"""with recursive e(p, c) as (values {_RELATIONS}),
    walk(path, last, hops) as (
        select p || '>' || c, c, 1 from e
        union all select path || '>' || e.c, e.c, hops + 1 from walk join e on e.p = walk.last),
    n as ({_COUNTS})
    select path, hops::BIGINT as hops, n.n as bottom_rows from walk join n on n.t = walk.last where hops > 1""",
)
def m9(spark, d) -> DataFrame:
    """Every path of two edges or more with the rows of its joined table."""
    data = star(spark, d)
    sizes = {t: data.tables[t].agg(F.count(F.lit(1)).alias("bottom_rows")) for t in {p[-1] for p in GRAPH.long_paths()}}
    parts = [
        sizes[p[-1]].select(
            F.lit(">".join(p)).alias("path"), F.lit(len(p) - 1).cast("bigint").alias("hops"), "bottom_rows"
        )
        for p in GRAPH.long_paths()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "u4_unused_ids",
    """select o_orderkey from orders except select l_orderkey from lineitem""",
)
def u4(spark, d) -> DataFrame:
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(used, "o_orderkey", "left_anti")


@query(
    "w3_inverse_cdf",
    f"""with s as (select l_orderkey, count(*) as group_size from lineitem group by 1),
    dist as (select group_size, count(*) as n from s group by 1),
    upto as (select group_size, sum(n) over (order by group_size) / sum(n) over ()::DOUBLE as upto from dist)
    select c_custkey, min(group_size) as drawn from
    (select c_custkey, {uniform_sql('c_custkey', salt='w3')} as u from customer)
    join upto on upto.upto + 1e-12 >= u group by 1""",
)
def w3(spark, d) -> DataFrame:
    dist = R.size_distribution(R.group_sizes(table(spark, d, "lineitem"), "l_orderkey"))
    row = R.pack_distribution(dist, None, "group_size").first()
    at = bound(hash_uniform("c_custkey", salt="w3"), lambda u: F.size(F.filter(F.lit(row["upto"]), lambda s: s < u)))
    pick = F.element_at(F.lit(row["values"]), F.least(at + 1, F.lit(len(row["values"]))))
    return table(spark, d, "customer").select("c_custkey", pick.alias("drawn"))
