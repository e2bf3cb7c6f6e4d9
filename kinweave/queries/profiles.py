"""Profiles and cleaning over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import hash_uniform, uniform_sql
from kinweave.operators import clean as C
from kinweave.operators import profile as P
from kinweave.operators.encode import categories
from kinweave.operators.ordering import dense_ids
from kinweave.queries.registry import query
from kinweave.queries.star import SPECS, star, table
from kinweave.specs import Domain, TableSpec

DOMAIN_SQL = " union all ".join(
    f"select '{t}' as table_name, '{c}' as \"column\", '{role}' as role, "
    f"(count(distinct {c}) + max(({c} is null)::INTEGER))::BIGINT as size from {t}"
    for t, s in SPECS.items()
    for c, (_, role) in s.domain.columns.items()
)


@query(
    "s1_table_inventory",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows, {len(s.domain.continuous)}::BIGINT as n_numeric, "
        f"{len(s.domain.discrete)}::BIGINT as n_categorical, {len(s.key_columns)}::BIGINT as n_keys from {t}"
        for t, s in SPECS.items()
    ),
)
def s1(spark, d) -> DataFrame:
    data = star(spark, d)
    return reduce(
        DataFrame.unionByName,
        [
            data.tables[t].agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(t).alias("table_name"),
                "n_rows",
                F.lit(len(s.domain.continuous)).cast("bigint").alias("n_numeric"),
                F.lit(len(s.domain.discrete)).cast("bigint").alias("n_categorical"),
                F.lit(len(s.key_columns)).cast("bigint").alias("n_keys"),
            )
            for t, s in SPECS.items()
        ],
    )


@query("m4_domain", DOMAIN_SQL)
def m4(spark, d) -> DataFrame:
    return P.dataset_domains(star(spark, d))


@query(
    "m3_task_types",
    f"""select *, case when role = 'continuous' then 'regression' when size = 2 then 'binclass'
    else 'multiclass' end as task from ({DOMAIN_SQL})""",
)
def m3(spark, d) -> DataFrame:
    return P.task_types(P.dataset_domains(star(spark, d)))


_WIDE = TableSpec("customer", "c_custkey", Domain.of(["c_name", "c_mktsegment"], ["c_acctbal"]))


@query(
    "m7_wide_roles",
    """select 'customer' as table_name, 'c_name' as "column",
    case when count(distinct c_name) >= 1000 then 'continuous' else 'discrete' end as role,
    count(distinct c_name) as size from customer
    union all select 'customer', 'c_mktsegment', 'discrete', count(distinct c_mktsegment) from customer
    union all select 'customer', 'c_acctbal', 'continuous', count(distinct c_acctbal) from customer""",
)
def m7(spark, d) -> DataFrame:
    return P.override_wide_roles(P.domain_table(table(spark, d, "customer"), _WIDE))


_NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "part": ["p_size", "p_retailprice"]}


@query(
    "m5_profile",
    " union all ".join(
        f"select '{c}' as \"column\", min({c})::DOUBLE as min_value, max({c})::DOUBLE as max_value, "
        f"round(max({c})::DOUBLE - min({c})::DOUBLE, 9) as value_range, count(*) filter (where {c} is null) as nulls from {t}"
        for t, cs in _NUMERIC.items()
        for c in cs
    ),
)
def m5(spark, d) -> DataFrame:
    parts = [P.numeric_ranges(table(spark, d, t), cs) for t, cs in _NUMERIC.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("value_range", F.round("value_range", 9))


_CATEGORICAL = {
    "lineitem": ["l_returnflag", "l_linestatus", "l_linenumber"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_brand", "p_type", "p_name"],
}
_COUNTS = " union all ".join(
    f"select '{c}' as \"column\", {c}::VARCHAR as value, count(*) as n from {t} group by 2"
    for t, cs in _CATEGORICAL.items()
    for c in cs
)


@query("m5_category_counts", _COUNTS)
def m5_categories(spark, d) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [P.category_counts(table(spark, d, t), cs) for t, cs in _CATEGORICAL.items()]
    )


@query(
    "m6_key_check",
    " union all ".join(
        [
            f"select '{t}' as table_name, '{s.primary_key}' as key, 'repeated' as kind, "
            f"(select count(*) from (select {s.primary_key} from {t} group by 1 having count(*) > 1)) as violations"
            for t, s in SPECS.items()
            if s.primary_key
        ]
        + [
            f"select '{t}', '{fk}', 'missing', (select count(*) from {t} where {fk} is null) union all "
            f"select '{t}', '{fk}', 'orphan', (select count(*) from {t} where {fk} is not null and {fk} not in "
            f"(select {SPECS[p].primary_key} from {p}))"
            for t, s in SPECS.items()
            for p, fk in s.foreign_keys.items()
        ]
    ),
)
def m6(spark, d) -> DataFrame:
    return P.key_check(star(spark, d))


@query(
    "m10_numeric_first",
    "select l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber from lineitem",
)
def m10(spark, d) -> DataFrame:
    spec = SPECS["lineitem"]
    lines = C.drop_keys(table(spark, d, "lineitem"), spec)
    numeric, categorical = spec.domain.split(lines.columns)
    return lines.select(*numeric, *categorical)


@query(
    "m11_encoder_profile",
    f"""select *, (row_number() over (partition by "column" order by n desc, value) - 1)::INTEGER as code
    from ({_COUNTS}) where "column" in ('l_returnflag', 'l_linestatus', 'l_linenumber')""",
)
def m11(spark, d) -> DataFrame:
    return P.frequency_ranked(table(spark, d, "lineitem"), _CATEGORICAL["lineitem"])


_SPLIT_SQL = f"""case when {uniform_sql('p_partkey', salt='split')} < 0.8 then 'train'
when {uniform_sql('p_partkey', salt='split')} < 0.9 then 'val' else 'test' end"""


def split_parts(spark, d) -> DataFrame:
    u = hash_uniform("p_partkey", salt="split")
    return table(spark, d, "part").withColumn(
        "split", F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test")
    )


PARTS_SQL = f"(select *, {_SPLIT_SQL} as split from part)"


@query(
    "m12_category_sizes",
    " union all ".join(
        f"select split, '{c}' as \"column\", count(distinct {c}) as size from {PARTS_SQL} group by 1"
        for c in ("p_brand", "p_type", "p_name")
    ),
)
def m12(spark, d) -> DataFrame:
    return P.category_sizes(split_parts(spark, d), ["p_brand", "p_type", "p_name"], "split")


@query(
    "m13_integer_like",
    " union all ".join(
        f"select '{c}' as \"column\", count(distinct {c}) as n_distinct, "
        f"count(distinct {c}) <= 50 and bool_and({c} = round({c})) as is_integer_like from {t}"
        for t, cs in _NUMERIC.items()
        for c in cs
    ),
)
def m13(spark, d) -> DataFrame:
    parts = [P.integer_like(table(spark, d, t), cs, limit=50) for t, cs in _NUMERIC.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "m14_split_sizes",
    f"""select split, count(*) as n_rows, 2::BIGINT as n_numeric, 3::BIGINT as n_categorical,
    5::BIGINT as n_features from {PARTS_SQL} group by 1""",
)
def m14(spark, d) -> DataFrame:
    return P.split_sizes(split_parts(spark, d), SPECS["part"], "split")


@query(
    "a9_ranges",
    """select 'o_totalprice' as "column", round(max(o_totalprice) - min(o_totalprice), 6) as value_range from orders
    union all select 'c_acctbal', round(max(c_acctbal) - min(c_acctbal), 6) from customer""",
)
def a9(spark, d) -> DataFrame:
    both = P.numeric_ranges(table(spark, d, "orders"), ["o_totalprice"]).unionByName(
        P.numeric_ranges(table(spark, d, "customer"), ["c_acctbal"])
    )
    return both.select("column", F.round("value_range", 6).alias("value_range"))


@query(
    "a10_class_distribution",
    "select label, count(*) as n, round(count(*) / (select count(*) from embeddings)::DOUBLE, 9) as prob "
    "from embeddings group by 1",
)
def a10(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    return vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("prob", F.round(F.col("n") / n, 9))


@query(
    "a11_split_coverage",
    " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as n_all,
        count(distinct {c}) filter (where split = 'train') as n_part,
        count(distinct {c}) = count(distinct {c}) filter (where split = 'train') as covered from {PARTS_SQL}"""
        for c in ("p_brand", "p_type", "p_name")
    ),
)
def a11(spark, d) -> DataFrame:
    return P.split_coverage(split_parts(spark, d), ["p_brand", "p_type", "p_name"], "split")


@query("p1_drop_keys", "select o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def p1(spark, d) -> DataFrame:
    return C.drop_keys(table(spark, d, "orders"), SPECS["orders"])


@query(
    "p2_sentinels",
    """select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
    case when o_orderpriority = '5-LOW' then 'nan' else o_orderpriority end as o_orderpriority from orders""",
)
def p2(spark, d) -> DataFrame:
    raw = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, C.UNKNOWN)
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "5-LOW", C.UNKNOWN).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return C.sentinels_to_missing(raw, ["o_totalprice"], ["o_orderpriority"])


@query(
    "p3_cast_roles",
    """select p_partkey, try_cast(split_part(p_brand, '#', 2) as double) as brand_number,
    try_cast(p_type as double) as type_number, p_size::VARCHAR as p_size from part""",
)
def p3(spark, d) -> DataFrame:
    raw = table(spark, d, "part").select(
        "p_partkey",
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_number"),
        F.col("p_type").alias("type_number"),
        "p_size",
    )
    return C.cast_roles(raw, ["brand_number", "type_number"], ["p_size"])


@query(
    "p4_codes_to_int",
    f"select p_partkey, round_even(p_size + 2 * {uniform_sql('p_partkey', salt='p4')} - 1, 0)::INTEGER as p_size from part",
)
def p4(spark, d) -> DataFrame:
    noisy = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") + 2 * hash_uniform("p_partkey", salt="p4") - 1).alias("p_size")
    )
    return C.codes_to_int(noisy, ["p_size"])


@query("p5_original_columns", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def p5(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    columns = orders.columns
    return orders.select(*sorted(columns), F.lit(1).alias("cluster")).select(*columns)


# values blanked out by a hash so both engines see the same holes
_HOLES = "case when {u} < 0.1 then null else {c} end"


def _with_holes(spark, d) -> DataFrame:
    parts = split_parts(spark, d)
    hole_n = (hash_uniform("p_partkey", salt="hole-n") < 0.1) & (F.col("split") != "test")
    hole_c = hash_uniform("p_partkey", salt="hole-c") < 0.1
    return parts.select(
        "p_partkey",
        "split",
        F.when(~hole_n, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(~hole_c, F.col("p_type")).alias("p_type"),
    )


_HOLES_SQL = f"""(select p_partkey, split,
case when not ({uniform_sql('p_partkey', salt='hole-n')} < 0.1 and split <> 'test') then p_retailprice end as p_retailprice,
case when not ({uniform_sql('p_partkey', salt='hole-c')} < 0.1) then p_type end as p_type from {PARTS_SQL})"""


@query("p6_drop_missing", f"select * from {_HOLES_SQL} where p_retailprice is not null")
def p6(spark, d) -> DataFrame:
    return C.drop_missing(_with_holes(spark, d), ["p_retailprice"], split="split")


@query(
    "p7_mean_impute",
    f"""with h as {_HOLES_SQL} select p_partkey, split, p_type, round(coalesce(p_retailprice,
    (select avg(p_retailprice) from h where split = 'train')), 6) as p_retailprice from h""",
)
def p7(spark, d) -> DataFrame:
    filled = C.impute_mean(_with_holes(spark, d), ["p_retailprice"], F.col("split") == "train")
    return filled.withColumn("p_retailprice", F.round("p_retailprice", 6))


@query(
    "p8_mode_impute",
    f"""with h as {_HOLES_SQL}, c as (select p_type, count(*) as n from h
    where split = 'train' and p_type is not null group by 1)
    select p_partkey, split, p_retailprice,
    coalesce(p_type, (select arg_min(p_type, (-n, p_type)) from c)) as p_type from h""",
)
def p8(spark, d) -> DataFrame:
    return C.impute_mode(_with_holes(spark, d), ["p_type"], F.col("split") == "train")


@query(
    "p9_rare_collapse",
    f"""with t as {PARTS_SQL}, k as (select round_even(count(*) * 0.015, 0) as least from t where split = 'train'),
    pop as (select p_name from t where split = 'train' group by 1 having count(*) >= (select least from k))
    select p_partkey, case when p_name in (select p_name from pop) then p_name else '__rare__' end as p_name from t""",
)
def p9(spark, d) -> DataFrame:
    parts = split_parts(spark, d).select("p_partkey", "p_name", "split")
    return C.collapse_rare(parts, "p_name", 0.015, F.col("split") == "train").select("p_partkey", "p_name")


@query(
    "p10_clamp",
    """with b as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer where c_mktsegment = 'BUILDING')
    select c_custkey, greatest((select lo from b), least((select hi from b), c_acctbal * 1.2::DOUBLE)) as c_acctbal from customer""",
)
def p10(spark, d) -> DataFrame:
    customers = table(spark, d, "customer")
    limits = P.bounds(customers.where("c_mktsegment = 'BUILDING'"), ["c_acctbal"])
    scaled = customers.select("c_custkey", (F.col("c_acctbal") * 1.2).alias("c_acctbal"))
    return C.clamp_to(scaled, limits)


@query(
    "p11_snap",
    f"""with levels as (select list(distinct l_tax) as lv from lineitem),
    s as (select o_orderkey, {uniform_sql('o_orderkey', salt='snap')} * 0.1::DOUBLE as x from orders)
    select o_orderkey, (select arg_min(v, (abs(v - x), v)) from unnest(lv) as t(v)) as snapped from s, levels""",
)
def p11(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    levels = categories(lines, "l_tax", limit=32)
    x = hash_uniform("o_orderkey", salt="snap") * 0.1
    return table(spark, d, "orders").select("o_orderkey", C.snap(x, levels).alias("snapped"))


@query(
    "p13_stack_columns",
    "select p_partkey, p_size, p_retailprice, p_brand, p_type from part",
)
def p13(spark, d) -> DataFrame:
    from kinweave.operators.relational import add_columns

    parts = table(spark, d, "part")
    return add_columns(
        parts.select("p_partkey", "p_size", "p_retailprice"), parts.select("p_partkey", "p_brand", "p_type"), "p_partkey"
    )


@query(
    "p14_dense_ids",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() over
    (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as line_id from lineitem""",
)
def p14(spark, d) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return dense_ids(table(spark, d, "lineitem").select(*columns), columns, "line_id")


@query(
    "p15_first_per_key",
    """select user_id, event_id, event_type, value from (select *, row_number() over
    (partition by user_id order by event_id) as rn from events) where rn = 1""",
)
def p15(spark, d) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return C.first_per_key(events, "user_id", ["event_id"])


@query(
    "u1_union_dictionary",
    """select value, count(*) as n from (select o_orderpriority as value from orders
    union all select case when o_orderkey % 11 = 0 then 'NEW' else o_orderpriority end from orders) group by 1""",
)
def u1(spark, d) -> DataFrame:
    real = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("value"))
    fake = real.withColumn("value", F.when(F.col("o_orderkey") % 11 == 0, "NEW").otherwise(F.col("value")))
    return real.unionByName(fake).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u3_new_columns",
    """select c_custkey, c_acctbal, c_mktsegment, n_name from customer join nation on c_nationkey = n_nationkey""",
)
def u3(spark, d) -> DataFrame:
    """Columns a child gains from its second parent, shared columns kept once."""
    from kinweave.operators.relational import add_columns

    customers = table(spark, d, "customer")
    first = customers.select("c_custkey", "c_acctbal", "c_mktsegment")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    second = customers.join(nations, "c_nationkey").select("c_custkey", "c_mktsegment", "n_name")
    return add_columns(first, second, "c_custkey")
