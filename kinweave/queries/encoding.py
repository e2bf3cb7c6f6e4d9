"""Encoders, scalers, noise and divergences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import columns as K
from kinweave.functions.hashing import hash_uniform, normal_sql, uniform_sql
from kinweave.operators import encode as E
from kinweave.operators import noise as N
from kinweave.operators.profile import bounds, frequency_ranked, moments
from kinweave.queries.profiles import PARTS_SQL, split_parts
from kinweave.queries.registry import query
from kinweave.queries.star import LINE_KEY_SQL, line_key, table


@query(
    "w1_label_encode",
    """select p_partkey, (dense_rank() over (order by p_brand) - 1)::INTEGER as p_brand,
    (dense_rank() over (order by p_name) - 1)::INTEGER as p_name, (dense_rank() over (order by p_size) - 1)::INTEGER as p_size
    from part""",
)
def w1(spark, d) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    out = parts
    for column in ("p_brand", "p_name", "p_size"):
        out = E.encode(out, column, E.dictionary(parts, column))
    return out


@query(
    "w1_wide_dictionary",
    "select c_custkey, dense_rank() over (order by c_name) - 1 as code from customer",
)
def w1_wide(spark, d) -> DataFrame:
    """A dictionary past the driver limit is numbered on the cluster."""
    people = table(spark, d, "customer").select("c_custkey", "c_name")
    coded = E.encode(people, "c_name", E.dictionary(people, "c_name", limit=100))
    return coded.select("c_custkey", F.col("c_name").cast("bigint").alias("code"))


@query(
    "w2_ordinal_unseen",
    f"""with t as (select p_partkey, p_retailprice, split from {PARTS_SQL}),
    dict as (select p_retailprice, (row_number() over (order by p_retailprice) - 1)::INTEGER as code
             from (select distinct p_retailprice from t where split = 'train'))
    select p_partkey, split, coalesce(code, (select max(code) + 1 from dict))::INTEGER as p_retailprice
    from t left join dict using (p_retailprice)""",
)
def w2(spark, d) -> DataFrame:
    parts = split_parts(spark, d).select("p_partkey", "p_retailprice", "split")
    return E.ordinal_encode(parts, "p_retailprice", F.col("split") == "train")


@query(
    "w4_normal_score_order",
    """select c_custkey, dense_rank() over (order by c_acctbal) as rank from customer""",
)
def w4(spark, d) -> DataFrame:
    """Normal scores alone order the rows as their values do."""
    from kinweave.operators.ordering import with_position

    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    n = min(1000, people.count())
    grid = E.quantile_grid(people, ["c_acctbal"], n)["c_acctbal"]
    scored = people.withColumn("score", E.quantile_normal(F.col("c_acctbal"), grid))
    ranked = with_position(scored.select("score").distinct(), ["score"])
    return scored.join(ranked, "score").select("c_custkey", (F.col("position") + 1).alias("rank"))


@query("w4_round_trip", "select c_custkey, true as close from customer")
def w4_round_trip(spark, d) -> DataFrame:
    """Scores mapped back land on the value they came from, within one grid step."""
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    grid = E.quantile_grid(people, ["c_acctbal"], min(1000, people.count()))["c_acctbal"]
    back = E.quantile_normal_inverse(E.quantile_normal(F.col("c_acctbal"), grid), grid)
    step = max(b - a for a, b in zip(grid, grid[1:]))
    return people.select("c_custkey", (F.abs(back - F.col("c_acctbal")) <= step * 1e-3 + 1e-6).alias("close"))


@query(
    "w6_topk_accuracy",
    f"""with s as (select vec_id, label, unnest(range(10)) as cls, unnest(embedding[1:10]) as score from embeddings),
    r as (select vec_id, label, cls, row_number() over (partition by vec_id order by score desc, cls) as rk from s)
    select label, round(avg((rk <= 3)::INTEGER), 9) as top3, round(avg((rk <= 1)::INTEGER), 9) as top1, count(*) as n
    from r where cls = label group by 1""",
)
def w6(spark, d) -> DataFrame:
    from kinweave.operators.predict import top_k_hit

    v = table(spark, d, "embeddings")
    scores = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    hits = v.select("label", *[top_k_hit(scores, F.col("label"), k).alias(f"h{k}") for k in (1, 3)])
    return hits.groupBy("label").agg(
        F.round(F.avg("h3"), 9).alias("top3"), F.round(F.avg("h1"), 9).alias("top1"), F.count(F.lit(1)).alias("n")
    )


@query(
    "w7_leave_one_out",
    f"""with t as {PARTS_SQL}, s as (select p_name, sum(p_retailprice) as s, count(*) as n from t where split = 'train' group by 1),
    g as (select avg(p_retailprice) as m from t where split = 'train')
    select p_partkey, split, round(coalesce(case when split = 'train' then
        case when n > 1 then (s - p_retailprice) / (n - 1) end else s / n end, m), 6) as encoded
    from t left join s using (p_name), g""",
)
def w7(spark, d) -> DataFrame:
    parts = split_parts(spark, d).select("p_partkey", "p_name", "p_retailprice", "split")
    out = E.leave_one_out(parts, "p_name", "p_retailprice", F.col("split") == "train", "encoded")
    return out.select("p_partkey", "split", F.round("encoded", 6).alias("encoded"))


def _dated(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyMMdd").alias("day"))


@query(
    "f1_days_since",
    "select o_orderkey, date_diff('day', (select min(o_orderdate::DATE) from orders), o_orderdate::DATE)::INTEGER as days from orders",
)
def f1(spark, d) -> DataFrame:
    dated, _ = K.days_since_earliest(_dated(spark, d), "day", "days")
    return dated.select("o_orderkey", "days")


@query("f2_rebuild_date", "select o_orderkey, strftime(o_orderdate, '%y%m%d') as day from orders")
def f2(spark, d) -> DataFrame:
    dated, earliest = K.days_since_earliest(_dated(spark, d), "day", "days")
    return dated.select("o_orderkey", K.rebuild_date(F.col("days"), earliest).alias("day"))


@query(
    "f3_packed_birth",
    """select o_orderkey, (year(o_orderdate) % 100)::INTEGER as year, month(o_orderdate)::INTEGER as month,
    day(o_orderdate)::INTEGER as day, (o_custkey % 2)::INTEGER as gender from orders""",
)
def f3(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    month = F.month("o_orderdate") + F.when(F.col("o_custkey") % 2 == 1, 50).otherwise(0)
    number = F.concat(
        F.date_format("o_orderdate", "yy"), F.lpad(month.cast("string"), 2, "0"), F.date_format("o_orderdate", "dd")
    )
    return orders.select("o_orderkey", K.packed_birth(number).alias("b")).select("o_orderkey", "b.*")


_B = "(select min({c})::DOUBLE from {t})", "(select max({c})::DOUBLE from {t})"


def _lohi(c: str, t: str) -> tuple[str, str]:
    return _B[0].format(c=c, t=t), _B[1].format(c=c, t=t)


_LO, _HI = _lohi("o_totalprice", "orders")


@query(
    "f4_minmax",
    f"""with b as (select {_LO} as lo, {_HI} as hi),
    s as (select o_orderkey, (o_totalprice - lo) / (hi - lo) * 2.0::DOUBLE - 1 as x, lo, hi from orders, b)
    select o_orderkey, round(x, 9) as scaled, round((x + 1) / 2 * (hi - lo) + lo, 4) as restored from s""",
)
def f4(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    lo, hi = bounds(orders, ["o_totalprice"])["o_totalprice"]
    scaled = orders.select("o_orderkey", E.minmax(F.col("o_totalprice"), lo, hi).alias("x"))
    return scaled.select(
        "o_orderkey",
        F.round("x", 9).alias("scaled"),
        F.round(E.minmax_inverse(F.col("x"), lo, hi), 4).alias("restored"),
    )


@query(
    "f5_standardise",
    """with m as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders)
    select o_orderkey, round((o_totalprice - m) / s, 6) as z, round(o_totalprice, 2) as restored from orders, m""",
)
def f5(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    m, s = moments(orders, ["o_totalprice"])["o_totalprice"]
    z = E.standardise(F.col("o_totalprice"), m, s)
    return orders.select(
        "o_orderkey", F.round(z, 6).alias("z"), F.round(E.standardise_inverse(z, m, s), 2).alias("restored")
    )


@query(
    "f6_target_scale",
    f"""with t as {PARTS_SQL}, m as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from t where split = 'train')
    select p_partkey, split, round((p_retailprice - m) / s, 6) as target from t, m""",
)
def f6(spark, d) -> DataFrame:
    parts = split_parts(spark, d)
    m, s = moments(parts.where("split = 'train'"), ["p_retailprice"])["p_retailprice"]
    return parts.select("p_partkey", "split", F.round(E.standardise(F.col("p_retailprice"), m, s), 6).alias("target"))


@query(
    "f7_efficacy_scale",
    """with b as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer),
    p as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
    select o_orderkey, round(case when p.lo >= 0 and p.hi >= 1000 then ln(greatest(o_totalprice, 0.01))
      else (o_totalprice - p.lo) / (p.hi - p.lo) * 5 end, 9) as price,
    round(case when b.lo >= 0 and b.hi >= 1000 then ln(greatest(c_acctbal, 0.01))
      else (c_acctbal - b.lo) / (b.hi - b.lo) * 5 end, 9) as balance
    from orders join customer on o_custkey = c_custkey, b, p""",
)
def f7(spark, d) -> DataFrame:
    orders, people = table(spark, d, "orders"), table(spark, d, "customer")
    p = bounds(orders, ["o_totalprice"])["o_totalprice"]
    b = bounds(people, ["c_acctbal"])["c_acctbal"]
    joined = orders.join(people.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return joined.select(
        "o_orderkey",
        F.round(E.efficacy_scale(F.col("o_totalprice"), *p), 9).alias("price"),
        F.round(E.efficacy_scale(F.col("c_acctbal"), *b), 9).alias("balance"),
    )


@query(
    "f8_one_hot_long",
    """select o_orderkey, p as category, (p = o_orderpriority)::DOUBLE as hot
    from orders, (select distinct o_orderpriority as p from orders)""",
)
def f8(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    values = E.categories(orders, "o_orderpriority")
    hot = E.one_hot(F.col("o_orderpriority"), values)
    return orders.select("o_orderkey", F.posexplode(hot).alias("at", "hot")).select(
        "o_orderkey", F.element_at(F.lit(values), F.col("at") + 1).alias("category"), "hot"
    )


@query("f8_one_hot_inverse", "select o_orderkey, o_orderpriority from orders")
def f8_inverse(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    values = E.categories(orders, "o_orderpriority")
    hot = E.one_hot(F.col("o_orderpriority"), values)
    return orders.select("o_orderkey", E.from_one_hot(hot, values).alias("o_orderpriority"))


@query(
    "f9_width_guard",
    """select 'c_name' as "column", count(distinct c_name) as size, count(distinct c_name) <= 1000 as kept from customer
    union all select 'c_mktsegment', count(distinct c_mktsegment), count(distinct c_mktsegment) <= 1000 from customer""",
)
def f9(spark, d) -> DataFrame:
    people = table(spark, d, "customer")
    kept = E.narrow_categories(people, ["c_name", "c_mktsegment"])
    sizes = people.agg(F.count_distinct("c_name").alias("a"), F.count_distinct("c_mktsegment").alias("b"))
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(s).alias("size"), F.lit(c in kept).alias("kept"))
            for c, s in (("c_name", "a"), ("c_mktsegment", "b"))
        ]
    )
    return sizes.select(F.inline(rows))


@query(
    "f10_gan_scale",
    """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
    f as (select l_returnflag, row_number() over (order by count(*) desc, l_returnflag) - 1 as code from lineitem group by 1),
    s as (select l_orderkey, l_partkey, l_linenumber, code, ((l_extendedprice - lo) / (hi - lo)) * 2.0::DOUBLE - 1 as x, lo, hi
          from lineitem join f using (l_returnflag), b)
    select l_orderkey, l_partkey, l_linenumber, code::INTEGER as code, round(x, 9) as scaled,
    round(greatest(0, least(1, (x * 1.5::DOUBLE + 1) / 2)) * (hi - lo) + lo, 4) as restored from s""",
)
def f10(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    lo, hi = bounds(lines, ["l_extendedprice"])["l_extendedprice"]
    codes = frequency_ranked(lines, ["l_returnflag"]).select("value", "code")
    scaled = E.encode(
        lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice"), "l_returnflag", codes, "code"
    ).withColumn("x", E.gan_scale(F.col("l_extendedprice"), lo, hi))
    return scaled.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("code").cast("int").alias("code"),
        F.round("x", 9).alias("scaled"),
        F.round(E.gan_scale_inverse(F.col("x") * 1.5, lo, hi), 4).alias("restored"),
    )


@query("f11_log_clip", "select o_orderkey, round(ln(greatest(1, least(20000, o_totalprice))), 9) as target from orders")
def f11(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(K.log_clip(F.col("o_totalprice")), 9).alias("target")
    )


@query(
    "f12_scores_to_labels",
    """with s as (select vec_id, embedding[1:4] as e from embeddings),
    p as (select vec_id, e, [exp(x - list_max(e)::DOUBLE) for x in e] as r from s),
    q as (select vec_id, e, [x / list_sum(r) for x in r] as pr from p)
    select vec_id, (list_position(e, list_max(e)) - 1)::INTEGER as label, round(list_max(pr), 6) as confidence,
    round(1 / (1 + exp(-e[1]::DOUBLE)), 6) as binary_probability,
    round_even(1 / (1 + exp(-e[1]::DOUBLE)), 0) as binary_label from q""",
)
def f12(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select(
        "vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("scores")
    )
    p = v.withColumn("p", N.softmax(F.col("scores"))).withColumn("b", N.sigmoid(F.col("scores")[0]))
    return p.select(
        "vec_id",
        N.label_of(F.col("p")).alias("label"),
        F.round(F.array_max("p"), 6).alias("confidence"),
        F.round("b", 6).alias("binary_probability"),
        K.round_half_even(F.col("b")).alias("binary_label"),
    )


@query(
    "f13_round_half_even",
    "select l_orderkey, l_partkey, l_linenumber, round_even(l_quantity / 2, 0) as half from lineitem",
)
def f13(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", K.round_half_even(F.col("l_quantity") / 2).alias("half")
    )


NOISY_PRICE = f"(o_totalprice * (0.9 + 0.2::DOUBLE * {uniform_sql('o_orderkey', salt='price')}))"


@query(
    "f14_gaussian_kl",
    f"""with r as (select avg(o_totalprice) as m1, ln(var_pop(o_totalprice)) as v1, avg({NOISY_PRICE}) as m2,
    ln(var_pop({NOISY_PRICE})) as v2 from orders)
    select 'o_totalprice' as "column", round(0.5 * (-1 + v2 - v1 + exp(v1 - v2) + (m1 - m2) * (m1 - m2) * exp(-v2)), 9) as kl from r""",
)
def f14(spark, d) -> DataFrame:
    real = table(spark, d, "orders")
    noisy = F.col("o_totalprice") * (0.9 + 0.2 * hash_uniform("o_orderkey", salt="price"))
    drift = N.column_drift(real, real.withColumn("o_totalprice", noisy), ["o_totalprice"])
    return drift.withColumn("kl", F.round("kl", 9))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRIORITY_LIST = "['" + "', '".join(PRIORITIES) + "']"


def response_sql(value: str, values: str, n: int, alpha: str, *keys: str, salt: str) -> str:
    keep, pick = uniform_sql(*keys, salt=salt), uniform_sql(*keys, salt=salt, part=1)
    return f"(case when {keep} < {alpha} then {value} else ({values})[floor({pick} * {n})::BIGINT + 1] end)"


_RESPONSE = response_sql("o_orderpriority", _PRIORITY_LIST, 5, "0.7", "o_orderkey", salt="f18")


@query(
    "f15_categorical_kl",
    f"""with r as (select o_orderpriority as v, count(*) as n from orders where o_orderstatus = 'F' group by 1),
    s as (select o_orderpriority as v, count(*) as n from orders where o_orderstatus <> 'F' group by 1),
    j as (select greatest(coalesce(r.n, 0) / (select sum(n) from r)::DOUBLE, 1e-9) as p,
          greatest(coalesce(s.n, 0) / (select sum(n) from s)::DOUBLE, 1e-9) as q from r full join s on r.v = s.v)
    select round(sum(p * (ln(p) - ln(q))), 9) as kl from j""",
)
def f15(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    kl = N.categorical_kl(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "o_orderpriority")
    return kl.withColumn("kl", F.round("kl", 9))


@query(
    "f16_normal_cdf",
    """with m as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer),
    z as (select c_custkey, (c_acctbal - m) / s as z from customer, m)
    select c_custkey, round(0.5 * (1 + tanh(sqrt(2 / pi()) * (z + 0.044715 * pow(z, 3)))), 6) as p from z""",
)
def f16(spark, d) -> DataFrame:
    people = table(spark, d, "customer")
    m, s = moments(people, ["c_acctbal"])["c_acctbal"]
    z = E.standardise(F.col("c_acctbal"), m, s)
    return people.select("c_custkey", F.round(N.normal_cdf_tanh(z), 6).alias("p"))


STEPS = 200
_BAR = "pow(cos((({x}) + 0.008) / 1.008 * (pi() / 2)), 2)"
_SCHEDULE = f"""b as (select range as t, least(1 - {_BAR.format(x=f'(range + 1) / {STEPS}.0')} / {_BAR.format(x=f'range / {STEPS}.0')}, 0.999)
as beta from range({STEPS})), sched as (select t, beta, exp(sum(ln(1 - beta)) over (order by t)) as bar from b)"""


@query(
    "f17_noise",
    f"""with {_SCHEDULE}, m as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders),
    z as (select o_orderkey, (o_totalprice - m) / s as z, floor({uniform_sql('o_orderkey', salt='t')} * {STEPS})::BIGINT as t
          from orders, m)
    select o_orderkey, t, round(sqrt(bar) * z + sqrt(1 - bar) * {normal_sql('o_orderkey', salt='f17')}, 6) as noisy
    from z join sched using (t)""",
)
def f17(spark, d) -> DataFrame:
    """W5 + F17: every row gets a step of the cosine schedule and its share of noise."""
    orders = table(spark, d, "orders")
    m, s = moments(orders, ["o_totalprice"])["o_totalprice"]
    steps = N.schedule(spark, STEPS, "cosine").select("t", "alpha_bar")
    t = F.floor(hash_uniform("o_orderkey", salt="t") * STEPS).cast("bigint")
    rows = orders.select("o_orderkey", E.standardise(F.col("o_totalprice"), m, s).alias("z"), t.alias("t"))
    noisy = N.gaussian_noise(F.col("z"), F.col("alpha_bar"), "o_orderkey", salt="f17")
    return rows.join(steps, "t").select("o_orderkey", "t", F.round(noisy, 6).alias("noisy"))


@query("f18_randomised_response", f"select o_orderkey, {_RESPONSE} as o_orderpriority from orders")
def f18(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    values = E.categories(orders, "o_orderpriority")
    drawn = N.randomised_response(F.col("o_orderpriority"), values, 0.7, "o_orderkey", salt="f18")
    return orders.select("o_orderkey", drawn.alias("o_orderpriority"))


@query(
    "f18_noised_probabilities",
    f"""with {_SCHEDULE}, r as (select o_orderkey, o_orderpriority, floor({uniform_sql('o_orderkey', salt='t')} * {STEPS})::BIGINT as t from orders)
    select o_orderkey, p as category, round(bar * (p = o_orderpriority)::INTEGER + (1 - bar) / 5, 9) as probability
    from r join sched using (t), (select unnest({_PRIORITY_LIST}) as p)""",
)
def f18_probabilities(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    values = E.categories(orders, "o_orderpriority")
    t = F.floor(hash_uniform("o_orderkey", salt="t") * STEPS).cast("bigint")
    rows = orders.select("o_orderkey", "o_orderpriority", t.alias("t"))
    noised = rows.join(N.schedule(spark, STEPS).select("t", "alpha_bar"), "t")
    p = N.category_probabilities(F.col("o_orderpriority"), values, F.col("alpha_bar"))
    return noised.select("o_orderkey", F.posexplode(p).alias("at", "p")).select(
        "o_orderkey", F.element_at(F.lit(values), F.col("at") + 1).alias("category"), F.round("p", 9).alias("probability")
    )


@query(
    "f19_log_sum_exp",
    """select l_returnflag, l_linestatus, round(m + ln(sum(exp(x - m))), 6) as log_sum_exp from
    (select l_returnflag, l_linestatus, l_quantity * 20 as x, max(l_quantity * 20) over (partition by l_returnflag, l_linestatus) as m
     from lineitem) group by l_returnflag, l_linestatus, m""",
)
def f19(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") * 20).alias("x"))
    out = N.log_sum_exp(lines, ["l_returnflag", "l_linestatus"], "x")
    return out.withColumn("log_sum_exp", F.round("log_sum_exp", 6))


@query(
    "f20_vector_distance",
    """with c as (select label, embedding as e from embeddings e1 where vec_id = (select min(vec_id) from embeddings e2 where e2.label = e1.label))
    select vec_id, round(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(embedding, e)]), 4) as squared_l2,
    round(list_sum([abs(x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(embedding, e)]), 4) as l1
    from embeddings join c using (label)""",
)
def f20(spark, d) -> DataFrame:
    """Distance of every vector to the first vector of its class."""
    v = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    j = v.join(first, "label")
    return j.select(
        "vec_id",
        F.round(N.squared_l2(F.col("embedding"), F.col("e")), 4).alias("squared_l2"),
        F.round(N.l1_distance(F.col("embedding"), F.col("e")), 4).alias("l1"),
    )


@query(
    "f21_code_noise",
    f"""with c as (select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as code from orders)
    select o_orderkey, round(code + 0.25 * {normal_sql('o_orderkey', salt='f21')}, 6) as code from c""",
)
def f21(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    coded = E.encode(orders, "o_orderpriority", E.dictionary(orders, "o_orderpriority"), "code")
    return coded.select("o_orderkey", F.round(N.code_noise(F.col("code"), 0.25, "o_orderkey", salt="f21"), 6).alias("code"))


@query(
    "f17_line_noise",
    f"""with m as (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s from lineitem),
    z as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice - m) / s as z from lineitem, m)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(sqrt(0.9::DOUBLE) * z + sqrt(1 - 0.9::DOUBLE) * {normal_sql(LINE_KEY_SQL, salt='line')}, 5) as noisy from z""",
)
def f17_lines(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    m, s = moments(lines, ["l_extendedprice"])["l_extendedprice"]
    z = E.standardise(F.col("l_extendedprice"), m, s)
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(N.gaussian_noise(z, F.lit(0.9), line_key(), salt="line"), 5).alias("noisy"),
    )


@query(
    "l32_transform_minmax",
    f"""with t as {PARTS_SQL}, b as (select min(p_size) as lo, max(p_size) as hi from t where split = 'train'),
    y as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from t where split = 'train'),
    dict as (select p_type, (row_number() over (order by p_type) - 1)::INTEGER as code from (select distinct p_type from t where split = 'train'))
    select p_partkey, split, round((p_size - lo)::DOUBLE / (hi - lo), 9) as p_size,
    coalesce(code, (select max(code) + 1 from dict))::INTEGER as p_type, round((p_retailprice - m) / s, 6) as p_retailprice
    from t left join dict using (p_type), b, y""",
)
def l32(spark, d) -> DataFrame:
    policy = E.Transformations(normalization="minmax")
    parts = split_parts(spark, d).select("p_partkey", "split", "p_size", "p_type", "p_retailprice")
    out = E.transform_features(parts, ["p_size"], ["p_type"], "p_retailprice", "regression", policy).df
    return out.withColumns({"p_size": F.round("p_size", 9), "p_retailprice": F.round("p_retailprice", 6)})


@query(
    "l32_transform_standard",
    f"""with t as (select p_partkey, split, p_brand, case when p_partkey % 13 = 0 and split <> 'test' then null else p_size end as p_size,
    case when p_partkey % 17 = 0 then null else p_name end as p_name, p_retailprice from {PARTS_SQL}),
    a as (select avg(p_size) as m from t where split = 'train'),
    f as (select p_partkey, split, p_brand, p_name, p_retailprice, coalesce(p_size, m) as p_size from t, a),
    s as (select avg(p_size) as m, stddev_pop(p_size) as s from f where split = 'train'),
    c as (select p_name, count(*) as n from f where split = 'train' and p_name is not null group by 1),
    g as (select f.*, coalesce(p_name, (select arg_min(p_name, (-n, p_name)) from c)) as name2 from f),
    k as (select round_even(count(*) * 0.016::DOUBLE, 0) as least from g where split = 'train'),
    pop as (select name2 from g where split = 'train' group by 1 having count(*) >= (select least from k)),
    h as (select g.*, case when name2 in (select name2 from pop) then name2 else '__rare__' end as name3 from g),
    dict as (select name3, (row_number() over (order by name3) - 1)::INTEGER as code from (select distinct name3 from h where split = 'train')),
    y as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from h where split = 'train')
    select p_partkey, split, round((p_size - s.m) / s.s, 6) as p_size, coalesce(code, (select max(code) + 1 from dict))::INTEGER as p_name,
    round((p_retailprice - y.m) / y.s, 6) as p_retailprice from h left join dict using (name3), s, y""",
)
def l32_standard(spark, d) -> DataFrame:
    policy = E.Transformations("standard", "mean", "most_frequent", 0.016)
    parts = split_parts(spark, d).select(
        "p_partkey",
        "split",
        F.when(~((F.col("p_partkey") % 13 == 0) & (F.col("split") != "test")), F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_name")).alias("p_name"),
        "p_retailprice",
    )
    out = E.transform_features(parts, ["p_size"], ["p_name"], "p_retailprice", "regression", policy).df
    return out.withColumns({"p_size": F.round("p_size", 6), "p_retailprice": F.round("p_retailprice", 6)})
