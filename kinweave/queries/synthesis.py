"""Clustering, synthesis, matching and learner queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import uniform_sql
from kinweave.operators import cluster as L
from kinweave.operators import matching as M
from kinweave.operators import predict as P
from kinweave.operators import relational as R
from kinweave.operators.encode import narrow_categories
from kinweave.queries.perturbed import perturbed_sql, perturbed_table
from kinweave.queries.registry import query
from kinweave.queries.star import SPECS, star, table
from kinweave.specs import RelationalDataset, RelationGraph

# --- clustering -----------------------------------------------------------------------------------

def _scaled_sql(x: str) -> str:
    return f"({x} - min({x}) over ()) / (max({x}) over () - min({x}) over ()) * 2.0::DOUBLE - 1"


@query(
    "l1_joint_features",
    f"""with j as (select o_orderkey, o_custkey, o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment
    from orders join customer on o_custkey = c_custkey),
    n as (select o_orderkey, 'c__o_totalprice' as feature, {_scaled_sql('o_totalprice')} as value from j
    union all select o_orderkey, 'p__c_acctbal', 0.5 * ({_scaled_sql('c_acctbal')}) from j
    union all select o_orderkey, 'key', ({_scaled_sql('o_custkey')}) from j),
    h as (select o_orderkey, 'c__o_orderstatus=' || v as feature, (v = o_orderstatus)::INTEGER::DOUBLE as value
          from j, (select distinct o_orderstatus as v from orders)
    union all select o_orderkey, 'c__o_orderpriority=' || v, (v = o_orderpriority)::INTEGER::DOUBLE from j, (select distinct o_orderpriority as v from orders)
    union all select o_orderkey, 'p__c_mktsegment=' || v, 0.5 * (v = c_mktsegment)::INTEGER from j, (select distinct c_mktsegment as v from customer))
    select o_custkey, feature, round(value, 7) as value from (select * from n union all select * from h) join orders using (o_orderkey)""",
)
def l1(spark, d) -> DataFrame:
    """The joint feature matrix in long form."""
    data = star(spark, d)
    rows = L.joint_features(
        data.tables["orders"], SPECS["orders"], data.tables["customer"], SPECS["customer"], "o_custkey", parent_scale=0.5
    )
    values = narrow_categories(data.tables["orders"], ["o_orderstatus", "o_orderpriority"])
    values |= narrow_categories(data.tables["customer"], ["c_mktsegment"])
    names = ["c__o_totalprice", "p__c_acctbal"]
    names += [f"c__{c}={v}" for c in ("o_orderstatus", "o_orderpriority") for v in values[c]]
    names += [f"p__c_mktsegment={v}" for v in values["c_mktsegment"]] + ["key"]
    long = rows.select(F.col("fk").alias("o_custkey"), F.posexplode("features").alias("at", "value"))
    return long.select("o_custkey", F.element_at(F.lit(names), F.col("at") + 1).alias("feature"), F.round("value", 7).alias("value"))


@query(
    "l2_assign",
    """with c as (select c_mktsegment, row_number() over (order by c_mktsegment) - 1 as k, avg(c_acctbal) / 1000 as a,
    avg(c_nationkey) as b from customer group by 1),
    d as (select c_custkey, k, (c_acctbal / 1000 - a) * (c_acctbal / 1000 - a) + (customer.c_nationkey - b) * (customer.c_nationkey - b) as d from customer, c)
    select c_custkey, arg_min(k, (d, k))::INTEGER as cluster from d group by 1""",
)
def l2_assign(spark, d) -> DataFrame:
    """Nearest of the segment means."""
    people = table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("features")
    )
    means = people.groupBy("c_mktsegment").agg(
        F.avg(F.col("features")[0]).alias("a"), F.avg(F.col("features")[1]).alias("b")
    )
    centroids = [(r["a"], r["b"]) for r in few_segments(means)]
    return L.assign_to_centroids(people, centroids).select("c_custkey", "cluster")


L_MAX = 1000  # segments (clusters) whose means may travel with the expression


def few_segments(means: DataFrame) -> list:
    """Rows of all segments in order; more than ``L_MAX`` are an error, none is dropped."""
    rows = means.orderBy("c_mktsegment").limit(L_MAX + 1).collect()
    if len(rows) > L_MAX:
        raise ValueError(f"more than {L_MAX} segments")
    return rows


@query(
    "l3_em_step",
    """with s as (select c_mktsegment, row_number() over (order by c_mktsegment) - 1 as k, avg(c_acctbal) / 1000 as m, var_pop(c_acctbal / 1000) + 1e-6 as v
    from customer group by 1),
    p as (select c_custkey, k, c_acctbal / 1000 as x, exp(-0.5 * ((c_acctbal / 1000 - m) * (c_acctbal / 1000 - m) / v + ln(2 * pi() * v))) as f from customer, s),
    r as (select c_custkey, k, x, f / sum(f) over (partition by c_custkey) as r from p)
    select k::INTEGER as component, round(sum(r) / (select count(*) from customer), 6) as weight, round(sum(r * x) / sum(r), 6) as mean,
    round(sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) * (sum(r * x) / sum(r)) + 1e-6, 5) as variance from r group by 1""",
)
def l3_em_step(spark, d) -> DataFrame:
    import numpy as np

    people = table(spark, d, "customer").select("c_mktsegment", F.array(F.col("c_acctbal") / 1000).alias("features"))
    x = F.col("features")[0]
    start = few_segments(people.groupBy("c_mktsegment").agg(F.avg(x).alias("m"), (F.var_pop(x) + 1e-6).alias("v")))
    n = len(start)
    mixture = L.Mixture(np.full(n, 1 / n), np.array([[r["m"]] for r in start]), np.array([[r["v"]] for r in start]))
    after, _ = L.em_step(people, mixture)
    rows = [(i, float(after.weights[i]), float(after.means[i, 0]), float(after.variances[i, 0])) for i in range(n)]
    out = spark.createDataFrame(rows, "component int, weight double, mean double, variance double")
    return out.select("component", *[F.round(c, p).alias(c) for c, p in (("weight", 6), ("mean", 6), ("variance", 5))])


def _digamma_sql(x: str) -> str:
    """The asymptotic series, for arguments of some dozen and more."""
    return f"(ln({x}) - 1 / (2 * ({x})) - 1 / (12 * power({x}, 2)) + 1 / (120 * power({x}, 4)) - 1 / (252 * power({x}, 6)))"


@query(
    "l4_variational_step",
    f"""with c as (select c_custkey, c_mktsegment, c_acctbal::DOUBLE / 1000 as x from customer),
    p as (select avg(x) as m0, var_pop(x) + 1e-6 as b0 from c),
    s as (select row_number() over (order by c_mktsegment) - 1 as k, count(*)::DOUBLE as n, avg(x) as mu, var_pop(x) as v, count(*) over () as parts
          from c group by c_mktsegment),
    q as (select k, 1.0::DOUBLE / parts + n as alpha, 1 + n as beta, (m0 + n * mu) / (1 + n) as m, 1 + n / 2 as a,
          b0 + 0.5 * (n * v + n / (1 + n) * (mu - m0) * (mu - m0)) as b from s, p),
    e as (select k, m, a / b as l, {_digamma_sql('alpha')} + 0.5 * ({_digamma_sql('a')} - ln(b) - ln(2 * pi()) - 1 / beta) as w from q),
    f as (select c_custkey, k, x, exp(w - 0.5 * l * (x - m) * (x - m)) as f from c, e),
    r as (select k, x, f / sum(f) over (partition by c_custkey) as r from f),
    t as (select k, sum(r) as n, sum(r * x) / sum(r) as mu, sum(r * x * x) as xx from r group by k)
    select k::INTEGER as component, round(1.0::DOUBLE / (select max(parts) from s) + n, 4) as alpha, round((m0 + n * mu) / (1 + n), 6) as mean,
    round((b0 + 0.5 * (xx - n * mu * mu + n / (1 + n) * (mu - m0) * (mu - m0))) / (1 + n / 2), 5) as variance from t, p""",
)
def l4_variational_step(spark, d) -> DataFrame:
    """The posterior after one pass from that of the market segments."""
    import numpy as np

    x = F.col("c_acctbal").cast("double") / 1000
    people = table(spark, d, "customer").select("c_mktsegment", F.array(x).alias("features"))
    x = F.col("features")[0]
    known = few_segments(people.groupBy("c_mktsegment").agg(F.count(x).alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx")))
    whole = people.agg(F.avg(x).alias("m"), (F.var_pop(x) + 1e-6).alias("v")).first()
    prior = L.Prior(1 / len(known), 1.0, np.array([whole["m"]]), 1.0, np.array([whole["v"]]))
    start = prior.after(np.array([float(r["n"]) for r in known]), np.array([[r["x"]] for r in known]), np.array([[r["xx"]] for r in known]))
    after, _ = L.variational_step(people, start)
    rows = [(i, float(after.alpha[i]), float(after.means[i, 0]), float(after.b[i, 0] / after.a[i])) for i in range(len(known))]
    out = spark.createDataFrame(rows, "component int, alpha double, mean double, variance double")
    return out.select("component", *[F.round(c, n).alias(c) for c, n in (("alpha", 4), ("mean", 6), ("variance", 5))])


def small_graph(spark, d, *edges) -> RelationalDataset:
    """Part of the star with the relations named."""
    data = star(spark, d)
    tables = dict.fromkeys(t for e in edges for t in e)
    children = {t: [c for p, c in edges if p == t] for t in tables}
    graph = RelationGraph.from_children(children)
    from dataclasses import replace

    specs = {
        t: replace(SPECS[t], foreign_keys={p: fk for p, fk in SPECS[t].foreign_keys.items() if (p, t) in edges}) for t in tables
    }
    frames = {
        t: data.tables[t].select(
            *[c for c in data.tables[t].columns if c in specs[t].domain.columns or c in specs[t].key_columns]
        )
        for t in tables
    }
    return RelationalDataset(frames, specs, graph)


@query("l5_edge_clusters")
def l5(spark, d) -> DataFrame:
    """Group sizes of customers per fitted relation label."""
    data = small_graph(spark, d, ("customer", "orders"))
    return L.cluster_edge(data, "customer", "orders", 8, L.kmeans_assigner()).sizes


@query("l4_soft_clusters")
def l4(spark, d) -> DataFrame:
    data = small_graph(spark, d, ("customer", "orders"))
    return L.cluster_edge(data, "customer", "orders", 4, L.mixture_assigner(variational=True)).sizes


@query("l6_graph_clusters")
def l6(spark, d) -> DataFrame:
    """Labels over a two-edge graph, child-most edge first."""
    data = small_graph(spark, d, ("nation", "customer"), ("customer", "orders"))
    clustered, _ = L.cluster_graph(data, 6, "kmeans")
    people = clustered.tables["customer"]
    return people.groupBy("nation_customer_cluster", "customer_orders_cluster").agg(F.count(F.lit(1)).alias("n"))


# --- synthesis ------------------------------------------------------------------------------------


@query("l7_copula")
def l7(spark, d) -> DataFrame:
    """As many synthetic orders as there are real ones."""
    from kinweave.operators.synth import CopulaSynthesizer

    orders, domain = table(spark, d, "orders"), SPECS["orders"].domain
    slots = spark.range(orders.count()).withColumnRenamed("id", "slot_id")
    return CopulaSynthesizer().fit(orders.select(*domain.columns), domain).sample(slots)


@query("l8_conditional_copula")
def l8(spark, d) -> DataFrame:
    """Synthetic lines conditioned on the voted label of their order."""
    from kinweave.operators.synth import CopulaSynthesizer

    lines = table(spark, d, "lineitem")
    labels = R.vote(lines.select("l_orderkey", (F.col("l_partkey") % 5).cast("int").alias("k")), "l_orderkey", "k")
    labelled = R.label_children(lines, "l_orderkey", labels)
    domain = SPECS["lineitem"].domain
    model = CopulaSynthesizer().fit(labelled.select(*domain.columns, "label"), domain, "label")
    sizes = R.size_distribution(R.group_sizes(lines, "l_orderkey").join(labels, "l_orderkey"), "label")
    slots = R.expand_children(labels, "l_orderkey", "label", sizes, salt="l8")
    keyed = slots.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("slot").cast("string")).alias("slot_id"), "l_orderkey", "label")
    return model.sample(keyed)


@query("l10_synthesise")
def l10(spark, d) -> DataFrame:
    """Customers and their orders synthesised through the whole chain; rows per synthetic customer."""
    from kinweave.plans.synthesis import run
    from kinweave.sources.stages import RunConfig

    data = small_graph(spark, d, ("customer", "orders"))
    made = run(data, RunConfig(workspace="", num_clusters=6, clustering_method="kmeans"))
    return made.tables["orders"]


@query("l10_two_parents")
def l10_two_parents(spark, d) -> DataFrame:
    """Lines made once under suppliers and once under parts, reconciled into one table."""
    from kinweave.plans.synthesis import run
    from kinweave.sources.stages import RunConfig

    data = small_graph(spark, d, ("supplier", "lineitem"), ("part", "lineitem"))
    config = RunConfig(workspace="", num_clusters=4, clustering_method="kmeans", unique_matching=False)
    return run(data, config).tables["lineitem"]


@query("l12_single_table_baseline")
def l12(spark, d) -> DataFrame:
    from kinweave.operators.synth import BootstrapSynthesizer
    from kinweave.plans.baselines import single_table

    data = small_graph(spark, d, ("customer", "orders"))
    return single_table(data, lambda t: BootstrapSynthesizer()).tables["orders"]


@query("l15_denormalised_baseline")
def l15(spark, d) -> DataFrame:
    from kinweave.operators.synth import CopulaSynthesizer
    from kinweave.plans.baselines import denormalised

    data = small_graph(spark, d, ("customer", "orders"))
    return denormalised(data, lambda p, c: CopulaSynthesizer()).tables["customer"]


@query("l13_smote")
def l13(spark, d) -> DataFrame:
    """One synthetic part per real part, class by class."""
    from kinweave.operators.synth import smote

    return smote(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_brand"], "p_type")


_DRAWS_PER_ROW = 20
_COVERED = {"part": ["p_brand", "p_type", "p_name"], "customer": ["c_name", "c_mktsegment"]}


@query(
    "l7_category_coverage",
    " union all ".join(
        f"select '{c}' as column_name, count(distinct {c}) as n_real, count(distinct {c}) as n_synthetic, 0::BIGINT as n_invented from {t}"
        for t, cs in _COVERED.items()
        for c in cs
    ),
)
def l7_coverage(spark, d) -> DataFrame:
    """Every real category is drawn and none is invented, however many values a column has."""
    from kinweave.operators.synth import CopulaSynthesizer
    from kinweave.specs import Domain

    out = None
    for t, columns in _COVERED.items():
        real = table(spark, d, t).select(*columns)
        slots = spark.range(_DRAWS_PER_ROW * real.count()).withColumnRenamed("id", "slot_id")
        made = CopulaSynthesizer().fit(real, Domain.of(columns)).sample(slots)
        for c in columns:
            known = real.select(c).distinct().withColumn("__real", F.lit(1))
            drawn = made.select(c).distinct().withColumn("__made", F.lit(1))
            part = known.join(drawn, c, "full").agg(
                F.lit(c).alias("column_name"), F.count("__real").alias("n_real"), F.count("__made").alias("n_synthetic"),
                F.count_if(F.col("__real").isNull()).alias("n_invented"),
            )
            out = part if out is None else out.unionByName(part)
    return out


@query(
    "l13_class_counts",
    "select p_type, floor(count(*) * 0.37::DOUBLE)::BIGINT as n from part group by 1 having floor(count(*) * 0.37::DOUBLE) > 0",
)
def l13_counts(spark, d) -> DataFrame:
    """Rows per class of an oversampled table."""
    from kinweave.operators.synth import smote

    made = smote(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_brand"], "p_type", frac=0.37)
    return made.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l13_wide_categories",
    """select c_mktsegment, floor(count(*) * 0.37::DOUBLE)::BIGINT as n, 0::BIGINT as n_foreign from customer group by 1
    having floor(count(*) * 0.37::DOUBLE) > 0""",
)
def l13_wide(spark, d) -> DataFrame:
    """Oversampling with a name per customer as a category: rows per class, and names that no customer of the class has."""
    from kinweave.operators.synth import smote

    people = table(spark, d, "customer")
    made = smote(people, "c_custkey", ["c_acctbal"], ["c_name"], "c_mktsegment", frac=0.37)
    known = people.select("c_mktsegment", "c_name").distinct().withColumn("known", F.lit(True))
    met = made.join(known, ["c_mktsegment", "c_name"], "left")
    return met.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_foreign"))


@query(
    "l24_centre_wide",
    """with s as (select avg(c_acctbal / 1000) as x, count(*) as n from customer),
    p as (select c_name, count(*) / (select n from s) as p from customer group by 1), q as (select sum(p * p) as q from p)
    select c_custkey, round(sqrt((c_acctbal / 1000 - x) * (c_acctbal / 1000 - x) + 1 - 2 * p + q), 6) as d
    from customer join p using (c_name), s, q""",
)
def l24_centre_wide(spark, d) -> DataFrame:
    """Distance of customers to their centre, a name per customer being a category beyond the lists."""
    from kinweave.operators.privacy import Centre, coded_features

    people = table(spark, d, "customer").withColumn("x", F.col("c_acctbal") / 1000)
    (points,), _ = coded_features([people], "c_custkey", ["x"], ["c_name"], None, limit=0)
    return Centre(points, 1).distances(points).select("c_custkey", F.round("d", 6).alias("d"))


@query(
    "x1_smote_rows",
    """with c as (select p_type, count(*) as k from part group by 1),
    w as (select (select count(*) from part) as real, (select count(*) from supplier) + 777 as want),
    q as (select p_type, k * want // real as n, k * want % real as rest, want from c, w),
    r as (select *, row_number() over (order by rest desc, p_type) as turn, want - sum(n) over () as missing from q)
    select p_type, (n + (turn <= missing)::INTEGER)::BIGINT as n from r where n + (turn <= missing)::INTEGER > 0""",
)
def x1_rows(spark, d) -> DataFrame:
    """SMOTE as a synthesiser: exactly the wanted rows, shared among the classes by largest remainder."""
    from kinweave.operators.synth import SmoteSynthesizer
    from kinweave.specs import Domain

    real = table(spark, d, "part").select("p_type", "p_brand", "p_size", "p_retailprice")
    domain = Domain.of(["p_type", "p_brand"], ["p_size", "p_retailprice"])
    slots = spark.range(table(spark, d, "supplier").count() + 777).withColumnRenamed("id", "slot_id")
    made = SmoteSynthesizer("p_type").fit(real, domain).sample(slots)
    return made.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


_WIDE = """(select c_custkey as id, c_acctbal, c_mktsegment, c_name, c_custkey % 3 as part from customer)"""


@query(
    "l25_distances_wide",
    f"""with c as {_WIDE}, s as (select max(c_acctbal) - min(c_acctbal) as span from c where part = 1),
    d as (select f.id, o.part, min(abs(f.c_acctbal / span - o.c_acctbal / span) + 2 * (f.c_mktsegment <> o.c_mktsegment)::INTEGER
              + 2 * (f.c_name <> o.c_name)::INTEGER) as gap
          from c f join c o on o.part > 0, s where f.part = 0 group by 1, 2)
    select id, round(min(gap) filter (where part = 1), 6) as to_train, round(min(gap) filter (where part = 2), 6) as to_test from d group by 1""",
)
def l25_wide(spark, d) -> DataFrame:
    """Distances over a column with a value per row: codes instead of one-hot vectors."""
    from kinweave.operators.privacy import closest_distances

    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment", "c_name")
    fake, train, test = (people.where(F.col("id") % 3 == k) for k in range(3))
    found = closest_distances(fake, train, test, "id", ["c_acctbal"], ["c_mktsegment", "c_name"])
    return found.select("id", F.round("to_train", 6).alias("to_train"), F.round("to_test", 6).alias("to_test"))


@query("l13_smote_regression")
def l13_regression(spark, d) -> DataFrame:
    from kinweave.operators.synth import smote

    return smote(table(spark, d, "part"), "p_partkey", ["p_size"], ["p_type"], "p_retailprice", regression=True)


_NEIGHBOUR = """with n as (select a.vec_id, b.vec_id as nb, row_number() over (partition by a.vec_id order by
    list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.embedding, b.embedding)]), b.vec_id) as rk
    from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)"""


@query(
    "l13_class_neighbours",
    f"{_NEIGHBOUR} select vec_id, rk::INTEGER as neighbour_rank, nb as neighbour_id from n where rk <= 3",
)
def l13_neighbours(spark, d) -> DataFrame:
    from kinweave.operators.synth import class_neighbours

    v = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return class_neighbours(v, "vec_id", "embedding", "label", 3).select("vec_id", "neighbour_rank", "neighbour_id")


# --- matching -------------------------------------------------------------------------------------

_A = "(select s_suppkey as a_id, s_acctbal / 100 as x, (s_nationkey)::DOUBLE as y from supplier)"
_B = "(select c_custkey as b_id, c_acctbal / 100 as x, (c_nationkey)::DOUBLE as y from customer)"
_NEAREST = f"""near as (select a_id, arg_min(b_id, (d, b_id)) as b_id, min(d) as distance from (select a_id, b_id,
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d from {_A} a, {_B} b) group by 1)"""


def match_sides(spark, d):
    a = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("a_id"), F.array(F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")).alias("vector")
    )
    b = table(spark, d, "customer").select(
        F.col("c_custkey").alias("b_id"), F.array(F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double")).alias("vector")
    )
    return a, b


@query("j8_greedy_match")
def j8(spark, d) -> DataFrame:
    """Every supplier takes the nearest customer no earlier supplier took."""
    return M.greedy_match(*match_sides(spark, d))


@query(
    "j9_match_repair",
    f"""with {_NEAREST}, k as (select *, a_id = min(a_id) over (partition by b_id) as keep from near),
    moved as (select a_id, distance, row_number() over (order by a_id) as rk from k where not keep),
    unused as (select c_custkey as b_id, row_number() over (order by c_custkey) as rk from customer
               where c_custkey not in (select b_id from near))
    select a_id, b_id, round(distance, 6) as distance, false as repaired from k where keep
    union all select a_id, b_id, round(distance, 6), true from moved join unused using (rk)""",
)
def j9(spark, d) -> DataFrame:
    return M.match_with_repair(*match_sides(spark, d)).withColumn("distance", F.round("distance", 6))


@query("j10_iterative_match")
def j10(spark, d) -> DataFrame:
    return M.iterative_match(*match_sides(spark, d))


@query(
    "j12_shuffled_match",
    f"""with a as (select s_suppkey as a_id, row_number() over (order by {uniform_sql('s_suppkey', salt='j12-a_id')}, s_suppkey) as rk from supplier),
    b as (select c_custkey as b_id, row_number() over (order by {uniform_sql('c_custkey', salt='j12-b_id')}, c_custkey) as rk from customer)
    select a_id, b_id from a join b using (rk)""",
)
def j12(spark, d) -> DataFrame:
    return M.shuffled_match(*match_sides(spark, d), salt="j12")


@query(
    "a15_match_counts",
    f"""with {_NEAREST}, h as (select b_id, count(*) as hits from near group by 1)
    select hits, count(*) as n_targets, sum(hits)::BIGINT as n_rows from h group by 1""",
)
def a15(spark, d) -> DataFrame:
    counted = M.match_counts(M.nearest_pairs(*match_sides(spark, d)))
    per_target = counted.select("b_id", "hits").distinct()
    return per_target.groupBy("hits").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("hits").alias("n_rows"))


# --- prediction metrics ---------------------------------------------------------------------------

_CONF = "c as (select quality as t, toxic as p, count(*) as n from labels group by 1, 2)"
_PER_CLASS = f"""{_CONF}, k as (select distinct t as k from c union select distinct p from c),
    s as (select k, coalesce((select sum(n) from c where t = k), 0) as support, coalesce((select sum(n) from c where p = k), 0) as called,
          coalesce((select sum(n) from c where t = k and p = k), 0) as hits from k),
    f as (select k, support, hits, case when called > 0 then hits / called::DOUBLE else 0 end as pr, case when support > 0 then hits / support::DOUBLE else 0 end as rc,
          2 * hits / (called + support)::DOUBLE as f1 from s)"""


@query(
    "l27_metrics",
    f"""with {_PER_CLASS} select sum(support)::BIGINT as n, round(sum(hits) / sum(support)::DOUBLE, 6) as accuracy, round(avg(pr), 6) as macro_precision,
    round(avg(rc), 6) as macro_recall, round(avg(f1), 6) as macro_f1 from f""",
)
def l27(spark, d) -> DataFrame:
    m = P.classification_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query(
    "l28_inverse_prevalence_f1",
    f"""with {_PER_CLASS} select round(sum(f1 * (1 - support / (select sum(support) from f)::DOUBLE)) / (count(*) - 1), 6) as inverse_prevalence_f1 from f""",
)
def l28(spark, d) -> DataFrame:
    m = P.classification_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select(F.round("inverse_prevalence_f1", 6).alias("inverse_prevalence_f1"))


@query(
    "l27_auc",
    """with s as (select 'amount' as name, (o_orderstatus = 'F')::INTEGER as y, floor(o_totalprice / 100) as score from orders
    union all select 'key', (o_orderstatus = 'F')::INTEGER, (o_custkey % 100)::DOUBLE from orders),
    r as (select name, y, rank() over (partition by name order by score) + (count(*) over (partition by name, score) - 1) / 2.0::DOUBLE as rk from s)
    select name, round((sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)::DOUBLE), 6) as auc from r group by 1""",
)
def l27_auc(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    y = (F.col("o_orderstatus") == "F").cast("int").alias("y")
    rows = orders.select(F.lit("amount").alias("name"), y, F.floor(F.col("o_totalprice") / 100).cast("double").alias("score")).unionByName(
        orders.select(F.lit("key").alias("name"), y, (F.col("o_custkey") % 100).cast("double").alias("score"))
    )
    areas = P.roc_auc_many(rows)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in areas.items()], "name string, auc double")


@query(
    "l27_regression",
    f"""with j as (select a.o_totalprice as y, b.o_totalprice as p from orders a join {perturbed_sql('orders')} b using (o_orderkey))
    select count(*) as n, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2, round(sqrt(avg((y - p) * (y - p))), 3) as rmse,
    round(avg(abs(y - p)), 3) as mae, round(1 - var_pop(y - p) / var_pop(y), 6) as explained_variance from j""",
)
def l27_regression(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    guessed = perturbed_table(orders, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    m = P.regression_metrics(orders.join(guessed, "o_orderkey"), "o_totalprice", "p")
    return m.select("n", *[F.round(c, p).alias(c) for c, p in (("r2", 6), ("rmse", 3), ("mae", 3), ("explained_variance", 6))])


@query(
    "a14_seed_summary",
    f"""with s as (select case o_custkey % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, o_custkey % 5 as seed,
    avg((o_orderstatus = 'F')::INTEGER) as value from orders group by 1, 2)
    select split, count(value) as count, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from s group by 1""",
)
def a14(spark, d) -> DataFrame:
    """A share per split and seed, summarised over the seeds."""
    split = F.when(F.col("o_custkey") % 3 == 0, "train").when(F.col("o_custkey") % 3 == 1, "val").otherwise("test")
    scores = table(spark, d, "orders").groupBy(split.alias("split"), (F.col("o_custkey") % 5).alias("seed")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("value")
    )
    out = P.seed_summary(scores, ["split"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "a13_efficacy_summary",
    """with s as (select 'multiclass' as task, c_mktsegment as col, avg(c_acctbal) / 10000 as value from customer group by 2
    union all select 'regression', o_orderpriority, avg(o_totalprice) / 500000 from orders group by 2)
    select case when task = 'regression' then 'regression' else 'classification' end as kind, round(avg(value), 6) as mean,
    round(stddev_pop(value), 6) as std, count(value) as n from s group by 1""",
)
def a13(spark, d) -> DataFrame:
    """Scores per column averaged per kind of task."""
    first = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("column")).agg((F.avg("c_acctbal") / 10000).alias("value"))
    second = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("column")).agg((F.avg("o_totalprice") / 500000).alias("value"))
    scores = first.select(F.lit("multiclass").alias("task"), "column", F.lit("macro_f1").alias("metric"), "value").unionByName(
        second.select(F.lit("regression").alias("task"), "column", F.lit("r2").alias("metric"), "value")
    )
    out = P.efficacy_summary(scores)
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# --- learners -------------------------------------------------------------------------------------


@query("l23_detection")
def l23(spark, d) -> DataFrame:
    """Detection score of the noisy orders against the real ones."""
    from kinweave.operators.learn import detection_score

    orders = table(spark, d, "orders")
    score = detection_score(orders, perturbed_table(orders, "orders"), SPECS["orders"].domain)
    return spark.createDataFrame([("orders", score)], "table_name string, score double")


@query("l26_efficacy")
def l26(spark, d) -> DataFrame:
    """Train on noisy customers, test on real ones, one column after the other as target, over all settings."""
    from kinweave.operators.learn import all_efficacies
    from kinweave.operators.profile import infer_domain

    people = table(spark, d, "customer")
    domain = infer_domain(people, SPECS["customer"])
    return all_efficacies(perturbed_table(people, "customer"), people, domain)


@query("l30_label_recovery")
def l30(spark, d) -> DataFrame:
    """Does a classifier fitted on real orders recover the label noisy orders carry?"""
    from kinweave.operators.learn import label_recovery

    orders = table(spark, d, "orders").withColumn("label", F.floor(F.col("o_totalprice") / 125000).cast("int"))
    fake = perturbed_table(orders, "orders")
    return label_recovery(orders, fake, SPECS["orders"].domain, "label")


@query("l31_single_table_report")
def l31(spark, d) -> DataFrame:
    from kinweave.plans.reports import single_table_report

    real = small_graph(spark, d, ("nation", "customer"))
    fake = real.replacing({"customer": perturbed_table(real.tables["customer"], "customer")})
    return single_table_report(real, fake, "customer")


@query("l21_multi_table_report")
def l21(spark, d) -> DataFrame:
    from kinweave.plans.reports import multi_table_report

    real = small_graph(spark, d, ("nation", "customer"), ("customer", "orders"))
    fake = real.replacing({t: perturbed_table(real.tables[t], t) for t in ("customer", "orders")})
    return multi_table_report(real, fake)["averages"]
