"""Fidelity of the noisy copy against the test tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import fidelity as Q
from kinweave.queries.perturbed import perturbed, perturbed_sql
from kinweave.queries.registry import query
from kinweave.queries.star import GRAPH, SPECS


def _ks_sql(values: str) -> str:
    """``values``: rows (value, fake) -> one number."""
    return f"""(with v as ({values}), c as (select value, count(*) filter (where not fake) as r,
    count(*) filter (where fake) as f from v where value is not null group by 1),
    s as (select sum(r) over (order by value) / sum(r) over ()::DOUBLE - sum(f) over (order by value) / sum(f) over ()::DOUBLE as gap from c)
    select 1 - max(abs(gap)) from s)"""


def _tv_sql(values: str) -> str:
    return f"""(with v as ({values}), c as (select value, count(*) filter (where not fake) as r,
    count(*) filter (where fake) as f from v where value is not null group by 1),
    s as (select r / sum(r) over ()::DOUBLE - f / sum(f) over ()::DOUBLE as gap from c) select 1 - sum(abs(gap)) / 2 from s)"""


def _both(table: str, value: str) -> str:
    return (
        f"select {value} as value, false as fake from {table} union all "
        f"select {value}, true from {perturbed_sql(table)}"
    )


_SHAPES = " union all ".join(
    f"select '{t}' as table_name, '{c}' as \"column\", '{'ks' if role == 'continuous' else 'tv'}' as metric, "
    f"round({(_ks_sql if role == 'continuous' else _tv_sql)(_both(t, c))}, 6) as score"
    for t, s in SPECS.items()
    for c, (_, role) in s.domain.columns.items()
)


@query("l16_shapes", _SHAPES)
def l16(spark, d) -> DataFrame:
    return Q.column_shapes(*perturbed(spark, d)).withColumn("score", F.round("score", 6))


def _pair_sql(real: str, fake: str, a: str, b: str, numeric: set[str]) -> str:
    if a in numeric and b in numeric:
        return f"(select 1 - abs((select corr({a}, {b}) from {real}) - (select corr({a}, {b}) from {fake})) / 2)"

    def code(c: str) -> str:
        if c not in numeric:
            return f"{c}::VARCHAR"
        low, high = f"(select min({c}) from {real})", f"(select max({c}) from {real})"
        return f"greatest(0, least(9, floor(({c} - {low}) / ({high} - {low}) * 10)))::INTEGER::VARCHAR"

    value = f"{code(a)} || '|' || {code(b)}"
    return _tv_sql(f"select {value} as value, false as fake from {real} union all select {value}, true from {fake}")


def _table_trends_sql(table: str, hop: int = 0) -> str:
    domain = SPECS[table].domain
    numeric = set(domain.continuous)
    return " union all ".join(
        f"select {hop} as hop, '{table}' as path, '{table}' as top_table, '{table}' as bottom_table, '{a}' as column_1, "
        f"'{b}' as column_2, round({_pair_sql(table, 'fake_' + table, a, b, numeric)}, 6) as score"
        for a, b in combinations(domain.columns, 2)
    )


_TREND_TABLES = [t for t, s in SPECS.items() if len(s.domain.columns) > 1]
_FAKES = ", ".join(f"fake_{t} as materialized (select * from {perturbed_sql(t)})" for t in SPECS)


@query(
    "l17_pair_trends",
    f"with {_FAKES} select * from ({' union all '.join(map(_table_trends_sql, _TREND_TABLES))}) where score is not null",
)
def l17(spark, d) -> DataFrame:
    real, fake = perturbed(spark, d)
    parts = [Q.table_trends(real, fake, t) for t in _TREND_TABLES]
    return reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6))


def _path_name(path) -> str:
    return "_".join(path)


def _path_ctes(path) -> str:
    """Real and noisy joined tables of a path as two CTEs."""
    ctes = []
    for side in ("real", "fake"):
        source = (lambda t: t) if side == "real" else (lambda t: f"fake_{t}")
        sql = f"{source(path[-1])} as {path[-1]}"
        for parent, child in reversed(list(zip(path, path[1:]))):
            fk, pk = SPECS[child].foreign_keys[parent], SPECS[parent].primary_key
            sql += f" left join {source(parent)} as {parent} on {child}.{fk} = {parent}.{pk}"
        columns = ", ".join(f"{t}.{c}" for t in (path[0], path[-1]) for c in SPECS[t].domain.columns)
        ctes.append(f"{side}_{_path_name(path)} as materialized (select {columns} from {sql})")
    return ", ".join(ctes)


def _path_rows(path) -> str:
    top, bottom = SPECS[path[0]].domain, SPECS[path[-1]].domain
    numeric = set(top.continuous) | set(bottom.continuous)
    name = _path_name(path)
    return " union all ".join(
        f"select {len(path) - 1} as hop, '{'>'.join(path)}' as path, '{path[0]}' as top_table, '{path[-1]}' as bottom_table, "
        f"'{a}' as column_1, '{b}' as column_2, round({_pair_sql('real_' + name, 'fake_' + name, a, b, numeric)}, 6) as score"
        for a in top.columns
        for b in bottom.columns
    )


def _paths_sql(paths) -> str:
    return (
        f"with {_FAKES}, {', '.join(map(_path_ctes, paths))} "
        f"select * from ({' union all '.join(map(_path_rows, paths))}) where score is not null"
    )


@query("l18_intertable", _paths_sql(GRAPH.relations))
def l18(spark, d) -> DataFrame:
    real, fake = perturbed(spark, d)
    parts = [Q.path_trends(real, fake, p) for p in GRAPH.relations]
    return reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6))


@query("l20_long_range", _paths_sql(GRAPH.long_paths()))
def l20(spark, d) -> DataFrame:
    real, fake = perturbed(spark, d)
    parts = [Q.path_trends(real, fake, p) for p in GRAPH.long_paths()]
    return reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6))


_ORDERED = [">".join(p) for p in GRAPH.long_paths()]
_RANK = " ".join(f"when '{p}' then {i}" for i, p in enumerate(_ORDERED))


@query(
    "l20_latest_path",
    f"""select hop, top_table, bottom_table, column_1, column_2, arg_max(path, r) as path, arg_max(score, r) as score
    from (select *, case path {_RANK} end as r from ({_paths_sql(GRAPH.long_paths())})) group by 1, 2, 3, 4, 5""",
)
def l20_latest(spark, d) -> DataFrame:
    return Q.latest_path(l20(spark, d), _ORDERED)


def _cardinality_sql(parent: str, child: str) -> str:
    fk, pk = SPECS[child].foreign_keys[parent], SPECS[parent].primary_key

    def side(p: str, c: str, flag: str) -> str:
        return f"select count(c.{fk}) as value, {flag} as fake from {p} p left join {c} c on c.{fk} = p.{pk} group by p.{pk}"

    values = side(parent, child, "false") + " union all " + side(perturbed_sql(parent), perturbed_sql(child), "true")
    return f"select '{parent}' as parent, '{child}' as child, round({_ks_sql(values)}, 6) as score"


@query("l19_cardinality", " union all ".join(_cardinality_sql(p, c) for p, c in GRAPH.relations))
def l19(spark, d) -> DataFrame:
    return Q.cardinality_shapes(*perturbed(spark, d)).withColumn("score", F.round("score", 6))


def _coverage_sql(table: str) -> str:
    rows, fake = [], perturbed_sql(table)
    for c, (_, role) in SPECS[table].domain.columns.items():
        if role == "discrete":
            score = (
                f"(select count(*) from (select distinct {c} from {table} intersect select distinct {c} from {fake})) / "
                f"(select count(distinct {c}) from {table})::DOUBLE"
            )
        else:
            score = (
                f"(select greatest(0, 1 - greatest(0, (flo - lo) / (hi - lo)) - greatest(0, (hi - fhi) / (hi - lo))) from "
                f"(select min({c})::DOUBLE as lo, max({c})::DOUBLE as hi from {table}), "
                f"(select min({c})::DOUBLE as flo, max({c})::DOUBLE as fhi from {fake}))"
            )
        rows.append(f"select '{table}' as table_name, '{c}' as \"column\", round({score}, 6) as score")
    return " union all ".join(rows)


@query("l22_coverage", " union all ".join(_coverage_sql(t) for t in SPECS))
def l22(spark, d) -> DataFrame:
    real, fake = perturbed(spark, d)
    parts = [Q.coverage(real, fake, t) for t in SPECS]
    return reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6))


_HOPS = " union all ".join([*map(_table_trends_sql, _TREND_TABLES), *map(_path_rows, GRAPH.relations)])


@query(
    "a12_hop_average",
    f"""with {_FAKES}, {', '.join(map(_path_ctes, GRAPH.relations))},
    s as (select hop, score from ({_HOPS}) where score is not null)
    select hop, count(*) as n, round(avg(score), 5) as mean_score from s group by 1
    union all select -1, count(*), round(avg(score), 5) from s""",
)
def a12(spark, d) -> DataFrame:
    real, fake = perturbed(spark, d)
    scores = Q.trend_scores(real, fake, long_range=False)
    return Q.hop_averages(scores).withColumn("mean_score", F.round("mean_score", 5))
