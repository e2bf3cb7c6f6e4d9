"""A synthetic side both engines can compute: the test tables with hash-driven noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import hash_uniform, uniform_sql
from kinweave.operators.encode import category_lists, narrow_categories
from kinweave.operators.noise import respond
from kinweave.operators.profile import category_counts
from kinweave.queries.star import LINE_KEY_SQL, SPECS, line_key, star
from kinweave.session import spread
from kinweave.specs import RelationalDataset

KEEP = 0.8
# column -> kind of noise; tables without an entry stay as they are
NOISE = {
    "customer": {"c_acctbal": "scale", "c_mktsegment": "response"},
    "supplier": {"s_acctbal": "scale"},
    "part": {"p_retailprice": "scale", "p_type": "response", "p_brand": "response"},
    "orders": {"o_totalprice": "scale", "o_orderstatus": "response", "o_orderpriority": "response"},
    "lineitem": {
        "l_extendedprice": "scale",
        "l_quantity": "whole",
        "l_returnflag": "response",
        "l_linestatus": "response",
    },
    "events": {"value": "scale", "event_type": "response"},
}
DROPPED = {"lineitem": 0.1}  # share of rows left out, so group sizes change


def _row_key(table: str):
    return line_key() if table == "lineitem" else F.col(SPECS[table].primary_key)


def _row_key_sql(table: str) -> str:
    return LINE_KEY_SQL if table == "lineitem" else SPECS[table].primary_key


def _responses(table: str) -> list[str]:
    return [c for c, kind in NOISE.get(table, {}).items() if kind == "response"]


def _number_of(table: str, wanted: str) -> tuple[str, int]:
    """(salt, part) of a named random number; four numbers share one digest."""
    names = []
    for c, kind in NOISE.get(table, {}).items():
        names += [f"{c}-keep", f"{c}-pick"] if kind == "response" else [c]
    at = (["dropped"] + names).index(wanted)
    return f"noise-{at // 4}", at % 4


def _uniform(table: str, wanted: str):
    salt, part = _number_of(table, wanted)
    return hash_uniform(_row_key(table), salt=salt, part=part)


def _uniform_sql(table: str, wanted: str) -> str:
    salt, part = _number_of(table, wanted)
    return uniform_sql(_row_key_sql(table), salt=salt, part=part)


def perturbed_table(df: DataFrame, table: str, values: dict[str, list[str]] | None = None) -> DataFrame:
    noise = NOISE.get(table, {})
    if values is None:
        values = narrow_categories(df, _responses(table))
    df = spread(df)  # the hashes below are the expensive part
    changes = {}
    for c, kind in noise.items():
        if kind == "scale":
            changes[c] = F.col(c) * (0.8 + 0.4 * _uniform(table, c))
        elif kind == "whole":
            changes[c] = F.col(c) + F.floor(5 * _uniform(table, c)).cast("double")
        else:
            keep, pick = _uniform(table, f"{c}-keep"), _uniform(table, f"{c}-pick")
            changes[c] = respond(F.col(c), values[c], KEEP, keep, pick)
    if table in DROPPED:
        df = df.where(_uniform(table, "dropped") >= DROPPED[table])
    return df.withColumns(changes) if changes else df


def perturbed(spark, sf_dir: str) -> tuple[RelationalDataset, RelationalDataset]:
    real = star(spark, sf_dir)
    with_lists = [t for t in NOISE if _responses(t)]
    # one job gives the category lists of all tables; the column names are distinct
    counts = reduce(DataFrame.unionByName, [category_counts(real.tables[t], _responses(t)) for t in with_lists])
    values = category_lists(counts, sum(len(_responses(t)) for t in with_lists))
    return real, real.replacing({t: perturbed_table(real.tables[t], t, values) for t in NOISE})


def perturbed_sql(table: str) -> str:
    """Parenthesised query giving the noisy copy of ``table``."""
    noise = NOISE.get(table, {})
    if not noise:
        return table
    changes = []
    for c, kind in noise.items():
        if kind == "scale":
            changes.append(f"{c} * (0.8::DOUBLE + 0.4::DOUBLE * {_uniform_sql(table, c)}) as {c}")
        elif kind == "whole":
            changes.append(f"{c} + floor(5 * {_uniform_sql(table, c)}) as {c}")
        else:
            keep, pick = _uniform_sql(table, f"{c}-keep"), _uniform_sql(table, f"{c}-pick")
            values = f"(select list(distinct {c} order by {c}) from {table})"
            changes.append(
                f"case when {keep} < {KEEP} then {c} else {values}[floor({pick} * len({values}))::BIGINT + 1] end as {c}"
            )
    kept = f" where {_uniform_sql(table, 'dropped')} >= {DROPPED[table]}" if table in DROPPED else ""
    return f"(select * replace ({', '.join(changes)}) from {table}{kept})"
