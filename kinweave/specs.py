"""Schemas of a relational dataset: column roles, keys and the graph of relations.

Everything here is metadata with a few dozen entries and lives on the driver.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

DISCRETE = "discrete"
CONTINUOUS = "continuous"


@dataclass(frozen=True)
class Domain:
    """S3: column -> (size, role); keys are not part of a domain."""

    columns: Mapping[str, tuple[int | None, str]]

    def __post_init__(self) -> None:
        for name, (_, role) in self.columns.items():
            if role not in (DISCRETE, CONTINUOUS):
                raise ValueError(f"unknown role {role!r} for column {name}")

    @classmethod
    def of(cls, discrete: Iterable[str] = (), continuous: Iterable[str] = ()) -> Domain:
        return cls({**{c: (None, DISCRETE) for c in discrete}, **{c: (None, CONTINUOUS) for c in continuous}})

    @classmethod
    def from_json(cls, text: str) -> Domain:
        return cls({c: (int(v["size"]), v["type"]) for c, v in json.loads(text).items()})

    def to_json(self) -> str:
        return json.dumps({c: {"size": size, "type": role} for c, (size, role) in self.columns.items()})

    def role(self, column: str) -> str | None:
        return self.columns[column][1] if column in self.columns else None

    def size(self, column: str) -> int | None:
        return self.columns[column][0]

    @property
    def discrete(self) -> list[str]:
        return [c for c, (_, role) in self.columns.items() if role == DISCRETE]

    @property
    def continuous(self) -> list[str]:
        return [c for c, (_, role) in self.columns.items() if role == CONTINUOUS]

    def split(self, columns: Iterable[str], exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
        """M1/M2: (numeric, categorical) columns of a table, in table order."""
        keep = [c for c in columns if c in self.columns and c not in set(exclude)]
        return [c for c in keep if self.role(c) == CONTINUOUS], [c for c in keep if self.role(c) == DISCRETE]

    def task_type(self, target: str) -> str | None:
        """M3: learning task a target column defines."""
        if target not in self.columns:
            return None
        if self.role(target) == CONTINUOUS:
            return "regression"
        return "binclass" if self.size(target) == 2 else "multiclass"

    def with_max_categories(self, limit: int = 1000) -> Domain:
        """M7: discrete columns with ``limit`` values or more count as numeric."""
        return Domain(
            {
                c: (size, CONTINUOUS if role == DISCRETE and size is not None and size >= limit else role)
                for c, (size, role) in self.columns.items()
            }
        )

    def merged(self, other: Domain) -> Domain:
        return Domain({**self.columns, **other.columns})

    def adding(self, column: str, size: int | None, role: str) -> Domain:
        return Domain({**self.columns, column: (size, role)})


@dataclass(frozen=True)
class TableSpec:
    name: str
    primary_key: str | None
    domain: Domain
    foreign_keys: Mapping[str, str] = field(default_factory=dict)  # parent table -> column
    columns: Sequence[str] = ()

    @property
    def key_columns(self) -> list[str]:
        own = [self.primary_key] if self.primary_key else []
        return own + list(self.foreign_keys.values())

    @classmethod
    def by_convention(cls, name: str, columns: Sequence[str], domain: Domain, parents: Iterable[str]) -> TableSpec:
        """Fallback naming rule: ``<table>_id`` and ``<parent>_id``."""
        return cls(name, f"{name}_id", domain, {p: f"{p}_id" for p in parents}, tuple(columns))


@dataclass(frozen=True)
class RelationGraph:
    """Ordered [parent, child] edges; a root has parent ``None``."""

    edges: tuple[tuple[str | None, str], ...]

    @classmethod
    def from_children(cls, children: Mapping[str, Sequence[str]]) -> RelationGraph:
        """M8: roots first, then edges breadth first; a child expands once all its parents are done."""
        waiting = dict.fromkeys(children, 0)
        for targets in children.values():
            for child in targets:
                waiting[child] += 1
        ready = deque(t for t, n in waiting.items() if n == 0)
        order: list[tuple[str | None, str]] = [(None, t) for t in ready]
        expanded = 0
        while ready:
            parent = ready.popleft()
            expanded += 1
            for child in children[parent]:
                order.append((parent, child))
                waiting[child] -= 1
                if waiting[child] == 0:
                    ready.append(child)
        if expanded != len(waiting):
            raise ValueError("the relation graph has a cycle")
        return cls(tuple(order))

    @classmethod
    def from_meta(cls, text: str) -> RelationGraph:
        return cls(tuple((p, c) for p, c in json.loads(text)["relation_order"]))

    def to_meta(self) -> str:
        tables = {t: {"parents": self.parents(t), "children": self.children(t)} for t in self.tables}
        return json.dumps({"relation_order": [list(e) for e in self.edges], "tables": tables})

    @property
    def tables(self) -> list[str]:
        return list(dict.fromkeys(c for _, c in self.edges))

    @property
    def relations(self) -> list[tuple[str, str]]:
        return [(p, c) for p, c in self.edges if p is not None]

    def parents(self, table: str) -> list[str]:
        return [p for p, c in self.relations if c == table]

    def children(self, table: str) -> list[str]:
        return [c for p, c in self.relations if p == table]

    def long_paths(self) -> list[tuple[str, ...]]:
        """M9: every directed path with two edges or more, from every table that has children."""
        found: list[tuple[str, ...]] = []
        for start in dict.fromkeys(p for p, _ in self.relations):
            stack = [(start,)]
            while stack:
                path = stack.pop()
                if len(path) > 2:
                    found.append(path)
                for child in reversed(self.children(path[-1])):
                    if child in path:
                        raise ValueError("the relation graph has a cycle")
                    stack.append((*path, child))
        return found


@dataclass(frozen=True)
class RelationalDataset:
    tables: Mapping[str, DataFrame]
    specs: Mapping[str, TableSpec]
    graph: RelationGraph

    def replacing(self, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] | None = None) -> RelationalDataset:
        return replace(self, tables={**self.tables, **tables}, specs={**self.specs, **(specs or {})})

    def foreign_key(self, parent: str, child: str) -> str:
        return self.specs[child].foreign_keys[parent]
