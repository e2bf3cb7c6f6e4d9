"""Relational data synthesis and fidelity measurement on Spark DataFrames."""

from kinweave.specs import Domain, RelationalDataset, RelationGraph, TableSpec

__all__ = ["Domain", "RelationGraph", "RelationalDataset", "TableSpec"]
