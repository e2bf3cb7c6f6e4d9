"""Registered queries, one module per family of operators."""

from importlib import import_module
from pathlib import Path

_SKIP = {"__init__", "registry", "star"}


def load_all() -> None:
    for path in sorted(Path(__file__).parent.glob("*.py")):
        if path.stem not in _SKIP:
            import_module(f"{__name__}.{path.stem}")
