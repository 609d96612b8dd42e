"""Operators by name: plain functions ``f(df, ...) -> DataFrame``."""

from importlib import import_module
from inspect import getmembers, isfunction

MODULES = [
    "shaping", "profiling", "extraction", "matching", "decisions", "candidates", "resolve", "xref", "insights", "regress",
    "telemetry", "catalog", "positions",
]


def operator_catalog() -> dict[str, callable]:
    """``module.function`` for every public operator."""
    found = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        found.update({f"{name}.{n}": f for n, f in getmembers(module, isfunction) if f.__module__ == module.__name__ and not n.startswith("_")})
    return found
