"""Imports every plan module once, so that the registry is complete."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "tables",
    "relational",
    "aggregates",
    "rankings",
    "noise",
    "consensus",
    "ensembles",
    "clusters",
    "recommendation",
    "evaluation",
)


def load() -> None:
    for name in MODULES:
        import_module(f"ratesift.plans.{name}")
