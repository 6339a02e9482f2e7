"""Registered queries over the given tables."""

import importlib

MODULES = (
    "selection",
    "collections",
    "joining",
    "filling",
    "collecting",
    "combining",
    "weighting",
    "optimising",
    "correcting",
    "extracting",
    "catalogs",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"eventloom.plans.{name}")
