"""Registered queries, by family; importing a module of this package registers its queries."""

from importlib import import_module

MODULES = ["teams", "ranks", "forecasts", "audits", "models", "features", "bank", "history", "contracts", "extras", "arms", "storage"]


def load() -> None:
    for name in MODULES:
        import_module(f"fieldglass.plans.{name}")
