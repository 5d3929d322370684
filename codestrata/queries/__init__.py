"""Queries bound to the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    from . import registry

    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, registry.ORACLES
