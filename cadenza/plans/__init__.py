"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType

from cadenza.plans import catalog


def registered() -> ModuleType:
    """The catalogue, after every module of this package has added its queries to it."""
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
    return catalog
