"""Operators for training-data pipelines; nothing else in the package imports this one."""

from __future__ import annotations

import re
from importlib import import_module
from pkgutil import iter_modules

from gridloom.registry import Registry


def registries() -> list[Registry]:
    """Registries of the query modules, those named ``p<N>_...``."""
    return [import_module(f"{__name__}.{m.name}").REG for m in iter_modules(__path__) if re.match(r"p\d+_", m.name)]
