"""Query modules; each holds a ``REG`` of queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from gridloom.registry import Registry


def registries() -> list[Registry]:
    return [import_module(f"{__name__}.{m.name}").REG for m in iter_modules(__path__)]
