"""Queries over the tables. `load` imports every module that registers some."""

import importlib
import pkgutil

from inkwright.plans.registry import CORE


def load():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return CORE
