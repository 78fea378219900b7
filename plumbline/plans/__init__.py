"""Registered queries, one module per group of operators."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
