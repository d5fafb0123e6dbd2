"""Registered queries on the given tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for m in iter_modules(__path__):
        if m.name.endswith("_queries"):
            import_module(f"{__name__}.{m.name}")
