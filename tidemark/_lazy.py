"""Public names that are loaded when they are asked for."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module


def exported(package: str, places: dict[str, str]) -> tuple[Callable[[str], object], list[str]]:
    """A package's ``__getattr__`` and ``__all__``: ``places`` has the names of each of its modules, by spaces."""
    of = {name: module for module, names in places.items() for name in names.split()}

    def get(name: str):
        if name not in of:
            raise AttributeError(f"{package} has no {name}")
        return getattr(import_module(f"{package}.{of[name]}"), name)

    return get, sorted(of)
