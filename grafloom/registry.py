"""Names of all operators: procedures take a graph first and return rows, functions map columns to a column."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, NamedTuple


class Entry(NamedTuple):
    name: str
    kind: str  # read, write, function or batch
    call: Callable[..., Any]

    def signature(self) -> str:
        return f"{self.name}{inspect.signature(self.call)}"


REGISTRY: dict[str, Entry] = {}


def register(*names: str, kind: str = "read") -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    def add(call: Callable[..., Any]) -> Callable[..., Any]:
        for name in names:
            if name in REGISTRY:
                raise ValueError(f"{name} is already registered")
            REGISTRY[name] = Entry(name, kind, call)
        return call

    return add


def function(*names: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    return register(*names, kind="function")


def load_all() -> dict[str, Entry]:
    """Import every module that registers something."""
    import importlib
    import pkgutil

    import grafloom

    for part in ("functions", "operators", "sources", "streaming"):
        package = importlib.import_module(f"grafloom.{part}")
        for m in pkgutil.iter_modules(package.__path__):
            importlib.import_module(f"grafloom.{part}.{m.name}")
    assert grafloom
    return REGISTRY


def lookup(name: str) -> Entry:
    if name not in REGISTRY:
        load_all()
    if name not in REGISTRY:
        raise KeyError(f"no operator named {name}")
    return REGISTRY[name]
