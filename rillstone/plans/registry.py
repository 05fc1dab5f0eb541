"""Named functions: estimators, losses, reward functions, tokenizers, plug-ins."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """Names for functions; giving a name to a second function is an error, asking for an unknown one too."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str, value: T | None = None) -> Callable[[T], T]:
        def put(x: T) -> T:
            if self._known.get(name, x) is not x:
                raise ValueError(f"{self.kind} {name!r} is taken")
            self._known[name] = x
            return x

        return put(value) if value is not None else put

    def __getitem__(self, name: str) -> T:
        if name not in self._known:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._known))


def load_function(path: str, name: str, **options) -> Callable:
    """A user's function from a Python file, with keyword arguments bound."""
    spec = importlib.util.spec_from_file_location(f"user_{abs(hash(path))}", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    found = getattr(module, name)
    return (lambda *a, **k: found(*a, **{**options, **k})) if options else found
