"""Options, taken at plan time and baked into expressions as literals; executors never read them."""

from __future__ import annotations

import threading
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Env:
    """significant: digits of a coordinate that are free of noise.  Use as a context or pass on."""

    significant: float = 9.0
    default_index_dtype: str = "int"
    allow_complex_footprint: bool = False

    def __post_init__(self):
        if not self.significant > 0:
            raise ValueError("significant must be positive")
        if self.default_index_dtype not in ("byte", "short", "int", "long"):
            raise ValueError("default_index_dtype must be an integer type")

    def __enter__(self):
        _stack().append(self)
        return self

    def __exit__(self, *_):
        _stack().pop()

    def but(self, **changes) -> "Env":
        return replace(self, **changes)


_local = threading.local()
_main = [Env()]


def _stack() -> list[Env]:
    if not hasattr(_local, "stack"):
        _local.stack = list(_main)
    return _local.stack


def current() -> Env:
    return _stack()[-1]
