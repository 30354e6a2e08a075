"""What a worker process keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The object of ``key``.  A worker keeps one only, so that operators that run one after the other do not add up."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drops what the worker keeps; called by tasks that need none of it."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


class Remembered(dict):
    """A dictionary that computes what it lacks and keeps between one and two times ``most`` recent keys, none longer than ``longest``."""

    def __init__(self, make: Callable[[Any], Any], most: int, longest: int) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
