"""What a worker process keeps from task to task: one object, so that stages don't add up their caches.

Spark reuses worker processes for the tasks of all stages. The object of a stage goes when a task of another asks for
its own; until then the tasks of a stage share it. What is kept never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

_KEPT: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """The object called ``name``, made if the worker doesn't hold it; all others are let go first."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]
