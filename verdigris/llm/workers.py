"""What a Python worker remembers between tasks.

Spark reuses workers from stage to stage, so what one operator remembers would lie beside the next operator's memory. An
operator claims the worker before it fills its memory; what others remembered is let go then.
"""

from __future__ import annotations

from collections.abc import Callable

_HOLDERS: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None] = lambda: None) -> None:
    if name in _HOLDERS:
        return
    if _HOLDERS:
        import ctypes
        import gc

        for drop in _HOLDERS.values():
            drop()
        _HOLDERS.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
    _HOLDERS[name] = forget
