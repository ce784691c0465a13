"""Built column expressions, kept for reuse.

A Column is not bound to a frame, and building a few thousand of them takes seconds of driver
time. Jobs that run per micro-batch build them once per set of definitions.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import SparkContext

# Expressions of this many sets of definitions are kept, those used last.
MOST = 64
_KEPT: OrderedDict[Hashable, object] = OrderedDict()


def memo(name: str, owners: list, build: Callable[[], object], *key: Hashable):
    """``build()``, once per name, key and content of ``owners``."""
    full = (name, id(SparkContext._gateway), tuple(map(repr, owners)), key)
    if full not in _KEPT:
        _KEPT[full] = build()
        if len(_KEPT) > MOST:
            _KEPT.popitem(last=False)
    _KEPT.move_to_end(full)
    return _KEPT[full]
