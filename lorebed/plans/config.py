"""Settings as nested maps: small and on the driver."""

from __future__ import annotations

from functools import reduce
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` put on it, map by map."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return base | both


def get(settings: dict, path: str, default: Any = None) -> Any:
    """What is at a dotted path."""
    found = reduce(lambda at, name: at.get(name) if isinstance(at, dict) else None, path.split("."), settings)
    return default if found is None else found


def put(settings: dict, path: str, value: Any) -> dict:
    """``settings`` with a value at a dotted path."""
    return merged(settings, reduce(lambda inner, name: {name: inner}, reversed(path.split(".")), value))
