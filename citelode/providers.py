"""Model stages as column providers, chosen by name.

A provider takes and returns columns, so an external model drops in as an iterator
Pandas UDF; the defaults are deterministic and need no model.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column

from citelode.functions import text as T
from citelode.operators import fusion, vectors

_REGISTRY: dict[str, dict[str, Callable]] = {
    "normalizer": {"whitespace": lambda: T.tokens},
    "embedder": {"hashing": vectors.hashing_embedder},
    "reranker": {"lexical": lambda: fusion.lexical_score},
}


def register(phase: str, name: str, factory: Callable) -> None:
    _REGISTRY.setdefault(phase, {})[name] = factory


def provider(phase: str, name: str, **params) -> Callable[..., Column]:
    try:
        factory = _REGISTRY[phase][name]
    except KeyError:
        raise ValueError(f"no {phase} named {name!r}; known: {sorted(_REGISTRY.get(phase, {}))}") from None
    return factory(**params)


def identity(name: str, **params) -> str:
    """Name plus twelve digits of its canonical parameters; the key of cached work."""
    canonical = json.dumps({"name": name, "params": params}, sort_keys=True, separators=(",", ":"))
    return f"{name}-{hashlib.sha256(canonical.encode()).hexdigest()[:12]}"
