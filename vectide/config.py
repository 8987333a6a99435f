"""Limits and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .errors import InvalidArgument


@dataclass(frozen=True)
class Limits:
    """Bounds of one request; each can be raised. The defaults."""

    max_k: int = 1000
    max_queries: int = 64
    max_add_coordinates: int = 4_000_000
    frame_bytes: int = 2 * 1024 * 1024
    batch_bytes: int = 64 * 1024
    query_timeout_s: int = 30

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "VECTIDE_") -> Limits:
        """Each field from PREFIX + its upper-case name; a value that is no positive whole number is refused."""
        env = os.environ if env is None else env
        return cls(**{f.name: positive(env[prefix + f.name.upper()], f.name) for f in fields(cls) if prefix + f.name.upper() in env})


def positive(value: str, name: str) -> int:
    try:
        n = int(value)
    except ValueError:
        n = 0
    if n <= 0:
        raise InvalidArgument(f"{name} must be a positive whole number, not {value!r}")
    return n


def flag(value: str | None, name: str, default: bool = False) -> bool:
    if value is None or value == "":
        return default
    if value.lower() in ("1", "true", "yes", "on"):
        return True
    if value.lower() in ("0", "false", "no", "off"):
        return False
    raise InvalidArgument(f"{name} must be true or false, not {value!r}")
