"""Invented prose."""

from __future__ import annotations

import random


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(("an", "er", "on", "the", "re", "ti", "ou", "é", "st", "ha")) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def lined(words: list[str], per: int = 9) -> str:
    return "\n".join(" ".join(words[i : i + per]) for i in range(0, len(words), per))
