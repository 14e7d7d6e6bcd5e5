"""Quality tiers, surfaces and overrides."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Profile:
    """What a tier may spend: candidates a list, the width of the vector search, graph hops and neighbours, the trade of rank against variety."""

    name: str
    candidates: int
    mmr: float
    bm25: bool = True
    hops: int = 0
    neighbours: int = 0
    budget_ms: int = 0
    efs: int = 64


# fixed values: the shipped tiers and surfaces
TIERS = (
    Profile("instant", 5, 1.0, budget_ms=150, efs=32),
    Profile("fast", 20, 0.7, budget_ms=220, efs=50),
    Profile("balanced", 30, 0.7, hops=1, neighbours=5, budget_ms=320, efs=64),
    Profile("thorough", 40, 0.6, hops=1, neighbours=8, budget_ms=700, efs=100),
    Profile("exhaustive", 80, 0.5, hops=2, neighbours=12, budget_ms=1600, efs=200),
)
SURFACES = {"hook": (1, 0.66, 1500), "mcp": (3, 0.55, 4000)}


def overridden(base: Any, changes: dict[str, Any]) -> Any:
    """base with the named fields replaced; None leaves a field as it is, an unknown name is an error that suggests the nearest."""
    known = vars(base)
    for name in changes:
        if name not in known:
            raise KeyError(f"{name}; did you mean {suggestion(name, list(known))}?")
    return replace(base, **{k: v for k, v in changes.items() if v is not None})


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def suggestion(name: str, known: list[str]) -> str | None:
    """The known name nearest to a mistyped one, by name among equals; None if all are further than a third of its length."""
    near = sorted((edit_distance(name, k), k) for k in known)
    return near[0][1] if near and near[0][0] <= max(len(name) // 3, 1) else None
