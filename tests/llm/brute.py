"""Brute force that several tests share."""

from __future__ import annotations


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts: list[str | None]) -> list[int]:
    """The first text that each reaches over pairs whose 5-word shingles have a similarity of 0.8."""
    sets, roots = list(map(shingles, texts)), list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if roots[i] != roots[j] and (len(x & y) >= 0.8 * len(x | y) if x | y else True):
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots
