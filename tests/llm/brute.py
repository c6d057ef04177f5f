"""Plain single-process versions of what the operators compute, for small inputs."""

from __future__ import annotations

from collections import defaultdict


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)])


def linked_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least id reachable), comparing every two documents with a common shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    done = set()
    for i, s in sets.items():
        for j in {x for g in s for x in holders[g] if x > i}:
            if (i, j) not in done:
                done.add((i, j))
                if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}
