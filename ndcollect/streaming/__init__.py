"""Arrays in bounded blocks at ingest: a task holds one at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product


def blocks(shape: list[int], chunk: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """(start, size) of every block of an array, row-major, clipped at the edges; one empty block where an axis has no cells."""
    if any(s == 0 for s in shape):
        return
    for at in product(*(range(0, s, c) for s, c in zip(shape, chunk))):
        yield list(at), [min(c, s - a) for a, s, c in zip(at, shape, chunk)]
