"""What one dataset declares, as a value that compares by content."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ArrayMeta:
    name: str
    dtype: str
    position: int = field(compare=False)
    attribute_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class SchemaView:
    """Arrays in order, and the dataset's attributes as (key, type). Equal views declare the same arrays and
    attribute keys in the same order; the types of the dataset's attributes don't matter."""

    arrays: tuple[ArrayMeta, ...]
    pairs: tuple[tuple[str, str], ...] = field(compare=False)
    attribute_names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "attribute_names", tuple(k for k, _ in self.pairs))

    def __len__(self) -> int:
        return len(self.arrays)

    def __iter__(self) -> Iterator[ArrayMeta]:
        return iter(self.arrays)

    def names(self) -> list[str]:
        return [a.name for a in self.arrays]

    def index_of(self, array: str) -> int | None:
        return next((i for i, a in enumerate(self.arrays) if a.name == array), None)

    def get(self, array: str) -> ArrayMeta | None:
        return next((a for a in self.arrays if a.name == array), None)

    def get_index(self, position: int) -> ArrayMeta | None:
        return self.arrays[position] if 0 <= position < len(self.arrays) else None

    def attribute_dtype(self, key: str) -> str | None:
        return dict(self.pairs).get(key)
