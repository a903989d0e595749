"""What can go wrong, by cause."""

from __future__ import annotations


class CollectionError(Exception):
    """Any failure of this library."""


class DatasetNotFound(CollectionError, KeyError):
    """No such dataset, or the deletion mask hides it."""

    def __str__(self) -> str:
        return f"dataset not found: {self.args[0]}"


class ArrayNotFound(CollectionError, KeyError):
    """The dataset has no such array."""

    def __str__(self) -> str:
        return f"array not found: {self.args[0]}"


class DatasetAlreadyExists(CollectionError):
    """A dataset of that name was begun before; names stay reserved even if its writing was given up."""


class ArrayAlreadyExists(CollectionError):
    """The dataset already has an array of that name."""


class InvalidName(CollectionError, ValueError):
    """A name is empty, has a slash, is a dot or two, or begins with an underscore."""


class NotACollection(CollectionError):
    """There is no manifest at the location, or it isn't one."""


class UnsupportedVersion(CollectionError):
    """The manifest's version is not the one that this library reads."""


class CorruptCollection(CollectionError):
    """The tables contradict each other, or an array isn't of the requested type."""


class CorruptMask(CollectionError):
    """The deletion mask can't be read as one."""


class WriterFinished(CollectionError):
    """The writer has committed or was given up."""


class UnsupportedType(CollectionError, NotImplementedError):
    """A value has no type in this data model."""


class InvalidValue(CollectionError, ValueError):
    """A value is out of its type's range or of another kind."""


class SourceError(CollectionError, ValueError):
    """A location can't be resolved to a file system."""
