"""Collections of many labelled N-dimensional datasets on Spark."""

from .errors import CollectionError
from .ops import create, describe, info, list_datasets, remove
from .reader import Collection, Dataset
from .sources.ingest import ArraySpec, from_dataframe
from .writer import CollectionWriter, save

__all__ = ["ArraySpec", "Collection", "CollectionError", "CollectionWriter", "Dataset", "create", "describe", "from_dataframe", "info", "list_datasets", "remove", "save"]
