"""Logging to a file, once a path."""

from __future__ import annotations

import logging
import os

LOGGER = logging.getLogger("ndcollect")


def log_to_file(path: str, level: int = logging.INFO) -> logging.Handler:
    """Append the library's messages to a file; asking again for the same file changes nothing. Gives the handler."""
    path = os.path.abspath(path)
    for h in LOGGER.handlers:
        if getattr(h, "baseFilename", None) == path:
            return h
    handler = logging.FileHandler(path, mode="a", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    LOGGER.addHandler(handler)
    LOGGER.setLevel(min(level, LOGGER.level or level))
    return handler
