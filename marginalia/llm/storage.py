"""Intermediate tables in the folder that the whole cluster shares."""

from marginalia.sources.store import discard, shared_folder
from marginalia.sources.store import materialised as saved

__all__ = ["discard", "saved", "shared_folder"]
