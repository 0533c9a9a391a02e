"""Shared-folder tables: results cut from their lineage, in the folder all executors share."""

from __future__ import annotations

from weftline.sources.state import discard as drop
from weftline.sources.state import shared_dir
from weftline.sources.state import stored as written

__all__ = ["drop", "shared_dir", "written"]
