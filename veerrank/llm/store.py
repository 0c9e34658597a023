"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

from ..sources.shared import buckets_for, discard, input_bytes, scratch, shared_dir, shelve, stash

__all__ = ["buckets_for", "discard", "input_bytes", "scratch", "shared_dir", "shelve", "stash"]
