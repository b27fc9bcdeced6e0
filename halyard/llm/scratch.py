"""Intermediate tables, as the library keeps them."""

from halyard.sources.scratch import drop_scratch, shared_dir, written

__all__ = ["drop_scratch", "shared_dir", "written"]
