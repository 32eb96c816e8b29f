"""Readers and writers."""

from tidemark.sources.tables import checkpoint, ensure_checkpoint_dir, table

__all__ = ["checkpoint", "ensure_checkpoint_dir", "table"]
