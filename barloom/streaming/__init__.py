"""Incremental arrival. It comes in batches that are merged into history by key."""
