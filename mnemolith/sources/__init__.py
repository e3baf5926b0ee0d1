"""Readers and writers: JSON lines and trees, Arrow streams, text in several formats, tables with manifests, keyed upserts, resumable appends."""
