"""Readers and writers: file trees, tables, exports."""
