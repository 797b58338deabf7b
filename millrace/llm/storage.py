"""Intermediate tables of the corpus operators: those of the library."""

from millrace.storage import Table, delete, fresh_path, release, scratch, shared_dir, shuffle_width

__all__ = ["Table", "delete", "fresh_path", "release", "scratch", "shared_dir", "shuffle_width"]
