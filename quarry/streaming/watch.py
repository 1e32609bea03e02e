"""Detectors over a stream of new files: they look at one file at a time, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import corpus, detectors


def watch(files: DataFrame) -> DataFrame:
    """Findings of a streaming frame (relative_path, content): credentials and unfinished-work comments."""
    known = corpus.with_language(files)
    return detectors.secrets(known).unionByName(detectors.todo_comments(known))
