"""Cutting windows out of a long text.

A substring is found by walking the text from its start. Many windows of one text are
therefore cut from a list of chunks of fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1024


def text_chunks(text: Column, chunk: int = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{chunk}}})"), F.lit(1))


def window_text(chunks: Column, start: Column, end: Column, chunk: int = CHUNK) -> Column:
    """Characters start..end of the text behind ``chunks``."""
    first = F.floor(start / chunk).cast("int")
    last = F.floor(F.greatest(end - 1, start) / chunk).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.substring(part, (start - first * chunk + 1).cast("int"), (end - start).cast("int"))
