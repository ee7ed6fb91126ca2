"""Words of a text as native columns, and the words' hashes for code that runs in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.llm.spans import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that are white space in the contracts.
SPACE = r"\x20\x09-\x0D"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Where all characters are ASCII, lower() does the same at less cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _trimmed(parts: Column) -> Column:
    """Without the empty strings that a split leaves at either end."""

    def kept(p: Column) -> Column:
        first = F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(p) > first) & (F.get(p, F.size(p) - 1) == ""), 1).otherwise(0)
        return F.slice(p, first + 1, F.size(p) - first - last)

    return let(parts, kept)


def plain_words(text: Column) -> Column:
    """Array of the runs of characters other than white space; null text has none."""
    return _trimmed(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"))


def folded_words(text: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered; null text has none."""
    return _trimmed(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
