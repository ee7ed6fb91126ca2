"""Code-aware tokens of whole tables, cut in Arrow batches: the same sets as ``text.code_tokens``, in no fixed order.

Bytes are told apart by a table, and each different run of letters and digits is looked at once a batch, however often it stands there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Bytes of text that are cut at once, whole texts at least.
STRETCH = 4 << 20
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The different ones in ascending order: by a sort, which is many times faster than numpy's table of hashes."""
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


def _of_runs(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """To different runs: where each one's tokens begin (and the end), their numbers, and the tokens."""
    every = np.arange(len(runs))
    low = pc.ascii_lower(runs)
    mixed = np.flatnonzero(pc.match_substring_regex(runs, "[a-z][A-Z]|[A-Z][A-Z][a-z]").to_numpy(zero_copy_only=False))
    parts = pc.replace_substring_regex(runs.take(pa.array(mixed)), "([a-z])([A-Z])", r"\1 \2")
    parts = pc.split_pattern(pc.replace_substring_regex(parts, "([A-Z]+)([A-Z][a-z])", r"\1 \2"), " ")
    named = pc.replace_substring_regex(pa.concat_arrays([low, pc.ascii_lower(parts.flatten())]), "^[0-9]+", "")
    owner = np.concatenate([every, every, mixed.repeat(parts.value_lengths().to_numpy(zero_copy_only=False))])
    tokens = pa.concat_arrays([low, named])
    long = pc.greater(pc.binary_length(tokens), 1).to_numpy(zero_copy_only=False)
    coded = tokens.filter(pa.array(long)).dictionary_encode()
    n = max(1, len(coded.dictionary))
    owner, number = np.divmod(_distinct(owner[long] * n + coded.indices.to_numpy()), n)
    return np.searchsorted(owner, np.arange(len(runs) + 1)), number, coded.dictionary


def _runs(texts: pa.StringArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text that each run of letters and digits stands in, and the runs; none goes on from one text into the next."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _RUN[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    within = offsets[inside[offsets] & inside[offsets + 1]]  # where a text ends and the next begins inside a run
    if len(within):
        turns = np.sort(np.append(turns, np.repeat(np.unique(within), 2)))
    starts, stops = turns[::2], turns[1::2]
    ends = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside[1:-1]])).dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets))), runs


def _cut(texts: pa.StringArray) -> tuple[pa.ListArray, pa.StringArray, np.ndarray]:
    """The distinct tokens of each text, none of which is null; the tokens of all, and how many texts have each."""
    doc, runs = _runs(texts)
    first, number, tokens = _of_runs(runs.dictionary)
    doc, run = np.divmod(_distinct(doc * max(1, len(runs.dictionary)) + runs.indices.to_numpy()), max(1, len(runs.dictionary)))
    many = first[run + 1] - first[run]
    at = np.arange(many.sum()) + np.repeat(first[run] - np.append(0, np.cumsum(many))[:-1], many)
    doc, token = np.divmod(_distinct(np.repeat(doc, many) * max(1, len(tokens)) + number[at]), max(1, len(tokens)))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), tokens.take(pa.array(token))), tokens, np.bincount(token, minlength=len(tokens))


def _stretches(texts: pa.Array) -> list[pa.StringArray]:
    """The texts in parts that are cut at once; null is an empty text."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    # A stretch holds whole texts, and more than its bytes only by one.
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // STRETCH)) + 1
    return [texts.slice(a, b - a).cast(pa.string()) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)]


def _cut_all(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_cut(x)[0] for x in _stretches(texts)])


def counted(rows: DataFrame, text: str) -> DataFrame:
    """The other columns of the rows, tokens, many: a row per text with its distinct tokens (many is null), and a row per stretch of texts
    with all tokens of it and how many of its texts have each (the other columns are null).

    So texts are cut and tokens counted in one pass, and what is left to add up is a row per token of a stretch, not of a text."""
    others = [c for c in rows.columns if c != text]

    def cut(batches):
        for batch in batches:
            at = 0
            for part in _stretches(batch.column(text)):
                held, tokens, many = _cut(part)
                own = [batch.column(c).slice(at, len(part)) for c in others]
                at += len(part)
                names = [*others, "tokens", "many"]
                yield pa.RecordBatch.from_arrays([*own, held, pa.nulls(len(part), pa.list_(pa.int64()))], names)
                both = [pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), x) for x in (tokens, pa.array(many, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x.type) for x in own), *both], names)

    schema = StructType([StructField(c, rows.schema[c].dataType) for c in others]).add("tokens", ArrayType(StringType())).add("many", ArrayType(LongType()))
    return rows.mapInArrow(cut, schema)


def token_sets(text: Column) -> Column:
    """Array of the distinct tokens of each text, none for null."""
    return F.arrow_udf(_cut_all, "array<string>")(text)
