"""Substring dedup by recompression: passages that a document with a smaller id has too are taken out.

A text is a row of symbols, at first its words. Each round names the runs of a symbol and then pairs of neighbours: a name's digest puts it on
the left or on the right, and a left symbol with a right one after it becomes one symbol. Names are digests of what they stand for, so equal passages get equal symbols in all texts, but for some at their ends. Of a
symbol it is known from which words it follows (its reach); wherever these come, the symbol does.

A window of 13 words has as its sign the highest symbol whose reach lies in it (the least name among several). Equal windows have equal
signs. So a first round of exchange finds signs that several documents share, which a bounded sieve tells to all tasks; only windows
with such a sign take part in the second, in which two digests of the whole window verify it. Both exchanges are
summed up in the tasks first, so that a passage of very many documents is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.names import BASES, Runs, Sieve, U, Words, as_batch, dealt, gathered, mixed, share_for, slices
from loomspark.session import checkpointed

#: Words of a window, and rounds of naming: symbols of a third round reach over more than a window.
SPAN, ROUNDS = 13, 2
#: Windows or signs that a task holds before it passes them on.
HELD = 1_000_000
#: Bytes of spans that are sent to all tasks; more are joined by a shuffle.
BROADCAST = 64 << 20
_INSIDE = np.array([b not in (0x20, *range(0x09, 0x0E)) for b in range(256)])
_FAR = 1 << 40


def _levels(words: Words, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each round's new symbols the name, and the first and last word (exclusive) of the reach; it is endless at either end of a text."""
    name, text = words.name, words.text
    low = np.arange(len(name))
    high = low + 1
    for r in range(rounds):
        if not len(name):
            return
        # Runs: a symbol follows from itself and its neighbours, which show that the run has ended.
        first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1]))))
        size = np.diff(np.append(first, len(name)))
        before, after = np.maximum(first - 1, 0), np.minimum(first + size, len(name) - 1)
        own = text[first]
        low = np.where((first > 0) & (text[before] == own), low[before], -_FAR)
        high = np.where((first + size < len(name)) & (text[after] == own), high[after], _FAR)
        new = size > 1
        name, text = np.where(new, mixed(name[first] * BASES[1] + size.astype(U)), name[first]), own
        # Pairs: a left symbol looks at the next one, a right symbol at the one before.
        right = (mixed(name ^ U(int(BASES[0]) * (r + 1) % (1 << 64))) >> U(63)) == 1
        near = np.append(text[1:] == text[:-1], False)
        pair = np.append(~right[:-1] & right[1:], False) & near
        second = np.concatenate(([False], pair[:-1]))
        next_high = np.where(near, np.append(high[1:], _FAR), _FAR)
        last_low = np.where(np.concatenate(([False], near[:-1])), np.concatenate(([-_FAR], low[:-1])), -_FAR)
        high = np.where(right, high, next_high)
        low = np.where(right & ~second, last_low, low)
        name = np.where(pair, mixed(name * BASES[0] + np.append(name[1:], U(0)) * BASES[1]), name)
        kept = ~second
        name, text, low, high, new = name[kept], text[kept], low[kept], high[kept], (new | pair)[kept]
        yield name[new], low[new], high[new]


def signs(words: Words, span: int = SPAN, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window, and the name of its sign: that of the words which the sign reaches over, or the window's own."""
    n = len(words.name)
    starts = np.flatnonzero(words.text[: n - span + 1] == words.text[span - 1 :]) if n >= span else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, U)
    best = np.full(n, np.iinfo(np.uint64).max, U)
    lows, highs, known = [], [], 0
    for r, (name, low, high) in enumerate(_levels(words, rounds)):
        some = high - low <= span
        name, low, high = name[some], low[some], high[some]
        rank = (U(rounds - 1 - r) << U(61)) | ((name >> U(36)) << U(33)) | (np.arange(len(name), dtype=U) + U(known))
        # A symbol offers itself to all windows that it lies in.
        many = span + 1 - (high - low)
        place = np.repeat(high - span, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        inside = place >= 0
        np.minimum.at(best, place[inside], np.repeat(rank, many)[inside])
        lows.append(low)
        highs.append(high)
        known += len(name)
    best = best[starts]
    none = best == np.iinfo(np.uint64).max
    chosen = (best & U((1 << 33) - 1)).astype(np.int64)
    chosen[none] = 0
    low, high = (np.concatenate([*x, [0]]).astype(np.int64)[chosen] for x in (lows, highs))
    runs = Runs(words.name)
    return starts, runs.names(np.where(none, starts, low), np.where(none, starts + span, high))


def _texts(docs: DataFrame) -> DataFrame:
    """id, h (hash of the text) and text as bytes of the rows that take part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part.column("id").to_numpy(), part.column("h").to_numpy(), Words(part.column("text").to_pylist(), _INSIDE)


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    for c in columns:
        new[1:] &= c[1:] == c[:-1]
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def _summed(held: list[tuple], share: int) -> Iterator[dict]:
    """A row a bucket of signs with their least and greatest document and number of windows."""
    name, low, high, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(name, kind="stable")
    name, low, high, n = name[order], low[order], high[order], n[order]
    at = _runs_of(name) if len(name) else np.zeros(0, np.int64)
    if len(at):
        name, low, high, n = name[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(n, at)
        yield from dealt((name >> U(64 - share)).astype(np.int64), {"name": name, "low": low, "high": high, "n": n})


def shared_signs(texts: DataFrame, share: int, size: int, span: int = SPAN) -> tuple[Sieve, int]:
    """The sieve of signs that more than one document has, and how many windows have one."""
    out = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("name", "low", "high", "n")]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for ids, _, words in _parts(batches):
            starts, name = signs(words, span)
            if not len(starts):
                continue
            owner = ids[words.text[starts]]
            at = _runs_of(name, owner)
            held.append((name[at], owner[at], owner[at], np.diff(np.append(at, len(name)))))
            many += len(at)
            if many > HELD:
                yield as_batch(list(_summed(held, share)), out)
                held, many = [], 0
        if held:
            yield as_batch(list(_summed(held, share)), out)

    def tell(table: pa.Table) -> pa.Table:
        columns = [gathered(table, c, k) for c, k in (("name", "<u8"), ("low", "<i8"), ("high", "<i8"), ("n", "<i8"))]
        row = next(_summed([tuple(columns)], share))
        name, low, high, n = (np.frombuffer(row[c], k) for c, k in (("name", "<u8"), ("low", "<i8"), ("high", "<i8"), ("n", "<i8")))
        several = low < high
        return pa.table({"bucket": pa.array([row["bucket"]], pa.int32()), "bits": [Sieve.segment(name[several], size, share)], "n": [int(n[several].sum())]})

    found = texts.mapInArrow(ask, "bucket int, name binary, low binary, high binary, n binary").groupBy("bucket").applyInArrow(tell, "bucket int, bits binary, n long")
    rows = found.where("n > 0").collect()  # 2 ** size bits in all
    return Sieve.joined({r["bucket"]: bytes(r["bits"]) for r in rows}, size, share), sum(r["n"] for r in rows)


def _judged(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of windows by both digests: whether one of a smaller document is among them."""
    order = np.lexsort((b, a))
    at = _runs_of(a[order], b[order])
    least = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(order))))
    out = np.empty(len(order), bool)
    out[order] = ids[order] > least
    return out


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """id, h, spans of each document that loses words: the merged spans (first word, last word exclusive; 32-bit numbers) of its windows that
    a document with a smaller id has too."""
    texts = _texts(docs).where("id is not null")
    n_words = (texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] or 0) // 6  # one number, for sizes alone
    share, size = share_for(n_words // 6), Sieve.bits_for(n_words // 32)
    sieve, n = shared_signs(texts, share, size, span)
    told = docs.sparkSession.sparkContext.broadcast(sieve)
    windows, owners = share_for(n), share_for(n, 4_000_000)
    columns = ("id", "h", "a", "b", "place")
    out = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in columns]])
    kinds = {"id": "<i8", "h": "<i8", "a": "<u8", "b": "<u4", "place": "<u4"}

    def of_owner(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (mixed(ids.view(np.uint64) * BASES[0] + h.view(np.uint64)) >> U(64 - owners)).astype(np.int64)

    def passed(held: list[tuple]) -> Iterator[dict]:
        """Windows that are the least of the task, by their digest; of others it is known that they go, and they stand behind, by document."""
        ids, h, a, b, place = (np.concatenate(x) for x in zip(*held, strict=True))
        gone = _judged(a, b, ids)
        stay = ~gone
        yield from dealt((a[stay] >> U(64 - windows)).astype(np.int64), dict(zip(columns, (ids[stay], h[stay], a[stay], b[stay], place[stay]), strict=True)))
        for row in dealt(of_owner(ids[gone], h[gone]) + (1 << windows), {"id": ids[gone], "h": h[gone], "place": place[gone]}):
            yield row | {"a": b"", "b": b""}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, held, many = told.value, [], 0
        for ids, h, words in _parts(batches):
            starts, name = signs(words, span)
            starts = starts[sieve.holds(name)]
            if not len(starts):
                continue
            runs, of = Runs(words.name, 2), words.text[starts]
            a, b = (runs.names(starts, starts + span, lane) for lane in (0, 1))
            held.append((ids[of], h[of], a, (b >> U(32)).astype("<u4"), (starts - words.at[of]).astype("<u4")))
            many += len(starts)
            if many > HELD:
                yield as_batch(list(passed(held)), out)
                held, many = [], 0
        if held:
            yield as_batch(list(passed(held)), out)

    def verify(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        got = {c: gathered(table, c, kinds[c]) for c in columns}
        if bucket < 1 << windows:
            gone = _judged(got["a"], got["b"], got["id"])
            rows = list(dealt(of_owner(got["id"][gone], got["h"][gone]), {c: got[c][gone] for c in ("id", "h", "place")}))
        else:
            rows = [{"bucket": bucket - (1 << windows)} | {c: got[c].tobytes() for c in ("id", "h", "place")}]
        return pa.Table.from_pylist(rows, pa.schema([out.field(c) for c in ("bucket", "id", "h", "place")]))

    def merge(table: pa.Table) -> pa.Table:
        ids, h, place = (gathered(table, c, kinds[c]) for c in ("id", "h", "place"))
        order = np.lexsort((place, h, ids))
        ids, h, place = ids[order], h[order], place[order].astype(np.int64)
        owner = _runs_of(ids, h)
        apart = np.zeros(len(ids), bool)
        apart[owner] = True
        apart[1:] |= place[1:] > place[:-1] + span
        first = np.flatnonzero(apart)
        spans = np.column_stack((place[first], place[np.append(first[1:], len(place)) - 1] + span)).astype("<u4")
        cut = np.searchsorted(first, np.append(owner, len(ids)))
        each = [spans[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"id": pa.array(ids[owner]), "h": pa.array(h[owner]), "spans": pa.array(each, pa.binary())})

    # Each bucket of windows gives rows for many documents, which meet those whose fate the tasks knew.
    found = texts.mapInArrow(ask, "bucket int, " + ", ".join(f"{c} binary" for c in columns))
    gone = found.groupBy("bucket").applyInArrow(verify, "bucket int, id binary, h binary, place binary")
    return gone.groupBy("bucket").applyInArrow(merge, "id long, h long, spans binary")


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one blank), spans (first, last exclusive, of those that go).

    Words are runs of characters other than blanks, tabs and line ends. A word goes if it lies in ``span`` successive words that also start
    somewhere in a document with a smaller id; windows are those of the texts as they came. Documents of one id don't take words from each other. A row without an id keeps all its
    words, and takes none from others; a null text has no words; other columns aren't read.
    """
    spans = checkpointed(repeated_spans(docs, span))
    size = spans.agg(F.coalesce(F.sum(F.length("spans") + 40), F.lit(0))).first()[0]  # one number
    rows = _texts(docs)
    small = F.broadcast(spans) if size <= BROADCAST else spans
    joined = rows.join(small.withColumnsRenamed({"id": "__id", "h": "__h"}), (F.col("id") == F.col("__id")) & (F.col("h") == F.col("__h")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = text.split()  # of bytes, at the same six characters
                    stay, at = [], 0
                    for a, b in np.frombuffer(gone or b"", "<u4").reshape(-1, 2).tolist():
                        stay += words[at:a]
                        at = b
                    stay += words[at:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), part.column("spans")], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    out = joined.select("id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary, spans binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def duckdb_sql(span: int = SPAN) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    w AS (SELECT r, doc_id, i, array_to_string(words[i:i + {span - 1}], ' ') AS s FROM d, unnest(range(1, len(words) - {span - 2})) AS t(i)),
    least AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
    gone AS (SELECT DISTINCT r, i + k AS p FROM w JOIN least USING (s), unnest(range({span})) AS t(k) WHERE doc_id > low),
    each AS (SELECT r, p, words[p] AS word FROM d, unnest(range(1, len(words) + 1)) AS t(p)),
    stay AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN stay USING (r)"""
