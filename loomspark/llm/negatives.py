"""Hard negatives by a secondary sort: pair scores under keys of anchor, descending score and id, read as a stream.

Each task multiplies its rows with a block of anchors and keeps, of each anchor, only the pairs that can come first: so the
shuffle has a few rows an anchor and task, whatever the size of a label. What is left is packed into keys (anchor, descending
score, kind, id), dealt out by anchor and sorted within partitions. An iterator walks each partition once: a positive opens a
window below its score, negatives go to the windows that are open and full ones close. It holds the windows of one anchor, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import checkpointed

#: Bytes of anchors that are sent to all tasks at once; more anchors go in rounds.
BLOCK = 32 << 20
#: Greatest size of a component after scaling, so that scores fit in 64 bits.
LARGEST = 1 << 24
#: Pairs that a task holds before it cuts them down to those that can come first.
HELD = 500_000
POSITIVE, NEGATIVE = 0, 1
PAIRS = "anchor long, down long, kind int, id long"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Scaled and floored vectors as rows of whole numbers; short ones are filled with zeros, long ones lose what no anchor has."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    inside = place < width
    out[np.repeat(np.arange(len(sizes)), sizes)[inside], place[inside]] = flat[inside]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _distinct(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their ids, each that comes several times once."""
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], rows[order]
    if len(ids) and (ids[1:] == ids[:-1]).any():
        _, first = np.unique(np.column_stack((ids.view(np.float64), labels, rows)).view("u8"), axis=0, return_index=True)
        first.sort()
        ids, labels, rows = ids[first], labels[first], rows[first]
    return ids, labels, rows


def _first(pairs: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (anchor, down, id) the first k different ones of each anchor."""
    anchor, down, ids = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((ids, down, anchor))
    anchor, down, ids = anchor[order], down[order], ids[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (down[1:] != down[:-1]) | (ids[1:] != ids[:-1])
    anchor, down, ids = anchor[new], down[new], ids[new]
    start = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1))
    place = np.arange(len(anchor)) - np.repeat(start, np.diff(np.append(start, len(anchor))))
    return [[x[place < k] for x in (anchor, down, ids)]]


def _below(scores: np.ndarray, ids: np.ndarray, opens: np.ndarray, k: int, low: int) -> np.ndarray:
    """Places of the first k scores, ties by id, of each window from an opening score down to low hundredths of it."""
    near = np.flatnonzero((100 * scores >= low * opens.min()) & (scores <= opens.max()))
    near = near[np.lexsort((ids[near], -scores[near]))]
    down = -scores[near]
    taken = []
    for p in opens:
        at = np.searchsorted(down, -p)
        some = near[at : at + k]
        taken.append(some[100 * scores[some] >= low * p])
    return np.unique(np.concatenate(taken))


class _Anchors:
    """A block of anchors, as tasks get it: ids, labels, vectors, and the scores of their positives where these are known."""

    def __init__(self, table: pa.Table, scale: int, scores: pa.Table | None = None):
        column = table.column("v").combine_chunks()
        width = max(column.value_lengths().to_pylist(), default=0)
        self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        self.vectors, self.width, self.scale = _matrix(column, width, scale), width, scale
        self.opens: dict[int, np.ndarray] = {}
        if scores is not None:
            anchor, score = scores.column("anchor").to_numpy(), -scores.column("down").to_numpy()
            order = np.argsort(anchor, kind="stable")
            at = np.flatnonzero(np.diff(anchor[order], prepend=anchor[order][:1] - 1))
            self.opens = dict(zip(anchor[order][at].tolist(), np.split(score[order], at[1:]), strict=True)) if len(at) else {}

    def scored(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and labels of a batch's rows, and scores by anchor and row."""
        rows = _matrix(batch.column("v"), self.width, self.scale)
        ids, labels, rows = _distinct(batch.column("id").to_numpy(), batch.column("label").to_numpy(), rows)
        return ids, labels, _products(self.vectors, rows)


def _packed(anchor: np.ndarray, down: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(down), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids)], ["anchor", "down", "kind", "id"])


def _sorted(pairs: DataFrame) -> DataFrame:
    """The pairs of an anchor in one partition, highest score first, a positive before negatives of its score, then by id."""
    return pairs.repartition("anchor").sortWithinPartitions("anchor", "down", "kind", "id")


def _leading(rows: DataFrame, anchors, k: int) -> DataFrame:
    """Pairs of each anchor and its first k positives."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = anchors.value, []
        for batch in batches:
            ids, labels, scores = own.scored(batch)
            for label in np.unique(own.labels):
                a, b = np.flatnonzero(own.labels == label), np.flatnonzero(labels == label)
                # Rows are in the order of their ids, so a stable sort leaves ties in it; one more than k, for the anchor itself.
                some = b[np.argsort(-scores[np.ix_(a, b)], axis=1, kind="stable")[:, : k + 1]]
                anchor = np.repeat(a, some.shape[1])
                other = ids[some.ravel()] != own.ids[anchor]
                held.append([own.ids[anchor][other], -scores[anchor, some.ravel()][other], ids[some.ravel()][other]])
            if sum(len(x[0]) for x in held) > HELD:
                held = _first(held, k)
        if held:
            yield _packed(*(x := _first(held, k)[0])[:2], POSITIVE, x[2])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen, last = None, 0, None
        for batch in batches:
            kept = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if row[0] != anchor:
                    anchor, seen, last = row[0], 0, None
                if row != last and seen < k:
                    kept.append(i)
                    seen += 1
                last = row
            yield batch.take(pa.array(kept, pa.int64()))

    return _sorted(rows.mapInArrow(ask, PAIRS)).mapInArrow(cut, PAIRS)


def _following(rows: DataFrame, anchors, k: int, low: int) -> DataFrame:
    """Pairs of each anchor and those negatives that are among a task's first k of one of its windows."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = anchors.value
        for batch in batches:
            ids, labels, scores = own.scored(batch)
            for a, anchor in enumerate(own.ids.tolist()):
                if (opens := own.opens.get(anchor)) is None:
                    continue
                others = np.flatnonzero(labels != own.labels[a])
                some = others[_below(scores[a, others], ids[others], opens, k, low)]
                if len(some):
                    yield _packed(np.full(len(some), anchor), -scores[a, some], NEGATIVE, ids[some])

    return rows.mapInArrow(ask, PAIRS)


def windows(keys: Iterator[tuple[int, int, int, int]], k: int, low: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of SCHEMA from sorted keys (anchor, descending score, kind, id): one pass, the open windows of one anchor in memory."""
    anchor, last, open_ = None, None, []
    for key in keys:
        if key == last:
            continue
        last, score = key, -key[1]
        if key[0] != anchor:
            anchor, open_ = key[0], []
        if key[2] == POSITIVE:
            open_.append([key[3], score, 0])
            continue
        open_ = [w for w in open_ if w[2] < k and 100 * score >= low * w[1]]
        for w in open_:
            w[2] += 1
            yield anchor, w[0], w[2], key[3], w[1], score


def mined(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, block: int = BLOCK
) -> DataFrame:
    """A row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key is divisible by ``every``; a score is the inner product of floor(scale * component).
    An anchor's positives are its first rows of the same label, its own key left out, by score, ties by key. Of the rows of
    other labels with at least ``low`` hundredths of a positive's score and no more than all of it, the first are its negatives.

    Rows without a key, label or vector, with a null or non-finite component, or one of more than 65,536 in size (scores must
    fit in 64 bits) take no part. Vectors of unlike lengths are filled with zeros. A row that comes several times counts once; so do rows of one key,
    side and score. Of several rows with the key of an anchor the greatest (label, then vector) is the anchor. No anchors, no rows.
    """
    of = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), of.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST / scale), F.lit(False))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", sound))
    asking = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.max(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    asking = checkpointed(asking)
    size = asking.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0]  # one number
    rounds = max(1, -(-size // block))
    context, out = vectors.sparkSession.sparkContext, None
    for r in range(rounds):
        # A round's anchors are a block of a known size; all rows pass by them twice.
        own = asking.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow()
        asked = context.broadcast(_Anchors(own, scale))
        leading = checkpointed(_leading(rows, asked, positives))
        known = context.broadcast(_Anchors(own, scale, leading.select("anchor", "down").toArrow()))
        pairs = checkpointed(_following(rows, known, negatives, low).union(leading)) if rounds > 1 else _following(rows, known, negatives, low).union(leading)
        out = pairs if out is None else out.union(pairs)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (key for batch in batches for key in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = []
        for row in windows(keys, negatives, low):
            found.append(row)
            if len(found) == 10_000:
                yield as_batch(found)
                found = []
        if found:
            yield as_batch(found)

    def as_batch(found: list) -> pa.RecordBatch:
        names = [x.split() for x in SCHEMA.split(", ")]
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if kind == "int" else pa.int64()) for (_, kind), c in zip(names, columns, strict=True)], [n for n, _ in names])

    return _sorted(out).mapInArrow(walk, SCHEMA)
