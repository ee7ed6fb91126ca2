"""Packing by lexical retrieval: documents that share rare tokens share a window.

Texts are encoded once. Counts of documents over the whole corpus give each token its weight (idf). Three weighted random
orders of the vocabulary, in which a token comes early in proportion to its weight, give each document three keys: its
earliest token in each order. Two documents have a key in common with the probability of the weighted similarity of
their tokens, so that sorting by the keys brings neighbours together, and range partitioning cuts that order evenly, however
skewed the corpus is. Along the order, each ``per_shard`` documents are a shard of the inverted index. A seed document opens a window;
its unused neighbours in the shard, best BM25 first, fill it. A document that does not fit whole is cut at the window's end
and its rest opens the next window as the next seed. So all windows of a task are full but the last.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import checkpointed

K1, B = 1.2, 0.75
#: Token that ends a document.
END = 1
#: Keys by which documents are sorted.
KEYS = 3
#: A token that more than one in so many documents hold tells no neighbours.
COMMON = 4
#: Tokens that one task packs, about.
PER_TASK = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the public split pattern of byte-level vocabularies whose file names none of its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White-space characters in a row from which a text isn't given to ``tiktoken``.
BLANKS = 100_000
_LONG_BLANK = re.compile(r"\s{%d}" % BLANKS)


def _plain(spec: dict) -> bool:
    """Whether the vocabulary splits and merges as ``tiktoken`` does: byte level, the public pattern, nothing else."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    none = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges", "dropout")
    return (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and bool(split.get("use_regex", True))
        and not split.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(x) for x in none)
        and not any(t.get(x) for t in spec.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip", "normalized"))
    )


@lru_cache(maxsize=4)
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[Callable[[str], np.ndarray], int]:
    """The tokenizer at the path, as a function from a text to its ids, and the number of ids.

    A plain byte-level vocabulary of ``tokenizers`` (json) is read into the merge table of ``tiktoken``, which gives the same
    ids at four times the speed; any other goes through ``tokenizers`` itself, and so does a text with a run of BLANKS white-space
    characters, on which the patterns of ``tiktoken`` give up. Strings of added tokens become their ids.
    """
    import json

    spec = json.loads(open(path, encoding="utf-8").read())
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
    if not _plain(spec):
        return lambda text: np.array(_whole(path).encode(text, add_special_tokens=False).ids, np.uint32), size
    import tiktoken

    sign = {c: b for b, c in _byte_signs().items()}
    ranks = {bytes(sign[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    bpe = tiktoken.Encoding("from_json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        if len(text) >= BLANKS and _LONG_BLANK.search(text):
            return np.array(_whole(path).encode(text, add_special_tokens=False).ids, np.uint32)
        return bpe.encode_to_numpy(text, allowed_special="all")

    return encode, size


def _byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def width(tokenizer: str) -> str:
    """How an id is stored: two bytes where all ids of the vocabulary fit."""
    return "<u2" if _encoder(tokenizer)[1] <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned numbers in a binary) of each row, END included; null text is empty."""
    kind = width(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer)[0], np.array([END], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encoder(t or "").astype(kind).tobytes() + end for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def statistics(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int, int]:
    """Documents that hold each token (an array by id, no longer than the vocabulary), documents, and tokens in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column("ids"):
                text = np.frombuffer(ids.as_buffer(), kind)
                own = np.unique(text[:-1])
                if len(own) and own[-1] >= len(held):
                    held = np.concatenate((held, np.zeros(own[-1] + 1 - len(held), np.int64)))
                held[own] += 1
                n, total = n + 1, total + len(text)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1, -2], pa.int64()), pa.array([*held[some], n, total], pa.int64())], ["token", "n"])

    summed = tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"]: r["n"] for r in summed.collect()}  # a row per id of the vocabulary at most
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    held = np.zeros(max(found, default=0) + 1, np.int64)
    held[list(found)] = list(found.values())
    return held, n, total


def idf_of(held: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - held + 0.5) / (held + 0.5))


def orders(held: np.ndarray, n: int, keys: int = KEYS) -> np.ndarray:
    """keys random orders of the tokens (places, by id): an exponential race in which a token's rate is its idf squared.
    Tokens of one document bring nobody together and come last."""
    rate = np.where(held > 1, idf_of(held, n) ** 2, 1e-9)
    race = np.random.default_rng(7).exponential(size=(keys, len(held))) / rate
    return np.argsort(np.argsort(race, axis=1), axis=1).astype(np.int32)


def keyed(tokens: DataFrame, kind: str, places: np.ndarray) -> DataFrame:
    """tokens with k0, k1, ...: the earliest place of each document's tokens in each order; -1 for a document without a token."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]
            columns = [[int(place[t[:-1]].min()) if len(t) > 1 else -1 for t in texts] for place in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int32()) for c in columns]], names)

    names = [*tokens.columns, *[f"k{j}" for j in range(len(places))]]
    fields = ", ".join(f"{n} {'binary' if n == 'ids' else 'long' if n in tokens.columns else 'int'}" for n in names)
    return tokens.mapInArrow(key, fields)


class Index:
    """Inverted index of one shard: for each token the documents that hold it, with their BM25 weights.

    Weights and the mean length are those of the whole corpus where they are given, else of the shard. Tokens of weight 0 are left out."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        lengths = np.array([len(t) for t in texts])
        n = len(texts)
        term = np.concatenate([t[:-1] for t in texts]).astype(np.uint64)
        owner = np.repeat(np.arange(n, dtype=np.uint64), lengths - 1)
        if idf is not None:
            told = idf[term] > 0
            term, owner = term[told], owner[told]
        # One sort by token, then document; runs are the postings with their counts.
        pair, count = np.unique(term * np.uint64(n) + owner, return_counts=True)
        term, self.owner = (pair // np.uint64(n)).astype(np.int64), (pair % np.uint64(n)).astype(np.int64)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(np.append(first, len(term)))
        weight = idf_of(df, n) if idf is None else idf[term[first]]
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if mean is None else mean))
        self.weight = np.repeat(weight, df) * count * (K1 + 1) / (count + norm[self.owner])
        # Of each document's tokens, where their postings begin and how many there are.
        order = np.argsort(self.owner, kind="stable")
        self.begin, self.df = np.repeat(first, df)[order], np.repeat(df, df)[order]
        self.at = np.searchsorted(self.owner[order], np.arange(n + 1))
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct tokens of one."""
        own = slice(self.at[doc], self.at[doc + 1])
        begin, n = self.begin[own], self.df[own]
        if not len(n):
            return np.zeros(self.n)
        places = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[places], self.weight[places], self.n)


def order_of(texts: list[np.ndarray], window: int, room: int = 0, idf: np.ndarray | None = None, mean: float | None = None) -> list[int]:
    """The documents of a shard in the order in which they fill windows, the first of which has so much room left (0: a new one)."""
    index, unused = Index(texts, idf, mean), np.ones(len(texts), bool)
    out: list[int] = []
    ranked: list[int] = []
    seed, first = -1, 0
    while len(out) < len(texts):
        if room == 0 or seed < 0:  # a new window, or one that another shard began: the first unused document is the seed
            while not unused[first]:
                first += 1
            pick, seed, ranked = first, first, []
        else:
            if not ranked:  # unused neighbours of the seed, best last; ties in the order of the shard
                left = np.flatnonzero(unused)
                ranked = left[np.argsort(-index.scores(seed)[left], kind="stable")][::-1].tolist()
            pick = ranked.pop()
        if len(texts[pick]) > room:  # it opens a window, or is cut and its rest does
            seed, ranked = pick, []
        unused[pick] = False
        out.append(pick)
        room = (room - len(texts[pick])) % window
    return out


def packed(docs: DataFrame, tokenizer: str, window: int = 2048, per_shard: int = 400) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every row lies in exactly one piece; rows that are equal are packed as often as they come. A null text
    is its END alone. sequence_id is unique over tasks; offsets in a sequence leave no gap. Other columns are not read.
    """
    kind = width(tokenizer)
    tokens = checkpointed(tokenized(docs, tokenizer))
    held, n, total = statistics(tokens, kind)
    # Tokens of more than a quarter of all documents are stop words of the index.
    idf, mean = np.where(held > n / COMMON, 0.0, idf_of(held, n)), total / max(n, 1)
    apart = 1 << 40  # more sequences than a task can have

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        """Documents in the order of the keys, so many at a time."""
        ids, texts = [], []
        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(np.frombuffer(x, kind))
                if len(texts) == per_shard:
                    yield ids, texts
                    ids, texts = [], []
        if texts:
            yield ids, texts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = TaskContext.get().partitionId() * apart, 0
        for ids, texts in shards(batches):
            rows = []
            for d in order_of(texts, window, -at % window, idf, mean):
                text, start = texts[d].astype("<u4"), 0
                while start < len(text):
                    length = min(len(text) - start, window - at % window)
                    rows.append((ids[d], start, length, crc32(text[start : start + length].tobytes()), len(text), first + at // window, at % window))
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    by = [f"k{j}" for j in range(KEYS)]
    # Rows of the checkpoint have fixed places, so each has a number of its own: equal rows are dealt out like others.
    numbered = tokens.withColumn("r", F.monotonically_increasing_id())
    spread = F.xxhash64("r")
    sorted_ = keyed(numbered, kind, orders(held, n)).withColumn("r", spread).repartitionByRange(max(1, -(-total // PER_TASK)), *by, "r").sortWithinPartitions(*by, "r")
    return sorted_.select("doc_id", "ids").mapInArrow(pack, SCHEMA)


def tokenizer_path() -> str:
    """The public vocabulary that the production query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
