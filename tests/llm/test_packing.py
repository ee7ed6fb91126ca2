"""Packing: an exact round trip of every token, against the tokenizer itself."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomspark.llm import packing
from tests.llm import nasty

HF = Tokenizer.from_file(packing.tokenizer_path())


def check(pieces, rows, window=2048):
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(np.array([*HF.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert set(by_doc) == set(ids)
    for doc_id, got in by_doc.items():
        want_tokens = sorted(len(x) for x in ids[doc_id] for _ in range(1))
        assert sum(n for _, n, _, _ in got) == sum(want_tokens)
        for start, length, crc, total in got:
            assert any(len(x) == total and crc32(x[start : start + length].tobytes()) == crc for x in ids[doc_id])
    return sequences


def test_round_trip(spark):
    rows = [r[:2] for r in nasty.rows()] + [(70, "two  blanks and \n a line \n\n end "), (71, " leading"), (72, "it's 12,345 ok nbsp <|endoftext|>x")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    pieces = packing.packed(docs, packing.tokenizer_path(), per_shard=8).collect()
    check(pieces, rows)


def test_little_padding_and_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.packed(docs, packing.tokenizer_path()).collect()
    sequences = check(pieces, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) == 1
    assert packing.packed(nasty.empty(spark), packing.tokenizer_path()).count() == 0


def test_neighbours_come_by_bm25():
    rng = np.random.default_rng(1)
    topic = [rng.integers(100 + 50 * k, 150 + 50 * k, 30) for k in (0, 1) for _ in range(5)]
    texts = [np.array([*t, 1], np.uint32) for t in topic]
    shuffled = [texts[i] for i in (0, 5, 1, 6, 2, 7, 3, 8, 4, 9)]
    order = packing.order_of(shuffled, 31 * 5)
    assert {i % 2 for i in order[:5]} == {0} and {i % 2 for i in order[5:]} == {1}
    index = packing.Index(shuffled)
    n, lengths = len(shuffled), np.array([31] * 10)
    for d in range(n):
        want = np.zeros(n)
        for term in set(shuffled[d][:-1].tolist()):
            df = sum(term in s[:-1] for s in shuffled)
            for j, s in enumerate(shuffled):
                tf = (s[:-1] == term).sum()
                want[j] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[j] / lengths.mean()))
        assert index.scores(d) == pytest.approx(want)


def test_every_code_point_is_encoded_as_the_tokenizer_does():
    encode, size = packing._encoder(packing.tokenizer_path())
    assert size == HF.get_vocab_size() and packing.width(packing.tokenizer_path()) == "<u2"
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}!{chr(c)}{chr(c)}  {chr(c)}" for c in [*range(0x3000), *range(0x3000, 0xD800, 97), *range(0xE000, 0x110000, 997)]]
    assert [encode(t).tolist() for t in texts] == [e.ids for e in HF.encode_batch(texts, add_special_tokens=False)]
    assert encode("a<|endoftext|>b")[1] == 50256


def test_statistics_and_keys_are_of_the_whole_corpus(spark):
    docs = nasty.documents(spark)
    kind = packing.width(packing.tokenizer_path())
    tokens = packing.tokenized(docs, packing.tokenizer_path()).persist()
    held, n, total = packing.statistics(tokens, kind)
    ids = [HF.encode(r[1] or "", add_special_tokens=False).ids for r in nasty.rows()]
    want = np.zeros(len(held), np.int64)
    for x in ids:
        want[list(set(x))] += 1
    assert held.tolist() == want.tolist() and (n, total) == (len(ids), sum(map(len, ids)) + len(ids))
    places = packing.orders(held, n)
    got = sorted((r["k0"], r["k1"], r["k2"]) for r in packing.keyed(tokens, kind, places).collect())
    assert got == sorted(tuple(min((int(p[t]) for t in x), default=-1) for p in places) for x in ids)


def test_neighbours_far_apart_in_the_table_share_windows(spark):
    """Topics dealt over the table at random: most windows hold one topic, which a random order would hardly ever give."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    topics = [rng.choice(words, 12, replace=False) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(topics[i % 40], 30))) for i in rng.permutation(2000).tolist()]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), packing.tokenizer_path(), window=512).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p["doc_id"] % 40)
    same = sum(max(x.count(t) for t in set(x)) for x in by.values()) / sum(map(len, by.values()))
    assert same > 0.6


def test_equal_rows_are_spread_and_whole(spark):
    rows = [(1, "the same words again")] * 3000 + [(None, None)] * 1000
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), packing.tokenizer_path(), window=64).collect()
    assert sum(p["length"] for p in pieces) == 3000 * (len(HF.encode("the same words again", add_special_tokens=False).ids) + 1) + 1000


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u00a0"])
def test_ids_of_very_long_blank_runs(blank):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encode, whole = packing._encoder(path)[0], Tokenizer.from_file(path)
    for text in (blank * 1_000_000, "a" + blank * 1_000_000 + "b", "word " * 3 + blank * 99_999 + "x" + blank * 100_000):
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_survives_a_padded_text(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "x" * 1_000_000)], "doc_id long, text string")
    rows = packing.packed(docs, packing.tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and all(sum(r["length"] for r in rows if r["doc_id"] == i) == next(r["doc_tokens"] for r in rows if r["doc_id"] == i) for i in (1, 2))
