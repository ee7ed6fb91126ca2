"""The pipeline's stages against plain Python on a small corpus."""

import random

import corpus_pipeline as P
from loomspark.llm import decontam
from tests.llm import nasty
from tests.llm.test_neardup import brute


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(2)
    english = "the of and to in that is was for on with as at by from they have this are".split()
    french = "le la les des et est une dans que pour pas sur avec il elle nous été très où".split()
    make = lambda words: " ".join(rng.choice(words) + rng.choice(["", "", "ing", "tion"]) for _ in range(80))
    clean = [(100 + i, make(english), "en") for i in range(60)] + [(200 + i, make(french), "fr") for i in range(60)]
    passage = make(english)
    rows = clean + [(300, clean[0][1], "en"), (301, clean[1][1] + " once more", "en"), (302, make(english) + " " + passage + " tail", "en"), (303, "12 34 !!", "en"),
                    (304, make(english) + ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" ' + make(english), "en"), (305, None, "en"), (306, "", None)]
    full = [(i, t, g, "s", len(t or ""), 0.0, 0, "x", 0, 0) for i, t, g in rows]
    spark.createDataFrame(full, nasty.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    texts = {i: t for i, t, _ in rows}
    assert set(texts) - set(kept["language"]) == {303, 305, 306}
    assert set(kept["near_duplicates"]) == {c for _, c, _ in brute([(i, texts[i]) for i in sorted(kept["language"])])} == set(kept["language"]) - {300, 301}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {302}
    assert set(kept["secrets"]) == set(kept["decontamination"])
    changed = {i for i, r in kept["secrets"].items() if r["text"] != texts[i]}
    assert changed == {304} and "1beb58" not in kept["secrets"][304]["text"] and kept["secrets"][304]["n_chars"] == len(kept["secrets"][304]["text"])
    assert set(kept["packing"]) == set(kept["secrets"])
    assert P.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept["packing"])


def test_empty_and_nasty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "dup")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (nasty.documents(spark), nasty.empty(spark)):
        for name, stage in P.STAGES:
            docs = decontam.checkpointed(stage(spark, docs, str(tmp_path)))
        assert docs.columns[0] == "doc_id"
