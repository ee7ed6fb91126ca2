"""Loops within loops against a stack in plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from loomspark.functions import loops


def brute(text):
    stack, nested, bare, deepest = [], 0, 0, 0
    for line in (text or "").split("\n"):
        body = line.strip()
        if not body:
            continue
        indent = len(line) - len(line.lstrip())
        while stack and indent <= stack[-1]:
            stack.pop()
        if re.match(r"(for|while)\b", body):
            nested += bool(stack)
            stack.append(indent)
        bare += body == "except:" or bool(re.match(r"except\s+Exception\s*(\s+as\s+\w+)?\s*:", body))
        deepest = max(deepest, len(stack))
    return nested, bare, deepest


def test_like_a_stack(spark):
    rng = random.Random(3)
    heads = ["for x in y:", "while True:", "x = 1", "", "   ", "except:", "except Exception as e:", "except ValueError:", "forty = 2", "except Exception:", "\tfor z in q:"]
    texts = [None, "", "for a in b:"] + ["\n".join(" " * rng.randrange(7) + rng.choice(heads) for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: tuple(r["n"]) for r in df.select("i", F.lit("for").alias("text"), loops.nesting(df["text"]).alias("n")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_long_files_take_linear_time(spark):
    seconds = []
    for n in (20_000, 80_000):
        text = "\n".join(" " * (i % 9) + ("for x in y:" if i % 3 else "pass") for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        df.select(loops.nesting(F.col("text"))).collect()
        began = time.time()
        assert tuple(df.select(loops.nesting(F.col("text")).alias("n")).first()["n"]) == brute(text)
        seconds.append(time.time() - began)
    assert seconds[1] < 8 * seconds[0] + 2
