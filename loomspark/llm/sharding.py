"""Balanced label propagation: linked documents gather in one shard, and shards stay even.

Equal texts are linked. Documents of a group are alike to the propagation, so the state is a table of cells (group,
shard of origin, count) instead of documents: joins of each round move whole cells to the shard that holds most of
their group, as far as that shard's quota allows. Groups larger than a quarter of a shard, of which there are fewer
than four times the shards, are given places first: whole where one has room, else shard after shard is filled. A last pass moves what is over the exact quota, documents without a link first, to where it is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import checkpointed

#: Rows of a bucket inside which documents are numbered; buckets are numbered by their counts.
PER_BUCKET = 5_000
#: Equal rows that are numbered together.
EQUAL = 10_000


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _propagated(cells: DataFrame, loads: dict[int, int], shards: int, capacity: int, rounds: int, full: list[int]) -> DataFrame:
    """cells (g, part, origin, n, shard) with the shard that each ends in. loads: linked documents in each shard, kept up to date.
    full: shards that large groups fill, which others want last."""
    for turn in range(rounds):
        held = cells.groupBy(F.col("g").alias("g2"), F.col("part").alias("part2"), F.col("shard").alias("s2")).agg(F.sum("n").alias("m"))
        best = held.groupBy("g2", "part2").agg(F.max_by("s2", F.struct(~F.col("s2").isin(full), "m", F.hash("g2", "s2"))).alias("best"))
        wish = cells.join(best, (F.col("g") == F.col("g2")) & (F.col("part") == F.col("part2"))).drop("g2", "part2")
        wish = checkpointed(wish)
        flows = [(r["shard"], r["best"], r["n"]) for r in wish.where("shard <> best").groupBy("shard", "best").agg(F.sum("n").alias("n")).collect()]  # shards x shards at most
        if not flows:
            break
        share = _shares(flows, loads, shards, capacity)
        luck = F.pmod(F.xxhash64("g", "part", "origin", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        goes = (F.col("shard") != F.col("best")) & (luck < F.get(F.array(*[F.lit(x) for x in share]), F.col("best")))
        moved = checkpointed(wish.select("g", "part", "origin", "n", F.when(goes, F.col("best")).otherwise(F.col("shard")).alias("shard"), F.col("shard").alias("was")))
        for r in moved.where("shard <> was").groupBy("was", "shard").agg(F.sum("n").alias("n")).collect():
            loads[r["was"]] -= r["n"]
            loads[r["shard"]] += r["n"]
        cells = moved.drop("was")
    return cells


def _shares(flows: list, loads: dict[int, int], shards: int, capacity: int) -> list[float]:
    """The share of the wishes for each shard that may come true, so that what comes fits beside what then leaves."""
    wanted = [sum(n for _, b, n in flows if b == s) for s in range(shards)]
    share = [1.0] * shards
    for _ in range(30):
        leaves = [sum(n * share[b] for a, b, n in flows if a == s) for s in range(shards)]
        share = [min(1.0, max(0.0, (capacity - loads[s] + leaves[s]) / wanted[s])) if wanted[s] else 0.0 for s in range(shards)]
    return share


def _places(groups: list[tuple[int, int]], shards: int, quota: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """(shard, documents) pairs of each group (largest first): the tightest shard that holds it whole, else the emptiest are filled; and what room is left."""
    room, out = [quota] * shards, {}
    for g, left in groups:
        out[g] = []
        while left:
            whole = [s for s in range(shards) if room[s] >= left]
            s = min(whole, key=lambda x: room[x]) if whole else max(range(shards), key=lambda x: room[x])
            take = min(left, room[s]) or left
            out[g].append((s, take))
            room[s] -= take
            left -= take
    return out, room


def balanced(docs: DataFrame, shards: int = 24, rounds: int = 6, slack: float = 0.05) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, shard, slot (0, 1, ... in each shard), linked.

    Counts of shards differ by one at most, whatever the texts are. size is the text's UTF-8 bytes plus 8; a null text has no
    bytes and counts as an empty one. Rows that are equal are documents of their own. Other columns are not read.
    linked: whether another row has the same text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("x"))
    # One pass over the texts. The group is the texts' two hashes and length. Equal rows are counted and numbered, a block of them
    # at a time, so that the row's own hash tells them apart whatever files they come from.
    same = rows.groupBy("doc_id", "size", "text_crc32", "x").agg(F.count("*").alias("n"))
    block = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL).cast("long"))).alias("from"))
    rows = block.select("*", F.explode(F.sequence("from", F.least(F.col("from") + EQUAL, F.col("n")) - 1)).alias("nth"))
    rows = rows.select("doc_id", "size", "text_crc32", _hash("x", "text_crc32", "size").alias("g"), _hash("doc_id", "x", "nth").alias("r"))
    rows = checkpointed(rows)
    total = rows.count()
    capacity = int(total / shards * (1 + slack)) + 1
    quota = max(1, total // shards)
    groups = checkpointed(rows.groupBy("g").count().where("count > 1"))
    large = [(r["g"], r["count"]) for r in groups.where(F.col("count") > quota / 4).orderBy(F.desc("count"), "g").collect()]  # fewer than 4 x (shards + 1)
    places, room = _places(large, shards, quota)
    full = [s for s in range(shards) if room[s] < quota // 10]

    spark = docs.sparkSession
    named = spark.createDataFrame([(g, [n for _, n in at], [s for s, _ in at]) for g, at in places.items()], "gg long, takes array<long>, ats array<int>")
    # Rows of large groups, at most 4 x (shards + 1) of them, meet their places by broadcast; no other group has many rows.
    known = rows.join(F.broadcast(named), F.col("g") == F.col("gg"), "left")
    linked = groups.select(F.col("g").alias("gl"), F.lit(True).alias("linked"))
    small = known.where("gg is null").join(linked, F.col("g") == F.col("gl"), "left").drop("gl")
    placed = known.where("gg is not null").withColumn("linked", F.lit(True)).unionByName(small)
    # A document's place is where its hash falls among the shares of the group's places.
    point = F.pmod("r", F.lit(1 << 20)) / float(1 << 20) * F.aggregate("takes", F.lit(0).cast("long"), lambda x, y: x + y)
    passed = F.aggregate("takes", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at")), lambda x, y: F.struct((x["sum"] + y).alias("sum"), (x["at"] + F.when(point >= x["sum"] + y, 1).otherwise(0)).alias("at")))
    given = F.get("ats", passed["at"])
    placed = placed.select("doc_id", "size", "text_crc32", "g", "r", F.coalesce("linked", F.lit(False)).alias("linked"), given.alias("given"), F.pmod(_hash("r"), F.lit(shards)).cast("int").alias("origin"))
    placed = checkpointed(placed.withColumn("part", F.lit(0)))
    # Documents without a link make room for others in the last pass, so that only linked ones are a load.
    held = placed.where("linked").groupBy(F.coalesce("given", "origin").alias("s")).count().collect()
    loads = dict.fromkeys(range(shards), 0) | {r["s"]: r["count"] for r in held}
    cells = placed.where("linked and given is null").groupBy("g", "part", "origin").agg(F.count("*").alias("n")).withColumn("shard", F.col("origin"))
    cells = _propagated(checkpointed(cells), loads, shards, capacity, rounds, full)

    moved = cells.select(F.col("g").alias("cg"), F.col("part").alias("cp"), F.col("origin").alias("co"), F.col("shard").alias("cs"))
    on = (F.col("g") == F.col("cg")) & (F.col("part") == F.col("cp")) & (F.col("origin") == F.col("co"))
    settled = placed.join(moved, on, "left").select("doc_id", "size", "text_crc32", "g", "r", "linked", F.col("given").isNotNull().alias("large"), F.coalesce("given", "cs", "origin").alias("s"))
    return _numbered(settled, shards, total)


def _numbered(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Rows with exact quotas and slots: numbered in each shard, groups first, and those beyond the quota moved on."""
    buckets = max(1, total // (shards * PER_BUCKET))
    own = F.when(F.col("large"), F.col("r")).otherwise(F.col("g"))  # a large group is numbered in many buckets
    at = F.when(F.col("linked"), F.pmod(own, F.lit(buckets))).otherwise(buckets + F.pmod("r", F.lit(buckets))).cast("int")
    rows = checkpointed(rows.select("*", at.alias("bucket")))
    sizes = checkpointed(rows.groupBy("s", "bucket").agg(F.count("*").alias("n")))
    first = sizes.select(F.col("s").alias("s2"), F.col("bucket").alias("b2"), F.expr("coalesce(sum(n) over (partition by s order by bucket rows between unbounded preceding and 1 preceding), 0)").alias("first"))
    numbered = rows.join(first, (F.col("s") == F.col("s2")) & (F.col("bucket") == F.col("b2")))
    slot = F.col("first") + F.expr("row_number() over (partition by s, bucket order by g, r, doc_id)") - 1
    numbered = numbered.select("doc_id", "size", "text_crc32", "s", slot.alias("slot"), "linked")

    loads = [0] * shards
    for r in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect():
        loads[r["s"]] = r["n"]
    # The shards that hold most get the quotas that are one larger.
    order = sorted(range(shards), key=lambda s: (-loads[s], s))
    quota = [0] * shards
    for place, s in enumerate(order):
        quota[s] = total // shards + (place < total % shards)
    over, gaps, n_over, n_gap = [], [], 0, 0
    for s in range(shards):
        over.append(n_over)
        n_over += max(0, loads[s] - quota[s])
        if loads[s] < quota[s]:
            gaps.append((s, n_gap, loads[s]))
            n_gap += quota[s] - loads[s]
    lit = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("s"))
    rank = lit(over) + F.col("slot") - lit(quota)  # among all rows beyond their quota
    target = F.lit(None).cast("struct<shard:int,slot:bigint>")
    for s, begin, load in gaps:
        target = F.when(rank >= begin, F.struct(F.lit(s).alias("shard"), (load + rank - begin).cast("long").alias("slot"))).otherwise(target)
    stays = F.struct(F.col("s").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    ends = numbered.select("*", F.when(F.col("slot") < lit(quota), stays).otherwise(target).alias("end"))
    return ends.select("doc_id", "size", "text_crc32", F.col("end.shard").alias("shard"), F.col("end.slot").alias("slot"), "linked")
