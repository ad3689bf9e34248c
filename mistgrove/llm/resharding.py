"""Moving documents from old shards to new capacities with the fewest bytes moved.

Shard sizes make a small transport network: from each old shard to each new one, free where the shard stays the
same and one unit of cost a byte otherwise. A minimum-cost flow on it says how many bytes go where. Blocks
of documents (by hash of their text, large ones split) then fill those amounts in order, and only files that
gain or lose blocks are rewritten. Only the shard sizes reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mistgrove.llm.common import fresh, stored

PLAN = ("size", "text_crc32", "old_shard", "shard", "slot")
#: Lists of at most so many texts are sent to every task, longer ones are joined.
BROADCAST_TEXTS = 1_000_000
#: Blocks of an old shard at least; one holds at most 1 / SPLIT of a new shard's capacity, or else is split.
BLOCKS, SPLIT = 1024, 512


def flow(supplies: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from old to new shard, all supplies placed, capacities kept, fewest bytes changing their number.

    Successive shortest paths with potentials; each augmentation fills a supply, a capacity or an arc.
    """
    if sum(supplies.values()) > sum(capacities.values()):
        raise ValueError("the new shards can't hold what the old ones have")
    source, sink = ("source",), ("sink",)
    room: dict[tuple, dict[tuple, int]] = {}
    cost: dict[tuple[tuple, tuple], int] = {}

    def arc(a: tuple, b: tuple, most: int, price: int) -> None:
        room.setdefault(a, {})[b] = most
        room.setdefault(b, {}).setdefault(a, 0)
        cost[a, b], cost[b, a] = price, -price

    for i, size in supplies.items():
        arc(source, ("old", i), size, 0)
        for j in capacities:
            arc(("old", i), ("new", j), size, int(i != j))
    for j, most in capacities.items():
        arc(("new", j), sink, most, 0)
    potential = dict.fromkeys(room, 0)
    left = sum(supplies.values())
    while left:
        distance, previous, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for b, free in room[a].items():
                if free and d + cost[a, b] + potential[a] - potential[b] < distance.get(b, 1 << 62):
                    distance[b] = d + cost[a, b] + potential[a] - potential[b]
                    previous[b] = a
                    heapq.heappush(queue, (distance[b], b))
        for a, d in distance.items():
            potential[a] += d
        path, at = [], sink
        while at != source:
            path.append((previous[at], at))
            at = previous[at]
        amount = min(left, *(room[a][b] for a, b in path))
        for a, b in path:
            room[a][b] -= amount
            room[b][a] += amount
        left -= amount
    return {(i, j): x for i in supplies for j in capacities if (x := room[("new", j)][("old", i)])}


def even(total: int, shards: int) -> dict[int, int]:
    """Capacities that differ by one byte at most."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, key: str = "doc_id", text: str = "text",
            capacities: dict[int, int] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, size, text_crc32, old_shard, shard, slot, and the columns in carry.

    Size is the text's UTF-8 bytes (null: none) plus 1. Capacities are even shares of all bytes unless given, and
    are met up to a block, at most 1 / SPLIT of a share or one group. Equal texts of all old shards lie in one block, planned from the
    old shard that holds most of their bytes, unless they alone are larger than this. Slots count from 0 without gaps, by block, key and text hash;
    rows that repeat key and text take neighbouring slots in any order. Null keys come first; an old shard of null counts
    as -1; an empty table gives an empty result; columns not named are not looked at. A carried column named like one of the plan's
    goes out as that name with underscores before it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    measured = docs.select(
        F.struct(*carry).alias("carried"), F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"),
        F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old"))
    rows = stored(measured.select("key", "size", "crc", "old"), "shard-rows")
    groups = rows.groupBy("crc", "old").agg(F.sum("size").alias("bytes")).groupBy("crc").agg(
        F.max_by("old", F.struct("bytes", -F.col("old"))).alias("most_of"), F.count(F.lit(1)).alias("shards"))
    spread = stored(groups.where("shards > 1").select("crc", "most_of"), "shard-texts")  # texts that several old shards hold
    spread = F.broadcast(spread) if spread.count() <= BROADCAST_TEXTS else spread

    def at_home(table: DataFrame) -> DataFrame:
        return table.join(spread, "crc", "left").withColumn("home", F.coalesce("most_of", "old")).drop("most_of")

    rows = stored(at_home(rows), "shard-homes")
    supplies = {r["home"]: r["bytes"] for r in rows.groupBy("home").agg(F.sum("size").alias("bytes")).collect()}  # a row a shard
    total = sum(supplies.values())
    capacities = capacities or even(total, shards)
    moves = flow(supplies, capacities)
    most = max(1, total // (len(capacities) * SPLIT))
    block = F.pmod(F.xxhash64("crc"), F.lit(BLOCKS))
    rows = rows.withColumn("block", block)
    # blocks above the limit are fewer than capacities * SPLIT: few enough to broadcast
    large = rows.groupBy("home", "block").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most) \
        .select("home", "block", F.ceil(2 * F.col("bytes") / most).cast("long").alias("parts"))

    # so are groups of equal texts above it, the only ones that are split
    huge = rows.groupBy("crc").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most).select("crc", F.lit(True).alias("huge"))

    def parted(table: DataFrame) -> DataFrame:
        told = table.join(F.broadcast(large), ["home", "block"], "left").join(F.broadcast(huge), "crc", "left")
        dealt = F.when(F.col("huge"), F.xxhash64("key", "crc")).otherwise(F.xxhash64(F.lit("part"), F.col("crc")))
        return told.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(dealt, F.col("parts")))).drop("parts", "huge")

    split = parted(rows)
    blocks = split.groupBy("home", "block", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("home").orderBy("block", "part")  # blocks, never documents
    middle = F.sum("bytes").over(along) - F.col("bytes") / 2
    goal = F.lit(None).cast("int")
    for i in supplies:
        upto, ways = 0, [(j, x) for (a, j), x in sorted(moves.items(), key=lambda m: (m[0][0], m[0][1] != m[0][0], m[0][1])) if a == i]
        for j, x in reversed([(j, upto := upto + x) for j, x in ways]):
            goal = F.when((F.col("home") == i) & (F.col("middle") <= x), j).otherwise(goal)
    placed = blocks.withColumn("middle", middle).withColumn("shard", goal)
    order = Window.partitionBy("shard").orderBy("home", "block", "part")
    placed = stored(placed.select("home", "block", "part", "shard", (F.sum("n").over(order) - F.col("n")).alias("first")), "shard-blocks")
    inside = Window.partitionBy("home", "block", "part").orderBy("key", "crc")
    numbered = (parted(at_home(measured).withColumn("block", block)) if carry else split).withColumn("at", F.row_number().over(inside) - 1)
    # a row a block, of which there are at most (BLOCKS + 3 * SPLIT * new shards) per old shard
    return numbered.join(F.broadcast(placed), ["home", "block", "part"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("at")).cast("long").alias("slot"), *[F.col("carried")[c].alias(fresh([key, *PLAN], c)) for c in carry])


def rewrite(docs: DataFrame, plan: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> list[int]:
    """Write the documents of affected shards to folder/shard=N, in slot order within each file, and tell which those are.

    A shard is affected if it gains or loses a document. docs may have any columns. Repeated rows are written as
    often as the plan has them.
    """
    changed = plan.where(F.col("old_shard") != F.col("shard"))
    affected = sorted({r[0] for r in changed.select(F.explode(F.array("old_shard", "shard"))).distinct().collect()})  # shard numbers
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    nth = Window.partitionBy("_key", "_crc").orderBy("_slot")
    goals = plan.where(F.col("shard").isin(affected)).select(
        F.col(key).alias("_key"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    goals = goals.withColumn("_nth", F.row_number().over(nth))
    own = docs.withColumn("_nth_own", F.row_number().over(Window.partitionBy(F.col(key), crc).orderBy(F.col(key))))
    out = own.join(goals, F.col(key).eqNullSafe(F.col("_key")) & (crc == F.col("_crc")) & (F.col("_nth_own") == F.col("_nth")))
    out = out.withColumn("shard", F.col("_shard")).drop("_key", "_crc", "_nth", "_nth_own", "_shard")
    out.repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    return affected
