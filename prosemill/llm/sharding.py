"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

A key goes to the next virtual node clockwise of its hash; where that shard is full it continues clockwise. Keys between
two neighbouring virtual nodes share one sequence of shards, so where a key ends depends only on how many keys stand before
it between them: the ring is settled on counts per arc, a few hundred numbers whatever the number of rows, and each row
then needs its rank within its arc. Ranks come from cells of a size chosen by the row count, so no cell is large.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bits48, written

#: Rows that a cell has on average, at most.
CELL_ROWS = 20_000
#: The ring has 2^BITS points.
BITS = 14
#: Places of an array of equal rows, at most.
RUN = 1 << 17


def ring(spark: SparkSession, shards: int, nodes: int = 64) -> list[tuple[int, int]]:
    """[(point, shard), ...] clockwise. Each shard has nodes virtual nodes at hashed points; of two at one point the lower
    shard has it. A shard's points don't depend on how many shards there are, so a new one moves no other."""
    made = spark.range(shards * nodes).select((F.col("id") / nodes).cast("int").alias("shard"), (F.col("id") % nodes).alias("node"))
    made = made.select("shard", F.shiftright(bits48(F.concat_ws(":", F.lit("shard"), "shard", "node")), 48 - BITS).cast("int").alias("point"))
    return sorted((r["point"], r["shard"]) for r in made.groupBy("point").agg(F.min("shard").alias("shard")).collect())


def settle(counts: dict[int, int], order: list[tuple[int, int]], room: list[int]) -> list[dict[str, int]]:
    """Keys arrive arc by arc clockwise; arc i ends at order[i]. Which ranks of an arc go to which shard, after how many rows."""
    used, out = [0] * len(room), []
    for arc in range(len(order)):
        rank, left, step = 0, counts.get(arc, 0), 0
        while left:
            shard = order[(arc + step) % len(order)][1]
            if n := min(left, room[shard] - used[shard]):
                out.append({"arc": arc, "p_from": rank, "p_to": rank + n, "shard": shard, "before": used[shard]})
                used[shard], rank, left = used[shard] + n, rank + n, left - n
            step += 1
    return out


def bounded_ring(docs: DataFrame, shards: int = 8, nodes: int = 64, slack: float = 0.0, key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of docs (doc_id, text).

    No shard gets more than (1 + slack) times its even part; with slack 0 the first (rows mod shards) shards may hold one row
    more than the others, so counts are at most one apart. slot counts a shard's rows from 0 without gaps. Keys are ids; a null
    id hashes as an empty one; equal rows are counted, ranked as one and dealt out again, so an id that repeats millions of
    times fills one shard after another. size is the text's UTF-8 bytes plus 1, 1 for null, whose text_crc32 is that of an
    empty text. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), bits48(F.col(key)).alias("h"))
    rows = written(rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("n")), "shard-keys")
    order, points = ring(spark, shards, nodes), 1 << BITS
    arcs, at = [], 0
    for point in range(points):
        while at < len(order) and order[at][0] < point:
            at += 1
        arcs.append(str(at % len(order)))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    room = [total // shards + (i < total % shards) for i in range(shards)] if not slack else [math.ceil(total * (1 + slack) / shards)] * shards
    point = F.shiftright("h", 48 - BITS)
    celled = rows.withColumn("arc", F.element_at(F.split(F.lit(",".join(arcs)), ","), (point + 1).cast("int")).cast("int"))
    # Clockwise the first arc starts with what lies past the last virtual node. A cell lies in one point, so in one arc.
    finer = (total // (CELL_ROWS * points)).bit_length()
    celled = celled.withColumn("turn", F.when((F.col("arc") == 0) & (point > order[0][0]), 0).otherwise(1)).withColumn("cell", F.shiftright("h", 48 - BITS - finer))
    cells = written(celled.groupBy("arc", "turn", "cell").agg(F.sum("n").alias("rows")), "shard-cells")
    counts = {r["arc"]: r["rows"] for r in cells.groupBy("arc").agg(F.sum("rows").alias("rows")).collect()}  # at most shards x nodes
    starts = cells.select(F.col("cell").alias("s_cell"), (F.sum("rows").over(Window.partitionBy("arc").orderBy("turn", "cell")) - F.col("rows")).alias("start"))
    low = F.sum("n").over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")) - F.col("n")
    ranked = celled.withColumn("low", low).join(starts, F.col("cell") == F.col("s_cell")).withColumn("low", F.col("low") + F.col("start"))
    # At most shards x nodes + shards parts, so they are broadcast.
    parts = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(settle(counts, order, room))), "array<struct<arc:int,p_from:bigint,p_to:bigint,shard:int,before:bigint>>"))).withColumnRenamed("arc", "p_arc")
    placed = ranked.join(F.broadcast(parts), (F.col("arc") == F.col("p_arc")) & (F.col("low") < F.col("p_to")) & (F.col("low") + F.col("n") > F.col("p_from")))
    # Equal rows are dealt out again in runs of bounded length.
    placed = placed.withColumn("last", F.least(F.col("low") + F.col("n"), F.col("p_to")) - 1)
    placed = placed.withColumn("run", F.explode(F.sequence(F.greatest("low", "p_from"), F.col("last"), F.lit(RUN).cast("long"))))
    placed = placed.withColumn("at", F.explode(F.sequence("run", F.least(F.col("run") + RUN - 1, F.col("last")))))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - F.col("p_from")).alias("slot"))
