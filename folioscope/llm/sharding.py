"""Sharding by Karmarkar-Karp differencing: byte-balanced shards of indivisible groups of equal texts.

Every group is an item. An item starts as a partial partition: its bytes in one part, nothing in the others. The two with the
largest spread are combined, the heaviest part of the one with the lightest of the other, until one is left, whose parts are the
shards. Groups are dealt to cells of about CELL by hash and differenced there, each cell in a task; what a cell ends with is a
partial partition again, and the cells' (at most MOST_CELLS, a sum per shard each) are differenced in the driver in the same way.

Slots number each shard's documents without gaps: a running count inside hashed chunks of the shard, after the counts of
the chunks before, so neither a shard nor a hot group meets in one task.

Defined results: a null text has size 16, crc32 0 and forms one group with other null texts, apart from empty ones; rows that
repeat go to the same shard, each with its own slot; null identifiers are rows like any other; texts of one 64-bit hash are one
group, as equal texts are; an empty table gives an empty result. Only identifier and text are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from folioscope.llm.common import hot_join, kept_on_disk, scaled, table

SHARDS = 40
#: Groups in a cell, about, unless that makes more than MOST_CELLS.
CELL, MOST_CELLS = 20_000, 20_000
#: Rows that a chunk of a shard holds, about.
CHUNK_ROWS = 20_000


def partition(items: list, k: int) -> list[np.ndarray]:
    """For each item the parts (0..k-1) that its own parts become. An item: a weight, which is its part k - 1, or k sums."""
    if not items:
        return []
    heap, orders = [], []
    for i, item in enumerate(items):
        sums = np.zeros(k, np.int64)
        if np.ndim(item):
            orders.append(np.argsort(item, kind="stable"))
            sums = np.asarray(item, np.int64)[orders[-1]]
        else:
            orders.append(None)
            sums[-1] = item
        heap.append((int(sums[0] - sums[-1]), i, sums, i))
    heapq.heapify(heap)
    turn, back = len(items), np.arange(k)[::-1]
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        joined = a + b[::-1]
        order = np.argsort(joined, kind="stable")
        place = np.empty(k, np.int16)
        place[order] = np.arange(k)
        sums = joined[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), turn, sums, (left, right, place)))
        turn += 1
    out: list = [None] * len(items)
    stack = [(heap[0][3], np.arange(k))]
    while stack:
        node, to = stack.pop()
        if isinstance(node, int):
            if orders[node] is not None:
                own = np.empty(k, np.int64)
                own[orders[node]] = to
                to = own
            out[node] = to
        else:
            left, right, place = node
            stack += [(left, to[place]), (right, to[place[back]])]
    return out


def differencing(weights: list[int], k: int) -> list[int]:
    """A part in 0..k-1 for each weight."""
    return [int(to[-1]) for to in partition([int(w) for w in weights], k)]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    spark, text = docs.sparkSession, F.col("text")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = kept_on_disk(source.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("code"),
    ))
    groups = kept_on_disk(rows.groupBy("code").agg(F.sum("size").alias("bytes"), F.count("*").alias("many")))
    n, cells = rows.count(), min(MOST_CELLS, scaled(groups.count(), CELL, 1))

    def difference(part: pa.Table) -> pa.Table:
        part = part.sort_by([("bytes", "descending"), ("code", "ascending")])
        return part.append_column("part", pa.array(differencing(part.column("bytes").to_pylist(), shards), pa.int32()))

    cell = F.pmod(F.xxhash64("code", F.lit(7)), F.lit(cells)).cast("int")
    parts = groups.select(cell.alias("cell"), "code", "bytes", "many").groupBy("cell").applyInArrow(difference, "cell int, code long, bytes long, many long, part int")
    parts = kept_on_disk(parts)
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes")).orderBy("cell", "part").collect():  # MOST_CELLS x shards rows at most
        sums.setdefault(r["cell"], np.zeros(shards, np.int64))[r["part"]] = r["bytes"]
    where = partition(list(sums.values()), shards)
    plan = [(c, p, int(to[p])) for c, to in zip(sums, where, strict=True) for p in range(shards)]
    plan = spark.createDataFrame(plan, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())]))
    assigned = parts.join(F.broadcast(plan), ["cell", "part"]).select("code", "shard", "many")
    dealt = hot_join(rows, assigned, "code", "shard", "doc_id")
    chunks = scaled(n, CHUNK_ROWS * shards, 16)
    placed = dealt.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).alias("chunk"))
    before = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = before.select("shard", "chunk", (F.sum("n").over(W.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("own", own)
        .join(before, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
