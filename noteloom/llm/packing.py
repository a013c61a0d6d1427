"""Problem 8: pack notes into containers of fixed capacity, best-fit decreasing.

A note's size is its token count. What a note has beyond whole containers is cut off as full pieces,
each of which fills a container of its own; only the rest (at most one piece a note) is packed. The
rests are dealt by hash into groups of bounded size and each group is packed by itself: best-fit
decreasing leaves at most a few open containers a group, so groups of ``GROUP_ITEMS`` keep the unused
room of the whole within a fraction of a per cent of one global packing, without one global task.
In a group a segment tree over remaining capacities (0..capacity) counts the open containers, and the
tightest one that fits is found in O(log capacity).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.tokens import encode_documents
from noteloom.session import settings, table, written

#: Notes in a packing group: the bound of what one task holds.
GROUP_ITEMS = 20_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each size (each of 0..capacity); numbers count from 0.

    Equal sizes keep their order; among equally tight containers the one opened last is taken."""
    width = 1 << capacity.bit_length()  # leaves 0..capacity
    count = [0] * (2 * width)
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def change(room: int, by: int) -> None:
        node = width + room
        while node:
            count[node] += by
            node >>= 1

    def tightest(size: int) -> int:
        """The least room of at least ``size`` that an open container has, or -1."""
        node = width + size
        if count[node]:
            return size
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < width:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - width
            node >>= 1
        return -1

    where, opened = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        room = tightest(sizes[i])
        if room < 0:
            box, opened, room = opened, opened + 1, capacity
        else:
            box = at_room[room].pop()
            change(room, -1)
        where[i] = box
        at_room[room - sizes[i]].append(box)
        change(room - sizes[i], 1)
    return where


def pack_documents(sized: DataFrame, capacity: int, items: int, id_column: str = "doc_id", size_column: str = "n_tokens") -> DataFrame:
    """Pieces with their container: ``container_id, <id>, piece, start_token, n_tokens``.

    ``items`` is the number of rows of ``sized`` and only sets the number of groups. Rows larger than
    ``capacity`` are cut into full pieces and a rest, others stay whole. A row of no tokens is kept with
    a null container, since it needs no room; a null size counts as 0. Repeated ids are packed as often
    as they are given (rows that are alike get one place each). Rows that are alike are told apart by a number, so
    copies of an id, or null ids, are dealt to all groups and every container has the same name in each run. Extra
    columns are ignored; an empty table gives no rows."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = dict(sized.dtypes)[id_column]
    groups = max(1, math.ceil(items / GROUP_ITEMS))
    rows = sized.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column), F.lit(0)).cast("int").alias("size"))
    numbered = rows.groupBy("id", "size").agg(F.count("*").alias("copies")).select("id", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    pieces = numbered.withColumn("full", F.floor(F.col("size") / capacity).cast("int"))
    full = (
        pieces.where("full > 0")
        .select("id", "size", "copy", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
        .select(
            F.concat_ws("-", F.lit("f"), F.coalesce(F.col("id").cast("string"), F.lit("null")), "size", "copy", "piece").alias("container_id"),
            "id", "piece", (F.col("piece") * capacity).alias("start_token"), F.lit(capacity).alias("n_tokens"),
        )
    )
    rest = pieces.select("id", "copy", F.col("full").alias("piece"), (F.col("full") * capacity).alias("start_token"), (F.col("size") - F.col("full") * capacity).alias("n_tokens"))
    empty = rest.where("n_tokens = 0 and piece = 0").select(F.lit(None).cast("string").alias("container_id"), "id", "piece", "start_token", "n_tokens")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "id", "copy"], ascending=[False, True, True], kind="stable")
        boxes = best_fit_decreasing(frame["n_tokens"].tolist(), capacity)
        group = int(frame["packing_group"].iloc[0])
        return frame.assign(container_id=[f"g{group}-{box}" for box in boxes])[["container_id", "id", "piece", "start_token", "n_tokens"]]

    packed = (
        rest.where("n_tokens > 0")
        .withColumn("packing_group", F.pmod(F.xxhash64("id", "copy", "n_tokens"), F.lit(groups)).cast("int"))
        .groupBy("packing_group")
        .applyInPandas(pack, f"container_id string, id {kind}, piece int, start_token int, n_tokens int")
    )
    return full.unionByName(empty).unionByName(packed).withColumnRenamed("id", id_column)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    capacity = settings(table(spark, sf_dir, "analysis_limits"))["capacity_tokens"]
    # the sizes feed three branches; they are written once (two numbers a note) instead of encoded three times
    sized = written(spark, encode_documents(documents, ids=False))
    return pack_documents(sized, capacity, documents.count())


QUERIES = {"p8_containers": p8_containers}
