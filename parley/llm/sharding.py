"""Sharding over fixed virtual slots.

Records hash into thousands of slots that never change; a versioned map says which shard holds each slot. The first map
is balanced by the bytes of the slots; rebalancing and growing edit the map, moving whole slots, and write a new version.

The slot follows from id and text, so that rows without id, or with one id, are dealt to many slots too. Null ids hash like
the empty text, null texts have no bytes; every row counts one byte more, so empty rows spread too. Rows with equal id and
text share a slot and get places of their own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import id_key, keep, text_of

SLOTS, SHARDS = 4096, 16
MAP = "version int, virtual_slot int, bytes long, shard int"


def virtual_slot(text_crc32: Column, slots: int = SLOTS) -> Column:
    """Slot of an id and its text: 32 bits of the MD5 of the id and the text's CRC-32, modulo the number of slots."""
    key = F.concat(id_key(), F.lit("|"), text_crc32.cast("string")).cast("binary")
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    raw = text_of("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), virtual_slot(F.crc32(raw), slots).alias("virtual_slot"))


def first_map(load: pd.DataFrame, shards: int = SHARDS) -> pd.DataFrame:
    """Slots by falling bytes, each to the shard with the fewest bytes so far (then the lowest number)."""
    heap = [(0, s) for s in range(shards)]
    home = {}
    for slot, size in sorted(zip(load["virtual_slot"].tolist(), load["bytes"].tolist()), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        home[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return load.assign(version=1, shard=[home[s] for s in load["virtual_slot"].tolist()])


def edited_map(old: pd.DataFrame, load: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The next version for new bytes per slot or more shards: slots leave the fullest shard that can spare one for the
    emptiest one while that brings the two closer; all others stay where they are. New shards are the only ones to take."""
    table = load.merge(old[["virtual_slot", "shard"]], on="virtual_slot", how="left")
    held = {s: 0 for s in range(shards)}
    members: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    home = {}
    for slot, size, shard in table[["virtual_slot", "bytes", "shard"]].sort_values("virtual_slot").itertuples(index=False):
        to = min(held, key=lambda s: (held[s], s)) if pd.isna(shard) else int(shard)
        home[int(slot)] = to
        held[to] += int(size)
        members[to].append((int(size), int(slot)))
    takers = [s for s in held if s not in set(old["shard"])] or list(held)  # new shards fill up first
    for _ in range(2 * len(home)):
        empty = min(takers, key=lambda s: (held[s], s))
        found = ((s, [m for m in members[s] if 0 < 2 * m[0] <= held[s] - held[empty]]) for s in sorted(held, key=lambda s: (-held[s], s)))
        full, fits = next(((s, f) for s, f in found if f), (None, None))
        if full is None:
            break
        size, slot = max(fits)
        members[full].remove((size, slot))
        members[empty].append((size, slot))
        held[full] -= size
        held[empty] += size
        home[slot] = empty
    return load.assign(version=int(old["version"].max()) + 1, shard=[home[s] for s in load["virtual_slot"].tolist()])


def slot_map(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Bytes per slot (at most `slots` rows reach the driver), and the stored first version of the map."""
    load = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).toPandas()
    load = pd.DataFrame({"virtual_slot": range(slots)}).merge(load, on="virtual_slot", how="left").fillna({"bytes": 0}).astype("int64")
    table = first_map(load, shards)[["version", "virtual_slot", "bytes", "shard"]]
    return keep(rows.sparkSession.createDataFrame(table, MAP), "slot-map")


def rebalanced(rows: DataFrame, stored: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The stored map's next version for the present rows and number of shards."""
    load = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).toPandas()
    load = pd.DataFrame({"virtual_slot": range(slots)}).merge(load, on="virtual_slot", how="left").fillna({"bytes": 0}).astype("int64")
    table = edited_map(stored.toPandas(), load, shards)[["version", "virtual_slot", "bytes", "shard"]]
    return keep(rows.sparkSession.createDataFrame(table, MAP), "slot-map")


def placed(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows with their shard and, without gaps from 0, their place in it: places in a slot after those of lower slots."""
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (stored.select("virtual_slot", "shard", "version").join(counts, "virtual_slot")
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("_place", F.row_number().over(inside) - 1).join(F.broadcast(starts), "virtual_slot")
            .withColumn("slot", (F.col("_start") + F.col("_place")).cast("long")).drop("_start", "_place"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row.

    The law is `bytes`: the map is balanced by what the slots hold.
    """
    rows = keep(sized(docs, slots), "sized")
    stored = slot_map(rows, shards, slots)
    return placed(rows, stored).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                                       F.col("version").alias("map_version"))
