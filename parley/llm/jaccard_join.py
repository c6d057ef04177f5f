"""N-gram Jaccard join: a size-aware heavy-light join of the documents' sets of word shingles.

Two sets link when 100 * |A and B| >= 80 * |A or B|. Sets of at most `boundary` shingles are light: for each pair of sizes
that can link, they name all their subsets of the size of the least overlap, and sets with a subset in common link. For
larger sets, inverted lists are scanned: a set is listed under its rarest fifth of shingles, so linked sets meet in a
list. The boundary is where counting subsets costs less than scanning lists, from the histogram of set sizes.

Work on large groups stays linear. Equal sets are one set. Shingles are ordered by how common they are (a bounded sketch
of counts over all sets), so what many sets share is listed last: sets of one boilerplate meet in it only where it is
most of each. In a list every set is first compared with the list's head; in lists that then still hold several components, the sets outside the largest one are tried with a few sets of it,
and in those that even then hold several, they meet all sets of other components.
Sizes, positions and parity sketches exclude most pairs before their texts are looked at; every other pair is decided by
its whole sets. Nothing is capped: order and sketches change the cost, never the links.

Null texts are empty; empty sets link with nothing; a null id is never a component's name while another id is in it.
Repeated rows are equal sets. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import shingles
from parley.llm.common import flag_maybe, keep, maybe_in, mix, parts, text_of, texts
from parley.llm.components import components

#: Similarity in percent.
PERCENT = 80
#: Cells of the count sketch, count from which a shingle is common.
CELLS, COMMON = 1 << 22, 32
#: Low bits of a shingle's hash that the counts do not tell apart (2**40 positions stay), and the largest light size ever considered.
_GRAIN, LIGHTEST = 24, 16
#: Sets compared with one head in a task, and sets of a list's largest component that one outside it is tried with first.
CHUNK, TRIES = 500, 6
SETS = "doc_id long, place long, n int, name binary, sketch binary, bits array<long>"


def overlap(m: int, n: int) -> int:
    """Least size of the intersection of linked sets of m and n elements."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def partners(n: int, most: int) -> list[int]:
    """Sizes up to `most` that can link with size n."""
    return [m for m in range(1, most + 1) if 100 * min(m, n) >= PERCENT * max(m, n)]


def light_keys(n: int, most: int) -> int:
    """Number of subsets that a light set of n elements names."""
    return sum(math.comb(n, overlap(m, n)) for m in partners(n, most))


def boundary(sizes: dict[int, int]) -> int:
    """Largest light size with the least cost: a named subset costs 1; a list entry 1 and about 3 for comparisons."""
    def cost(x: int) -> float:
        light = sum(c * light_keys(n, x) for n, c in sizes.items() if 0 < n <= x)
        heavy = sum(4.0 * c * (n - -(-PERCENT * n // 100) + 1) for n, c in sizes.items() if 100 * n >= PERCENT * (x + 1))
        return light + heavy

    return min(range(LIGHTEST + 1), key=lambda x: (cost(x), x))


def sized_sets(docs: DataFrame) -> DataFrame:
    """doc_id, place, n, name, sketch of every row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 8192, 1_000_000):
            found = shingles.sets(batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int32()), pa.array(shingles.set_ids(found), pa.binary()),
                pa.array([shingles.parity(x) for x in found], pa.binary()),
                pa.array([shingles.short_parity(x) for x in found], pa.list_(pa.int64()))], names=["doc_id", "place", "n", "name", "sketch", "bits"])

    return _narrow(docs).select("doc_id", _place(), "text").mapInArrow(run, SETS)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))


def _place() -> Column:
    """Where a row's text is found again: its id, or a hash of the text where that is null."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("place")


def common_cells(docs: DataFrame, rows: int) -> np.ndarray:
    """The count sketch: per cell of the hash range, log2 of the count of its commonest shingle (0: rare).

    Every shingle is counted. Counts are exact up to collisions in 2**40 positions; the sketch has CELLS bytes at every size. Where common
    shingles fill more than an eighth of an owner's cells, the commonest are kept.
    """
    owners = 1 << min(22, max(8, (rows // 4096).bit_length()))
    shift = 40 - owners.bit_length() + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 8192, 1_000_000):
            place, times = np.unique(np.concatenate(shingles.sets(batch.column(1))) >> np.uint64(_GRAIN), return_counts=True)
            owner = (place >> np.uint64(shift)).astype(np.int64)
            key = (place & np.uint64((1 << shift) - 1)).astype(np.uint32)
            ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
            out = [[], [], [], []]
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                k, t = key[a:b], times[a:b]
                for column, x in zip(out, (int(owner[a]), k[t == 1].tobytes(), k[t > 1].tobytes(), t[t > 1].astype(np.uint32).tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                                             names=["owner", "single", "several", "times"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        single = np.frombuffer(b"".join(frame["single"]), np.uint32)
        several = np.frombuffer(b"".join(frame["several"]), np.uint32)
        times = np.frombuffer(b"".join(frame["times"]), np.uint32).astype(np.int64)
        key, where = np.unique(np.concatenate([single, several]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([np.ones(len(single)), times]))
        hot = np.flatnonzero(total >= COMMON)
        room = max(1, CELLS // owners // 8)
        hot = hot[np.argsort(-total[hot], kind="stable")[:room]]
        owner = int(frame["owner"].iloc[0])
        cell = ((np.uint64(owner) << np.uint64(shift)) + key[hot].astype(np.uint64)) >> np.uint64(18)
        return pd.DataFrame({"cell": cell.astype(np.int64), "level": np.log2(total[hot]).astype(np.int64)})

    sent = _narrow(docs).mapInArrow(send, "owner int, single binary, several binary, times binary")
    found = sent.groupBy("owner").applyInPandas(count, "cell long, level long").groupBy("cell").agg(F.max("level").alias("level")).toPandas()
    cells = np.zeros(CELLS, np.uint8)  # at most an eighth of the cells, or one an owner, reach the driver
    cells[found["cell"].to_numpy(np.int64)] = found["level"].to_numpy(np.uint8)
    return cells


def entries(docs: DataFrame, spread: Broadcast, light: int) -> DataFrame:
    """List entries of every set: g, h, meta. `spread` is the broadcast count sketch.

    g: shingle or subset; h: first half of the set's name; meta: salt * 2**40 + kind * 2**39 + dealt * 2**38 + 2 * n + flag.
    Kind 1 is a subset (flag: the set has the smaller of the two sizes); kind 0 a listed shingle (flag: listed also as the
    smaller set of a pair, which needs the rarest ninth only). Common shingles are salted by h, so a long list is dealt out
    (dealt: the list has several salts).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        levels = spread.value
        for batch in texts(batches, 8192, 1_000_000):
            found = shingles.sets(batch.column(1))
            gs, hs, metas = [], [], []
            for x, name in zip(found, shingles.set_ids(found)):
                n, h = len(x), int.from_bytes(name[:8], "big", signed=True)
                if not n or h in seen:  # the task has listed an equal set
                    continue
                seen.add(h)
                if n <= light:
                    for m in partners(n, light):
                        low, high = min(m, n), max(m, n)
                        seed = np.uint64(low * 64 + high)
                        for chosen in itertools.combinations(x.tolist(), overlap(m, n)):
                            gs.append(mix(mix(np.array(chosen, np.uint64)).sum(keepdims=True) * np.uint64(3) + seed))
                            metas.append(np.array([(1 << 39) + 2 * n + (n == low)], np.int64))
                            hs.append(np.array([h], np.int64))
                if 100 * n < PERCENT * (light + 1):
                    continue
                level = levels[x >> np.uint64(_GRAIN + 18)]
                listed = np.argsort(level, kind="stable")[:n - -(-PERCENT * n // 100) + 1]
                least = n - overlap(n, n) + 1
                salts = (np.int64(1) << np.maximum(level[listed].astype(np.int64) - 5, 0)) - 1
                salt = np.int64(h & 0xFFFFF) & salts
                gs.append(x[listed])
                hs.append(np.full(len(listed), h, np.int64))
                metas.append((salt << 40) + ((salts > 0).astype(np.int64) << 38) + 2 * n + (np.arange(len(listed)) < least))
            if gs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gs).astype(np.uint64).view(np.int64)), pa.array(np.concatenate(hs)),
                                                  pa.array(np.concatenate(metas))], names=["g", "h", "meta"])

    return _narrow(docs).mapInArrow(run, "g long, h long, meta long")


def _lists(rows: DataFrame) -> DataFrame:
    """Entries of lists that more than one set is in, with the head of the list or of the list's part of one salt: kind, g,
    h, n, flag, head. A set alone in its part of a dealt-out list stays: others may be in the parts of other salts."""
    told = rows.select("g", "h", "meta", F.shiftright("meta", 40).alias("salt"))
    own = Window.partitionBy("g", "salt")
    dealt = F.col("meta").bitwiseAND(F.lit(1 << 38)) != 0
    kept = (told.withColumn("head", F.min("h").over(own)).withColumn("_last", F.max("h").over(own))
            .where((F.col("head") < F.col("_last")) | dealt))
    low = F.col("meta").bitwiseAND(F.lit((1 << 38) - 1))
    return kept.select(F.shiftright("meta", 39).bitwiseAND(F.lit(1)).cast("int").alias("kind"), "g", "h", F.shiftright(low, 1).cast("int").alias("n"),
                       (low.bitwiseAND(F.lit(1)) == 1).alias("flag"), "head")


def _half(name) -> Column:
    """First half of a set's name as a whole number."""
    return F.conv(F.substring(F.hex(name), 1, 16), 16, -10).cast("long")


def _compare(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (head, h) of halves of set names, the head that of many -> those that link, as names u, v."""
    side = lambda half, k: reps.select(F.col("h").alias(half), F.col("name").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    told = pairs.join(side("head", "a"), "head").join(side("h", "b"), "h")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            least = [max(abs(m - n), shingles.least_difference(x, y)) for m, n, x, y in zip(t["n_a"], t["n_b"], t["s_a"], t["s_b"])]
            near = [100 * (m + n - d) >= PERCENT * (m + n + d) for d, m, n in zip(least, t["n_a"], t["n_b"])]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], names=["a", "b"])

    left = keep(told.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bound, "a binary, b binary"), "bounds")
    chunks = left.groupBy("a").agg((F.floor(F.count(F.lit(1)) / CHUNK) + 1).cast("int").alias("chunks"))
    members = left.join(chunks, "a").select("a", F.col("b").alias("name"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"))
    heads = chunks.select("a", F.col("a").alias("name"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    wanted = keep(members.unionByName(heads).join(reps.select("name", "place"), "name"), "wanted")
    placed = _narrow(docs).select(_place(), "text")
    found = wanted.join(maybe_in(placed, F.col("place"), wanted.select("place"), "place"), "place")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, current = (None, None), None
        for batch in texts(batches, 1024, 1_000_000):
            sets = shingles.sets(batch.column("text"))
            links: list[tuple[bytes, bytes]] = []
            for a, chunk, role, name, x, own in zip(batch.column("a").to_pylist(), batch.column("chunk").to_pylist(), batch.column("role").to_pylist(),
                                                    batch.column("name").to_pylist(), sets, shingles.set_ids(sets)):
                if own != name:  # another text under the same id or place
                    continue
                if role == 0:
                    head, current = (a, chunk), x
                elif head == (a, chunk):
                    at = np.searchsorted(current, x)
                    common = int((current[np.minimum(at, len(current) - 1)] == x).sum())
                    if 100 * common >= PERCENT * (len(x) + len(current) - common):
                        links.append((a, name))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], names=["u", "v"])

    dealt = found.select("a", "chunk", "role", "name", "text").repartition(parts(docs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return dealt.mapInArrow(decide, "u binary, v binary").distinct()


def links(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets with one row's id each, and links (u, v) between them that make up all components."""
    reps = keep(sets.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("place")).alias("place"), *[F.first(c).alias(c) for c in ("n", "sketch", "bits")])
                .withColumn("h", _half("name")), "sets")
    sizes = {r["n"]: r["c"] for r in reps.groupBy(F.least("n", F.lit(4 * LIGHTEST)).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    light = boundary(sizes)
    spread = docs.sparkSession.sparkContext.broadcast(common_cells(docs, sum(sizes.values())))
    lists = keep(_lists(entries(docs, spread, light)), "lists")
    spread.destroy()  # the lists are written
    names = reps.select("h", "name")
    # light sets: all sets of a subset link with the subset's first set of the smaller size
    subsets = lists.where("kind = 1").select("g", "h", "flag")
    first = subsets.where("flag").groupBy("g").agg(F.min("h").alias("head"))
    sure = subsets.join(first, "g").where("h <> head").select("head", "h").distinct()
    # heavy sets: every set of a list with the head, the heads of a dealt-out list with the least of them
    listed = lists.where("kind = 0").drop("kind")
    tops = listed.select("g", "head").distinct().withColumnRenamed("head", "h").join(listed.groupBy("g").agg(F.min("head").alias("head")), "g").select("head", "h")
    stars = listed.select("head", "h").distinct().unionByName(tops).where("h <> head").distinct()
    named = sure.join(names.select(F.col("h").alias("head"), F.col("name").alias("u")), "head").join(names.select("h", F.col("name").alias("v")), "h").select("u", "v")
    first_links = keep(named.unionByName(_compare(stars, reps, docs)), "links")
    names_bits = reps.select("name", "h", "bits")
    roots = keep(components(first_links), "roots")
    mixed = keep(_mixed(listed.select("g", "h", "n", "flag"), names_bits, roots), "mixed")
    # once more a star: sets outside a list's largest component with some set of that component, by eight orders of the sets
    some = mixed.where("root = main").groupBy("g").agg(F.min_by(F.struct("h", "n"), F.xxhash64("h", F.pmod("g", F.lit(8)))).alias("y"))
    met = (mixed.where("root <> main").join(some, "g").select("h", "n", F.col("y.h").alias("head"), F.col("y.n").alias("n_y"))
           .where(_may_link("n", "n_y", F.lit(0))).distinct())
    met = (met.join(names_bits.select("h", "bits"), "h").join(names_bits.select(F.col("h").alias("head"), F.col("bits").alias("bits_y")), "head")
           .select("h", "head", "n", "n_y", _differ("bits", "bits_y").alias("differ")).where(_may_link("n", "n_y", "differ")))
    closest = Window.partitionBy("h").orderBy("differ", "head")
    tried = met.withColumn("_r", F.row_number().over(closest)).where(F.col("_r") <= TRIES).select("head", "h").distinct()
    more = keep(_compare(tried, reps, docs), "links")
    again = keep(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "roots")
    # what is still apart: every set outside a list's largest component with all sets of other components
    rest = keep(_mixed(mixed.select("g", "h", "n", "flag"), names_bits, again).join(names_bits.select("h", "bits"), "h"), "mixed")
    # one of the two lists the shingle as the smaller set: strays that do meet all, others that do meet the strays
    side = lambda k, t: t.select("g", "wide", *[F.col(c).alias(f"{c}_{k}") for c in ("h", "n", "root", "bits")])
    ahead = side("x", rest.where("flag").withColumn("wide", F.col("root") != F.col("main")))
    every = side("y", rest.withColumn("wide", F.explode(F.when(F.col("root") != F.col("main"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))))
    pairs = (ahead.join(every, ["g", "wide"])
             .where((F.col("root_x") != F.col("root_y")) & (F.col("n_x") <= F.col("n_y")) & _may_link("n_x", "n_y", _differ("bits_x", "bits_y")))
             .select(F.least("h_x", "h_y").alias("head"), F.greatest("h_x", "h_y").alias("h")).distinct())
    last = keep(_compare(keep(pairs, "pairs"), reps, docs), "links")
    return reps, again.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(last)


def _differ(a: str, b: str) -> Column:
    """Bits in which two short sketches differ: at most the size of the sets' symmetric difference."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(shingles.LONGS)]
    return sum(bits[1:], bits[0])


def _may_link(m: str, n: str, differ) -> Column:
    """Whether sizes and sketches leave a link possible."""
    fits = PERCENT * F.greatest(m, n) <= 100 * F.least(m, n)
    return fits & ((100 + PERCENT) * (F.col(differ) if isinstance(differ, str) else differ) <= (100 - PERCENT) * (F.col(m) + F.col(n)))


def _mixed(listed: DataFrame, names_bits: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (g, h, n, flag) of lists that hold more than one component, with root and the list's largest component
    (main). Lists of two sets whose sizes exclude a link are left out, and lists in which no set can be the smaller one."""
    root_of = keep(names_bits.select("h", "name").join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
                   .select("h", _half(F.coalesce("root", "name")).alias("root")), "placed")
    placed = listed.join(root_of, "h")
    share = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"),
                                                F.max("flag").alias("flag"))
    several = (share.groupBy("g").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"),
                                      F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("flag").alias("flag"))
               .where(F.col("flag") & (F.col("roots") > 1) & ((F.col("c") > 2) | (PERCENT * F.col("high") <= 100 * F.col("low")))).select("g", "main"))
    return placed.join(several, "g")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text)."""
    sets = keep(sized_sets(docs), "rows")
    reps, found = links(docs, sets)
    roots = keep(components(found), "roots")
    whole = reps.select("name", "doc_id").join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(least, "root").select("name", "component_id")
    return (sets.select("doc_id", "n", "name").join(named, "name", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component the one with the least id."""
    gone = keep(jaccard_join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")), "gone")
    marked = flag_maybe(docs, F.col("doc_id").cast("long"), gone, "_gone")
    doubtful = marked.where("_maybe").join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    return marked.where("NOT _maybe").select(docs.columns).unionByName(doubtful.select(docs.columns))
