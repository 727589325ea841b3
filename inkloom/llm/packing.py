"""Problem 3: filling fixed-capacity containers (batches) with items of varying length.

Hierarchical residual packing. The items of a group are spread over chunks of about ``chunk_items``; each chunk is
packed on its own by best fit decreasing under both limits (size, and number of items), its nearly full bins are
final, and the underfull ones go up a tree as items of the next round, ``fan`` chunks into one, until one chunk a
group is left, whose bins are all final. So a group may hold any share of the rows: no task gets more than
``chunk_items`` items, or the residue of ``fan`` chunks.

An item is split only if it alone exceeds the capacity: into full pieces and a rest. A null (or non-positive) limit
is no limit. Batch ids count from 0 in each group without gaps.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import cut, is_blank, latest_blocks, small_side

CHUNK_ITEMS = 4096
FAN = 8
NEARLY_FULL = 0.98


def best_fit(sizes: list[int], counts: list[int], cap: float, limit: float) -> list[list[int]]:
    """Best fit decreasing: each item goes to the open bin it leaves the least room in."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], -counts[i], i))
    if cap == math.inf:  # room is the number of items then
        order.sort(key=lambda i: (-counts[i], i))
    by_size = cap != math.inf
    bins: list[list[int]] = []
    room: list[list[float]] = []
    open_bins: list[tuple[float, int]] = []
    for i in order:
        s, c = sizes[i], counts[i]
        at = bisect_left(open_bins, (s if by_size else c, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if room[b][0] >= s and room[b][1] >= c:
                break
            at += 1
        if at < len(open_bins):
            open_bins.pop(at)
            bins[b].append(i)
            room[b][0] -= s
            room[b][1] -= c
        else:
            b = len(bins)
            bins.append([i])
            room.append([cap - s, limit - c])
        if room[b][0] > 0 and room[b][1] > 0:
            insort(open_bins, (room[b][0] if by_size else room[b][1], b))
    return bins


def even_fit(sizes: list[int], counts: list[int], cap: float, limit: float, n_bins: int) -> list[list[int]] | None:
    """Largest items first, each to the emptiest of ``n_bins`` bins; None if they do not hold them."""
    heap = [(0, 0, b) for b in range(n_bins)]
    bins: list[list[int]] = [[] for _ in range(n_bins)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not heap:
            return None
        load, n, b = heapq.heappop(heap)
        if load + sizes[i] > cap or n + counts[i] > limit:
            return None
        bins[b].append(i)
        if n + counts[i] < limit:
            heapq.heappush(heap, (load + sizes[i], n + counts[i], b))
    return bins


def lower_bound(sizes: list[int], counts: list[int], cap: float, limit: float) -> int:
    return max(1, math.ceil(sum(sizes) / cap), math.ceil(sum(counts) / limit))


def pack(sizes: list[int], counts: list[int], cap: float, limit: float) -> list[list[int]]:
    """Best fit; where both limits bind it can waste places, so fewer, evenly filled bins are tried as well."""
    bins = best_fit(sizes, counts, cap, limit)
    if limit != math.inf and cap != math.inf:
        for n in range(lower_bound(sizes, counts, cap, limit), len(bins)):
            even = even_fit(sizes, counts, cap, limit, n)
            if even is not None:
                return [b for b in even if b]
    return bins


def _local(nearly_full: float):
    """One chunk of one group: its items with their bin, numbered with the final ones first."""

    def run(table: pa.Table) -> pa.Table:
        sizes, counts = table["size"].to_pylist(), table["n"].to_pylist()
        cap, limit = table["cap"][0].as_py(), table["max_n"][0].as_py()
        cap, limit = math.inf if cap is None else cap, math.inf if limit is None else limit
        last = table["chunks"][0].as_py() <= 1
        bins = pack(sizes, counts, cap, limit) if last else best_fit(sizes, counts, cap, limit)
        full = [last or sum(sizes[i] for i in b) >= nearly_full * cap or sum(counts[i] for i in b) >= limit for b in bins]
        place, final = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for k, j in enumerate(sorted(range(len(bins)), key=lambda j: not full[j])):
            place[bins[j]] = k
            final[bins[j]] = full[j]
        return pa.table({"grp": table["grp"], "unit": table["unit"], "chunk": table["chunk"], "bin": place, "final": final})

    return run


PLACED = "grp string, unit string, chunk long, bin long, final boolean"


def pack_items(items: DataFrame, chunk_items: int = CHUNK_ITEMS, fan: int = FAN, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``items``: grp string, item string (unique in its group), size long, cap long, max_n long (equal in a group).

    Gives grp, item, piece, start, size, batch_id: every piece of every item, once."""
    items = items.select("grp", "item", "size", "cap", "max_n")
    limits = items.withColumn("cap", F.when(F.col("cap") >= 1, F.col("cap"))).withColumn("max_n", F.when(F.col("max_n") >= 1, F.col("max_n")))
    n_pieces = F.when(F.col("size") > F.col("cap"), F.ceil(F.col("size") / F.col("cap"))).otherwise(1).cast("int")
    parts = (
        limits.withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
        .withColumn("start", F.col("piece") * F.coalesce("cap", F.lit(0)))
        .withColumn("size", F.least(F.col("size") - F.col("start"), F.col("cap")))
        .withColumn("unit", F.concat_ws("/", "item", F.col("piece").cast("string")))
    )
    spread = parts.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / chunk_items).alias("chunks"))
    parts = cut(parts.join(spread, "grp"))
    level = parts.select(
        "grp",
        "unit",
        "size",
        F.lit(1).cast("long").alias("n"),
        "cap",
        "max_n",
        "chunks",
        F.pmod(F.xxhash64("unit"), F.col("chunks")).alias("chunk"),
    )
    rounds, most = 0, parts.agg(F.max("chunks")).head()[0] or 1
    chain = None  # unit -> the unit that carries it in this round
    placed = None  # grp, unit, round, chunk, bin of the finished pieces
    while True:
        got = cut(level.groupBy("grp", "chunk").applyInArrow(_local(nearly_full), PLACED))
        # the pieces that this round's units stand for
        carried = got.withColumnRenamed("unit", "carrier") if chain is None else None
        if chain is None:
            pieces = carried.select("grp", F.col("carrier").alias("unit"), "chunk", "bin", "final")
        else:
            pieces = chain.join(got.withColumnRenamed("unit", "carrier"), ["grp", "carrier"]).select("grp", "unit", "chunk", "bin", "final")
        done = pieces.where("final").select("grp", "unit", F.lit(rounds).alias("round"), "chunk", "bin")
        placed = done if placed is None else placed.unionByName(done)
        if most <= 1:
            break
        name = F.concat_ws(".", F.lit(str(rounds)), F.col("chunk").cast("string"), F.col("bin").cast("string"))
        chain = cut(pieces.where(~F.col("final")).select("grp", "unit", name.alias("carrier")))
        most, rounds = math.ceil(most / fan), rounds + 1
        level = (
            level.join(got.where(~F.col("final")).select("grp", "unit", "bin"), ["grp", "unit"])
            .groupBy("grp", "chunk", "bin")
            .agg(
                F.sum("size").alias("size"),
                F.sum("n").alias("n"),
                F.first("cap").alias("cap"),
                F.first("max_n").alias("max_n"),
                F.first("chunks").alias("chunks"),
            )
            .select(
                "grp",
                F.concat_ws(".", F.lit(str(rounds - 1)), F.col("chunk").cast("string"), F.col("bin").cast("string")).alias("unit"),
                "size",
                "n",
                "cap",
                "max_n",
                F.ceil(F.col("chunks") / fan).alias("chunks"),
                F.floor(F.col("chunk") / fan).alias("chunk"),
            )
        )
    # dense ids: bins of a chunk after those of all chunks before it
    order = Window.partitionBy("grp").orderBy("round", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("grp", "round", "chunk").agg((F.max("bin") + 1).alias("bins"))
    heads = heads.withColumn("offset", F.coalesce(F.sum("bins").over(order), F.lit(0))).drop("bins")
    numbered = placed.join(heads, ["grp", "round", "chunk"]).select("grp", "unit", (F.col("offset") + F.col("bin")).alias("batch_id"))
    return parts.join(numbered, ["grp", "unit"]).select("grp", "item", "piece", "start", "size", "batch_id")


def run_items(runs: DataFrame, blocks: DataFrame, providers: DataFrame) -> DataFrame:
    """The translatable blocks of each run with its provider's limits, as items. A run whose provider is not known has
    no limits; of rows with one state_key the greatest counts; runs without state_key are left out."""
    r = runs.where("state_key is not null").groupBy("state_key").agg(F.max(F.struct("book_id", "provider_id")).alias("r")).select("state_key", "r.*")
    p = providers.where("provider_id is not null").groupBy("provider_id").agg(F.max(F.struct("max_batch_chars", "max_batch_items")).alias("p"))
    p = p.select("provider_id", F.col("p.max_batch_chars").cast("long").alias("cap"), F.col("p.max_batch_items").cast("long").alias("max_n"))
    usable = blocks.withColumn("chars", F.when(~F.coalesce("protected", F.lit(False)) & ~is_blank(F.col("text")), F.length("text").cast("long")))
    b = latest_blocks(usable, "chars").where("chars is not null")
    # a short table of runs is broadcast, so that no book meets in one task
    return b.join(small_side(r.join(p, "provider_id", "left")), "book_id").select(
        F.col("state_key").alias("grp"),
        F.col("block_id").cast("string").alias("item"),
        F.col("chars").alias("size"),
        "cap",
        "max_n",
    )


def plan_batches(runs: DataFrame, blocks: DataFrame, providers: DataFrame, **how) -> DataFrame:
    """(state_key, block_id, piece, start, n_chars, batch_id)."""
    got = pack_items(run_items(runs, blocks, providers), **how)
    return got.select(
        F.col("grp").alias("state_key"),
        F.col("item").cast("long").alias("block_id"),
        "piece",
        F.col("start").cast("long").alias("start"),
        F.col("size").cast("long").alias("n_chars"),
        "batch_id",
    )


def fill_report(runs: DataFrame, blocks: DataFrame, providers: DataFrame, **how) -> DataFrame:
    """Per run: batches, the least number that could do by either limit, and the share of full places."""
    items = run_items(runs, blocks, providers)
    sums = items.groupBy(F.col("grp").alias("state_key")).agg(
        F.sum("size").alias("chars"),
        F.first("cap").alias("cap"),
        F.first("max_n").alias("max_n"),
    )
    made = plan_batches(runs, blocks, providers, **how).groupBy("state_key").agg(
        (F.max("batch_id") + 1).alias("batches"),
        F.count(F.lit(1)).alias("pieces"),
    )
    least = F.greatest(
        F.lit(1),
        F.coalesce(F.ceil(F.col("chars") / F.col("cap")), F.lit(1)),
        F.coalesce(F.ceil(F.col("pieces") / F.col("max_n")), F.lit(1)),
    )
    return sums.join(made, "state_key").select(
        "state_key",
        "pieces",
        "chars",
        "batches",
        least.alias("least_batches"),
        (least / F.col("batches")).alias("fill"),
    )
