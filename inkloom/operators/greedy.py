"""Greedy packing in order, in parallel even within one book.

Rows of a group are packed in order: a batch closes when the next row would take it over a limit; a row that is over
the limit alone rides alone. Order makes this sequential, yet what a chunk of rows does depends on the rows before it
only through the open batch's size at its start. Rows are gathered by chunks of at most CHUNK positions. A group of one
chunk starts from nothing; for a longer one, each chunk tells, for every place the first new batch may start at, how
full the last one is at its end, and these short tables are read one after the other, as a stream, to get the state
each chunk begins with. A chunk that no batch can end in is summed up in one row. Then all chunks are walked in parallel, by a fold in the JVM that
keeps the starts of batches only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.session import small_side, stored

#: Positions a chunk has at most.
CHUNK = 16_384


def _closes(size: int, n: int, s: int, cap: int | None, most: int | None) -> bool:
    return n > 0 and (cap is not None and size + s > cap or most is not None and n + 1 > most)


def walk(sizes: list[int], size: int, n: int, cap: int | None, most: int | None) -> tuple[list[int], int, int]:
    """(batch of each row counted from the open one, size and rows of the last batch): the rule itself, for tests."""
    out, k = [], 0
    for s in sizes:
        if _closes(size, n, s, cap, most):
            k, size, n = k + 1, 0, 0
        out.append(k)
        size, n = size + s, n + 1
    return out, size, n


def summary(sizes: list[int], cap: int | None, most: int | None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Sizes of the rows up to the last place where the first new batch of a chunk can start, and for each of these
    places (size and rows of the chunk's last batch, batches) if one starts there. Without limits there are none."""
    if cap is None and most is None or not sizes:
        return [], []
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    count = len(sizes)
    at = np.arange(count)
    # where the batch that starts at a place ends: the first row that takes it over a limit, but after its own row
    ends_at = np.full(count, count)
    if cap is not None:
        ends_at = np.minimum(ends_at, np.searchsorted(prefix, prefix[:-1] + cap, side="right") - 1)
    if most is not None:
        ends_at = np.minimum(ends_at, at + most)
    ends_at = np.maximum(ends_at, at + 1)
    reach = min(int(ends_at[0]) + 1, count)
    after = ends_at.tolist()
    ends: list[tuple[int, int, int]] = [(0, 0, 0)] * count
    for i in range(count - 1, -1, -1):
        if after[i] >= count:
            ends[i] = (int(prefix[-1] - prefix[i]), count - i, 1)
        else:
            size, n, b = ends[after[i]]
            ends[i] = (size, n, b + 1)
    return sizes[:reach], ends[:reach]


SUMMARY = "grp string, chunk long, cap long, most long, size long, n long, sizes array<long>, end_size array<long>, end_n array<long>, end_batches array<long>"
STATE = "grp string, chunk long, open_size long, open_n long, first long"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grp, chunk, cap, most, sizes in zip(*[batch.column(k).to_pylist() for k in ("grp", "chunk", "cap", "most", "sizes")]):
            head, ends = summary(sizes, cap, most)
            size, n, k = ([e[j] for e in ends] for j in range(3))
            types = [pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 4]
            row = (grp, chunk, cap, most, sum(sizes), len(sizes), head, size, n, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types)],
                ["grp", "chunk", "cap", "most", "size", "n", "sizes", "end_size", "end_n", "end_batches"],
            )


def first_close(sizes: np.ndarray, size: int, n: int, cap: int | None, most: int | None) -> int:
    """Place of the first row that an open batch does not take; the number of rows if it takes all of them."""
    place = len(sizes)
    if cap is not None and place:
        over = np.flatnonzero(np.cumsum(sizes) + size > cap)
        # a batch without rows takes any first row
        over = over[1:] if n == 0 and len(over) and over[0] == 0 else over
        place = int(over[0]) if len(over) else place
    if most is not None:
        place = min(place, max(most - n, 0 if n else 1))
    return min(place, len(sizes))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each chunk begins with; chunks of a group come in order, and are forgotten once read."""
    group, size, n, first = None, 0, 0, 0
    for batch in batches:
        out = []
        c = {k: batch.column(k) for k in batch.schema.names}
        for i in range(batch.num_rows):
            grp = c["grp"][i].as_py()
            if grp != group:
                group, size, n, first = grp, 0, 0, 0
            out.append((grp, c["chunk"][i].as_py(), size, n, first))
            cap, most = c["cap"][i].as_py(), c["most"][i].as_py()
            sizes = c["sizes"][i].values.to_numpy(zero_copy_only=False)
            at = first_close(sizes, size, n, cap, most)
            if at == len(sizes):  # the whole chunk goes into the open batch
                size, n = size + c["size"][i].as_py(), n + c["n"][i].as_py()
            else:
                size, n = c["end_size"][i][at].as_py(), c["end_n"][i][at].as_py()
                first += c["end_batches"][i][at].as_py()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*out))],
                ["grp", "chunk", "open_size", "open_n", "first"],
            )


def _starts(items: Column) -> Column:
    """Fold over a chunk's items: the places where a batch starts, the first item's place always; whether the open batch
    closed at once; size and rows of the last batch."""
    zero = F.struct(
        F.col("open_size").alias("size"),
        F.col("open_n").alias("n"),
        F.lit(0).alias("i"),
        F.lit(False).alias("fresh"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(s: Column, x: Column) -> Column:
        over = (s["n"] > 0) & F.coalesce((s["size"] + x["size"] > F.col("cap")) | F.lit(False), F.lit(False))
        many = (s["n"] > 0) & F.coalesce((s["n"] + 1 > F.col("most")) | F.lit(False), F.lit(False))
        closes = over | many
        return F.struct(
            F.when(closes, x["size"]).otherwise(s["size"] + x["size"]).alias("size"),
            F.when(closes, F.lit(1).cast("long")).otherwise(s["n"] + 1).alias("n"),
            (s["i"] + 1).alias("i"),
            (s["fresh"] | (closes & (s["i"] == 0))).alias("fresh"),
            F.when(closes | (s["i"] == 0), F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(items, zero, step)


def packed_chunks(
    rows: DataFrame,
    grp: Column,
    pos: Column,
    size: Column,
    cap: Column,
    most: Column,
    strict: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """(grp, chunk, items array<struct<pos,size>>, first, fresh, starts): every chunk with the places its batches start
    at; its k-th batch has the number first + k, and one more where ``fresh``."""
    cap, most = cap.cast("long"), most.cast("long")
    given = rows.select(
        grp.cast("string").alias("grp"),
        pos.cast("long").alias("pos"),
        F.coalesce(size.cast("long"), F.lit(0)).cast("long").alias("size"),
        F.when(cap >= 1, cap).alias("cap"),
        F.when(most >= 1, most).alias("most"),
    ).where("grp is not null and pos is not null")
    if strict:
        checked = F.when(
            F.col("size") > F.col("cap"),
            F.raise_error(F.concat(F.lit("block over the limit: "), "grp", F.lit("/"), F.col("pos").cast("string"))),
        ).otherwise(F.col("size"))
        given = given.withColumn("size", checked.cast("long"))
    chunks = given.groupBy("grp", F.floor(F.col("pos") / chunk).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "size"))).alias("items"),
        F.first("cap").alias("cap"),
        F.first("most").alias("most"),
    )
    chunks = stored(chunks, "chunks")
    long = chunks.groupBy("grp").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1").select("grp")
    none = F.lit(0).cast("long")
    if long.isEmpty():
        begun = chunks.withColumns({"open_size": none, "open_n": none, "first": none})
    else:
        tables = chunks.join(long, "grp", "left_semi").select(
            "grp",
            "chunk",
            "cap",
            "most",
            F.transform("items", lambda x: x["size"]).alias("sizes"),
        ).mapInArrow(_summarise, SUMMARY)
        states = tables.repartition("grp").sortWithinPartitions("grp", "chunk").mapInArrow(_chain, STATE)
        begun = chunks.join(states, ["grp", "chunk"], "left").na.fill(0, ["open_size", "open_n", "first"])
    return begun.withColumn("walked", _starts(F.col("items"))).select(
        "grp",
        "chunk",
        "items",
        "first",
        F.col("walked.fresh").cast("int").alias("fresh"),
        F.col("walked.starts").alias("starts"),
    )


def greedy_batches(
    rows: DataFrame,
    grp: Column,
    pos: Column,
    size: Column,
    cap: Column,
    most: Column,
    strict: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """(grp, pos, batch) of every row; ``pos`` is unique in a group and gives the order, null limits are none.

    ``strict`` makes a row over the cap an error instead of a batch of its own. Groups or positions that are null are
    left out."""
    got = packed_chunks(rows, grp, pos, size, cap, most, strict, chunk)
    stops = F.concat(F.slice(F.col("starts"), F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("items")))
    parts = F.transform(F.arrays_zip(F.col("starts").alias("a"), stops.alias("b")), lambda z: F.slice(F.col("items"), z["a"] + 1, z["b"] - z["a"]))
    by_batch = got.select("grp", (F.col("first") + F.col("fresh")).alias("first"), F.posexplode(parts).alias("k", "part"))
    return by_batch.select("grp", (F.col("first") + F.col("k")).alias("batch"), F.explode("part").alias("x")).select("grp", "x.pos", "batch")


def batch_counts(
    rows: DataFrame,
    grp: Column,
    pos: Column,
    size: Column,
    cap: Column,
    most: Column,
    strict: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """(grp, batches): how many batches each group makes, without a row for each of its rows."""
    got = packed_chunks(rows, grp, pos, size, cap, most, strict, chunk)
    return got.groupBy("grp").agg(F.max(F.col("first") + F.col("fresh") + F.size("starts")).alias("batches"))


def within_limits(rows: DataFrame, grp: str, size: str, cap: str) -> tuple[DataFrame, DataFrame]:
    """The rows of groups in which no row is over its cap, and those of the other groups, which strict packing refuses."""
    bad = small_side(rows.where(F.col(size) > F.col(cap)).select(grp).distinct())
    return rows.join(bad, grp, "left_anti"), rows.join(bad, grp, "left_semi")
