"""Operators along the order of blocks: numbering, samples, running counts, resume, last write wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.session import is_blank, latest_blocks, small_side


def one_row_blocks(blocks: DataFrame) -> DataFrame:
    return latest_blocks(blocks, "chapter_idx", "path", "kind", "text", "protected")


def prefix_sum(rows: DataFrame, key: str, order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier rows of the key, by ``order`` (an integer, unique in it).

    Two levels: sums of chunks of the order are added up per key, rows within their chunk only, so that a key of any
    size is spread over many tasks."""
    rows = rows.withColumn("_c", F.floor(F.col(order) / chunk))
    heads = rows.groupBy(key, "_c").agg(F.sum(value).alias("_s"))
    over = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    inside = Window.partitionBy(key, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(heads, [key, "_c"])
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_c", "_before")


def book_prefix(rows: DataFrame, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier rows of the book, by block_id."""
    return prefix_sum(rows, "book_id", "block_id", value, name, chunk)


def sized_blocks(blocks: DataFrame, *more: str, count: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """(book_id, block_id, chars, tokens and ``more``) of the translatable blocks: texts are measured where they are read,
    by ``count``, so that only numbers go through the exchange. Of rows with one key the greatest counts."""
    text = F.col("text")
    usable = blocks.where("book_id is not null and block_id is not null").where(T.translatable(text, F.col("protected")))
    rows = usable.select("book_id", "block_id", *more, F.length(text).cast("long").alias("chars"), count(text).alias("tokens"))
    names = [*more, "chars", "tokens"]
    return rows.groupBy("book_id", "block_id").agg(F.max(F.struct(*names)).alias("r")).select("book_id", "block_id", *[f"r.{c}" for c in names])


def runs_of(runs: DataFrame, *columns: str) -> DataFrame:
    """The distinct runs, to be joined with blocks: a short table is broadcast, so that no book meets in one task; a long
    one is joined by exchange, of which adaptive execution splits hot books."""
    return small_side(runs.select("state_key", "book_id", *columns).distinct())


def global_ids(blocks: DataFrame) -> DataFrame:
    """Numbers a book's blocks from 0 in the order of their ids, without gaps."""
    return book_prefix(blocks.withColumn("_one", F.lit(1).cast("long")), "_one", "global_id").drop("_one")


def sample_text(blocks: DataFrame, chapters: int, budget: int) -> DataFrame:
    """(book_id, sample): the translatable text of the first chapters up to ``budget`` characters, joined by blank lines.

    Only rows within the budget are gathered, so a book's size does not matter."""
    rows = blocks.where((F.col("chapter_idx") < chapters) & T.translatable(F.col("text"), F.col("protected")))
    rows = book_prefix(rows.withColumn("_n", F.length("text").cast("long")), "_n", "_at").where(F.col("_at") < budget)
    take = F.expr(f"substring(text, 1, cast(least(_n, {budget} - _at) as int))")
    parts = F.sort_array(F.collect_list(F.struct("block_id", take.alias("t"))))
    return rows.groupBy("book_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("sample"))


def latest_state(state: DataFrame) -> DataFrame:
    """One row per (state_key, block_id): the latest saved, then the greatest."""
    best = F.max(F.struct("saved_at", "text", "batch_id", "path")).alias("r")
    return state.groupBy("state_key", "block_id").agg(best).select("state_key", "block_id", "r.path", "r.text", "r.batch_id", "r.saved_at")


def pending(runs: DataFrame, blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(state_key, book_id, block_id) of translatable blocks that a run has not saved yet."""
    todo = sized_blocks(blocks).select("book_id", "block_id")
    saved = state.select("state_key", "block_id").distinct()
    return todo.join(runs_of(runs), "book_id").join(saved, ["state_key", "block_id"], "left_anti")


def apply_translations(runs: DataFrame, blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Every block of every run with its text after translation: the saved one, else its own."""
    b = one_row_blocks(blocks).select("book_id", "block_id", F.col("text").alias("original"))
    rows = b.join(runs_of(runs), "book_id")
    saved = latest_state(state).select("state_key", "block_id", "text")
    out = rows.join(saved, ["state_key", "block_id"], "left")
    return out.select("state_key", "book_id", "block_id", F.coalesce("text", "original").alias("text"), F.col("text").isNotNull().alias("translated"))


def null_poisoned_sum(column: str) -> Column:
    """Sum that is null as soon as one value is; 0 for no rows."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.coalesce(F.sum(column), F.lit(0)))


def usage_totals(usage: DataFrame) -> DataFrame:
    one = usage.distinct()
    sums = one.groupBy("state_key").agg(
        null_poisoned_sum("prompt_tokens").alias("prompt_tokens"),
        null_poisoned_sum("completion_tokens").alias("completion_tokens"),
        F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"),
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"),
        F.count(F.lit(1)).alias("batches"),
    )
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def progress(usage: DataFrame) -> DataFrame:
    """(state_key, batch_id, done, total): running number of blocks, batch after batch."""
    one = usage.select("state_key", "batch_id", "blocks").distinct().groupBy("state_key", "batch_id").agg(F.sum("blocks").alias("blocks"))
    before = prefix_sum(one, "state_key", "batch_id", "blocks", "before")
    totals = one.groupBy("state_key").agg(F.sum("blocks").alias("total"))
    return before.join(totals, "state_key").select("state_key", "batch_id", (F.col("before") + F.col("blocks")).alias("done"), "total")


def eta(runs: DataFrame, blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(state_key, done, total, seconds_left): by the rate of the blocks saved so far, how long the rest of a run takes;
    null where nothing tells a rate."""
    sums = sized_blocks(blocks).groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    at = F.unix_micros(F.col("saved_at").cast("timestamp"))
    saved = state.groupBy("state_key").agg(F.count_distinct("block_id").alias("done"), (F.max(at) - F.min(at)).alias("us"))
    rows = runs.select("state_key", "book_id").distinct().join(sums, "book_id").join(saved, "state_key")
    return rows.select("state_key", "done", "total", seconds_left(F.col("done"), F.col("total"), F.col("us")).alias("seconds_left"))


def seconds_left(done: Column, total: Column, elapsed_us: Column) -> Column:
    """(total - done) / rate, the rate being done / elapsed."""
    return F.when((done > 0) & (elapsed_us > 0), F.floor(F.greatest(total - done, F.lit(0)) * elapsed_us / done / 1e6 + 0.5).cast("long"))


def pacing(requests: DataFrame, key: str, at: str, delay: float) -> DataFrame:
    """Adds ``wait``: seconds a request has to wait so that ``delay`` lies between it and the one before; the first of a
    key does not wait. Requests of a key that come at one time are ordered by their id."""
    line = Window.partitionBy(key).orderBy(at, "event_id")
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(line).cast("timestamp"))) / 1e6
    return requests.withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(delay) - gap), F.lit(0.0)))


def first_heading(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, title): the first heading with text of each chapter."""
    heads = one_row_blocks(blocks).where((F.col("kind") == "titulo") & ~is_blank(F.col("text")))
    return heads.groupBy("book_id", "chapter_idx").agg(F.min_by("text", "block_id").alias("title"))


def first_of(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given order, by an aggregate rather than a sort of all rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    pick = F.struct(*order, *rest)
    return rows.groupBy(*keys).agg((F.max if last else F.min)(pick).alias("r")).select(*keys, "r.*")


def zip_strict(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """(key, pos, the other columns, error): the rows of both sides side by side, by their place in ``order`` (unique in a
    key). Keys with another number of rows on either side give one row with the error instead."""
    def numbered(rows: DataFrame, n: str) -> DataFrame:
        line = Window.partitionBy(key)
        return rows.withColumn("pos", F.row_number().over(line.orderBy(order)).cast("long")).withColumn(n, F.count(F.lit(1)).over(line)).drop(order)

    a, b = numbered(left, "_a"), numbered(right, "_b")
    rest = [c for c in (*left.columns, *right.columns) if c not in (key, order)]
    counts = a.groupBy(key).agg(F.max("_a").alias("_a")).join(b.groupBy(key).agg(F.max("_b").alias("_b")), key, "full")
    wrong = counts.na.fill(0, ["_a", "_b"]).where("_a <> _b").select(
        key,
        F.concat(F.col("_a").cast("string"), F.lit(" against "), F.col("_b").cast("string")).alias("error"),
    )
    good = a.join(b, [key, "pos"]).where("_a = _b").select(key, "pos", *rest).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(wrong, allowMissingColumns=True)
