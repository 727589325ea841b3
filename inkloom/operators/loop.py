"""Whole translation runs: what is pending is packed, translated wave by wave, saved after each, and resumed later.

The state is a folder of append-only tables, one a wave ("epoch"), each written under its number with the commit of the
file format: an epoch that was not finished is not seen, one that is repeated overwrites itself. What a run has saved
counts only under the same key, the hash of all that its texts depend on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import json as J
from inkloom.functions import text as T
from inkloom.operators import greedy, run, sequence
from inkloom.session import cut, scratch

STATE = "state_key string, batch long, block_id long, text string, epoch long, reset boolean"
EVENTS = "state_key string, epoch long, kind string, done long, total long, message string"


class StateStore:
    """Saved texts and events of runs below ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "state")

    def _finished(self, kind: str) -> list[str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        place = jvm.Path(f"{self.path}/{kind}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        return sorted(f.getPath().toString() for f in files.listStatus(place) if files.exists(jvm.Path(f.getPath(), "_SUCCESS")))

    def next_epoch(self) -> int:
        done = self._finished("texts")
        return int(done[-1].rpartition("-")[2]) + 1 if done else 0

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = self._finished(kind)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def save(self, rows: DataFrame, epoch: int) -> None:
        """(state_key, batch, block_id, text) of one wave."""
        out = rows.select("state_key", "batch", "block_id", "text", F.lit(epoch).cast("long").alias("epoch"), F.lit(False).alias("reset"))
        out.write.mode("overwrite").parquet(f"{self.path}/texts/epoch-{epoch:09d}")

    def reset(self, keys: DataFrame) -> None:
        """Forgets all that was saved for the keys (state_key) so far; the tables stay as they are."""
        epoch = self.next_epoch()
        null = lambda t: F.lit(None).cast(t)
        out = keys.select(
            "state_key",
            null("long").alias("batch"),
            null("long").alias("block_id"),
            null("string").alias("text"),
            F.lit(epoch).cast("long").alias("epoch"),
            F.lit(True).alias("reset"),
        ).distinct()
        out.write.mode("overwrite").parquet(f"{self.path}/texts/epoch-{epoch:09d}")

    def texts(self) -> DataFrame:
        """(state_key, block_id, text, epoch): what is saved, the last epoch winning."""
        rows = self._read("texts", STATE)
        since = rows.where("reset").groupBy("state_key").agg(F.max("epoch").alias("since"))
        kept = rows.where("not reset").join(since, "state_key", "left").where("since is null or epoch > since")
        best = F.max(F.struct("epoch", "text")).alias("r")
        return kept.groupBy("state_key", "block_id").agg(best).select("state_key", "block_id", "r.text", "r.epoch")

    def note(self, events: DataFrame, label: str) -> None:
        events.write.mode("overwrite").parquet(f"{self.path}/events/{label}")

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)


@dataclass(frozen=True)
class Outcome:
    """How a run of the loop ended: batches sent and failed, waves done, whether it was stopped before its end."""

    waves: int
    sent: int
    failed: int
    stopped: bool


def pending_texts(runs: DataFrame, blocks: DataFrame, store: StateStore) -> DataFrame:
    """(state_key, block_id, text) of the translatable blocks of ``runs`` (state_key, book_id) that are not saved."""
    todo = sequence.one_row_blocks(blocks).where(T.translatable(F.col("text"), F.col("protected"))).select("book_id", "block_id", "text")
    every = todo.join(sequence.runs_of(runs), "book_id").select("state_key", "block_id", "text")
    return every.join(store.texts().select("state_key", "block_id"), ["state_key", "block_id"], "left_anti")


def translate_runs(
    runs: DataFrame,
    blocks: DataFrame,
    translator,
    store: StateStore,
    context: run.Context = run.Context(),
    batch_tokens: int = 4000,
    per_wave: int = 1000,
    cancelled: Callable[[], bool] = lambda: False,
    secrets: tuple[str, ...] = (),
    count: Callable[[Column], Column] = T.word_count,
    **how,
) -> Outcome:
    """Translates what is pending, ``per_wave`` batches of each run at a time; texts are saved and events noted after each
    wave. Between waves it stops where a batch has failed (the first error ends the run, what others did is saved) or
    ``cancelled`` says so. With nothing pending, no translator is called."""
    spark = blocks.sparkSession
    todo = cut(pending_texts(runs, blocks, store))
    totals = cut(todo.groupBy("state_key").agg(F.count(F.lit(1)).alias("total")))
    if totals.isEmpty():
        return Outcome(0, 0, 0, False)
    sizes = todo.select("state_key", "block_id", count(F.col("text")).alias("tokens"))
    none = F.lit(None).cast("long")
    packed = greedy.greedy_batches(sizes, F.col("state_key"), F.col("block_id"), F.col("tokens"), F.lit(batch_tokens), none)
    batches = cut(packed.select(F.col("grp").alias("state_key"), F.col("pos").alias("block_id"), "batch"))
    waves = (batches.agg(F.max("batch")).head()[0] or 0) // per_wave + 1
    first = store.next_epoch()
    _note(
        store,
        totals.withColumns({"kind": F.lit("started"), "done": F.lit(0).cast("long"), "message": F.lit(None).cast("string")}),
        first,
        "started",
    )
    sent = failed = done = 0
    stopped = False
    for wave in range(waves):
        part = batches.where(F.floor(F.col("batch") / per_wave) == wave)
        got = cut(run.translate_batches(part.join(todo, ["state_key", "block_id"]), translator, context, **how))
        epoch = first + wave
        store.save(got.where("error_class is null"), epoch)
        ends = got.groupBy("state_key", "batch").agg(F.max("error_class").alias("error_class"))
        seen = ends.agg(F.count(F.lit(1)).alias("sent"), F.count("error_class").alias("failed")).head()
        sent, failed, done = sent + seen.sent, failed + seen.failed, wave + 1
        saved = store.texts().where(F.col("epoch") >= first).groupBy("state_key").agg(F.count(F.lit(1)).alias("done"))
        _note(
            store,
            totals.join(saved, "state_key", "left").na.fill(0, ["done"]).withColumns({"kind": F.lit("progress"), "message": F.lit(None).cast("string")}),
            epoch,
            f"progress-{epoch:09d}",
        )
        if seen.failed:
            message = T.redact(
                F.concat(F.lit("batch "), F.col("batch").cast("string"), F.lit(": "), "error_class"),
                F.array(*map(F.lit, secrets)).cast("array<string>"),
            )
            log = ends.where("error_class is not null").select(
                "state_key",
                F.lit("log").alias("kind"),
                F.lit(None).cast("long").alias("done"),
                F.lit(None).cast("long").alias("total"),
                message.alias("message"),
            )
            _note(store, log, epoch, f"log-{epoch:09d}")
        if wave + 1 < waves and (seen.failed or cancelled()):
            stopped = True
            break
    if not failed and not stopped:
        _note(
            store,
            totals.withColumns({"kind": F.lit("completed"), "done": F.col("total"), "message": F.lit(None).cast("string")}),
            first + done - 1,
            f"completed-{first:09d}",
        )
    return Outcome(done, sent, failed, stopped)


def _note(store: StateStore, events: DataFrame, epoch: int, label: str) -> None:
    name = label if label[-1].isdigit() else f"{label}-{epoch:09d}"
    store.note(events.select("state_key", F.lit(epoch).cast("long").alias("epoch"), "kind", "done", "total", "message"), name)


# --- passes before a run


def sampled(samples: DataFrame, translator, task: str, context: run.Context = run.Context()) -> DataFrame:
    """(book_id, answer): what the translator makes of a book's sample for a task; null where it fails, which no run has
    to fail for, and for translators that do not support the task (``tasks``): those are passed by."""
    if task not in getattr(translator, "tasks", ("translate", "glossary", "priming")):
        return samples.select("book_id", F.lit(None).cast("string").alias("answer"))
    asked = run.Context(context.source, context.target, context.glossary, context.priming, task, context.policy)
    rows = samples.select(
        F.col("book_id").alias("state_key"),
        F.lit(0).cast("long").alias("batch"),
        F.lit(0).cast("long").alias("block_id"),
        F.col("sample").alias("text"),
    )
    got = run.translate_batches(rows, _Free(translator), asked, attempts=1)
    return got.select(F.col("state_key").alias("book_id"), F.col("text").alias("answer"))


@dataclass(frozen=True)
class _Free:
    """A translator whose answers need not keep the markup of what was sent."""

    inner: object

    def translate(self, texts: list[str], context: run.Context) -> list[str]:
        return [run.Loose(t) for t in self.inner.translate(texts, context)]


def glossary_pass(samples: DataFrame, translator, known: DataFrame | None = None, context: run.Context = run.Context()) -> DataFrame:
    """(book_id, term, translation) from the answers' lines; a book with entries in ``known`` keeps those and is not asked."""
    ask = samples if known is None else samples.join(known.select("book_id").distinct(), "book_id", "left_anti")
    answers = sampled(ask, translator, "glossary", context)
    got = answers.where("answer is not null").select("book_id", F.explode(T.glossary_lines(F.col("answer"))).alias("p")).select("book_id", "p.term", "p.translation")
    return got if known is None else got.unionByName(known.select("book_id", "term", "translation"))


def priming_pass(samples: DataFrame, translator, context: run.Context = run.Context()) -> DataFrame:
    """(book_id, priming): the lines of the answer that are not blank, trimmed."""
    answers = sampled(samples, translator, "priming", context)
    lines = F.filter(F.transform(F.split("answer", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    return answers.select("book_id", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("priming"))


def glossary_files(pairs: DataFrame, key: str = "book_id") -> DataFrame:
    """(path, content): one JSON file a key, as the strict reader takes it; write them with ``epub.save_archives``."""
    entry = F.struct("pos", F.struct(F.col("term").alias("termo"), F.col("translation").alias("traducao")).alias("e"))
    rows = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"])
    body = pairs.groupBy(key).agg(F.to_json(rows).alias("body"))
    return body.select(F.concat(F.col(key), F.lit(".json")).alias("path"), F.encode("body", "UTF-8").alias("content"))


def labels_or_own(own: DataFrame, translated: DataFrame) -> DataFrame:
    """(book_id, labels): a book's translated labels where there are as many as its own, else its own."""
    both = own.join(translated.withColumnRenamed("labels", "_new"), "book_id", "left")
    return both.select("book_id", F.when(F.size("_new") == F.size("labels"), F.col("_new")).otherwise(F.col("labels")).alias("labels"))


def strict_glossaries(files: DataFrame) -> DataFrame:
    """(path, terms) of JSON files (path, content); anything malformed is an error that names the path."""
    body: Column = F.decode("content", "UTF-8")
    return files.select("path", J.strict_glossary(F.col("path"), body).alias("terms"))
