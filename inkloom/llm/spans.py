"""Problem 8: long exact spans shared between records.

A span of ``min_chars`` code points is found through its *anchor*: the least of the hashes of its ``gram``-long
windows. Anchors depend on content only, so two records that share a span share its anchor; the anchors of all spans
of a text are its winnowed fingerprints (about one in 50 positions). ``SpanIndex`` keeps them log-structured: each
batch becomes an immutable run of postings (hash, doc), bucketed and sorted by hash, older runs are merge-joined with
it, and runs of one level are merged into one of the next. What a batch meets is reduced to the least and the greatest
doc of each hash: that answers "does another record have it" in one row however many copies there are, so no pairs
arise.

Anchors found in two records lead to verification: all ``min_chars`` windows at those anchors are keyed by 128 bits
and grouped (again least and greatest record, no pairs), consecutive windows merge into passages, and the code points of
each passage are compared, by their SHA-256, with those of a record that holds it.

Defined results: null texts and those under ``min_chars`` have no spans; rows without id are left out; of rows with
one id the greatest text counts; a passage repeated within one record only is no case.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.llm.bpe import one_text
from inkloom.session import cut, scratch, stored

MIN_CHARS = 200
GRAM = 100

#: Code points hashed in one vectorised stretch; positions must fit 24 bits.
STRETCH = 1 << 22

#: Odd multipliers of the two polynomial hashes and of the mixing step (splitmix64).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every window of ``width`` codes, by prefix sums of a polynomial modulo 2**64."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        step = np.full(n, base, np.uint64)
        step[0] = 1
        powers = np.multiply.accumulate(step)
        inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        back = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(codes.astype(np.uint64) + np.uint64(base)) * powers)])
        return mix((sums[width:] - sums[:-width]) * back[: n - width + 1])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    out = a
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, and where each begins."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer(raw, np.uint32), starts


def anchors(codes: np.ndarray, starts: np.ndarray, min_chars: int, gram: int):
    """(record, anchor position, anchor hash) of each span start p, as arrays over all valid p, with p itself."""
    grams = window_hashes(codes, gram, BASES[0])
    n = len(codes)
    spans = np.arange(max(0, n - min_chars + 1))
    if not len(spans):
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    low = np.uint64((1 << 24) - 1)
    # the rightmost of equal minima: positions count down in the low bits
    keyed = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    least = sliding_min(keyed, min_chars - gram + 1)
    at = (low - (least & low)).astype(np.int64)
    record = np.searchsorted(starts, spans, side="right") - 1
    valid = spans + min_chars <= starts[record + 1]
    spans, at, record = spans[valid], at[valid], record[valid]
    return record, spans, at, grams[at]


def pieces(batches: Iterator[pa.RecordBatch], *more: int) -> Iterator[tuple[list, ...]]:
    """Rows of stretches of texts; a text longer than a stretch comes alone."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if size + len(row[1]) > STRETCH and rows:
                yield tuple(map(list, zip(*rows)))
                rows, size = [], 0
            rows.append(row)
            size += len(row[1])
    if rows:
        yield tuple(map(list, zip(*rows)))


def cut_long(text: str, min_chars: int) -> list[tuple[int, str]]:
    """(offset, part) of parts that overlap such that no span is lost; one part for all but enormous texts."""
    if len(text) <= STRETCH:
        return [(0, text)]
    step = STRETCH - min_chars + 1
    return [(at, text[at : at + STRETCH]) for at in range(0, len(text) - min_chars + 1, step)]


def fingerprints(docs: DataFrame, min_chars: int = MIN_CHARS, gram: int = GRAM) -> DataFrame:
    """(h, doc_id): the anchors of every record, each once a record."""

    def run(batches):
        for ids, texts in pieces(batches):
            parts = [(i, p) for i, t in zip(ids, texts) for _, p in cut_long(t, min_chars)]
            for group in ([parts] if sum(len(p) for _, p in parts) <= STRETCH else [[x] for x in parts]):
                codes, starts = layout([p for _, p in group])
                record, _, _, h = anchors(codes, starts, min_chars, gram)
                owner = np.fromiter((i for i, _ in group), np.int64, len(group))[record]
                change = np.ones(len(h), bool)
                change[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[change].view(np.int64)), pa.array(owner[change])], ["h", "doc_id"])

    return docs.where(F.length("text") >= min_chars).select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


class SpanIndex:
    """Immutable sorted runs of fingerprints below ``path`` (a folder all executors share).

    A run is a table of (h, doc_id) in a fixed number of buckets by h, one sorted file each: a run is merge-joined with a
    new batch and merged with another run bucket by bucket, without an exchange of what is in the index. What runs there
    are stands in a manifest, a new version of it after each batch, so that an index can be opened again on its folder
    (with its own number of buckets); a version that was not finished is not seen. Merged runs are deleted once nothing
    reads them any more."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, min_chars: int = MIN_CHARS, gram: int = GRAM):
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "spans"), fanout
        self.name = f"inkloom_{uuid.uuid4().hex[:12]}"
        self.min_chars, self.gram = min_chars, gram
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made, self.version = 0, 0
        self.tables: dict[str, str] = {}
        self._open()

    def _folder(self, where: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _open(self) -> None:
        files, place = self._folder(f"{self.path}/manifest")
        if not files.exists(place):
            return
        done = [
            f.getPath().getName() for f in files.listStatus(place) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
        ]
        if not done:
            return
        got = json.loads(self.spark.read.text(f"{self.path}/manifest/{max(done)}").head().value)
        if (got["min_chars"], got["gram"]) != (self.min_chars, self.gram):
            raise ValueError(f"the index below {self.path} was made for spans of {got['min_chars']} by grams of {got['gram']}")
        self.levels, self.made, self.version, self.buckets = got["levels"], got["made"], int(max(done)) + 1, got["buckets"]

    def _note(self) -> None:
        """Writes the next version of the manifest."""
        state = {"levels": self.levels, "made": self.made, "buckets": self.buckets, "min_chars": self.min_chars, "gram": self.gram}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.version:08d}")
        self.version += 1

    def table(self, run: str) -> DataFrame:
        """A run as a table that the planner knows to be bucketed and sorted."""
        if run not in self.tables:
            self.tables[run] = f"{self.name}_{run.replace('-', '_')}"
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.tables[run]} (h BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'",
            )
        return self.spark.table(self.tables[run])

    def _write(self, postings: DataFrame, level: int) -> str:
        run = f"run-{self.made:05d}-level-{level}-{uuid.uuid4().hex[:8]}"
        self.made += 1
        self.tables[run] = f"{self.name}_{run.replace('-', '_')}"
        postings.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{run}").saveAsTable(self.tables[run])
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds records (doc_id, text); gives (h, doc_id) of all postings, old and new, whose anchor gained a second record."""
        fresh = fingerprints(batch, self.min_chars, self.gram).repartition(self.buckets, "h").dropDuplicates(["h", "doc_id"])
        old = self.runs()
        run = self._write(fresh, 0)
        found = cut(self.shared(run, old))
        merged = self.compact()
        self._note()
        for r in merged:
            self._delete(r)
        return found

    def shared(self, run: str, old: list[str]) -> DataFrame:
        new = self.table(run)
        got = new
        for r in old:
            # merge join of an old run with the batch, bucket by bucket; each run is read once
            got = got.unionByName(self.table(r).join(new.select("h").distinct().hint("merge"), "h", "left_semi"))
        if old:
            got = stored(got, "met")
        keys = got.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
        return got.join(keys.hint("merge"), "h", "left_semi")

    def compact(self) -> list[str]:
        """Merges the runs of each full level into one run of the next, bucket by bucket; gives the runs that were merged."""
        gone: list[str] = []
        by_part = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(by_part)
        for level in range(64):
            if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
                break
            runs = self.levels[level]
            self.spark.conf.set(by_part, "false")
            try:
                merged = self.table(runs[0])
                for r in runs[1:]:
                    merged = merged.join(self.table(r).hint("merge"), ["h", "doc_id"], "full_outer")
                self.levels[level] = []
                self._write(merged, level + 1)
            finally:
                self.spark.conf.set(by_part, before)
            gone += runs
        return gone

    def _delete(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
        files, place = self._folder(f"{self.path}/{run}")
        files.delete(place, True)


def candidate_windows(docs: DataFrame, shared: DataFrame, min_chars: int, gram: int) -> DataFrame:
    """(h, k, doc_id, pos) of every span at a shared anchor; (h, k) is its 128-bit key."""
    per_doc = shared.groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    rows = docs.where(F.length("text") >= min_chars).join(per_doc, "doc_id").select("doc_id", "text", "hs")

    def run(batches):
        for ids, texts, hs in pieces(batches):
            parts = [(i, at, p, h) for i, t, h in zip(ids, texts, hs) for at, p in cut_long(t, min_chars)]
            for group in ([parts] if sum(len(x[2]) for x in parts) <= STRETCH else [[x] for x in parts]):
                codes, starts = layout([x[2] for x in group])
                record, spans, _, h = anchors(codes, starts, min_chars, gram)
                wanted = np.unique(np.concatenate([np.asarray(x[3], np.int64) for x in group]))
                spot = np.searchsorted(wanted, h.view(np.int64))
                keep = wanted[np.minimum(spot, len(wanted) - 1)] == h.view(np.int64)
                record, spans, h = record[keep], spans[keep], h[keep]
                k = window_hashes(codes, min_chars, BASES[1])[spans]
                owner = np.fromiter((x[0] for x in group), np.int64, len(group))[record]
                offset = np.fromiter((x[1] for x in group), np.int64, len(group))[record]
                for lo in range(0, len(h), 200_000):
                    s = slice(lo, lo + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[s].view(np.int64)),
                            pa.array(k[s].view(np.int64)),
                            pa.array(owner[s]),
                            pa.array((spans - starts[record] + offset)[s]),
                        ],
                        ["h", "k", "doc_id", "pos"],
                    )

    return rows.mapInArrow(run, "h long, k long, doc_id long, pos long")


def passages(docs: DataFrame, shared: DataFrame, min_chars: int = MIN_CHARS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, n_chars, other_id, other_start): verified passages that stand in another record too.

    Windows are grouped by key to their first posting in the least and in the greatest record; a record's partner is
    the least one, or the greatest where it is the least itself. Windows of one partner at one distance that follow
    each other make a passage, whose text is then compared with the partner's."""
    windows = candidate_windows(docs, shared, min_chars, gram)
    place = F.struct("doc_id", "pos")
    ends = windows.groupBy("h", "k").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.doc_id < hi.doc_id")
    partner = F.when(F.col("doc_id") == F.col("lo.doc_id"), F.col("hi")).otherwise(F.col("lo"))
    hits = windows.join(ends, ["h", "k"]).select("doc_id", "pos", partner.alias("p")).select(
        "doc_id",
        "pos",
        F.col("p.doc_id").alias("other_id"),
        (F.col("p.pos") - F.col("pos")).alias("shift"),
    )
    line = Window.partitionBy("doc_id", "other_id", "shift").orderBy("pos")
    runs = (
        hits.withColumn("n", F.row_number().over(line))
        .groupBy("doc_id", "other_id", "shift", (F.col("pos") - F.col("n")).alias("g"))
        .agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + min_chars).alias("n_chars"))
        .select("doc_id", "start", "n_chars", "other_id", (F.col("start") + F.col("shift")).alias("other_start"))
    )
    # texts are compared by a cryptographic digest of their code points; a place many records share is cut out once
    cut_out = lambda at: F.sha2(F.expr(f"substring(text, cast({at} + 1 as int), cast(n_chars as int))"), 256)
    own = runs.join(docs, "doc_id").withColumn("own", cut_out("start")).drop("text")
    places = own.select(F.col("other_id").alias("doc_id"), "other_start", "n_chars").distinct()
    theirs = places.join(docs, "doc_id").select(F.col("doc_id").alias("other_id"), "other_start", "n_chars", cut_out("other_start").alias("own"))
    return own.join(theirs, ["other_id", "other_start", "n_chars", "own"]).select("doc_id", "start", "n_chars", "other_id", "other_start")


def by_id(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of every record as a table in buckets by doc_id: joins by it need no further exchange of texts."""
    spark = documents.sparkSession
    name, n = f"inkloom_docs_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    one = rows.repartition(n, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    one.write.bucketBy(n, "doc_id").sortBy("doc_id").option("path", scratch(spark, "docs")).saveAsTable(name)
    return spark.table(name)


def shared_spans(
    documents: DataFrame,
    batches: int = 3,
    min_chars: int = MIN_CHARS,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Passages over a whole table, taken up in ``batches`` as a growing corpus would be."""
    spark = documents.sparkSession
    docs = by_id(documents, id_col, text_col)
    index = SpanIndex(spark, min_chars=min_chars, gram=gram)
    found = None
    for n in range(batches):
        got = index.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == n))
        found = got if found is None else found.unionByName(got)
    return passages(docs, found.dropDuplicates(["h", "doc_id"]), min_chars, gram)


def coverage(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every record; passages that overlap count once."""
    order = Window.partitionBy("doc_id").orderBy("start", "n_chars")
    before = F.max(F.col("start") + F.col("n_chars")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("n_chars")
    gain = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = spans.withColumn("gain", gain).groupBy("doc_id").agg(F.sum("gain").alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    all_docs = one_text(documents, id_col, text_col).select("doc_id", n.alias("n_chars"))
    got = F.coalesce("shared_chars", F.lit(0)).cast("long")
    return all_docs.join(covered, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        got.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, got / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"),
    )
