"""Problem 7: mixing sources to target weights.

Sizes are tokens of each plan's public tokenizer. A source's quota is target_share x size_ratio x all tokens, at most
max_repeats times the source. Its records fall into hash blocks of a fixed number of tokens; the exact number of blocks
a source gives (all of them for each whole pass, and a rest drawn from their permutation) is split between the two
halves of the output shards by a multivariate-hypergeometric draw over the sources, and so on down to single shards,
which take disjoint blocks of the permutation and shuffle their records locally. A record is used as often as its block
was drawn. Only the block on the quota's boundary is looked into: by sub-blocks first, then one sub-block record by
record, and one more record that closes the gap best. So no sort or window ever holds a source.

Blocks and shards follow from the number of tokens; the tables of blocks on the driver are bounded by MAX_DRIVER_ROWS.

Defined results: every document id comes out for every plan, with 0 uses where it has no source, its source is not
named, or it was not drawn; null and empty texts have no tokens: they are used as often as their block is drawn. Of
repeated rows of one id the greatest counts. A source that cannot reach its quota within its cap is used as often as
the cap allows; the shares reached are reported. Targets without source or plan are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.bpe import TOKENIZER_DIR
from inkloom.llm.counting import counts_of, form_of
from inkloom.session import checked_broadcast, cut, spread

#: Tokens of a block, and of a shard of the mixture; sub-blocks of the block on a boundary.
BLOCK_TOKENS = 50_000
SHARD_TOKENS = 2_000_000
SUB_BLOCKS = 1024
SEED = 20

#: Of all tables that reach the driver, the most rows: blocks are made larger to stay below it; where plans x sources
#: alone are more, that is an error, never a cut.
MAX_DRIVER_ROWS = 1_000_000


def tokenizer_file(name: str, folder: str = TOKENIZER_DIR) -> Path:
    found = [p for p in (Path(folder, name), Path(folder, f"{name}.json"), Path(folder, f"{name}.model")) if p.is_file()]
    if not found:
        raise ValueError(f"no tokenizer {name} in {folder}")
    return found[0]


def token_sizes(documents: DataFrame, tokenizers: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokenizer, tokens), a row per document and tokenizer."""
    spark = documents.sparkSession
    files = {n: tokenizer_file(n, folder) for n in tokenizers}
    blobs = {n: (f.name, f.read_bytes()) for n, f in files.items()}
    forms = {n: form_of(*x) for n, x in blobs.items()}
    shared = checked_broadcast(spark, blobs, sum(len(b) for _, b in blobs.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counts_of(shared.value, forms)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts = count(texts)
                for n in tokenizers:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("source"), pa.array([n] * len(texts)), pa.array(counts[n], pa.int64())],
                        ["doc_id", "source", "tokenizer", "tokens"],
                    )

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    docs = spread(rows, "doc_id").groupBy("doc_id").agg(F.max(F.struct("source", "text")).alias("r")).select("doc_id", "r.source", "r.text")
    return docs.mapInArrow(run, "doc_id long, source string, tokenizer string, tokens long")


def rows_of(df: DataFrame) -> list:
    got = df.limit(MAX_DRIVER_ROWS + 1).collect()
    if len(got) > MAX_DRIVER_ROWS:
        raise ValueError("the plans name too many sources for the driver's block table; use fewer blocks")
    return got


def arrays_of(df: DataFrame) -> pa.Table:
    """Like rows_of, as columns: what a plan has a row a block of never stands on the driver as objects."""
    got = df.limit(MAX_DRIVER_ROWS + 1).toArrow()
    if got.num_rows > MAX_DRIVER_ROWS:
        raise ValueError("the plans name too many sources for the driver's block table; use fewer blocks")
    return got


def block_tables(sums: pa.Table) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """By tokenizer and source: the numbers of its blocks, ascending, and their tokens."""
    if not sums.num_rows:
        return {}
    names, codes = zip(*[(c.dictionary.to_pylist(), c.indices.to_numpy()) for k in ("tokenizer", "source") for c in [sums.column(k).combine_chunks().dictionary_encode()]])
    block, tokens = (sums.column(k).to_numpy() for k in ("block", "tokens"))
    line = np.lexsort((block, codes[1], codes[0]))
    first, second = codes[0][line], codes[1][line]
    starts = np.flatnonzero(np.r_[True, (np.diff(first) != 0) | (np.diff(second) != 0)])
    return {(names[0][first[a]], names[1][second[a]]): (block[part], tokens[part]) for a, part in zip(starts, np.split(line, starts[1:]))}


def frame_of(spark, parts: list[tuple], schema: str) -> DataFrame:
    """A DataFrame from parts (plan, source, arrays of the other columns); a block below 0 is null."""
    names = [c.split()[0] for c in schema.split(", ")]
    tables = []
    for plan, source, *columns in parts:
        n = len(columns[0])
        given = [pa.array([plan] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(columns[0], pa.int32(), mask=columns[0] < 0)]
        tables.append(pa.table([*given, *(pa.array(c, pa.int32()) for c in columns[1:])], names=names))
    rows = pa.concat_tables(tables).combine_chunks() if tables else None  # as separate chunks, rows were lost
    return spark.createDataFrame(rows) if rows is not None and rows.num_rows else spark.createDataFrame([], schema)


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact block quotas a source, split among shards: an array (shards, sources) whose columns add up to quotas."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    take = total * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if total else quotas
    return np.concatenate([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


class Mixture:
    """Quotas, uses and sequence of every plan over one documents table."""

    def __init__(
        self,
        documents: DataFrame,
        plans: DataFrame,
        targets: DataFrame,
        block_tokens: int = BLOCK_TOKENS,
        shard_tokens: int = SHARD_TOKENS,
        seed: int = SEED,
        folder: str = TOKENIZER_DIR,
    ):
        self.spark, self.block_tokens, self.shard_tokens, self.seed = documents.sparkSession, block_tokens, shard_tokens, seed
        plan_rows = rows_of(plans.where("plan_id is not null").groupBy("plan_id").agg(F.max(F.struct("size_ratio", "tokenizer")).alias("p")))
        self.plans = {r.plan_id: (r.p.size_ratio or 0.0, r.p.tokenizer) for r in plan_rows}
        target_rows = rows_of(
            targets.where("plan_id is not null and source is not null").groupBy("plan_id", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")),
        )
        self.targets = {
            (r.plan_id, r.source): (r.t.target_share or 0.0, max(0, r.t.max_repeats or 0)) for r in target_rows if r.plan_id in self.plans
        }
        names = sorted({t for _, t in self.plans.values() if t})
        self.sizes = cut(token_sizes(documents, names, folder))
        self._plan()

    def _plan(self) -> None:
        """Whole passes, then the blocks drawn beyond them, and the block on the boundary of every plan and source."""
        per = rows_of(self.sizes.groupBy("tokenizer", "source").agg(F.sum("tokens").alias("tokens")))
        total: dict[str, int] = {}
        for r in per:
            total[r.tokenizer] = total.get(r.tokenizer, 0) + r.tokens
        self.total, size = total, {(r.tokenizer, r.source): r.tokens for r in per}
        self.quota = {}
        for (plan, source), (share, repeats) in sorted(self.targets.items()):
            ratio, name = self.plans[plan]
            want, have = share * ratio * total.get(name, 0), size.get((name, source), 0)
            self.quota[plan, source] = (want, have, min(repeats, int(want // have)) if have else 0)
        drawn_times = sum(passes + 1 for _, _, passes in self.quota.values())
        self.blocks = max(1, min(max(total.values(), default=0) // self.block_tokens, MAX_DRIVER_ROWS // max(1, drawn_times, len(per))))
        block = F.pmod(F.xxhash64(F.lit(self.seed), "source", "doc_id"), F.lit(self.blocks)).cast("int")
        self.blocked = self.sizes.withColumn("block", block)
        table = block_tables(arrays_of(self.blocked.where("source is not null").groupBy("tokenizer", "source", "block").agg(F.sum("tokens").alias("tokens"))))
        nothing = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.draws: list[tuple[str, str, np.ndarray, np.ndarray]] = []  # plan, source, blocks, copies
        edges = []
        for (plan, source), (want, have, passes) in self.quota.items():
            name = self.plans[plan][1]
            named, tokens = table.get((name, source), nothing)
            rest = want - passes * have if have and passes < self.targets[plan, source][1] else 0.0
            line = np.random.default_rng([self.seed, len(named)]).permutation(len(named))
            order = named[line]
            drawn = np.zeros(len(order), bool)
            got, partial = 0, None
            for i, n in enumerate(tokens[line].tolist() if rest > 0 else []):
                if got + n > rest:
                    partial = int(order[i]) if partial is None else partial
                    continue
                got += n
                drawn[i] = True
            copies = np.r_[np.repeat(np.arange(passes), len(order)), np.full(drawn.sum(), passes)]
            self.draws.append((plan, source, np.r_[np.tile(order, passes), order[drawn]], copies))
            edges.append((plan, source, name, passes, partial, rest - got))
        self._edge(edges)
        self._tree()
        self._uses()

    def _edge(self, edges: list[tuple]) -> None:
        """(plan_id, source, doc_id, copy) of the records drawn one by one, from the blocks on a boundary."""
        spark = self.spark
        edge = spark.createDataFrame(edges, "plan_id string, source string, tokenizer string, copy int, partial int, gap double")
        whole = [(p, s, b[copy == self.quota[p, s][2]]) for p, s, b, copy in self.draws]
        more = frame_of(spark, whole, "plan_id string, source string, block int").withColumn("more", F.lit(1))
        sub = F.pmod(F.xxhash64(F.lit(self.seed + 1), "doc_id"), F.lit(SUB_BLOCKS)).cast("int")
        inside = self.blocked.join(edge.where("partial is not null"), ["tokenizer", "source"]).where("block = partial").withColumn("sub", sub)
        sums: dict[tuple[str, str], dict[int, int]] = {}
        for r in rows_of(inside.groupBy("plan_id", "source", "sub").agg(F.sum("tokens").alias("tokens"))):
            sums.setdefault((r.plan_id, r.source), {})[r.sub] = r.tokens
        taken, left = [], []
        for plan, source, _, _, partial, gap in edges:
            last = None
            for k in sorted(sums.get((plan, source), {})) if partial is not None else []:
                n = sums[plan, source][k]
                if n <= gap:
                    gap -= n
                    taken.append((plan, source, k))
                elif last is None:
                    last = k
            left.append((plan, source, last, gap))
        subs = spark.createDataFrame(taken, "plan_id string, source string, sub int").withColumn("all", F.lit(1))
        rest = spark.createDataFrame(left, "plan_id string, source string, last int, rest double")
        line = Window.partitionBy("plan_id", "source").orderBy(F.xxhash64(F.lit(self.seed + 2), "doc_id"), "doc_id")
        within = inside.join(subs, ["plan_id", "source", "sub"], "left").join(rest, ["plan_id", "source"])
        columns = ["plan_id", "source", "doc_id", "copy", "tokens"]
        by_sub = within.where("all = 1 and tokens > 0").select(*columns, F.lit(False).alias("single"))
        # one sub-block, record by record in hash order
        by_record = within.where("all is null and sub = last").withColumn("run", F.sum("tokens").over(line)).where("run <= rest and tokens > 0").select(*columns, F.lit(True).alias("single"))
        drawn = cut(by_sub.unionByName(by_record))
        filled = drawn.where("single").groupBy("plan_id", "source").agg(F.sum("tokens").alias("filled"))
        still = rest.join(filled, ["plan_id", "source"], "left").select(
            "plan_id",
            "source",
            (F.col("rest") - F.coalesce("filled", F.lit(0))).alias("left"),
        ).where("left > 0")
        free = self.blocked.join(edge.where("partial is not null"), ["tokenizer", "source"]).where("tokens > 0").join(more, ["plan_id", "source", "block"], "left").where("more is null")
        free = free.join(drawn.select("plan_id", "source", "doc_id"), ["plan_id", "source", "doc_id"], "left_anti").join(still, ["plan_id", "source"])
        miss = F.abs(F.col("left") - F.col("tokens"))
        closer = free.where(miss < F.col("left")).groupBy("plan_id", "source").agg(F.min(F.struct(miss.alias("miss"), "doc_id", "copy")).alias("b")).select("plan_id", "source", "b.doc_id", "b.copy")
        self.edge = cut(drawn.select("plan_id", "source", "doc_id", "copy").unionByName(closer))

    def _tree(self) -> None:
        """draw: plan_id, source, block, copy, shard. The records of a boundary are one more block (null) of their source."""
        rng = np.random.default_rng(self.seed)
        partial = {(r.plan_id, r.source) for r in rows_of(self.edge.select("plan_id", "source").distinct())}
        rows = []
        for plan, (ratio, name) in sorted(self.plans.items()):
            per = {s: (b, copy) for p, s, b, copy in self.draws if p == plan}
            for p, s in partial:
                if p == plan:
                    b, copy = per[s]
                    per[s] = np.r_[b, -1], np.r_[copy, self.quota[p, s][2]]
            names = sorted(s for s, (b, _) in per.items() if len(b))
            quotas = np.array([len(per[s][0]) for s in names], dtype=np.int64)
            shards = max(1, min(math.ceil(ratio * self.total.get(name, 0) / self.shard_tokens), int(quotas.sum())))
            shares = split_tree(quotas, shards, rng) if names else np.zeros((shards, 0), int)
            for k, s in enumerate(names):
                shard_of = np.repeat(np.arange(shards), shares[:, k])
                rows.append((plan, s, *per[s], shard_of[rng.permutation(len(shard_of))]))
        del self.draws
        self.draw = frame_of(self.spark, rows, "plan_id string, source string, block int, copy int, shard int")

    def _uses(self) -> None:
        """uses: plan_id, doc_id, source, tokens, block, times: how often the tree drew a record's block, or itself."""
        plan = self.spark.createDataFrame([(p, n) for p, (_, n) in self.plans.items()], "plan_id string, tokenizer string")
        drawn = self.draw.where("block is not null").groupBy("plan_id", "source", "block").agg(F.count(F.lit(1)).alias("drawn"))
        alone = self.draw.where("block is null").join(self.edge, ["plan_id", "source", "copy"]).groupBy("plan_id", "source", "doc_id").agg(F.count(F.lit(1)).alias("alone"))
        rows = self.blocked.join(plan, "tokenizer").join(drawn, ["plan_id", "source", "block"], "left").join(alone, ["plan_id", "source", "doc_id"], "left")
        times = F.coalesce("drawn", F.lit(0)) + F.coalesce("alone", F.lit(0))
        self.uses = rows.select("plan_id", "doc_id", "source", "tokens", "block", times.cast("int").alias("times"))

    def counts(self) -> DataFrame:
        """(plan_id, doc_id, source, tokens, times)."""
        return self.uses.select("plan_id", "doc_id", "source", "tokens", "times")

    def shares(self) -> DataFrame:
        """Per plan and named source: target and reached tokens and shares."""
        rows = [(p, s, t, r, float(q[0]), int(q[1])) for (p, s), (t, r) in self.targets.items() for q in [self.quota[p, s]]]
        goal = self.spark.createDataFrame(
            rows,
            "plan_id string, source string, target_share double, max_repeats int, target_tokens double, source_tokens long",
        )
        used = F.col("tokens") * F.col("times")
        got = self.uses.where("times > 0").groupBy("plan_id", "source").agg(
            F.sum(used).alias("tokens"),
            F.sum("times").cast("long").alias("records"),
            F.max("times").alias("most_repeats"),
        )
        all_of = Window.partitionBy("plan_id")
        both = goal.join(got, ["plan_id", "source"], "left").na.fill({"tokens": 0, "records": 0, "most_repeats": 0})
        return both.withColumn("reached_share", F.try_divide("tokens", F.sum("tokens").over(all_of))).withColumn(
            "reached_of_target",
            F.when(F.col("target_tokens") > 0, F.col("tokens") / F.col("target_tokens")),
        )

    def sequence(self) -> DataFrame:
        """(plan_id, shard, position_key, doc_id, source, tokens, copy): the mixture; sort a shard by position_key."""
        plan = self.spark.createDataFrame([(p, n) for p, (_, n) in self.plans.items()], "plan_id string, tokenizer string")
        sized = self.blocked.join(plan, "tokenizer")
        whole = sized.join(self.draw.where("block is not null"), ["plan_id", "source", "block"])
        ones = self.edge.join(
            self.draw.where("block is null").drop("block"),
            ["plan_id", "source", "copy"],
        ).join(sized, ["plan_id", "source", "doc_id"])
        cols = [
            "plan_id",
            "shard",
            F.xxhash64(F.lit(self.seed + 3), "plan_id", "doc_id", "copy").alias("position_key"),
            "doc_id",
            "source",
            "tokens",
            "copy",
        ]
        return whole.select(*cols).unionByName(ones.select(*cols))
