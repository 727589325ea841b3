from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.operators import greedy, run, sequence
from inkloom.operators.run import Context, Definitive, Degrading, Prefix, Transient


def packed(spark, sizes, cap, most=None, chunk=greedy.CHUNK, strict=False):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i long, s long")
    got = greedy.greedy_batches(rows, F.col("g"), F.col("i"), F.col("s"), F.lit(cap), F.lit(most).cast("long"), chunk=chunk, strict=strict)
    return [r.batch for r in got.orderBy("pos").collect()]


def test_greedy_goldens(spark):
    assert packed(spark, [4, 2, 4], 3) == [0, 1, 2]
    assert packed(spark, [2, 2, 2, 2], 4) == [0, 0, 1, 1]
    assert packed(spark, [100, 2], 10) == [0, 1]
    assert packed(spark, [4, 2, 4, 2], 6, 3) == [0, 0, 1, 1]
    with pytest.raises(Exception, match="over the limit"):
        packed(spark, [4], 2, strict=True)


def test_greedy_chunks_equal_one_walk(spark):
    rnd = random.Random(5)
    sizes = [rnd.randint(0, 12) for _ in range(500)]
    for cap, most in ((20, None), (9, 3), (None, 4)):
        assert packed(spark, sizes, cap, most, chunk=37) == greedy.walk(sizes, 0, 0, cap, most)[0]


def test_greedy_chains_without_spark():
    rnd = random.Random(0)
    for _ in range(300):
        sizes, cap, most, width = [rnd.randint(0, 12) for _ in range(rnd.randint(1, 40))], rnd.choice([None, 5, 9]), rnd.choice([None, 1, 3]), rnd.choice([1, 2, 5])
        parts = [sizes[c : c + width] for c in range(0, len(sizes), width)]
        columns = [pa.array(["a"] * len(parts)), pa.array(list(range(len(parts)))), pa.array([cap] * len(parts), pa.int64()), pa.array([most] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
        tables = greedy._summarise([pa.RecordBatch.from_arrays(columns, ["grp", "chunk", "cap", "most", "sizes"])])
        starts = [r for b in greedy._chain(tables) for r in b.to_pylist()]
        got = [s["first"] + k for p, s in zip(parts, starts) for k in greedy.walk(p, s["open_size"], s["open_n"], cap, most)[0]]
        assert got == greedy.walk(sizes, 0, 0, cap, most)[0]


def test_tables_are_short():
    """A chunk without limits needs no table, one with limits as many rows as the first batch takes."""
    assert greedy.summary([1] * 1000, None, None) == ([], [])
    assert len(greedy.summary([1] * 1000, 10, None)[0]) == 11
    assert len(greedy.summary([1] * 1000, None, 5)[0]) == 6


def test_batch_counts(spark):
    rows = spark.createDataFrame([(g, i, 3) for g, n in (("a", 7), ("b", 1)) for i in range(n)], "g string, i long, s long")
    got = greedy.batch_counts(rows, F.col("g"), F.col("i"), F.col("s"), F.lit(6), F.lit(None), chunk=2)
    assert {r.grp: r.batches for r in got.collect()} == {"a": 4, "b": 1}
    assert greedy.greedy_batches(rows.limit(0), F.col("g"), F.col("i"), F.col("s"), F.lit(6), F.lit(None)).count() == 0


def test_prefix_over_chunks_and_sample(spark):
    rows = spark.createDataFrame([("b", i, 0, "p", "paragrafo", "abcd", i == 2) for i in range(9)], "book_id string, block_id long, chapter_idx int, path string, kind string, text string, protected boolean")
    got = sequence.book_prefix(rows.withColumn("one", F.lit(1).cast("long")), "one", "n", chunk=2).orderBy("block_id").collect()
    assert [r.n for r in got] == list(range(9))
    assert sequence.sample_text(rows, 1, 10).head().sample == "abcd\n\nabcd\n\nab"


def test_usage_sum_is_unknown_with_a_part(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1, 9, 1), ("a", 2, None, 2, 1, 1), ("b", 1, 3, 4, 1, 1), ("b", 1, 3, 4, 1, 1)], "state_key string, batch_id long, prompt_tokens long, completion_tokens long, characters long, blocks long")
    got = {r.state_key: r for r in sequence.usage_totals(rows).collect()}
    assert got["a"].prompt_tokens is None and got["a"].total_tokens is None and got["a"].completion_tokens == 3
    assert got["b"].total_tokens == 7 and got["b"].batches == 1


class Flaky:
    """Fails as told, by call number."""

    def __init__(self, script):
        self.script, self.calls = script, 0

    def translate(self, texts, context):
        step = self.script[min(self.calls, len(self.script) - 1)]
        self.calls += 1
        return step(texts) if callable(step) else (_ for _ in ()).throw(step)


def test_batch_outcomes():
    ok = lambda ts: ["TR: " + t for t in ts]
    go = lambda *script, n=3: run.attempt_batch(["a {{0}}", "b"], Flaky(script), Context(), n, 2)
    assert go(ok) == (["TR: a {{0}}", "TR: b"], None)
    assert go(Transient(), Transient(), ok)[1] is None
    assert go(Transient())[1] == "transient"
    assert go(Definitive())[1] == "definitive"
    assert go(RuntimeError("x"))[1] == "unknown"
    assert go(lambda ts: ts[:1])[1] == "misaligned"
    assert go(lambda ts: ["a", "b"])[1] == "quality"
    assert go(lambda ts: ["a", "b"], ok)[1] is None
    assert run.attempt_batch(["<b>x</b>"], Flaky([lambda ts: ["y"]]), Context(), 2, 0) == (["y"], None)


def test_degrading_translator_masks():
    class Eats:
        def translate(self, texts, context):
            return [t.replace("<b>", "").replace("</b>", "") for t in texts]

    assert Degrading(Eats()).translate(["<b>x</b>"], Context()) == ["<b>x</b>"]


def test_degrading_translator_after_failures():
    """A refusal masks from then on, a passing failure masks one batch."""
    says = lambda ts: ["TR: " + t for t in ts]
    for failure, sticks in ((Definitive(), True), (Transient(), False)):
        degrading = Degrading(Flaky([failure, says]))
        assert degrading.translate(["<b>x</b>"], Context()) == ["TR: <b>x</b>"] and bool(degrading.seen) is sticks
    assert run.Tagless().translate(["<b>x</b> {{0}}"], Context()) == ["TR: x {{0}}"]
    assert Degrading(run.Tagless()).translate(["<b>x</b> {{0}}"], Context()) == ["TR: <b>x</b> {{0}}"]


def test_strict_glossary(spark):
    from inkloom.functions import json as J

    read = lambda body: [tuple(e) for e in spark.createDataFrame([("a/g.json", body)], "path string, body string").select(J.strict_glossary(F.col("path"), F.col("body")).alias("g")).first().g]
    assert read(None) == [] and read("[]") == [] and read('[{"termo": "a", "traducao": "b", "x": 1}]') == [("a", "b")]
    for body in ("", "{", "null", "{}", "[1]", '[{"termo": "a"}]', '[{"termo": "a", "traducao": 1}]', '[{"termo": "a", "traducao": "b"}, null]'):
        with pytest.raises(Exception, match="a/g.json"):
            read(body)


def test_run_keeps_other_batches(spark):
    class Picky:
        def translate(self, texts, context):
            if any("bad" in t for t in texts):
                raise Definitive
            return Prefix().translate(texts, context)

    rows = spark.createDataFrame([("k", 0, 0, "a"), ("k", 0, 1, "b"), ("k", 1, 2, "bad")], "state_key string, batch long, block_id long, text string")
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    got = run.translate_batches(rows, Picky()).orderBy("block_id").collect()
    assert [(r.text, r.error_class) for r in got] == [("TR: a", None), ("TR: b", None), (None, "definitive")]


def test_token_counters(spark):
    from inkloom.functions import tokens

    rows = spark.createDataFrame([("b", 0, 0, "p", "paragrafo", "the old lamp", False), ("b", 1, 0, "p", "paragrafo", "<|endoftext|>", False)], "book_id string, block_id long, chapter_idx int, path string, kind string, text string, protected boolean")
    sizes = lambda count: [r.tokens for r in sequence.sized_blocks(rows, count=count).orderBy("block_id").collect()]
    assert sizes(tokens.by_words) == [3, 1] and sizes(tokens.by_characters) == [12, 13]
    got = sizes(tokens.by_tokenizer(spark, "/opt/tokenizers/byte_bpe_50k.json"))
    assert got[0] == 3 and got[1] > 3
    assert rows.select(tokens.by_tokenizer(spark, "/opt/tokenizers/byte_bpe_50k.json")(F.lit(None).cast("string")).alias("n")).head().n == 0
