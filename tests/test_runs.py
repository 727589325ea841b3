"""Runs with durable state, endpoints, registry and settings."""

from __future__ import annotations

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from inkloom import config
from inkloom.operators import endpoints, loop, registry, run
from inkloom.plans import samples

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKS = "book_id string, block_id long, chapter_idx int, path string, kind string, text string, protected boolean"


@pytest.fixture
def tables(spark):
    rows = [("b", i, 0, "p", "paragrafo", f"wave {i}", i == 3) for i in range(10)] + [("b", 10, 0, "p", "paragrafo", " ", False), ("c", 0, 0, "p", "paragrafo", "sand", False), ("c", 0, 0, "p", "paragrafo", "sand", False)]
    runs = spark.createDataFrame([("k1", "b"), ("k1", "b"), ("k2", "c")], "state_key string, book_id string")
    return runs, spark.createDataFrame(rows, BLOCKS)


def texts(store):
    return {(r.state_key, r.block_id): r.text for r in store.texts().collect()}


def kinds(store):
    return sorted({(r.state_key, r.kind) for r in store.events().collect()})


def test_interrupted_runs_end_as_whole_ones(spark, tables, tmp_path):
    runs, blocks = tables
    whole = loop.StateStore(spark, f"file://{tmp_path}/whole")
    assert loop.translate_runs(runs, blocks, run.Prefix(), whole, batch_tokens=4) == loop.Outcome(1, 6, 0, False)
    assert len(texts(whole)) == 10 and texts(whole)["k2", 0] == "TR: sand" and ("k1", "completed") in kinds(whole)
    # the third batch fails; waves of two batches a run: what came before is saved, nothing after is sent
    store = loop.StateStore(spark, f"file://{tmp_path}/parts")
    marked = samples.marked(blocks, F.col("block_id") == 6)
    first = loop.translate_runs(runs, marked, samples.Refusing(), store, batch_tokens=4, per_wave=2)
    assert (first.failed, first.stopped) == (1, True) and ("k1", "log") in kinds(store) and ("k1", "completed") not in kinds(store)
    done = set(texts(store))
    assert ("k1", 0) in done and ("k1", 6) not in done and ("k1", 9) not in done
    # opened again, as after a crash: only what is missing is sent
    again = loop.StateStore(spark, f"file://{tmp_path}/parts")
    assert loop.translate_runs(runs, blocks, Counting(sorted(done)), again, batch_tokens=4).failed == 0
    assert texts(again) == texts(whole)
    assert loop.translate_runs(runs, blocks, Broken(), again) == loop.Outcome(0, 0, 0, False)


class Broken:
    def translate(self, texts, context):
        raise AssertionError("nothing is left to send")


class Counting(run.Prefix):
    """Fails where it is sent what was saved."""

    def __init__(self, done):
        object.__setattr__(self, "prefix", "TR: ")
        object.__setattr__(self, "done", {f"wave {i}" for k, i in done if k == "k1"})

    def translate(self, texts, context):
        if self.done & set(texts):
            raise run.Definitive("sent twice")
        return super().translate(texts, context)


def test_unfinished_epochs_are_not_seen(spark, tables, tmp_path):
    runs, blocks = tables
    store = loop.StateStore(spark, f"file://{tmp_path}/s")
    loop.translate_runs(runs, blocks, run.Prefix(), store)
    (tmp_path / "s/texts/epoch-000000000/_SUCCESS").unlink()
    assert store.texts().count() == 0 and store.next_epoch() == 0
    loop.translate_runs(runs, blocks, run.Prefix("X "), store)
    assert texts(store)["k2", 0] == "X sand" and len(texts(store)) == 10


def test_reset_and_cancel(spark, tables, tmp_path):
    runs, blocks = tables
    store = loop.StateStore(spark, f"file://{tmp_path}/s")
    loop.translate_runs(runs, blocks, run.Prefix(), store)
    store.reset(runs.where("state_key = 'k1'"))
    assert set(texts(store)) == {("k2", 0)}
    got = loop.translate_runs(runs, blocks, run.Prefix("Y "), store, batch_tokens=2, per_wave=1, cancelled=lambda: True)
    assert got.stopped and got.waves == 1 and texts(store) == {("k2", 0): "TR: sand", ("k1", 0): "Y wave 0"}


def test_log_is_redacted(spark, tables, tmp_path):
    runs, blocks = tables
    store = loop.StateStore(spark, f"file://{tmp_path}/s")
    loop.translate_runs(runs, samples.marked(blocks, F.lit(True)), samples.Refusing(), store, secrets=("definitive", ""))
    assert {r.message for r in store.events().where("kind = 'log'").collect()} == {"batch 0: ***"}


def test_passes(spark):
    rows = spark.createDataFrame([("a", "xyz"), ("b", "xy")], "book_id string, sample string")
    got = {tuple(r) for r in loop.glossary_pass(rows, samples.Lexicon()).collect()}
    assert got == {("a", "lamp", "L3"), ("a", "key", "chave"), ("b", "lamp", "L2"), ("b", "key", "chave")}
    known = spark.createDataFrame([("a", "oar", "remo")], "book_id string, term string, translation string")
    assert {r.term for r in loop.glossary_pass(rows, samples.Lexicon(), known).where("book_id = 'a'").collect()} == {"oar"}
    assert {r.priming for r in loop.priming_pass(rows, Broken()).collect()} == {""}
    service = endpoints.Service(None, None)
    assert loop.glossary_pass(rows, service).count() == 0 and {r.priming for r in loop.priming_pass(rows, service).collect()} == {""}


def test_labels_or_own(spark):
    own = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"]), ("c", ["1"])], "book_id string, labels array<string>")
    new = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"])], "book_id string, labels array<string>")
    assert {r.book_id: r.labels for r in loop.labels_or_own(own, new).collect()} == {"a": ["x", "y"], "b": ["1"], "c": ["1"]}


def test_backoff_and_pace():
    rng = random.Random(1)
    b = run.Backoff()
    assert b.delay(3, 100.0, rng) == 60.0 and b.delay(0, -5.0, rng) == -5.0 and run.Backoff(least=0.0).delay(0, -5.0, rng) == 0.0
    assert all(0 <= b.delay(k, None, rng) <= min(60, 2**k) for k in range(9) for _ in range(20))
    slept, clock = [], [0.0]
    pace = run.Pace(0.25)
    for at in (0.0, 0.1, 0.9):
        clock[0] = at
        pace.keep(lambda: clock[0], slept.append)
    assert [round(s, 3) for s in slept] == [0.15]


def test_retries_wait_as_told():
    answers = [run.Transient("HTTP 429", 7.0), run.Transient("HTTP 500"), None]
    slept = []

    class T:
        def translate(self, texts, context):
            e = answers.pop(0)
            if e:
                raise e
            return texts

    assert run.attempt_batch(["a"], T(), run.Context(), sleep=slept.append) == (["a"], None)
    assert slept[0] == 7.0 and 0 <= slept[1] <= 2.0


def test_no_more_is_sent_without_a_key(spark):
    class Closed:
        def translate(self, texts, context):
            raise run.Unauthorised("HTTP 401")

    rows = spark.createDataFrame([("k", b, b, "x") for b in range(6)], "state_key string, batch long, block_id long, text string")
    got = [r.error_class for r in run.translate_batches(rows, Closed(), in_flight=1).collect()]
    assert sorted(got) == ["auth"] + ["not sent"] * 5


# --- endpoints


def answering(*answers):
    left = list(answers)

    def post(url, headers, body):
        left.append(left[0])
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got if isinstance(got, tuple) else (200, {}, got if isinstance(got, str) else json.dumps(got))

    return post


def chat(content):
    return {"choices": [{"message": {"content": content}}]}


def test_chat(monkeypatch):
    seen = {}

    def post(url, headers, body):
        seen.update(url=url, headers=headers, body=json.loads(body))
        return 200, {}, json.dumps(chat('Sure:\n["um", "dois"]'))

    monkeypatch.setenv("SHELF_KEY", "s3cret")
    context = run.Context("en", "pt", (("sea", "mar"),), "Dry.")
    assert endpoints.Chat(post, "https://x", "m", "SHELF_KEY").translate(["one", "two"], context) == ["um", "dois"]
    assert seen["headers"]["Authorization"] == "Bearer s3cret" and "sea -> mar" in seen["body"]["messages"][0]["content"] and '["one", "two"]' in seen["body"]["messages"][1]["content"]
    with pytest.raises(run.Definitive, match="NO_SUCH_KEY"):
        endpoints.Chat(post, "https://x", "m", "NO_SUCH_KEY").translate(["one"], context)


@pytest.mark.parametrize(
    ("answer", "error", "told"),
    [((429, {"Retry-After": "4"}, ""), run.Transient, 4.0), ((503, {"retry-after": "Wed, 21 Oct 2026 07:28:00 GMT"}, ""), run.Transient, None), ((401, {}, ""), run.Unauthorised, None), ((404, {}, ""), run.Definitive, None), (OSError("down"), run.Transient, None), ("<html>", run.Transient, None), (chat("no list"), run.Transient, None), (chat("[1]"), run.Transient, None)],
)
def test_chat_errors(answer, error, told):
    with pytest.raises(error) as e:
        endpoints.Chat(answering(answer), "u", "m").translate(["a"], run.Context())
    assert getattr(e.value, "retry_after", None) == told


def test_service_degrades():
    text = endpoints.Plain(answering({"data": ["@@0@@X@@1@@"]}), "t", False)
    for first, sticks in (([["X"], "en"], True), ((400, {}, ""), True), ((500, {}, ""), False), ([["<b>X</b>"], "en"], False)):
        service = endpoints.Service(endpoints.Plain(answering(first), "m", True), text)
        assert service.translate(["<b>x</b>"], run.Context(target="pt")) == ["<b>X</b>"] and bool(service.state) is sticks
    with pytest.raises(run.Definitive):
        endpoints.Service(endpoints.Plain(answering({}), "m", True), endpoints.Plain(answering({}), "t", False)).translate(["x"], run.Context())


# --- registry and settings


def test_registry():
    r = registry.Registry()
    d = registry.Description("machine_translation", "quay", "Quay")
    r.register(d, run.Prefix)
    r.register(registry.Description("llm", "quay", "Quay", reports_token_usage=True), run.Tagless)
    assert [x.family for x in r.listed()] == ["llm", "machine_translation"] and r.find("quay", "llm").family == "llm"
    assert r.create("quay", "machine_translation", prefix="> ") == run.Prefix("> ")
    for call, message in ((lambda: r.find("quay"), "ambiguous"), (lambda: r.find("pier"), "unknown"), (lambda: r.register(d, run.Prefix), "already"), (lambda: r.register(registry.Description("llm", "x", "X"), run.Prefix), "usage"), (lambda: r.register(registry.Description("llm", "x", "X", max_batch_items=0, reports_token_usage=True), run.Prefix), "max_batch_items")):
        with pytest.raises(registry.RegistryError, match=message):
            call()


def test_discovery(tmp_path, monkeypatch):
    package = tmp_path / "shelf_translators"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "quay.py").write_text("from inkloom.operators.registry import Description\nfrom inkloom.operators.run import Prefix\nDESCRIPTION = Description('machine_translation', 'quay', 'Quay')\ndef create(**k): return Prefix(**k)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    r = registry.Registry()
    r.discover("shelf_translators")
    assert r.create("quay").translate(["a"], run.Context()) == ["TR: a"]
    (package / "rest.py").write_text("x = 1\n")
    with pytest.raises(registry.RegistryError, match="rest"):
        registry.Registry().discover("shelf_translators")


def test_settings(tmp_path):
    text = 'target = "es"\ntranslator = "b"\n[translators.b]\nmodel = "m"\nparallelism = 2\n[translators.a]\nfamily = "machine_translation"\ndelay_seconds = 0.5\n'
    got = config.parse(text)
    assert got.target == "es" and got.translators["a"].delay_seconds == 0.5 and config.parse(config.dump(got)) == got
    config.save(got, tmp_path / "c.toml")
    assert config.load(tmp_path / "c.toml") == got and config.load(tmp_path / "none.toml") == config.Settings()
    more = config.with_translator(got, "b", parallelism=9)
    assert more.translators["b"].parallelism == 9 and more.translators["b"].model == "m" and list(config.with_translator(got, "aa").translators) == ["a", "aa", "b"]


@pytest.mark.parametrize(
    ("text", "place"),
    [("target = 3", "target"), ("x = 1", "x"), ("batch_tokens = 0", "batch_tokens"), ('policy = "none"', "policy"), ('translator = "z"', "translator"), ("[translators.a]\nparallelism = 0", "translators.a.parallelism"), ('[translators.a]\nfamily = "x"', "translators.a.family"), ('[translators.a]\nfamily = "machine_translation"\nmodel = "m"', "translators.a.model"), ("[translators.a]\nparallelism = true", "translators.a.parallelism"), ("x =", "file")],
)
def test_settings_that_are_not_valid(text, place):
    with pytest.raises(config.ConfigError, match=f"^{place}: "):
        config.parse(text)
