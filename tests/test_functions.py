from __future__ import annotations

import json

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import json as J
from inkloom.functions import messages as M
from inkloom.functions import placeholders as P
from inkloom.functions import text as T
from inkloom.operators import run

#: Pieces that texts are made of: markup, placeholders, marks and what could be taken for them.
PIECES = ["<b>", "</b>", '<span lang="la">', "</span>", "<i></i>", "<i> \n</i>", "<br/>", "</", "stone", "é", " ", "\u00a0", "\n", "{{0}}", "{{", "}}", "7", "@", "@@", "@@0@@", "@ @ 1 @ @", "\0"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=24).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXTS.filter(lambda t: "\0" not in t), st.lists(st.sampled_from(["stone", "<b>", "7", "{{", "é", "<i></i>", "0}"]), max_size=6))
def test_protecting_is_undone(text, snippets):
    template, saved = P.protect(text, snippets)
    assert P.restore(template, saved) == text
    assert sorted(saved) == list(range(len(saved)))


@settings(max_examples=5000, deadline=None)
@given(TEXTS)
@example('<span class="x"> </span><span class="x"></span>')
@example("@@<b>@@5@@</b>@ @")
@example("<i></i><i> </i></i>")
def test_masking_is_undone(text):
    assert P.unmask(*P.mask(text)) == text


def test_protected_parts_are_numbered_as_they_come():
    template, saved = P.protect("north, east, south; east again", ["south", "east", "north", "west"])
    assert template == "{{0}}, {{1}}, {{2}}; {{1}} again" and saved == {0: "north", 1: "east", 2: "south"}
    assert P.protect("abc ab", ["ab", "abc"]) == ("{{0}} {{1}}", {0: "abc", 1: "ab"})
    with pytest.raises(ValueError):
        P.restore("{{1}}", {0: "x"})


def test_masks():
    assert P.mask("<q>see {{0}}</q> a@b") == ("@@0@@see {{0}}@@1@@ a@b", ["<q>", "</q>"], {})
    masked, kept, gaps = P.mask('<a id="p7"> </a>page')
    assert masked == "@@0@@\u00a0@@1@@page" and gaps == {0: " "}
    # marks that moved, were pulled apart, were made up or lost their filler
    assert P.unmask("page@ @ 0 @ @@@1@@ @@9@@", kept, gaps) == 'page<a id="p7"> </a> @@9@@'


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(col.alias("x")).head()[0]


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.clean_placeholders(c), t="see {{ 12 }} and @ @3 @@, @@ 4 @ @") == "see {{12}} and @@3@@, @@4@@"
    assert one(spark, T.placeholder_sequence(c), t="{{4}} \0{{9}}\0 {{ 2 }}") == [4, 2]
    assert one(spark, T.markup_sequence(c), t='<em  lang="la" >a</em ><hr />') == ['<em lang="la">', "</em>", "<hr/>"]
    assert one(spark, T.strip_markup(c), t=" <em>sun</em>  @@2@@ moon ") == "sun moon"
    assert one(spark, T.word_count(c), t=" sun\tmoon\u00a0stars ") == 3
    assert one(spark, T.version_parts(c), t="V2.11") == [2, 11]
    assert one(spark, T.version_parts(c), t="2.beta") == [0]
    assert one(spark, T.output_path(c, F.lit("es")), t="/shelf.old/moby.epub") == "/shelf.old/moby-es.epub"
    assert one(spark, T.slug(c), t="Moby Dick, vol. 2") == "Moby-Dick--vol--2"
    assert one(spark, T.growth_factor(c), t=" DE-at") == 1.1
    assert one(spark, T.growth_factor(c), t="") == 1.0
    assert one(spark, T.kind_of(c), t="H3") == "titulo" and one(spark, T.kind_of(c), t="figure") == "texto"
    lines = "whale -> baleia\n\n-> nothing\n\"mast: mastro\",\nno separator"
    assert [tuple(r) for r in one(spark, T.glossary_lines(c), t=lines)] == [("whale", "baleia"), ("mast", "mastro")]
    assert [one(spark, T.retry_class(F.col("n")), n=n) for n in (200, 404, 401, 503)] == ["ok", "definitive", "auth", "transient"]


@pytest.mark.parametrize(
    ("text", "marked"),
    [("chove [original: it rains] hoje", True), ("fim (n. t.)", True), ("Nota da tradutora", True), ("traduzida com inteligência artificial", True), ("a\n  ORIGINAL: b", True), ("o original da carta", False), ("[ver página 3]", False), ("tradução feita por máquina", True)],
)
def test_machine_marks(spark, text, marked):
    assert one(spark, T.has_machine_mark(F.col("t")), t=text) is marked and run.marked(text) is marked


ANSWERS = [
    ("Rain on <em>the sea</em> {{0}}", "Chuva n<em>o mar</em> {{ 0 }}"), ("Rain <em>x</em>", "Chuva x"), ("Rain {{0}}", "Chuva"), ("Rain", "\u00a0"), ("Rain", "Chuva (N. T.)"),
    ("Rain", None), ("Rain (n.t.)", "Chuva (n.t.)"), ("a {{0}} {{1}}", "a {{1}} {{0}}"), ("\0{{0}}\0 x", "{{0}} x"), ("<b>a</b>", "<b >a</b>"), ("<br/>", "<br />"),
]


def test_rules_are_the_same_inside_tasks(spark):
    """What columns say of an answer, and what a translator within a task says of it."""
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ANSWERS)], "i int, s string, t string").orderBy("i")
    got = df.select(T.reject_reason(F.col("s"), F.col("t")).alias("r"), T.salvage(F.col("s"), F.col("t")).alias("v")).collect()
    assert [r.r for r in got][:6] == [None, "markup", "markup", "empty", "mark", "empty"]
    for row, (source, answer) in zip(got, ANSWERS):
        tidied = run.tidy(answer or "")
        assert (row.r is None) == run.clean(source, tidied), (source, answer)
        assert row.v == run.salvaged(source, tidied), (source, answer)


def test_json(spark):
    c = F.col("t")
    assert one(spark, J.strings_in_chatter(c), t='Here: ["sun", "moon"] (done)') == ["sun", "moon"]
    assert one(spark, J.strings_in_chatter(c), t='["sun", null]') is None and one(spark, J.strings_in_chatter(c), t="sorry") is None
    assert one(spark, J.message_content(c), t='{"choices":[{"message":{"content":"sun"}}]}') == "sun"
    assert one(spark, J.message_content(c), t='{"choices":[]}') is None
    got = one(spark, J.saved_texts(c), t='{"translations":{"a.xhtml":{"7":"sun","seven":"x","8":["x"]}}}')
    assert [tuple(r) for r in got] == [("a.xhtml", 7, "sun")] and one(spark, J.saved_texts(c), t="[") == []
    assert tuple(one(spark, J.usage_counts(c), t='{"usage":{"prompt_tokens":3,"completion_tokens":null}}')) == (3, 0)
    assert tuple(one(spark, J.usage_counts(c), t="{}")) == (0, 0)
    for bad in ('"3"', "-1", "1.5", "true"):
        with pytest.raises(Exception, match="no token count"):
            one(spark, J.usage_counts(c), t='{"usage":{"prompt_tokens":%s}}' % bad)


def test_answers_in():
    find = lambda v, n=2, markup=False: J.aligned_answers(json.dumps(v), n, markup)
    assert find({"results": {"data": [{"text": "sun"}, {"translated": "moon"}]}}) == ["sun", "moon"]
    assert find([["sun", "x"], [["moon"]]]) == ["sun", "moon"] and find([["sun", "moon"], "en"], markup=True) == ["sun", "moon"]
    assert find({"text": "sun"}, 1) == ["sun"] and find({"text": 5}, 1) is None and find(["sun", " "]) is None and find(["sun"]) is None
    assert J.aligned_answers("<html>", 1) is None and J.aligned_answers(None, 1) is None


def test_prompts_are_the_same_inside_tasks(spark):
    glossary = F.array(F.struct(F.lit("sea").alias("term"), F.lit("mar").alias("translation")))
    for task in M.ROLE:
        for priming in ("", "Dry."):
            got = one(spark, M.system_prompt(F.col("t"), F.lit(None).cast("string"), F.lit("pt"), F.lit(priming), glossary, F.lit("manter")), t=task)
            assert got == M.system_text(task, "", "pt", priming, (("sea", "mar"),), "manter")
    assert tuple(one(spark, M.advice(F.col("t")), t="?")) == M.OTHER_ADVICE


def test_state_key(spark):
    names = ("book_hash", "source", "target", "model", "policy", "glossary", "family", "provider", "variant")
    key = lambda **k: one(spark, T.state_key(*[F.lit(k.get(n)) for n in names]), x=1)
    old = dict(book_hash="b", source="de", target="en", model="m1", policy="manter", glossary="g", family="llm", provider="deepseek")
    assert key(**old) == key(**old, variant="stream") == key(**(old | {"family": "", "provider": None}))
    for change in ({"target": "fr"}, {"model": "m2"}, {"policy": "traduzir"}, {"glossary": ""}, {"provider": "x"}):
        assert key(**(old | change)) != key(**old), change
    machine = old | {"family": "machine_translation", "provider": "x"}
    assert key(**machine) == key(**(machine | {"model": "other", "glossary": "z"})) != key(**machine, variant="text")
