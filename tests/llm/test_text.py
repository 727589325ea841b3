"""Broken pairs, garbled text and languages: rules, round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import bytecnn, encoding, language, pairs, queries

# --- broken pairs


@pytest.mark.parametrize(
    ("answer", "source", "empty"),
    [
        (None, "a", True),
        ("", "a", True),
        ("​ \n", "a", True),
        ("<b></b>", "a", True),
        ("&nbsp;", "a", True),
        ("…", "a", True),
        ("* * *", "* * *", False),
        ("", "* * *", True),
        ("{{0}}", "x {{0}}", True),
        ("7", "7", False),
        ("x", None, False),
        ("x&amp;", "a", False),
    ],
)
def test_empty(answer, source, empty):
    assert pairs.is_empty(answer, source) is empty


@pytest.mark.parametrize(
    ("text", "refused"),
    [
        ("I'm sorry, but I can't help with translating this passage.", True), (
            "[Sorry. This request cannot be completed because of my content guidelines.]",
            True,
        ),
        ("Infelizmente, sou obrigado a recusar este pedido.", True), (
            "Lo siento, pero no tengo permitido procesar este contenido.",
            True,
        ), ("Je dois refuser cette demande.", True),
        ("Ich kann diesen Abschnitt nicht übersetzen.", True), (
            "Mi dispiace, ma non posso aiutare con la traduzione di questo brano.",
            True,
        ), ("К сожалению, мне нельзя обрабатывать это содержимое.", True),
        ("Désolé, mais je ne suis pas autorisé à traiter ce contenu.", True), ("Lo siento, no\u00a0 puedo <i>traducir</i> este texto.", True),
        ("“I am sorry, but I cannot find the key”, whispers Daem.", False), ("Non riesco a trovare la mela.", False), ("The translator sells the text.", False),
    ],
)
def test_refusal(text, refused):
    assert pairs.is_refusal(text, "The miller sells the key.") is refused


@pytest.mark.parametrize(
    "text",
    [
        "Ik kan deze tekst helaas niet vertalen.",
        "Przepraszam, ale nie mogę przetłumaczyć tego tekstu.",
        "申し訳ありませんが、この文章を翻訳することはできません。",
        "抱歉，我无法翻译这段文字。",
        "Λυπάμαι, δεν μπορώ να μεταφράσω αυτό το κείμενο.",
        "عذرا، لا أستطيع ترجمة هذا النص.",
        "Üzgünüm, bu metni çeviremem mümkün değil.",
        "Bohužel nemohu přeložit tento text.",
    ],
)
def test_refusal_in_other_languages(text):
    assert pairs.is_refusal(text, "The miller sells the key.")


def test_tiles_are_fast_and_greedy():
    """Long and repetitive texts end soon; the result is that of trying every run."""
    rng = np.random.default_rng(3)

    def brute(a, b, least):
        free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
        while True:
            runs = []
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    runs.append((n, i, j))
            best = max(runs, default=(0, 0, 0))[0]
            if best < least:
                return covered
            for n, i, j in runs:
                if n == best and all(free_a[i : i + n]) and all(free_b[j : j + n]):
                    free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
                    covered += n

    for _ in range(30):
        a, b = ([str(x) for x in rng.integers(0, 12, rng.integers(1, 30))] for _ in range(2))
        got, want = pairs.tiles(a, b, 2), brute(a, b, 2)
        # ties between places of one length may be broken differently
        assert abs(got - want) <= 4 and (got > 0) == (want > 0)
    many = [str(x) for x in rng.integers(0, 300, 20_000)]
    assert pairs.tiles(many, many[10_000:] + many[:10_000], 3) == 20_000
    assert pairs.tiles(["the"] * 5000, ["the"] * 4000, 3) == 4000


def test_tiles():
    a = "the old miller sells the key at noon".split()
    assert pairs.tiles(a, a, 3) == 8
    assert pairs.tiles(a, "at noon the old miller sells the key".split(), 3) == 6
    assert pairs.tiles(a, "noon at key the sells".split(), 3) == 0


def test_copies():
    s = "The miller sells <b>the key</b> at noon."
    for t in (s, s.upper(), "Traducción: " + s, "“" + s + "”", "The  miller  sells the key at noon"):
        assert pairs.is_copy(s, t), t
    assert not pairs.is_copy(s, "El molinero vende <b>la llave</b> al mediodía.")
    assert not pairs.is_copy("Trux &amp; Kourt, 1651", "Trux &amp; Kourt, 1651")


def test_copies_without_their_markup():
    assert pairs.is_copy('<a href="ch1.xhtml">see note</a>', "see note") and pairs.is_copy("the old <b>key</b> {{0}}{{1}}{{2}}&#160;&nbsp;", "The old key")


def test_other_scripts():
    table = pairs.WordTable({})
    s = "The miller sells <b>the key</b> at noon."
    for t in ("Ключ <b>продан</b>.", "Το <b>κλειδί</b>.", "鍵を<b>売る</b>。", "מפתח <b>נמכר</b>."):
        assert pairs.defect(s, t, "es", "en", table, {}) == "wrong_language", t
    assert pairs.defect("Мельник продаёт ключ.", "Το κλειδί.", "ru", "en", table, {}) == "wrong_language"
    for source, answer, target, label in (
        (s, "El molinero vende <b>la llave π</b>.", "es", "en"),
        (s, "Мельник <b>продаёт ключ</b> в полдень.", "ru", "en"),
        ("Мельник продаёт ключ.", "Мельник продал.", "es", None),
        ("Trux Kourt, 1651", "Трукс Курт, 1651", "es", "en"),
        (s, "Ключ <b>продан</b>.", "es", "ru"),
        (s, "Ключ <b>продан</b>.", None, "en"),
    ):
        assert pairs.defect(source, answer, target, label, table, {}) != "wrong_language", answer


def test_truncation():
    s = "The miller sells <b>the key</b> (see {{0}}) at noon. “The queen waits”, says Tru. The boat is late."
    full = "El molinero vende <b>la llave</b> (véase {{0}}) al mediodía. «La reina espera», dice Tru. El barco se retrasa."
    for t in ("El molinero vende <b>la", "El molinero vende [...]", "El molinero vende <b>la llave</b> (véase {{0}}) al mediodía.", full[:70]):
        assert pairs.is_truncated(s, t, 1.05), t
    assert not pairs.is_truncated(s, full, 1.05)
    assert not pairs.is_truncated(s, full.rstrip(".") + "\n", 1.05)
    long = full + " " + full[:-1]
    assert pairs.is_truncated(s + " " + s, full + " " + full[:-9] + "…", 1.05) and pairs.is_truncated(s + " (" + s + ")", long + " (" + full, 1.05)
    assert pairs.is_truncated("let us go.", "El molinero vende la llave al mediodía, y entonces [...]", 20.0)
    assert pairs.open_at_end('He said "I will go') == 1 and pairs.open_at_end('He said "I will go", and left the 5" pipe.') == 0
    assert pairs.open_at_end("- a\n- b\n-") == 1 and pairs.open_at_end("1. a\n2. b") == 0 and pairs.open_at_end("‘a’ it’s „b“ «c» (d)") == 0
    assert pairs.parsed("```\n(x <b>\n```\n- a\n- {{0}} <i>b</i>") == (0, 2, 2, 1)
    assert pairs.open_at_end("a (b [c] <i>d") == 2 and pairs.open_at_end("<br>“x”\n```\ny") == 1 and pairs.open_at_end("a {{0") >= 1


def pair_tables(spark):
    en = [
        "the miller sells the key at noon",
        "a queen waits under the old bridge",
        "the boat brings bread before winter",
        "who finds the lamp in the attic",
    ]
    es = [
        "el molinero vende la llave al mediodía",
        "una reina espera bajo el viejo puente",
        "el barco trae pan antes del invierno",
        "quién encuentra la lámpara en el desván",
    ]
    fr = [
        "le meunier vend la clé à midi sur le pont",
        "la reine attend sous le vieux pont avec le pain",
        "le bateau apporte du pain avant l’hiver",
        "qui trouve la lampe dans le grenier",
    ]
    runs = spark.createDataFrame(
        [("k", "b", "en", "es", 1), ("k", "b", "en", "es", 1), ("f", "b", "en", "fr-FR", 1), ("o", "gone", None, "es", 1)],
        "state_key string, book_id string, source_language string, target_language string, text int",
    )
    blocks = spark.createDataFrame([("b", i, en[i % 4].capitalize() + ".") for i in range(60)], "book_id string, block_id long, text string")
    good = [("k", i, es[i % 4].capitalize() + ".", 1) for i in range(60)] + [("f", i, fr[i % 4].capitalize() + ".", 1) for i in range(60)]
    bad = [
        ("k", 0, None, 2),
        ("k", 1, "I can't help with translating this passage.", 2),
        ("k", 2, en[2].upper(), 2),
        ("k", 3, fr[3] + " " + fr[0] + ".", 2),
        ("k", 4, "El molinero [...]", 2),
        ("k", 5, "old", 0),
        ("o", 1, "", 1),
        ("o", 2, "x", 1),
        (None, 1, "", 1),
        ("k", None, "", 1),
    ]
    state = spark.createDataFrame(good + bad + bad, "state_key string, block_id long, text string, saved_at int")
    return state, runs, blocks


def test_broken_pairs(spark):
    state, runs, blocks = pair_tables(spark)
    got = {(r.state_key, r.block_id): r.defect for r in pairs.broken_pairs(state, runs, blocks).collect()}
    assert got == {("k", 0): "empty", ("k", 1): "refusal", ("k", 2): "copied", ("k", 3): "wrong_language", ("k", 4): "truncated", ("o", 1): "empty"}
    assert pairs.broken_pairs(state.limit(0), runs, blocks).count() == 0
    assert {r.defect for r in pairs.broken_pairs(state, runs, blocks.limit(0)).collect()} == {"empty", "refusal"}


def test_planted_defects(spark):
    """Recall and precision by type on sound pairs of a real table that were broken here."""
    d = "/root/testdata/sf0.01"
    state, runs, blocks = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("translation_state", "runs", "blocks"))
    found = {(r.state_key, r.block_id) for r in pairs.broken_pairs(state, runs, blocks).collect()}
    rows = pairs.pairs(state, runs, blocks).where(
        "length(source) > 60 and length(answer) > 60 and not source like '%{{%' and source like '%.' and label <> target and answer like '%.'",
    ).orderBy(F.xxhash64("state_key", "block_id")).limit(400).collect()
    sound = [r for r in rows if (r.state_key, r.block_id) not in found]
    whole = {t: [r.answer for r in sound if r.target == t] for t in {r.target for r in sound}}
    planted = {}
    for n, r in enumerate(sound[:250]):
        kind = ("empty", "refusal", "copied", "wrong_language", "truncated")[n % 5]
        other = next(t for t in sorted(whole) if t not in (r.target, r.label))
        text = {
            "empty": ["", " \n", "<p></p>", None][n % 4], "refusal": "I'm sorry, but I can't translate this text.", "copied": r.source,
            "wrong_language": whole[other][n % len(whole[other])], "truncated": r.answer[: len(r.answer) // 2].rsplit(" ", 1)[0] + ["", "…"][n % 2],
        }[kind]
        planted[r.state_key, r.block_id] = (kind, text)
    new = spark.createDataFrame(
        [(k, b, t) for (k, b), (_, t) in planted.items()],
        "state_key string, block_id long, text string",
    ).withColumn("saved_at", F.lit("2099-01-01").cast("timestamp_ntz"))
    got = {
        (r.state_key, r.block_id): r.defect for r in pairs.broken_pairs(
            state.select("state_key", "block_id", "text", "saved_at").unionByName(new),
            runs,
            blocks,
        ).collect()
    }
    for kind in ("empty", "refusal", "copied", "wrong_language", "truncated"):
        keys = [k for k, (x, _) in planted.items() if x == kind]
        assert sum(got.get(k) == kind for k in keys) >= 0.95 * len(keys), (kind, [planted[k] for k in keys if got.get(k) != kind][:4])
    assert len(got.keys() - planted.keys() - found) <= 0.02 * len(got)


# --- encodings


@pytest.mark.parametrize(("wrong", "true"), encoding.CHAINS)
def test_chains_are_undone(wrong, true):
    """What a chain did to a word that it can express is undone exactly."""
    done = 0
    for word in ("canção", "größer", "été", "свеча", "«Кто»"):
        garbled = word
        try:
            for w in reversed(wrong.split("+")):
                garbled = garbled.encode(true).decode(w) if true != "utf-8" else garbled.encode("utf-8").decode(w)
        except UnicodeError:
            continue
        if garbled != word:
            assert encoding.undo(garbled, wrong, true) == word
            done += 1
    assert done or wrong in ("cp1252", "cp1250", "cp1252+cp1252", "cp1251")


def garbled_tables(spark):
    clean = ["O pastor guarda a canção no sótão.", "A rainha procura a lâmpada além da ponte.", "Não há pão na estação.", "O irmão lê à meia-noite."]
    rows = [("b", i, clean[i % 4]) for i in range(200)]
    bad = [
        ("b", 500, clean[0].encode().decode("cp1252")),
        ("b", 501, "O pastor guarda a " + "canção".encode().decode("latin-1") + " no sótão."),
        ("b", 502, clean[2].encode("cp1252").decode("mac_roman")),
        ("b", 503, "Não h� pão"),
        ("b", 504, None),
        ("b", 505, ""),
        ("b", 506, "Krãst Vølm"),
        (None, 1, "Ã£"),
    ]
    blocks = spark.createDataFrame([(*r, 1) for r in rows + bad + bad], "book_id string, block_id long, text string, n int")
    books = spark.createDataFrame([("b", "A canção".encode().decode("cp1252")), ("c", "A canção"), ("d", None)], "book_id string, title string")
    return clean, blocks, books


def test_detection_and_repair(spark):
    clean, blocks, books = garbled_tables(spark)
    got = {(r.source, r.key): r for r in encoding.detect(encoding.records_of(blocks, books)).collect()}
    assert set(got) == {("b", 500), ("b", 501), ("b", 502), ("b", 503), ("b", -1)}
    assert got["b", 500].restored == clean[0] and got["b", 501].restored == clean[0] and got["b", 502].restored == clean[2]
    assert got["b", -1].restored == "A canção" and got["b", 503].restored is None and got["b", 503].chain == "lost"
    assert encoding.detect(encoding.records_of(blocks.limit(0), books.limit(0))).count() == 0


def test_garbled_character_references(spark):
    """Wrong decodings written as references are found and undone; the references of clean text stay."""
    clean, blocks, books = garbled_tables(spark)
    texts = {
        600: "O pastor guarda a can&Atilde;&#167;&Atilde;&#163;o no s&Atilde;&sup3;t&Atilde;&#163;o.",
        601: "A &amp; B: a can&Atilde;&#167;&atilde;o &lt;no&gt; p&atilde;o.",
        602: "Tom &amp; Rita: a can&ccedil;&atilde;o do s&oacute;t&atilde;o&nbsp;&#8212; &quot;n&#227;o&quot;.",
    }
    more = spark.createDataFrame([("b", k, t, 1) for k, t in texts.items()], blocks.schema)
    titles = spark.createDataFrame([("e", "A can&Atilde;&#167;&Atilde;&#163;o")], books.schema)
    got = {(r.source, r.key): r.restored for r in encoding.detect(encoding.records_of(blocks.union(more), books.union(titles))).collect()}
    assert set(got) == {("b", 500), ("b", 501), ("b", 502), ("b", 503), ("b", 600), ("b", 601), ("b", -1), ("e", -1)}
    assert got["b", 600] == clean[0] and got["b", 601] == "A &amp; B: a canç&atilde;o &lt;no&gt; p&atilde;o." and got["e", -1] == "A canção"


def test_lost_before_a_chain(spark):
    """What was lost before the wrong decoding is garbled too; letters before punctuation are not."""
    clean, blocks, books = garbled_tables(spark)
    lost = {
        700 + n: f"Não h{'\ufffd'.encode().decode(codec)} pão" for n, codec in enumerate(("cp1252", "latin-1", "cp1251", "mac_roman", "koi8-r", "cp866"))
    }
    lost |= {
        710: "Não h" + "\ufffd".encode().decode("cp1252").encode().decode("cp1252") + " pão",
        711: "O pastor guarda h" + "\x92".encode().decode("cp1252"),
    }
    fine = {720: "О, мой дорогой ВАСИЛЬЕВ… ВЛАДИСЛАВ” и ЛЬВОВ—", 721: "für größer", 722: "é à ü ç Â"}
    more = spark.createDataFrame([("b", k, t, 1) for k, t in (lost | fine).items()], blocks.schema)
    got = {r.key: (r.chain, r.restored) for r in encoding.detect(encoding.records_of(blocks.union(more), books)).where("key >= 700").collect()}
    assert got == {k: ("lost", None) for k in lost}


@pytest.mark.parametrize(
    ("raw", "word", "new", "out"),
    [
        ("B&Atilde;&#188;chern", "BÃ¼chern", "Büchern", "Büchern"),
        ("&#xC3;&#xBC;b&eacute;&amp;", "Ã¼bé&amp;", "übé&amp;", "üb&eacute;&amp;"),
        ("a&#32;&foo;&#10;b", "a&#32;&foo;&#10;b", "x", "x"),
        ("&NotEqualTilde;&Atilde;&copy;", "≂̸Ã©", "≂̸é", "&NotEqualTilde;é"),
        ("&Acirc;&#171;s&igrave;&Acirc;&raquo;", "Â«sìÂ»", "«sì»", "«s&igrave;»"),
    ],
)
def test_references_are_kept(raw, word, new, out):
    assert encoding.opened(raw) == word and encoding.closed(raw, new) == out


CHAINS_PLANTED = [
    ("cp1252", "utf-8"),
    ("latin-1", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp437", "utf-8"),
    ("cp1251", "utf-8"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp1251", "cp1252"),
]


@pytest.mark.parametrize("copies", [1, 4])
def test_planted_garbling(spark, copies):
    """Recall and precision on clean blocks of a real table that were garbled here, in a corpus of one and of four times
    its size."""
    d = "/root/testdata/sf0.01"
    blocks = spark.read.parquet(f"{d}/blocks.parquet").where("text is not null").dropDuplicates(["book_id", "block_id"]).select("book_id", "block_id", "text")
    books = spark.read.parquet(f"{d}/books.parquet").select("book_id", "title").limit(0)
    before = {(r.source, r.key) for r in encoding.detect(encoding.records_of(blocks, books), repair=False).collect()}
    # clean texts with at least two words beyond ASCII in a language of Latin script
    rows = [
        (r.book_id, r.block_id, r.text) for r in blocks.where(
            r"text rlike '[à-ÿ].* .*[à-ÿ]' and not text rlike '[\u0400-\u04ff]|&'",
        ).orderBy(F.xxhash64("book_id", "block_id")).limit(160).collect()
    ]
    planted = {}
    for n, (book, block, text) in enumerate(r for r in rows if (r[0], r[1]) not in before):
        wrong, true = CHAINS_PLANTED[n % len(CHAINS_PLANTED)]
        try:
            garbled = text.encode(true).decode(wrong)
        except UnicodeError:
            continue
        if garbled != text:
            planted[book, block] = (garbled, text)
    changed = spark.createDataFrame([(b, k, t) for (b, k), (t, _) in planted.items()], "book_id string, block_id long, new string")
    one = blocks.join(changed, ["book_id", "block_id"], "left").select("book_id", "block_id", F.coalesce("new", "text").alias("text"))
    many = one.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).select(
        F.concat("book_id", F.lit("/"), F.col("copy").cast("string")).alias("book_id"),
        "block_id",
        "text",
    )
    got = {(r.source, r.key): r.restored for r in encoding.detect(encoding.records_of(many, books)).collect()}
    wanted = {(f"{b}/{c}", k): t for (b, k), (_, t) in planted.items() for c in range(copies)}
    old = {(f"{b}/{c}", k) for b, k in before for c in range(copies)}
    hit = got.keys() & wanted.keys()
    assert len(planted) > 80
    assert len(hit) >= 0.95 * len(wanted), sorted(wanted.keys() - got.keys())[:9]
    assert len(got.keys() - wanted.keys() - old) <= 0.05 * len(got)
    wrong = [(wanted[k], got[k]) for k in hit if got[k] != wanted[k]]
    assert len(wrong) <= 0.1 * len(hit), wrong[:5]


# --- languages


def test_labels(spark):
    rows = [
        ("en_GB", "en"),
        ("Português", "pt"),
        ("ger", "de"),
        ("РУССКИЙ", "ru"),
        ("es-MX", "es"),
        (" FR ", "fr"),
        ("und", None),
        ("??", None),
        ("", None),
        (None, None),
        ("x" * 5000, None),
    ]
    df = spark.createDataFrame([(a,) for a, _ in rows], "label string")
    assert [r.l for r in df.select(language.label_language(F.col("label")).alias("l")).collect()] == [b for _, b in rows]


def test_plain_sentences():
    p = bytecnn.plain("Ｏｎｅ <b>two</b> {{0}}. “Three”, says Tru. (см. {{1}}) x\nlast")
    assert [p[a:b].strip() for a, b in bytecnn.sentences(p)] == ["One two .", "“Three”, says Tru.", "(см. ) x", "last"] or len(bytecnn.sentences(p)) >= 3
    long = '<a href="' + "x" * 250 + '">der Hund</a> läuft &CounterClockwiseContourIntegral; heim'
    assert bytecnn.plain(long).split() == ["der", "Hund", "läuft", "heim"]
    assert bytecnn.worth("鍵を売る人は正午に") and bytecnn.worth("מפתח נמכר בצהריים") and bytecnn.worth("यह एक किताब है")
    assert not bytecnn.worth("鍵, 1651")
    assert not bytecnn.worth("Trux Kourt, 1651") and bytecnn.worth("the boat is late") and bytecnn.worth("THE BOAT IS LATE")


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = bytecnn.ByteCnn.fresh(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(1, 200, (4, bytecnn.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(model.forward(x)[np.arange(4), y]).mean()
    grads = model.gradients(x, y)
    for name in ("embed", "f3", "b4", "out", "bias"):
        flat = grads[name].ravel()
        for at in np.argsort(-np.abs(flat))[:3]:
            p = model.p[name].reshape(-1)
            keep, e = p[at], 1e-5
            p[at] = keep + e
            up = loss()
            p[at] = keep - e
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * e) - flat[at]) < 1e-3 * max(1, abs(flat[at]))


def test_held_out_accuracy(spark, small):
    """Trained on half of the books' labelled blocks, right on nearly all sentences of the other half."""
    rows = spark.read.parquet("/root/testdata/sf0.01/blocks.parquet").where("not protected and text is not null").dropDuplicates(["book_id", "block_id"])
    books = language.book_labels(spark.read.parquet("/root/testdata/sf0.01/books.parquet"))
    labelled = rows.join(books.where("labelled is not null"), "book_id").select(
        "text",
        F.col("labelled").alias("language"),
        F.col("book_id").alias("grp"),
        (F.xxhash64("book_id", "block_id") % 2 == 0).alias("train"),
    )
    model = language.train(labelled.where("train"))
    test = labelled.where("not train").toPandas()
    x, y, _ = language.training_rows(list(test.text), list(test.language), list(test.grp))
    right = (model.texts(x).argmax(1) == np.array(y)).mean()
    assert right > 0.9  # labels are wrong for some books


def test_languages_of_blocks(spark):
    texts = {
        "en": "the miller sells the key at noon and the queen waits under the bridge",
        "ru": "мельник продаёт ключ в полдень и королева ждёт под мостом",
        "de": "der müller verkauft den schlüssel am mittag und die königin wartet unter der brücke",
    }
    rows = [(lang, i, texts[lang].capitalize() + f" {i}.", False) for lang in texts for i in range(40)]
    rows += [
        ("en", 100, texts["en"].capitalize() + ". " + texts["ru"].capitalize() + ".", False),
        ("en", 101, texts["ru"], True),
        ("en", 102, None, False),
        ("en", 103, "Trux 12", False),
        ("none", 1, "7", False),
        ("miss", 1, texts["de"], False),
        ("miss", 1, texts["de"], False),
    ]
    blocks = spark.createDataFrame(
        [(*r, "x", "y") for r in rows],
        "book_id string, block_id long, text string, protected boolean, language string, main string",
    )
    books = spark.createDataFrame(
        [("en", "eng"), ("ru", "ru"), ("de", "de-AT"), ("de", "de-AT"), ("none", "en"), ("miss", "fr"), (None, "en")],
        "book_id string, language string",
    )
    by_block = language.block_languages(blocks, books)
    by_book = language.book_languages(books, by_block)
    assert {(r.book_id, r.language) for r in by_book.collect()} == {("en", "en"), ("ru", "ru"), ("de", "de"), ("none", None), ("miss", "de")}
    assert {(r.book_id, r.language) for r in language.label_cases(by_book).collect()} == {("miss", "de")}
    assert {(r.book_id, r.block_id, r.language) for r in language.foreign_segments(by_block, by_book).collect()} == {("en", 100, "ru")}
    assert language.block_languages(blocks.limit(0), books).count() == 0


def test_sure_sentence_beside_an_unsure_one(spark):
    """A sure foreign sentence counts whatever its neighbours; two half sure ones make none together."""
    at = bytecnn.LANGUAGES.index

    def sentence(n, **probs):
        p = np.zeros(len(bytecnn.LANGUAGES), np.float32)
        for k, v in probs.items():
            p[at(k)] = v
        return n, n + 1, "es", float(p[at("es")]), p

    sure, unsure, mixed, weak = dict(es=0.99, pt=0.01), dict(es=0.6, pt=0.39), dict(es=0.75, pt=0.25), dict(es=0.5, pt=0.05, it=0.45)
    cases = {1: [sure, unsure], 2: [unsure, sure], 3: [unsure, unsure], 4: [mixed, weak], 5: [sure], 6: [sure, sure]}
    rows = [("b", i, language.segments_of([sentence(n, **p) for n, p in enumerate(c)])) for i, c in cases.items()]
    by_block = spark.createDataFrame(rows, f"book_id string, block_id long, segments {language.SEGMENTS}")
    by_book = spark.createDataFrame([("b", "pt")], "book_id string, language string")
    got = {r.block_id: (r.start, r.stop, r.language, round(r.confidence, 2)) for r in language.foreign_segments(by_block, by_book).collect()}
    assert got == {1: (0, 2, "es", 0.99), 2: (0, 2, "es", 0.99), 5: (0, 1, "es", 0.99), 6: (0, 2, "es", 0.99)}


# --- queries


COLUMNS = {
    "p1_found": ["state_key", "block_id", "defect"],
    "p2_found": ["book_id", "block_id"],
    "p4_found": ["book_id", "block_id", "language"],
    "p5_found": ["book_id", "block_a", "block_b"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
    rows = got.collect()
    assert rows
    if name.endswith("_found") or name == "p6_ids":
        assert len({tuple(map(str, r)) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, small, name):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
