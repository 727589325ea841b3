"""Packing, encoding, mixing, shared spans and canonical text against brute force, with their edge cases."""

from __future__ import annotations

import math
import random
import unicodedata as ud

import pytest
from pyspark.sql import functions as F

from inkloom.llm import bpe, canonical, counting, mixing, packing, spans

DOCS = "doc_id long, text string, source string, tokens int, h long, block int"


def documents(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, 0, 0, 0) for i, t, s in rows], DOCS)


# --- packing


def check_packing(items, got, cap, most):
    sizes, counts = {}, {}
    for r in got:
        k = (r.grp, r.batch_id)
        sizes[k] = sizes.get(k, 0) + r.size
        counts[k] = counts.get(k, 0) + 1
    assert cap is None or max(sizes.values()) <= cap
    assert most is None or max(counts.values()) <= most
    back = {}
    for r in got:
        back[r.grp, r.item] = back.get((r.grp, r.item), 0) + r.size
    assert back == {(g, i): s for g, i, s in items}
    for g in {g for g, _, _ in items}:
        ids = {b for gg, b in sizes if gg == g}
        assert ids == set(range(len(ids)))
    return len(sizes)


@pytest.mark.parametrize(("cap", "most", "chunk"), [(100, None, 4096), (100, 7, 16), (None, 5, 16), (None, None, 16), (100, 7, 4096), (0, None, 64)])
def test_packing(spark, cap, most, chunk):
    rnd = random.Random(1)
    items = [("hot", str(i), rnd.randint(1, 60)) for i in range(300)] + [("one", "x", 250), ("two", "a", 100), ("two", "b", 100)]
    df = spark.createDataFrame([(*i, cap, most, 9) for i in items], "grp string, item string, size long, cap long, max_n long, chunks int")
    limit = cap if cap else None
    n = check_packing(items, packing.pack_items(df, chunk_items=chunk, fan=4).collect(), limit, most)
    if limit and most is None:
        assert n <= math.ceil(sum(s for g, _, s in items if g == "hot") / cap) * 1.06 + 3 + 2


def test_only_oversized_items_are_split():
    assert packing.best_fit([5, 5], [1, 1], 10, math.inf) == [[0, 1]]
    assert packing.even_fit([9, 9, 9], [1, 1, 1], 10, math.inf, 2) is None
    assert packing.pack([], [], 10, 3) == []


def test_plan_batches_edges(spark):
    runs = spark.createDataFrame(
        [("s", "b", "p"), ("s", "b", "p"), ("t", "b", None), (None, "b", "p"), ("u", "none", "p")],
        "state_key string, book_id string, provider_id string",
    )
    blocks = spark.createDataFrame(
        [
            ("b", 1, "x" * 25, False),
            ("b", 1, "x" * 25, False),
            ("b", 2, None, False),
            ("b", 3, " ", False),
            ("b", 4, "code", True),
            ("b", 5, "y", None),
        ],
        "book_id string, block_id long, text string, protected boolean",
    )
    providers = spark.createDataFrame([("p", 10, None), ("p", 10, None)], "provider_id string, max_batch_chars int, max_batch_items int")
    got = packing.plan_batches(runs, blocks, providers).orderBy("state_key", "block_id", "piece").collect()
    assert [(r.state_key, r.block_id, r.piece, r.start, r.n_chars) for r in got] == [
        ("s", 1, 0, 0, 10),
        ("s", 1, 1, 10, 10),
        ("s", 1, 2, 20, 5),
        ("s", 5, 0, 0, 1),
        ("t", 1, 0, 0, 25),
        ("t", 5, 0, 0, 1),
    ]
    assert packing.plan_batches(runs.limit(0), blocks, providers).count() == 0
    assert packing.plan_batches(runs, blocks.limit(0), providers).count() == 0


# --- encoding


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoding_equals_the_library(spark):
    texts = [
        "",
        " ",
        "Hello  world's\n\n\tx",
        "<|endoftext|> a",
        "é è ﬁ 漢字 😀 ́",
        "a" * 3000,
        "=" * 2001 + " " * 1500 + "z",
        "aaa aaaa aaaaa",
        "x\r\ny\u0085z",
        "1234567 ١٢٣",
        "{" * 40,
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, "", "s"), (50, None, "s"), (None, "lost", "s")]
    docs = documents(spark, rows)
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(docs).collect()}
    assert got == dict(enumerate(library_ids(texts))) | {50: []}
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(docs)).collect()}
    assert back == dict(enumerate(texts)) | {50: ""}
    assert bpe.encode_corpus(docs.limit(0)).count() == 0


# --- mixing


def test_mixture(spark):
    rnd = random.Random(2)
    words = "the of and lamp harbour queen".split()
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 40))), "big") for i in range(400)] + [(1000 + i, "a b c", "small") for i in range(5)] + [
        (2000, "x y", None),
        (2001, None, "big"),
        (2002, "", "small"),
        (1000, "a b c", "small"),
    ]
    docs = documents(spark, rows)
    plans = spark.createDataFrame([("p", 0.5, "byte_bpe_50k")], "plan_id string, size_ratio double, tokenizer string")
    targets = spark.createDataFrame(
        [("p", "big", 0.7, 2), ("p", "small", 0.2, 3), ("p", "ghost", 0.1, 1), ("q", "big", 1.0, 1)],
        "plan_id string, source string, target_share double, max_repeats int",
    )
    m = mixing.Mixture(docs, plans, targets, block_tokens=125, shard_tokens=1000)
    assert m.blocks > 20
    uses = m.counts().collect()
    assert len(uses) == 408 and {r.doc_id: r.times for r in uses}[2000] == 0
    assert max(r.times for r in uses if r.source == "small") == 3
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].reached_of_target - 1) < 0.01
    assert shares["ghost"].tokens == 0 and shares["small"].tokens == 3 * shares["small"].source_tokens
    seq = m.sequence().collect()
    count = {}
    for r in seq:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {r.doc_id: r.times for r in uses if r.times}
    assert len({(r.doc_id, r.copy) for r in seq}) == len(seq)
    assert len({r.shard for r in seq}) == math.ceil(0.5 * m.total["byte_bpe_50k"] / 1000)
    coarse = {r.source: r for r in mixing.Mixture(docs, plans, targets, block_tokens=10**9).shares().collect()}
    assert abs(coarse["big"].reached_of_target - 1) < 0.01


def test_plan_of_many_blocks_takes_no_time_squared(spark):
    import time

    docs = spark.range(60_000).selectExpr("id doc_id", "'a' text", "if(id % 3 = 0, 's', 't') source")
    plans = spark.createDataFrame([("p", 0.5, "byte_bpe_50k")], "plan_id string, size_ratio double, tokenizer string")
    targets = spark.createDataFrame(
        [("p", "s", 0.5, 1), ("p", "t", 0.5, 1)],
        "plan_id string, source string, target_share double, max_repeats int",
    )
    began = time.time()
    m = mixing.Mixture(docs, plans, targets, block_tokens=1)
    assert m.blocks == 60_000
    assert {(r.source, r.tokens) for r in m.shares().collect()} == {("s", 15_000), ("t", 15_000)}
    assert time.time() - began < 60


def test_frame_of_parts_keeps_every_row(spark):
    import numpy as np

    parts = [("p", s, np.array([*range(n), -1]), np.arange(n + 1)) for s, n in (("a", 5), ("b", 0), ("c", 3))]
    parts.insert(1, ("p", "none", np.zeros(0, int), np.zeros(0, int)))
    got = mixing.frame_of(spark, parts, "plan_id string, source string, block int, copy int")
    want = sorted((p, s, int(b), int(c)) for p, s, bs, cs in parts for b, c in zip(bs, cs))
    assert sorted((r.plan_id, r.source, -1 if r.block is None else r.block, r.copy) for r in got.collect()) == want
    assert mixing.frame_of(spark, [], "plan_id string, source string, block int").count() == 0


def tokenizer_counts():
    files = {n: (f.name, f.read_bytes()) for n in ("byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k") for f in [mixing.tokenizer_file(n)]}
    return files, counting.Counts(files, {n: counting.form_of(*x) for n, x in files.items()})


def test_counts_by_units_equal_the_libraries():
    _, counts = tokenizer_counts()
    assert list(counts.by_unit) == list(counts.whole)
    rnd = random.Random(3)
    parts = [*" \t\n\r'\"stmdlvreSTaZ_09.,([{<|>-é中²½ßİΣςK", "  ", "\n\n", "\n    ", "    ", "'s", " 'Ve", "'ſ", "the", " return", "don't"]
    parts += ["<|endoftext|>", "<s>", "<0x0A>", "a" * 60, "e\u0301", "\u0301", "\u0345", "\xa0", "\u3000", "\u2581", "\x00", "\x1c", "\x85", "😀", "\u200d", "\ufeff"]
    plain = [p for p in parts if not counting.ODD.search(p)]
    texts = [""] + ["".join(rnd.choices(pool, k=rnd.randint(0, 14))) for pool in (parts, plain, plain) for _ in range(5000)]
    got = counts(texts)
    for n, whole in counts.whole.items():
        assert [t for t, a, b in zip(texts, got[n], whole(texts)) if a != b] == []


def test_counts_of_long_texts_and_full_memory(monkeypatch):
    monkeypatch.setattr(counting, "STRIDE", 50)
    monkeypatch.setattr(counting, "KEPT_UNITS", 30)
    _, counts = tokenizer_counts()
    rnd = random.Random(4)
    texts = ["  lead", "", *(" ".join(f"{rnd.choice('ab')}{rnd.randint(0, 99)}-x" for _ in range(n)) for n in (5, 400, 0, 900, 1, 20))]
    for _ in range(3):
        got = counts(texts)
        assert len(counts.now) <= 30 + 50 * len(texts)
        for n, whole in counts.whole.items():
            assert got[n] == whole(texts)


def test_known_words_cost_no_library_call():
    files, counts = tokenizer_counts()
    counts(["the lamp and the harbour"])
    counts.by_unit = dict.fromkeys(files)  # nothing to call
    text = "the harbour and the lamp and"
    assert counts([text]) == {n: whole([text]) for n, whole in counts.whole.items()}


def test_tokenizers_of_another_form_count_whole_texts():
    import json

    files, _ = tokenizer_counts()
    name, blob = files["word_bpe_49k"]
    other = json.loads(blob)
    other["normalizer"] = None
    changed = {"other": (name, json.dumps(other).encode())}
    assert counting.form_of(*changed["other"]) is None
    counts = counting.Counts(changed, {"other": None})
    assert counts(["Ab  cd", ""])["other"] == counts.whole["other"](["Ab  cd", ""])


def test_mixture_of_nothing(spark):
    docs = documents(spark, [(1, "a", "s")]).limit(0)
    plans = spark.createDataFrame([("p", 0.5, "byte_bpe_50k")], "plan_id string, size_ratio double, tokenizer string")
    targets = spark.createDataFrame([("p", "s", 1.0, 1)], "plan_id string, source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, plans, targets)
    assert m.counts().count() == 0 and m.shares().head().tokens == 0


def test_splitting_tree_is_exact():
    import numpy as np

    quotas = np.array([7, 0, 100, 3])
    got = mixing.split_tree(quotas, 5, np.random.default_rng(1))
    assert got.shape == (5, 4) and (got.sum(0) == quotas).all() and got.sum(1).max() - got.sum(1).min() <= 3


# --- spans


def brute_spans(docs, k):
    """Covered characters of every document, by all windows."""
    where = {}
    for i, t in docs.items():
        for a in range(len(t) - k + 1):
            where.setdefault(t[a : a + k], set()).add(i)
    out = {}
    for i, t in docs.items():
        hit = set()
        for a in range(len(t) - k + 1):
            if len(where[t[a : a + k]]) > 1:
                hit |= set(range(a, a + k))
        if hit:
            out[i] = len(hit)
    return out


def test_shared_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    noise = lambda n: "".join(rnd.choices("abcdefghij é漢😀", k=n))
    common, other = noise(90), noise(45)
    docs = {i: noise(rnd.randint(0, 120)) for i in range(40)}
    for i in range(0, 30):  # a hot passage
        docs[i] += common[rnd.randint(0, 30) :] + noise(20)
    docs[31] += other + noise(9) + other  # repeated within one record only
    docs[32], docs[33] = noise(10) + common[:40], common[:39] + "~"  # just long enough, and just not
    docs[34], docs[35] = "=" * 300, "=" * 41 + noise(5)
    rows = [(i, t, "s") for i, t in docs.items()] + [(0, docs[0], "s"), (90, None, "s"), (91, "", "s"), (None, common * 3, "s")]
    table = documents(spark, rows)
    want = brute_spans(docs, 40)
    got = spans.shared_spans(table, batches=3, min_chars=40, gram=20)
    cover = {r.doc_id: r.shared_chars for r in spans.coverage(table, got).collect()}
    assert {i: n for i, n in cover.items() if n} == want
    assert cover[90] == 0 and len(cover) == 42
    for r in got.collect():
        assert docs[r.doc_id][r.start : r.start + r.n_chars] == docs[r.other_id][r.other_start : r.other_start + r.n_chars] and r.doc_id != r.other_id
    assert spans.shared_spans(table.limit(0), min_chars=40, gram=20).count() == 0


def test_index_is_incremental(spark):
    a = spark.createDataFrame([(1, "x" + "abcdefghij" * 6), (2, "q" * 30)], "doc_id long, text string")
    b = spark.createDataFrame([(3, "abcdefghij" * 6 + "y")], "doc_id long, text string")
    index = spans.SpanIndex(spark, min_chars=40, gram=20)
    assert index.append(a).count() == 0
    assert {r.doc_id for r in index.append(b).collect()} == {1, 3}
    assert len(index.runs()) == 1  # compacted
    again = spans.SpanIndex(spark, index.path, min_chars=40, gram=20)  # as another session would open it
    assert again.runs() == index.runs() and again.buckets == index.buckets
    with pytest.raises(ValueError):
        spans.SpanIndex(spark, index.path, min_chars=50, gram=20)
    assert again.append(spark.createDataFrame([(5, "zz" + "abcdefghij" * 5)], "doc_id long, text string")).select("doc_id").distinct().count() == 3
    met = index.table(index.runs()[0])
    plan = met.join(met.select("h").distinct().hint("merge"), "h", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert index.append(spark.createDataFrame([(4, "abcdefghij" * 5)], "doc_id long, text string")).select("doc_id").distinct().count() == 3


def test_window_hashes_depend_on_content_only():
    import numpy as np

    c = np.frombuffer("zzabcabcabc".encode("utf-32-le"), np.uint32)
    h = spans.window_hashes(c, 3, spans.BASES[0])
    assert h[2] == h[5] == h[8] and h[2] != h[3] and len(spans.window_hashes(c, 12, spans.BASES[0])) == 0
    assert list(spans.sliding_min(np.array([5, 3, 4, 1, 9], np.uint64), 3)) == [3, 1, 1]


# --- canonical text


def brute_canonical(t):
    return ud.normalize("NFC", ud.normalize("NFD", "".join(canonical.folded(c) for c in t))).strip(" ")


SAMPLES = [
    "ẹ́x", "한A", "각 각", "̣́", "q̣̇", "ＡＢ　ｃ", "ﬁ ﬂ ﬆ", "x²½…–—", "​", "Й Й ё ё", "Å Å", "ế ế", "𝐀😀é", "ো", " a\nb\t ", "ǖ ṻ", "à֮̕b",
    "", " ", "plain", "e​́", "а͏b", "‐‑－-", "é" * 500, "​a", "ｶﾞ",
]


def test_canonical_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)] + [(99, None)], "k int, text string")
    got = {r.k: r.canonical for r in canonical.canonical_texts(df, ["k"]).collect()}
    assert got == {i: brute_canonical(t) for i, t in enumerate(SAMPLES)} | {99: None}


def test_look_alike_pairs(spark):
    rows = [
        ("b", 1, "The café", False), ("b", 1, "The café", False), ("b", 2, "The cafe\u0301", False), ("b", 3, "Ｔhe café", False), ("b", 4, "The café", False),
        ("b", 5, "The cafe", False), ("b", 6, "The café!", False), ("b", 7, "the café", False), ("b", 8, "The café", True), ("c", 9, "The café", False),
        ("b", 10, None, False), ("b", 11, " ", False), ("b", 12, " ", False), ("b", 13, "​", False), ("b", None, "The café", False), ("b", 14, "x²", None), ("b", 15, "x2", None), ("b", 16, "a–b", False), ("b", 17, "a-b", False), ("b", 18, "a‑b", False),
    ]
    df = spark.createDataFrame(
        [(*r, 0, "x") for r in rows],
        "book_id string, block_id long, text string, protected boolean, cluster int, canonical string",
    )
    got = {(r.book_id, r.block_a, r.block_b) for r in canonical.look_alike_pairs(df).collect()}
    assert got == {("b", 1, 2), ("b", 1, 3), ("b", 2, 3), ("b", 2, 4), ("b", 3, 4), ("b", 17, 18)}
    assert canonical.look_alike_pairs(df.limit(0)).count() == 0
    classes = {r.block_id: (r.representative, r.variant, r.blocks, r.variants) for r in canonical.look_alike_classes(df).collect()}
    assert classes == {1: (1, 1, 4, 3), 2: (1, 2, 4, 3), 3: (1, 3, 4, 3), 4: (1, 1, 4, 3), 17: (17, 17, 2, 2), 18: (17, 18, 2, 2)}
