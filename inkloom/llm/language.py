"""Problem 4: missing or wrong language labels, and segments in another language.

A byte convolutional network is trained on blocks whose book carries a label (a bounded sample; labels wrong for some
books are found and left out by the training itself) and applied to every sentence of every block. A book's language
is the one most of its blocks are written in; a segment is a run of sentences in another one.

Languages beyond those that are told apart make one class, "other"; a book in it whose label names such a language is
no case.

Defined results: blocks that are null, blank, protected, or without words beside names and numbers have no language;
a book without any language has none and is no case; of repeated rows of one key the greatest counts (of a book's
labels: of the rows that agree, any); rows without key are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm import bytecnn as net
from inkloom.session import checked_broadcast, cut, latest_blocks

#: The classifier is fitted on at most so many labelled blocks, chosen by hash, and three sentences of each.
TRAIN_BLOCKS = 9000
TRAIN_SENTENCES = 3
#: Least probability of a sentence's language for it to make a segment, and greatest one of its book's language: of one
#: of the segment's sentences, or on the mean over them.
SURE = 0.7
STILL_MAIN = 0.1

#: Spellings of the languages in labels, beside their two-letter codes.
SPELLINGS = {
    "de": ["deu", "ger", "german", "deutsch"],
    "en": ["eng", "english"],
    "es": ["spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fra", "fre", "french", "français", "francais"],
    "it": ["ita", "italian", "italiano"],
    "pt": ["por", "portuguese", "português", "portugues"],
    "ru": ["rus", "russian", "русский"],
}

#: Codes of other languages that labels may name.
OTHER_CODES = [
    "af", "ar", "bg", "bn", "ca", "cs", "cy", "da", "el", "eo", "et", "eu", "fa", "fi", "ga", "gl", "he", "hi", "hr", "hu", "hy",
    "id", "is", "ja", "ka", "ko", "la", "lt", "lv", "mk", "ms", "mt", "nb", "nl", "nn", "no", "pl", "ro", "sk", "sl", "sq", "sr",
    "sv", "ta", "te", "th", "tr", "uk", "ur", "vi", "zh", "nld", "dut", "pol", "swe", "ces", "jpn", "zho", "chi", "ukr", "ell",
]


def label_language(label: Column) -> Column:
    """The language a label names, by codes, names or regional tags; of other languages their code; null if it names
    none."""
    names = {s: k for k, ss in SPELLINGS.items() for s in [k, *ss]}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    first = F.split_part(F.lower(F.regexp_extract(F.trim(label), r"(?U)^\s*(\w+)", 1)), F.lit("_"), F.lit(1))
    return F.coalesce(F.try_element_at(table, first), F.when(first.isin(*OTHER_CODES), first))


def training_rows(texts: list[str], labels: list[str], groups: list) -> tuple[list[str], list[int], list]:
    x, y, g = [], [], []
    for text, label, group in zip(texts, labels, groups):
        p = net.plain(text)
        kept = [p[a:b] for a, b in net.sentences(p)]
        for s in [s for s in kept if net.worth(s)][:TRAIN_SENTENCES]:
            x.append(s)
            y.append(net.LANGUAGES.index(label))
            g.append(group)
    return x, y, g


def train(labelled: DataFrame, bound: int = TRAIN_BLOCKS) -> net.ByteCnn | None:
    """A network from (text, language, grp) rows; at most ``bound`` of them, by hash, reach the driver."""
    ok = labelled.where(F.col("language").isin(net.LANGUAGES) & F.length("text").between(12, 4000))
    rows = ok.select("text", "language", "grp").orderBy(F.xxhash64("grp", "text"), "language").limit(bound).toArrow()
    x, y, g = training_rows(*(rows.column(c).to_pylist() for c in ("text", "language", "grp")))
    return net.fit(x, y, g, len(net.LANGUAGES)) if x else None


def classify(texts: list[str | None], model: net.ByteCnn) -> list[list[tuple[int, int, str, float, np.ndarray, np.ndarray]]]:
    """For every text its sentences with words: (start, end, language, probability, all probabilities, and the former for
    each language that the sentence is hardly in), by position in the plain text."""
    found, parts, owner = [[] for _ in texts], [], []
    for i, t in enumerate(texts):
        if t:
            p = net.plain(t)
            for a, b in net.sentences(p):
                if net.worth(p[a:b]):
                    parts.append(p[a:b])
                    owner.append((i, a, b))
    probs = model.texts(parts)
    best = probs.argmax(1)
    top = probs.max(1)
    surest = np.where(probs <= np.float32(STILL_MAIN), top[:, None], 0.0)
    for (i, a, b), k, conf, p, s in zip(owner, best.tolist(), top.tolist(), probs, surest):
        found[i].append((a, b, net.CLASSES[k], conf, p, s))
    return found


SEGMENTS = "array<struct<start:int,stop:int,language:string,confidence:double,probs:array<float>,surest:array<double>>>"
STRUCT = pa.list_(
    pa.struct(
        [
            ("start", pa.int32()),
            ("stop", pa.int32()),
            ("language", pa.string()),
            ("confidence", pa.float64()),
            ("probs", pa.list_(pa.float32())),
            ("surest", pa.list_(pa.float64())),
        ],
    ),
)


def segments_of(sentences: list) -> list[dict]:
    """Neighbouring sentences of one language together; confidence and probabilities are means. ``surest`` has, for each
    language that the book may have, the greatest confidence of a sentence that is hardly in that one (0: none is)."""
    out: list[dict] = []
    for a, b, lang, conf, p, *known in sentences:
        surest = known[0] if known else np.where(p <= np.float32(STILL_MAIN), conf, 0.0)
        if out and out[-1]["language"] == lang:
            s = out[-1]
            s["n"] += 1
            s["stop"] = b
            s["confidence"] += (conf - s["confidence"]) / s["n"]
            s["probs"] = s["probs"] + (p - s["probs"]) / s["n"]
            s["surest"] = np.maximum(s["surest"], surest)
        else:
            out.append({"start": a, "stop": b, "language": lang, "confidence": conf, "probs": p, "surest": surest, "n": 1})
    return [{k: (v.tolist() if k in ("probs", "surest") else v) for k, v in s.items() if k != "n"} for s in out]


def block_languages(blocks: DataFrame, books: DataFrame, bound: int = TRAIN_BLOCKS) -> DataFrame:
    """(book_id, block_id, language, confidence, segments) of every unprotected block."""
    spark = blocks.sparkSession
    usable = latest_blocks(blocks, "text", "protected").where(~F.coalesce("protected", F.lit(False)) & F.col("text").isNotNull()).select("book_id", "block_id", "text")
    labels = book_labels(books).where("labelled is not null").select("book_id", F.col("labelled").alias("language"))
    model = train(usable.join(labels, "book_id").withColumn("grp", F.col("book_id")), bound)
    if model is None:
        return spark.createDataFrame([], f"book_id string, block_id long, language string, confidence double, segments {SEGMENTS}")
    shared = checked_broadcast(spark, model, sum(v.nbytes for v in model.p.values()))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                got = classify(part.column("text").to_pylist(), shared.value)
                lang, conf = [], []
                for sents in got:
                    mean = np.mean([s[4] for s in sents], axis=0) if sents else None
                    lang.append(None if mean is None else net.CLASSES[int(mean.argmax())])
                    conf.append(None if mean is None else float(mean.max()))
                columns = [
                    part.column("book_id"),
                    part.column("block_id"),
                    pa.array(lang, pa.string()),
                    pa.array(conf, pa.float64()),
                    pa.array([segments_of(s) for s in got], STRUCT),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["book_id", "block_id", "language", "confidence", "segments"])

    return cut(usable.mapInArrow(run, f"book_id string, block_id long, language string, confidence double, segments {SEGMENTS}"))


def book_labels(books: DataFrame) -> DataFrame:
    """(book_id, label, labelled): the label in the file and the language it names."""
    one = books.where("book_id is not null").groupBy("book_id").agg(F.max("language").alias("label"))
    return one.withColumn("labelled", label_language(F.col("label")))


def book_languages(books: DataFrame, by_block: DataFrame) -> DataFrame:
    """(book_id, label, labelled, language, confidence): the language most blocks are in, and their share of it."""
    n = by_block.where("language is not null").groupBy("book_id", "language").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("book_id").agg(F.max(F.struct("n", "language")).alias("m"), F.sum("n").alias("all"))
    main = main.select("book_id", F.col("m.language").alias("language"), (F.col("m.n") / F.col("all")).alias("confidence"))
    return book_labels(books).join(main, "book_id", "left")


def foreign_segments(by_block: DataFrame, by_book: DataFrame) -> DataFrame:
    """(book_id, block_id, start, stop, language, confidence) of the segments in another language than their book's;
    where the mean over a segment is not sure, the confidence is that of its surest sentence."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(net.CLASSES) for x in (k, i)])
    main = by_book.where("language is not null").select("book_id", F.col("language").alias("main"))
    s = by_block.select("book_id", "block_id", F.explode("segments").alias("s"))
    other = s.join(main, "book_id").where(F.col("s.language") != F.col("main"))
    place = order[F.col("main")]
    mean = F.when((F.col("s.confidence") >= SURE) & (F.col("s.probs")[place] <= STILL_MAIN), F.col("s.confidence"))
    one = F.when(F.col("s.surest")[place] >= SURE, F.col("s.surest")[place])
    found = other.select("book_id", "block_id", "s.start", "s.stop", "s.language", F.coalesce(mean, one).alias("confidence"))
    return found.where("confidence is not null")


def named(rows: DataFrame) -> DataFrame:
    """Those in one of the languages that are told apart."""
    return rows.where(F.col("language").isin(net.LANGUAGES))


def label_cases(by_book: DataFrame) -> DataFrame:
    return by_book.where("language is not null and (labelled is null or labelled <> language)")
