"""The pN_ queries. Each takes (spark, sf_dir) and runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import bpe, canonical, encoding, language, mixing, packing, pairs, spans
from inkloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "translation_state"), table(spark, sf_dir, "runs"), table(spark, sf_dir, "blocks"))


def garbled(spark: SparkSession, sf_dir: str, repair: bool) -> DataFrame:
    return encoding.detect(encoding.records_of(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "books")), repair)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(spark, sf_dir, repair=False).select(F.col("source").alias("book_id"), F.col("key").alias("block_id"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(spark, sf_dir, repair=True).withColumnsRenamed({"source": "book_id", "key": "block_id"})


def languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Languages by block and by book."""
    books = table(spark, sf_dir, "books")
    by_block = language.block_languages(table(spark, sf_dir, "blocks"), books)
    return by_block, language.book_languages(books, by_block)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_block, by_book = languages(spark, sf_dir)
    labels = language.named(language.label_cases(by_book)).select("book_id", F.lit(-1).cast("long").alias("block_id"), "language")
    mixed = language.named(language.foreign_segments(by_block, by_book)).select("book_id", "block_id", "language").distinct()
    return labels.unionByName(mixed)


def p4_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, sf_dir)[1]


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.foreign_segments(*languages(spark, sf_dir))


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.plan_batches(table(spark, sf_dir, "runs"), table(spark, sf_dir, "blocks"), table(spark, sf_dir, "providers"))


def p3_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(table(spark, sf_dir, "runs"), table(spark, sf_dir, "blocks"), table(spark, sf_dir, "providers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, sf_dir, "blocks"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_classes(table(spark, sf_dir, "blocks"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_blocks(table(spark, sf_dir, "blocks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by number of tokens and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents")
    ids = bpe.encode_corpus(docs)
    back = bpe.decode_corpus(ids).withColumnRenamed("text", "decoded")
    both = bpe.one_text(docs).join(back, "doc_id")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return both.select("doc_id", F.length("decoded").cast("long").alias("n_chars"), same.alias("same"))


def mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plans"), table(spark, sf_dir, "mix_targets"))


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).counts()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).shares()


def p7_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).sequence()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_spans(spark, sf_dir).select("doc_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.coverage(docs, spans.shared_spans(docs))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found,
        p2_found,
        p2_restored,
        p3_batches,
        p3_fill,
        p4_found,
        p4_books,
        p4_segments,
        p5_found,
        p5_classes,
        p5_canonical,
        p6_ids,
        p6_round_trip,
        p7_uses,
        p7_shares,
        p7_sequence,
        p8_found,
        p8_spans,
        p8_coverage,
    )
}

#: SQL: all 200-character windows, and those that stand in two documents.
WINDOWS = """WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, i, text[i:i + 199] AS s FROM d, unnest(range(1, length(text) - 198)) AS t(i) WHERE length(text) >= 200),
k AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)), h AS (SELECT doc_id, i FROM w JOIN k USING (s))"""



def fold_table() -> str:
    """SQL: a table of the characters beyond ASCII that have another form."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(ch, "".join(c for c, _, _ in parts)) for ch, parts in canonical.tables()[0]]
    names, values = (", ".join(map(quoted, x)) for x in zip(*[(a, b) for a, b in rows if a != b and a > "~"]))
    return f"fold AS (SELECT unnest([{names}]) AS k, unnest([{values}]) AS v)"


FORMS = rf"""WITH {fold_table()},
b AS (SELECT book_id, block_id, max(struct_pack(text := text, protected := protected)) AS r FROM blocks WHERE book_id IS NOT NULL AND block_id IS NOT NULL GROUP BY book_id, block_id),
x AS (SELECT book_id, block_id, r.text AS text, r.protected AS protected FROM b),
c AS (SELECT book_id, block_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM x WHERE text IS NOT NULL),
f AS (SELECT book_id, block_id, trim(nfc_normalize(string_agg(coalesce(v, c), '' ORDER BY i)), ' ') AS form FROM c LEFT JOIN fold ON k = c GROUP BY book_id, block_id),
u AS (SELECT x.book_id, x.block_id, x.text, f.form FROM x JOIN f USING (book_id, block_id) WHERE NOT coalesce(protected, false) AND form <> ''
  AND NOT regexp_full_match(text, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*'))"""

#: What SQL can say of these operators on whole tables; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "p5_canonical": FORMS + " SELECT x.book_id, x.block_id, CASE WHEN x.text = '' THEN '' ELSE f.form END AS canonical FROM x LEFT JOIN f USING (book_id, block_id)",
    "p5_found": FORMS + " SELECT a.book_id, a.block_id AS block_a, z.block_id AS block_b FROM u a JOIN u z ON a.book_id = z.book_id AND a.form = z.form AND a.block_id < z.block_id AND a.text <> z.text",
    "p5_classes": FORMS
    + """, t AS (SELECT book_id, form, text, min(block_id) AS variant, count(*) AS n FROM u GROUP BY ALL),
    k AS (SELECT book_id, form, min(variant) AS representative, sum(n)::BIGINT AS blocks, count(*) AS variants FROM t GROUP BY ALL HAVING count(*) > 1)
    SELECT u.book_id, u.block_id, k.representative, t.variant, k.blocks, k.variants FROM u JOIN k USING (book_id, form) JOIN t USING (book_id, form, text)""",
    "p6_round_trip": (
        "SELECT doc_id, coalesce(length(max(text)), 0)::BIGINT AS n_chars, true AS same FROM documents WHERE doc_id IS NOT NULL"
        " GROUP BY doc_id"
    ),
    "p8_found": WINDOWS + " SELECT DISTINCT doc_id FROM h",
    "p8_coverage": WINDOWS
    + """, g AS (SELECT doc_id, sum(least(200, coalesce(i - before, 200)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(g.n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(g.n, 0) / length(d.text) ELSE 0 END AS share FROM d LEFT JOIN g USING (doc_id)""",
}
