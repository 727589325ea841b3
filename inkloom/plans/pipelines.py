"""Queries over whole pipelines: archives, segmentation, translation runs, streams, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import json as J
from inkloom.functions import messages
from inkloom.functions.placeholders import mask_udf, protect_udf, restore_udf, unmask_udf
from inkloom.operators import loop, run, sequence
from inkloom.plans import samples
from inkloom.plans.catalog import B, BATCH_TOKENS, BOOK_ITEMS, OPEN, SAMPLE_CHAPTERS, SAMPLE_CHARS, blocks, open_blocks, packed_sql, query, token_packed
from inkloom.session import scratch, ship, stored, table
from inkloom.sources import epub
from inkloom.streaming import progress


def library(spark, d) -> DataFrame:
    """An archive for every book of the tables."""
    return stored(epub.archives_from_blocks(blocks(spark, d), table(spark, d, "books")), "library")


@query(f"WITH {B} SELECT b.book_id, count(*) AS blocks, count(DISTINCT chapter_idx) AS chapters, true AS readable FROM b GROUP BY b.book_id")
def epub_round_trip(spark, d):
    """Archives written from the blocks, read again and segmented; as many blocks and chapters come out."""
    files = library(spark, d)
    books = epub.read_archives(files).withColumn("book_id", F.regexp_extract("file", r"^(.*)\.epub$", 1))
    segments = epub.segment_chapters(epub.book_chapters(books)).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_distinct("chapter_idx").alias("chapters"),
    )
    return segments.join(books.select("book_id", F.col("error_class").isNull().alias("readable")), "book_id")


@query(
    f"WITH {B} SELECT book_id, count(DISTINCT chapter_idx) + 4 AS entries, count(DISTINCT chapter_idx) AS spine,"
    f" count(DISTINCT chapter_idx) AS labels, true AS contiguous FROM b GROUP BY book_id",
)
def epub_entries(spark, d):
    """Entries, spine and labels of the archives; byte ranges follow each other."""
    books = epub.read_archives(library(spark, d))
    e = F.sort_array(F.transform("entries", lambda x: F.struct(x["start"], x["stop"])))
    joined = F.forall(F.arrays_zip(F.slice(e, 1, F.size(e) - 1).alias("a"), F.slice(e, 2, F.size(e)).alias("b")), lambda z: z["a"]["stop"] == z["b"]["start"])
    return books.select(
        F.regexp_extract("file", r"^(.*)\.epub$", 1).alias("book_id"),
        F.size("entries").cast("long").alias("entries"),
        F.size("spine").cast("long").alias("spine"),
        F.size("labels").cast("long").alias("labels"),
        joined.alias("contiguous"),
    )


@query(
    f"WITH {B} SELECT book_id, count(*) FILTER (WHERE {OPEN}"
    f" AND kind NOT IN ('titulo', 'item_lista', 'citacao', 'codigo')) AS changed FROM b GROUP BY book_id",
)
def epub_translated(spark, d):
    """All paragraphs are marked in the archive, which is written and read again."""
    import pyarrow as pa

    ship(spark)

    def mark(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                book = epub.read_book(content)
                texts = {
                    c["path"]: [
                        "TR: " + b["text"] if b["kind"] == "paragrafo" and not b["protected"] and b["text"].strip() else None for b in epub.markup.segment(c["html"])
                    ] for c in book["chapters"]
                }
                yield pa.RecordBatch.from_pylist([{"path": path, "content": epub.translated(content, texts, "pt", stamp="2024-01-01T00:00:00Z")}])

    done = library(spark, d).select("path", "content").mapInArrow(mark, "path string, content binary")
    books = epub.read_archives(done).withColumn("book_id", F.regexp_extract("file", r"^(.*)\.epub$", 1))
    segments = epub.segment_chapters(epub.book_chapters(books))
    return segments.groupBy("book_id").agg(F.count_if((F.col("kind") == "paragrafo") & F.col("text").startswith("TR: ")).alias("changed"))


#: SQL: the number of a book's id.
NUMBER = "regexp_extract(book_id, '([0-9]+)$', 1)::INT"


@query(
    f"""WITH {B}, n AS (SELECT book_id, count(DISTINCT chapter_idx) AS n, {NUMBER} % 9 AS k FROM b GROUP BY book_id)
    SELECT book_id, CASE WHEN k = 1 THEN 'not_epub' WHEN k = 5 THEN 'drm' WHEN k IN (2, 3, 4, 7) THEN 'malformed' END AS error_class,
      CASE WHEN k IN (0, 6, 8) THEN n END AS chapters, CASE WHEN k IN (0, 8) THEN n WHEN k = 6 THEN n + 1 END AS spine, k IN (0, 2, 3, 6, 8) AS mended FROM n"""
)
def epub_cases(spark, d):
    """Archives damaged in nine ways are told apart, and rebuilt where that can be done."""
    damaged = samples.damaged(library(spark, d))
    books = epub.read_archives(damaged)
    mended = samples.mended(damaged)
    rows = books.select(
        F.regexp_extract("file", r"^(.*)\.epub$", 1).alias("book_id"),
        "error_class",
        F.size("chapters").cast("long").alias("n"),
        F.size("spine").cast("long").alias("m"),
    )
    good = F.col("error_class").isNull()
    return rows.join(mended, "book_id").select(
        "book_id",
        "error_class",
        F.when(good, F.col("n")).alias("chapters"),
        F.when(good, F.col("m")).alias("spine"),
        "mended",
    )


@query(
    f"""WITH {B}, n AS (SELECT book_id, count(DISTINCT chapter_idx) AS n, {NUMBER} % 2 AS k FROM b GROUP BY book_id)
    SELECT book_id, n + 1 AS chapters, array_to_string(list_transform(range(n), lambda i: 'Label ' || (i + 1)), '|') AS labels, k = 0 AS second_changed,
      'Glossário' AS appendix, 'lamp' AS term, 'lâmpada' AS translation, 'Title of ' || book_id AS title, 'pt' AS language, '2024-05-06T07:08:09Z' AS modified FROM n"""
)
def epub_contents(spark, d):
    """New labels in both tables of contents (the second kept where it has another number of
    them), an appendix, title, language and date, written and read again."""
    return samples.relabelled(library(spark, d))


@query(f"WITH {B} SELECT book_id, true AS same, true AS kept FROM b GROUP BY book_id")
def epub_saved(spark, d):
    """Archives as files, read again from their folder; writing them once more changes none."""
    files = library(spark, d)
    folder = scratch(spark, "books").removeprefix("file://").removeprefix("file:")
    first = stored(epub.save_archives(files, folder), "saved")
    again = stored(epub.save_archives(files, folder), "saved")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(f"file://{folder}").select(
        F.element_at(F.split("path", "/"), -1).alias("path"),
        F.sha2("content", 256).alias("digest"),
    )
    want = files.select("path", F.sha2("content", 256).alias("want"))
    rows = want.join(read, "path", "left").join(first.select("path", F.col("bytes").alias("a")), "path").join(again.select("path", F.col("bytes").alias("b")), "path")
    return rows.select(
        F.regexp_extract("path", r"^(.*)\.epub$", 1).alias("book_id"),
        (F.col("want") == F.col("digest")).alias("same"),
        (F.col("a") == F.col("b")).alias("kept"),
    )


@query(f"WITH {B} SELECT book_id, block_id, true AS masked_back, true AS restored FROM b WHERE text IS NOT NULL")
def reversible_masks(spark, d):
    """Protecting names of tags and masking markup, and back; every text must come back."""
    ship(spark)
    rows = blocks(spark, d).where("text is not null").select("book_id", "block_id", "text")
    words = F.slice(F.array_distinct(F.split("text", " ")), 1, 5)
    m = rows.withColumn("m", mask_udf("text")).withColumn("p", protect_udf("text", words))
    return m.select(
        "book_id",
        "block_id",
        (unmask_udf("m.masked", "m.kept", "m.gaps") == F.col("text")).alias("masked_back"),
        (restore_udf("p.template", "p.protected") == F.col("text")).alias("restored"),
    )


@query(f"WITH {B} SELECT book_id, block_id, 'TR: ' || text AS text FROM b WHERE {OPEN}")
def translated_run(spark, d):
    """All open blocks through a deterministic translator that loses tags, and masks them then, batch by batch."""
    batches = token_packed(spark, d).select(F.col("grp").alias("state_key"), F.col("pos").alias("block_id"), "batch")
    rows = batches.join(open_blocks(spark, d).select(F.col("book_id").alias("state_key"), "block_id", "text"), ["state_key", "block_id"])
    return run.translate_batches(rows, run.Degrading(run.Tagless())).where("error_class is null").select(F.col("state_key").alias("book_id"), "block_id", "text")


@query(
    "SELECT state_key, count(*) AS batches, sum(b)::BIGINT AS blocks, sum(c)::BIGINT AS characters"
    " FROM (SELECT state_key, batch_id, max(blocks) AS b, max(characters) AS c FROM usage_log GROUP BY ALL) GROUP BY state_key",
)
def usage_stream(spark, d):
    """Usage taken up as a stream with one durable write an epoch."""
    return progress.usage_stream(spark, f"{d}/usage_log.parquet").groupBy("state_key").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("blocks").alias("blocks"),
        F.sum("characters").alias("characters"),
    )


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Z1 as an extension: events by day, with a watermark."""
    got = progress.windowed_events(spark, f"{d}/events.parquet", late="3650 days")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


@query(
    "SELECT DISTINCT state_key, path, block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY state_key, block_id"
    " ORDER BY saved_at DESC, text DESC NULLS LAST, batch_id DESC, path DESC) AS n FROM translation_state) WHERE n = 1"
    " AND text IS NOT NULL AND path IS NOT NULL",
)
def state_documents(spark, d):
    """State written as JSON documents, a path at a time, and read back; broken entries are dropped."""
    rows = sequence.latest_state(table(spark, d, "translation_state")).where("path is not null")
    entry = F.collect_list(F.struct(F.col("block_id").cast("string").alias("k"), "text"))
    docs = rows.where("text is not null").groupBy("state_key", "path").agg(F.map_from_entries(entry).alias("m"))
    dirty = F.map_concat("m", F.create_map(F.lit("not a number"), F.lit("x")))
    body = docs.select("state_key", F.to_json(F.struct(F.create_map("path", dirty).alias("translations"))).alias("body"))
    return body.select("state_key", F.explode(J.saved_texts(F.col("body"))).alias("e")).select("state_key", "e.path", "e.block_id", "e.text")


@query(
    f"""WITH {B} SELECT book_id, block_id, CASE WHEN block_id % 3 = 2 THEN NULL ELSE text || '|b' END AS answer, (block_id % 7)::BIGINT AS prompt, 0::BIGINT AS completion, 'm' || block_id % 2 AS model
    FROM b WHERE text IS NOT NULL"""
)
def model_answers(spark, d):
    """Answers wrapped in chatter, with usage and models; one in three holds a number and is refused."""
    k, t = F.col("block_id"), F.col("text")
    items = F.when(
        k % 3 == 2,
        F.concat(F.lit("["), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2), F.lit(", 5]")),
    ).otherwise(F.to_json(F.array(t, F.lit("b"))))
    content = F.concat(F.lit("Sure: "), items, F.lit(" done"))
    body = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
            F.struct((k % 7).alias("prompt_tokens")).alias("usage"),
        ),
    )
    models = F.concat(F.lit('{"data":[{"id":"m'), (k % 2).cast("string"), F.lit('"},{"x":1}]}'))
    u = J.usage_counts(body)
    rows = blocks(spark, d).where("text is not null")
    return rows.select(
        "book_id",
        "block_id",
        F.array_join(J.strings_in_chatter(J.message_content(body)), "|").alias("answer"),
        u["prompt"].alias("prompt"),
        u["completion"].alias("completion"),
        J.model_ids(models)[0].alias("model"),
    )


#: SQL: batches that hold a block the flaky translator refuses, and what a first run saves.
FLAKY = packed_sql(BOOK_ITEMS, str(BATCH_TOKENS)) + ", f AS (SELECT grp, batch, bool_or(pos % 97 = 5) AS fails FROM w GROUP BY grp, batch)"


@query(
    FLAKY + "SELECT b.book_id, b.block_id, 'TR: ' || b.text AS text, CASE WHEN f.fails THEN 2 ELSE 1 END::BIGINT AS run FROM w JOIN f USING (grp, batch) JOIN b ON b.book_id = w.grp AND b.block_id = w.pos",
)
def interrupted_run(spark, d):
    """A run that some batches fail in, resumed by a second one with only what is missing; together they
    save what one uninterrupted run would."""
    ship(spark)
    books = table(spark, d, "blocks").where("book_id is not null").select(F.col("book_id").alias("state_key"), "book_id").distinct()
    store, rows = loop.StateStore(spark), table(spark, d, "blocks")
    marked = samples.marked(rows, F.col("block_id") % 97 == 5)
    loop.translate_runs(books, marked, samples.Refusing(), store, batch_tokens=BATCH_TOKENS)
    first = store.next_epoch()
    loop.translate_runs(books, rows, run.Prefix(), store, batch_tokens=BATCH_TOKENS)
    return store.texts().select(
        F.col("state_key").alias("book_id"),
        "block_id",
        "text",
        F.when(F.col("epoch") < first, 1).otherwise(2).cast("long").alias("run"),
    )


@query(
    FLAKY
    + """, n AS (SELECT grp AS book_id, count(*) AS total, sum(CASE WHEN NOT f.fails THEN 1 ELSE 0 END)::BIGINT AS done, count(DISTINCT batch) FILTER (WHERE f.fails) AS failed FROM w JOIN f USING (grp, batch) GROUP BY grp)
    SELECT book_id, 'started' AS kind, 0 AS done, total, 1 AS n FROM n UNION ALL SELECT book_id, 'progress', done, total, 1 FROM n
    UNION ALL SELECT book_id, 'log', NULL, NULL, failed FROM n WHERE failed > 0"""
)
def run_events(spark, d):
    """The events of a run in which some batches fail: its start, its progress, a line of the log a failure."""
    ship(spark)
    rows = table(spark, d, "blocks")
    books = rows.where("book_id is not null").select(F.col("book_id").alias("state_key"), "book_id").distinct()
    store = loop.StateStore(spark)
    marked = samples.marked(rows, F.col("block_id") % 97 == 5)
    loop.translate_runs(books, marked, samples.Refusing(), store, batch_tokens=BATCH_TOKENS)
    return store.events().groupBy(F.col("state_key").alias("book_id"), "kind").agg(
        F.max("done").alias("done"),
        F.max("total").alias("total"),
        F.count(F.lit(1)).alias("n"),
    )


SAMPLE = f"""{B}, s AS (SELECT book_id, block_id, text, length(text) AS n,
      coalesce(sum(length(text)) OVER (PARTITION BY book_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM b WHERE chapter_idx < {SAMPLE_CHAPTERS} AND {OPEN}),
    a AS (SELECT book_id, length(string_agg(text[1:least(n, {SAMPLE_CHARS} - before)::BIGINT], chr(10) || chr(10) ORDER BY block_id)) AS n FROM s WHERE before < {SAMPLE_CHARS} GROUP BY book_id)"""


@query(f"WITH {SAMPLE} SELECT book_id, 'lamp' AS term, 'L' || n AS translation FROM a UNION ALL SELECT book_id, 'key', 'chave' FROM a")
def glossary_pass(spark, d):
    """A glossary asked for from each book's sample, written as a file and read strictly again."""
    rows = sequence.sample_text(blocks(spark, d), SAMPLE_CHAPTERS, SAMPLE_CHARS)
    pairs = loop.glossary_pass(rows, samples.Lexicon()).withColumn("pos", F.when(F.col("term") == "lamp", 0).otherwise(1))
    got = loop.strict_glossaries(stored(loop.glossary_files(pairs), "glossaries"))
    return got.select(
        F.regexp_extract("path", r"^(.*)\.json$", 1).alias("book_id"),
        F.explode("terms").alias("g"),
    ).select("book_id", "g.term", "g.translation")


@query(f"WITH {SAMPLE} SELECT book_id, 'Plain.' || chr(10) || 'Of ' || n || ' characters.' AS priming FROM a")
def priming_pass(spark, d):
    """Style and tone asked for from each book's sample; the lines that are not blank."""
    rows = sequence.sample_text(blocks(spark, d), SAMPLE_CHAPTERS, SAMPLE_CHARS)
    return loop.priming_pass(rows, samples.Lexicon())


@query(
    f"""WITH {B} SELECT book_id, block_id, CASE block_id % 8 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE text || '|b' END AS answers FROM b WHERE {OPEN}"""
)
def answer_shapes(spark, d):
    """Translations found in answers of eight shapes; of another number, or blank, there are none."""
    ship(spark)
    t, k = F.col("text"), F.col("block_id") % 8
    q = F.to_json(F.array(t, F.lit("b")))
    text = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    body = (
        F.when(k == 0, q)
        .when(k == 1, F.concat(F.lit('{"data": {"translations": ['), F.lit('{"translatedText": '), text, F.lit('}, {"text": "b"}]}}')))
        .when(k == 2, F.concat(F.lit("["), q, F.lit(', "en"]')))
        .when(k == 3, F.concat(F.lit('{"translation": [], "results": '), q, F.lit("}")))
        .when(k == 4, F.concat(F.lit("[["), text, F.lit(', "en"], ["b", "en"]]')))
        .when(k == 5, F.concat(F.lit('[[['), text, F.lit(', "x"]], [["b", "x"]]]')))
        .when(k == 6, F.concat(F.lit('{"text": '), text, F.lit("}")))
        .otherwise(F.concat(F.lit("["), text, F.lit(', " "]')))
    )
    rows = open_blocks(spark, d).select("book_id", "block_id", body.alias("body"), (k == 2).alias("markup"))
    return rows.select("book_id", "block_id", F.array_join(J.answers_udf("body", F.lit(2), "markup"), "|").alias("answers"))


@query(
    "SELECT event_id, CASE k " + " ".join(
        f"WHEN {i} THEN '{v[0]}'" for i, v in enumerate(messages.ADVICE.values())
    ) + f" ELSE '{messages.OTHER_ADVICE[0]}' END AS title, "
    + "CASE k " + " ".join(
        f"WHEN {i} THEN '{v[1]}'" for i, v in enumerate(messages.ADVICE.values())
    ) + f" ELSE '{messages.OTHER_ADVICE[1]}' END AS advice FROM (SELECT event_id, event_id % {len(messages.ADVICE) + 1} AS k FROM events)"
)
def error_advice(spark, d):
    """Title and advice for every class of error."""
    kinds = F.array(*map(F.lit, [*messages.ADVICE, "no such class"]))
    kind = F.element_at(kinds, (F.col("event_id") % (len(messages.ADVICE) + 1) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", messages.advice(kind).alias("a")).select("event_id", "a.title", "a.advice")


@query(
    f"""SELECT DISTINCT state_key, replace(replace('{messages.ROLE['translate']}', '{{source}}', coalesce(source_language, '?')), '{{target}}', target_language)
      || chr(10) || chr(10) || 'Style and tone:' || chr(10) || 'Of ' || book_id || chr(10) || chr(10) || 'Use exactly these translations:' || chr(10) || '- key -> ' || target_language
      || chr(10) || chr(10) || '{messages.TERMS['manter']}' AS system, '{messages.ASK['translate']}' || chr(10) || '["' || book_id || '","x"]' AS request FROM runs"""
)
def prompt_texts(spark, d):
    """What a model is told and asked for each run."""
    c = F.col
    glossary = F.array(F.struct(F.lit("key").alias("term"), c("target_language").alias("translation")))
    task = F.lit("translate")
    system = messages.system_prompt(task, c("source_language"), c("target_language"), F.concat(F.lit("Of "), "book_id"), glossary, F.lit("manter"))
    return table(spark, d, "runs").select(
        "state_key",
        system.alias("system"),
        messages.user_prompt(task, F.array(c("book_id"), F.lit("x"))).alias("request"),
    ).distinct()


@query(
    f"""WITH l AS (SELECT book_id, list(path ORDER BY chapter_idx, path) AS own FROM (SELECT DISTINCT book_id, chapter_idx, path FROM chapters WHERE path IS NOT NULL) GROUP BY book_id)
    SELECT book_id, array_to_string(CASE WHEN {NUMBER} % 3 = 0 THEN own ELSE list_transform(own, lambda x: 'TR: ' || x) END, '|') AS labels FROM l"""
)
def kept_labels(spark, d):
    """Translated labels of the contents, or a book's own where there is another number of them (in every third book
    one is missing)."""
    rows = table(spark, d, "chapters").where("path is not null").select("book_id", "chapter_idx", "path").distinct()
    own = F.transform(F.sort_array(F.collect_list(F.struct("chapter_idx", "path"))), lambda x: x["path"])
    books = rows.groupBy("book_id").agg(own.alias("labels"))
    new = F.transform("labels", lambda x: F.concat(F.lit("TR: "), x))
    short = F.regexp_extract("book_id", "([0-9]+)$", 1).cast("int") % 3 == 0
    translated = books.select("book_id", F.when(short, F.slice(new, F.lit(1), F.size("labels") - 1)).otherwise(new).alias("labels"))
    return loop.labels_or_own(books, translated).select("book_id", F.array_join("labels", "|").alias("labels"))
