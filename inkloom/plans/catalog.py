"""All queries of the core, and their SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import json as J
from inkloom.functions import text as T
from inkloom.functions import tokens
from inkloom.operators import greedy, sequence
from inkloom.session import small_side, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: SQL: blocks without repeats, and what is translatable.
B = (
    "b AS (SELECT DISTINCT book_id, chapter_idx, path, block_id, kind, text, protected FROM blocks WHERE book_id IS NOT NULL"
    " AND block_id IS NOT NULL)"
)
BLANK = r"regexp_full_match({0}, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]*')".replace("{85}", "{{85}}").replace(r"\p{Z}", r"\p{{Z}}")
OPEN = "NOT coalesce(protected, false) AND text IS NOT NULL AND NOT " + BLANK.format("text")
WORDS = r"len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> ''))"
TAG = r"</?[A-Za-z][\w:-]*(?:\s[^>]*)?/?>"


SQL_MARK = lambda c: "(" + " OR ".join(
    f"regexp_matches({c}, '(?i{'m' if p.startswith('(?m)') else ''}){p.removeprefix('(?m)')}')" for p in T.MACHINE_MARKS
) + ")"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return sequence.one_row_blocks(table(spark, d, "blocks"))


def open_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).where(T.translatable(F.col("text"), F.col("protected")))


def packed_sql(rows: str, cap: str, most: str = "NULL", n: str = "") -> str:
    """Greedy packing as a recursive query over items (grp, pos, size, cap, most); ``n`` tells two of them apart."""
    closes = f"(coalesce(w{n}.total + o{n}.size > {cap}, false) OR coalesce(w{n}.cnt + 1 > {most}, false))"
    return f"""{rows},
    o{n} AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS n FROM items{n}),
    w{n} AS (
      SELECT grp, pos, n, size AS total, 1 AS cnt, 0::BIGINT AS batch FROM o{n} WHERE n = 1
      UNION ALL
      SELECT o{n}.grp, o{n}.pos, o{n}.n,
        CASE WHEN {closes} THEN o{n}.size ELSE w{n}.total + o{n}.size END,
        CASE WHEN {closes} THEN 1 ELSE w{n}.cnt + 1 END,
        w{n}.batch + CASE WHEN {closes} THEN 1 ELSE 0 END
      FROM w{n} JOIN o{n} ON o{n}.grp = w{n}.grp AND o{n}.n = w{n}.n + 1
    ) """


#: Tokens of a batch, characters and items of a request to a service without a key, characters of a book's sample.
BATCH_TOKENS, REQUEST_CHARS, REQUEST_ITEMS, SAMPLE_CHAPTERS, SAMPLE_CHARS = 4000, 5000, 8, 10, 20_000

BOOK_ITEMS = f"WITH RECURSIVE {B}, items AS (SELECT book_id AS grp, block_id AS pos, {WORDS} AS size FROM b WHERE {OPEN})"


def token_packing(rows: DataFrame) -> tuple:
    """What packs blocks with their ``tokens`` in order."""
    return rows, F.col("book_id"), F.col("block_id"), F.col("tokens"), F.lit(BATCH_TOKENS), F.lit(None).cast("long")


def token_packed(spark: SparkSession, d: str) -> DataFrame:
    return greedy.greedy_batches(*token_packing(sequence.sized_blocks(table(spark, d, "blocks"))))


@query(packed_sql(BOOK_ITEMS, str(BATCH_TOKENS)) + "SELECT grp AS book_id, pos AS block_id, batch FROM w")
def token_batches(spark, d):
    """Blocks in order into batches of at most 4000 tokens; one over the limit rides alone."""
    return token_packed(spark, d).select(F.col("grp").alias("book_id"), F.col("pos").alias("block_id"), "batch")


@query(
    packed_sql(BOOK_ITEMS, str(BATCH_TOKENS))
    + f""", k AS (SELECT grp, max(batch) + 1 AS batches FROM w GROUP BY grp)
    SELECT b.book_id, count(*) AS blocks, count(DISTINCT chapter_idx) AS chapters, sum(length(text))::BIGINT AS characters,
      sum({WORDS})::BIGINT AS tokens, any_value(k.batches) AS batches
    FROM b JOIN k ON k.grp = b.book_id WHERE {OPEN} GROUP BY b.book_id"""
)
def plan_books(spark, d):
    """The pre-flight plan: chapters, blocks, characters, tokens and batches of every book."""
    rows = sequence.sized_blocks(table(spark, d, "blocks"), "chapter_idx")
    sums = rows.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("chapter_idx").alias("chapters"),
        F.sum("chars").cast("long").alias("characters"), F.sum("tokens").cast("long").alias("tokens"),
    )
    return sums.join(greedy.batch_counts(*token_packing(rows)).withColumnRenamed("grp", "book_id"), "book_id")


RUN_ITEMS = f"""WITH RECURSIVE {B}, r AS (SELECT DISTINCT state_key, book_id, provider_id FROM runs),
    every AS (SELECT r.state_key AS grp, block_id AS pos, length(text) AS size, p.max_batch_chars AS cap, p.max_batch_items AS most
      FROM r JOIN b USING (book_id) JOIN providers p USING (provider_id) WHERE {OPEN}),
    bad AS (SELECT DISTINCT grp FROM every WHERE size > cap), items AS (SELECT * FROM every ANTI JOIN bad USING (grp))"""


@query(
    packed_sql(RUN_ITEMS, "o.cap", "o.most")
    + """SELECT grp AS state_key, pos AS block_id, batch, NULL::VARCHAR AS error FROM w
    UNION ALL SELECT grp, pos, NULL, CASE WHEN size > cap THEN 'over the limit' ELSE 'not sent' END FROM every SEMI JOIN bad USING (grp)"""
)
def char_item_batches(spark, d):
    """In order, by the characters and items a provider takes, null limits being none. A block over the limit is an
    error for its run, of which no block is sent; strict packing raises it, here it is a column."""
    p = table(spark, d, "providers").select("provider_id", F.col("max_batch_chars").alias("cap"), F.col("max_batch_items").alias("most"))
    runs = sequence.runs_of(table(spark, d, "runs").join(F.broadcast(p), "provider_id"), "cap", "most")
    rows = sequence.sized_blocks(table(spark, d, "blocks")).join(runs, "book_id").select("state_key", "block_id", "chars", "cap", "most")
    sent, failed = greedy.within_limits(rows, "state_key", "chars", "cap")
    got = greedy.greedy_batches(sent, F.col("state_key"), F.col("block_id"), F.col("chars"), F.col("cap"), F.col("most"), strict=True)
    good = got.select(F.col("grp").alias("state_key"), F.col("pos").alias("block_id"), "batch", F.lit(None).cast("string").alias("error"))
    error = F.when(F.col("chars") > F.col("cap"), "over the limit").otherwise("not sent")
    return good.unionByName(failed.select("state_key", "block_id", F.lit(None).cast("long").alias("batch"), error.alias("error")))


@query(
    packed_sql(BOOK_ITEMS, str(BATCH_TOKENS))
    + f""", every AS (SELECT w.grp || '/' || w.batch AS grp, b.block_id AS pos, length(b.text) AS size FROM w JOIN b ON b.book_id = w.grp AND b.block_id = w.pos),
    bad AS (SELECT DISTINCT grp FROM every WHERE size > {REQUEST_CHARS}), {packed_sql("items2 AS (SELECT * FROM every ANTI JOIN bad USING (grp))", str(REQUEST_CHARS), str(REQUEST_ITEMS), "2")}
    SELECT split_part(grp, '/', 1) AS book_id, split_part(grp, '/', 2)::BIGINT AS batch, pos AS block_id, batch AS request FROM w2
    UNION ALL SELECT split_part(grp, '/', 1), split_part(grp, '/', 2)::BIGINT, pos, NULL FROM every SEMI JOIN bad USING (grp)"""
)
def request_batches(spark, d):
    """The second packing, of each batch into requests of at most 5000 characters and 8 items; a batch with a block
    over that limit fails as a whole (request is null)."""
    rows = sequence.sized_blocks(table(spark, d, "blocks"))
    got = greedy.greedy_batches(*token_packing(rows)).select(F.col("grp").alias("book_id"), F.col("pos").alias("block_id"), "batch")
    both = got.join(rows.select("book_id", "block_id", "chars"), ["book_id", "block_id"])
    both = both.select(
        "book_id",
        "batch",
        "block_id",
        "chars",
        F.concat_ws("/", "book_id", F.col("batch").cast("string")).alias("grp"),
        F.lit(REQUEST_CHARS).alias("cap"),
    )
    sent, failed = greedy.within_limits(both, "grp", "chars", "cap")
    cap, most = F.lit(REQUEST_CHARS), F.lit(REQUEST_ITEMS)
    again = greedy.greedy_batches(sent, F.col("grp"), F.col("block_id"), F.col("chars"), cap, most, strict=True)
    good = again.select(
        F.split_part("grp", F.lit("/"), F.lit(1)).alias("book_id"),
        F.split_part("grp", F.lit("/"), F.lit(2)).cast("long").alias("batch"),
        F.col("pos").alias("block_id"),
        F.col("batch").alias("request"),
    )
    return good.unionByName(failed.select("book_id", "batch", "block_id", F.lit(None).cast("long").alias("request")))


@query(packed_sql(BOOK_ITEMS.replace(f"{WORDS} AS size", "length(text) AS size"), "8000") + "SELECT grp AS book_id, pos AS block_id, batch FROM w")
def counted_batches(spark, d):
    """Packing by another measure of texts that is passed in: characters."""
    rows = sequence.sized_blocks(table(spark, d, "blocks"), count=tokens.by_characters)
    got = greedy.greedy_batches(rows, F.col("book_id"), F.col("block_id"), F.col("tokens"), F.lit(8000), F.lit(None))
    return got.select(F.col("grp").alias("book_id"), F.col("pos").alias("block_id"), "batch")


@query(
    """WITH r AS (SELECT DISTINCT book_id, state_key, family FROM runs JOIN providers USING (provider_id))
    SELECT book_id, array_to_string(list_concat(coalesce(list(state_key ORDER BY state_key) FILTER (WHERE family = 'llm'), []), coalesce(list(state_key ORDER BY state_key) FILTER (WHERE family <> 'llm'), [])), ',') AS keys FROM r GROUP BY book_id"""
)
def ordered_lists(spark, d):
    """The ordered lists of two families of runs of a book, one after the other."""
    p = table(spark, d, "providers").select("provider_id", "family")
    rows = table(spark, d, "runs").join(F.broadcast(p), "provider_id").select("book_id", "state_key", "family").distinct()
    part = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("state_key"))))
    llm = F.col("family") == "llm"
    return rows.groupBy("book_id").agg(F.array_join(F.concat(part(llm), part(~llm)), ",").alias("keys"))


@query(f"WITH {B} SELECT book_id, block_id, length(text) AS n_chars, {WORDS}::BIGINT AS tokens FROM b WHERE {OPEN}")
def translatable_blocks(spark, d):
    """F1, P1, P2."""
    return open_blocks(spark, d).select(
        "book_id",
        "block_id",
        F.length("text").cast("long").alias("n_chars"),
        T.word_count(F.col("text")).alias("tokens"),
    )


@query(f"WITH {B} SELECT book_id, block_id, row_number() OVER (PARTITION BY book_id ORDER BY block_id) - 1 AS global_id FROM b")
def global_block_ids(spark, d):
    """W1."""
    return sequence.global_ids(blocks(spark, d)).select("book_id", "block_id", "global_id")


@query(
    f"""WITH {B}, s AS (SELECT book_id, block_id, text, length(text) AS n,
      coalesce(sum(length(text)) OVER (PARTITION BY book_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM b WHERE chapter_idx < {SAMPLE_CHAPTERS} AND {OPEN})
    SELECT book_id, string_agg(text[1:least(n, {SAMPLE_CHARS} - before)::BIGINT], chr(10) || chr(10) ORDER BY block_id) AS sample FROM s WHERE before < {SAMPLE_CHARS} GROUP BY book_id"""
)
def sample_budget(spark, d):
    """Text of the first ten chapters up to 20,000 characters (Z10, Z11 start from it)."""
    return sequence.sample_text(blocks(spark, d), SAMPLE_CHAPTERS, SAMPLE_CHARS)


@query(
    f"""WITH {B}, r AS (SELECT DISTINCT state_key, book_id FROM runs)
    SELECT r.state_key, r.book_id, b.block_id FROM r JOIN b USING (book_id) WHERE {OPEN}
      AND NOT EXISTS (SELECT 1 FROM translation_state t WHERE t.state_key = r.state_key AND t.block_id = b.block_id)"""
)
def pending_blocks(spark, d):
    """What a resumed run still has to do."""
    return sequence.pending(table(spark, d, "runs"), table(spark, d, "blocks"), table(spark, d, "translation_state"))


LATEST = (
    "t AS (SELECT state_key, block_id, text, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY state_key, block_id"
    " ORDER BY saved_at DESC, text DESC NULLS LAST, batch_id DESC) AS n FROM translation_state) WHERE n = 1)"
)


@query(
    f"""WITH {B}, {LATEST}, r AS (SELECT DISTINCT state_key, book_id FROM runs)
    SELECT r.state_key, r.book_id, b.block_id, coalesce(t.text, b.text) AS text, t.text IS NOT NULL AS translated
    FROM r JOIN b USING (book_id) LEFT JOIN t ON t.state_key = r.state_key AND t.block_id = b.block_id"""
)
def applied_translations(spark, d):
    """The translated book, block by block."""
    return sequence.apply_translations(table(spark, d, "runs"), table(spark, d, "blocks"), table(spark, d, "translation_state"))


@query(
    f"""WITH {B}, x AS (SELECT book_id, block_id, CASE block_id % 5 WHEN 0 THEN text || ' [Nota: original]' WHEN 1 THEN '(N. T.) ' || text
      WHEN 2 THEN text || ' TRADUÇÃO automática por X' WHEN 3 THEN 'a' || chr(10) || ' Original: ' || text ELSE text END AS text FROM b)
    SELECT book_id, block_id, {SQL_MARK('text')} AS marked
    FROM x WHERE text IS NOT NULL"""
)
def machine_marks(spark, d):
    """F3, X9, over blocks with marks added to four fifths of them."""
    t, k = F.col("text"), F.col("block_id") % 5
    dressed = F.when(k == 0, F.concat(t, F.lit(" [Nota: original]"))).when(k == 1, F.concat(F.lit("(N. T.) "), t)).when(k == 2, F.concat(t, F.lit(" TRADUÇÃO automática por X"))).when(k == 3, F.concat(F.lit("a\n Original: "), t)).otherwise(t)
    return blocks(spark, d).where("text is not null").select("book_id", "block_id", T.has_machine_mark(dressed).alias("marked"))


TIDY = r"regexp_replace(regexp_replace(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' +/>', '/>', 'g'), ' +>', '>', 'g')"


@query(
    f"WITH {B} SELECT book_id, block_id, array_to_string(list_transform(regexp_extract_all(text, '{TAG}'), lambda x: {TIDY}),"
    f" '|') AS tags FROM b WHERE text IS NOT NULL",
)
def markup_tags(spark, d):
    """The sequence of inline tags."""
    return blocks(spark, d).where("text is not null").select("book_id", "block_id", F.array_join(T.markup_sequence(F.col("text")), "|").alias("tags"))


@query(
    rf"WITH {B} SELECT book_id, block_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{TAG}', '', 'g'),"
    rf" '@@\d+@@', '', 'g'), ' +', ' ', 'g'), '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '',"
    rf" 'g') AS plain FROM b WHERE text IS NOT NULL",
)
def stripped_markup(spark, d):
    """X8."""
    return blocks(spark, d).where("text is not null").select("book_id", "block_id", T.strip_markup(F.col("text")).alias("plain"))


CLEAN = (
    r"regexp_replace(regexp_replace(z, '\{\{[\s\p{Z}]*(\d+)[\s\p{Z}]*\}\}', '{{\1}}', 'g'),"
    r" '@[\s\p{Z}]*@[\s\p{Z}]*(\d+)[\s\p{Z}]*@[\s\p{Z}]*@', '@@\1@@', 'g')"
)


@query(
    f"WITH {B}, x AS (SELECT book_id, block_id, replace(replace(text, '{{{{', '{{{{ '), '}}}}', ' }}}}') || ' @ @ 7 @ @' AS z"
    f" FROM b WHERE text IS NOT NULL) SELECT book_id, block_id, {CLEAN} AS cleaned, array_to_string(regexp_extract_all({CLEAN},"
    f" '\\{{\\{{(\\d+)\\}}\\}}', 1), ',') AS numbers FROM x",
)
def placeholder_numbers(spark, d):
    """X3, X4, over blocks whose placeholders were pulled apart."""
    z = F.concat(F.replace(F.replace("text", F.lit("{{"), F.lit("{{ ")), F.lit("}}"), F.lit(" }}")), F.lit(" @ @ 7 @ @"))
    rows = blocks(spark, d).where("text is not null").select("book_id", "block_id", z.alias("z"))
    return rows.select(
        "book_id",
        "block_id",
        T.clean_placeholders(F.col("z")).alias("cleaned"),
        F.array_join(T.placeholder_sequence(F.col("z")).cast("array<string>"), ",").alias("numbers"),
    )


def answered(spark, d):
    """Saved translations in force with their source."""
    runs = table(spark, d, "runs").select("state_key", "book_id").distinct()
    saved = sequence.latest_state(table(spark, d, "translation_state")).join(runs, "state_key")
    return saved.join(
        blocks(spark, d).select("book_id", "block_id", F.col("text").alias("source")),
        ["book_id", "block_id"],
    ).where("source is not null")


SQL_SEQ = lambda c: f"regexp_extract_all({c}, '\\{{\\{{(\\d+)\\}}\\}}', 1)"
SQL_TAGS = lambda c: f"list_transform(regexp_extract_all({c}, '{TAG}'), lambda x: {TIDY})"
SQL_PAIRS = (
    f"{B}, {LATEST}, a AS (SELECT t.state_key, t.block_id, t.batch_id, b.text AS s, t.text AS z FROM t"
    f" JOIN (SELECT DISTINCT state_key, book_id FROM runs) r USING (state_key) JOIN b ON b.book_id = r.book_id"
    f" AND b.block_id = t.block_id WHERE b.text IS NOT NULL), c AS (SELECT *, {CLEAN} AS f FROM a)"
)
SQL_BLANK_F = "(f IS NULL OR " + BLANK.format("f") + ")"
SQL_PH = f"{SQL_SEQ('s')} = {SQL_SEQ('f')}"
SQL_NEW_MARK = f"({SQL_MARK('f')} AND NOT {SQL_MARK('s')})"
SQL_FMT = f"({SQL_PH} AND {SQL_TAGS('s')} = {SQL_TAGS('f')})"


@query(
    f"WITH {SQL_PAIRS} SELECT state_key, block_id, CASE WHEN {SQL_BLANK_F} THEN 'empty' WHEN {SQL_NEW_MARK} THEN 'mark'"
    f" WHEN NOT {SQL_FMT} THEN 'markup' END AS reason FROM c WHERE {SQL_BLANK_F} OR {SQL_NEW_MARK} OR NOT {SQL_FMT}",
)
def reject_reasons(spark, d):
    """answers sent back, with the reason."""
    rows = answered(spark, d).select("state_key", "block_id", T.reject_reason(F.col("source"), F.col("text")).alias("reason"))
    return rows.where("reason is not null")


@query(
    f"WITH {SQL_PAIRS} SELECT state_key, batch_id, count(*) AS blocks, bool_and(NOT {SQL_BLANK_F} AND NOT {SQL_NEW_MARK}"
    f" AND {SQL_FMT}) AS clean, max(CASE WHEN {SQL_BLANK_F} OR {SQL_NEW_MARK} OR NOT ({SQL_PH}) THEN 1 ELSE 0 END) AS lost FROM c"
    f" GROUP BY state_key, batch_id",
)
def batch_quality(spark, d):
    """Whether a batch is clean, and whether salvaging it fails on any block."""
    s, t = F.col("source"), F.col("text")
    rows = answered(spark, d).select(
        "state_key",
        "batch_id",
        T.reject_reason(s, t).isNull().alias("ok"),
        T.salvage(s, t).isNull().cast("int").alias("gone"),
    )
    return rows.groupBy("state_key", "batch_id").agg(F.count(F.lit(1)).alias("blocks"), F.bool_and("ok").alias("clean"), F.max("gone").alias("lost"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12), chr(10)), chr(10))) AS line FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
    s AS (SELECT doc_id, trim(regexp_replace(trim(line), '^[",\[\]]+|[",\[\]]+$', '', 'g')) AS z FROM l),
    p AS (SELECT doc_id, CASE WHEN instr(z, '->') > 0 THEN '->' WHEN instr(z, ':') > 0 THEN ':' END AS sep, z FROM s)
    SELECT doc_id, trim(z[1:instr(z, sep) - 1]) AS term, trim(z[instr(z, sep) + length(sep):]) AS translation, count(*) AS n FROM p
    WHERE sep IS NOT NULL AND trim(z[1:instr(z, sep) - 1]) <> '' AND trim(z[instr(z, sep) + length(sep):]) <> '' GROUP BY ALL"""
)
def glossary_pairs(spark, d):
    """X10, over the lines of all documents (line ends are unified first)."""
    docs = table(spark, d, "documents").where("text is not null and doc_id is not null").select(
        "doc_id",
        F.regexp_replace("text", "\r\n|\r|\f", "\n").alias("text"),
    ).distinct()
    return docs.select("doc_id", F.explode(T.glossary_lines(F.col("text"))).alias("p")).select("doc_id", "p.term", "p.translation").groupBy("doc_id", "term", "translation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT book_id, substr(sha256(to_json(list([path, coalesce(title, '')]"
    " ORDER BY path, coalesce(title, '')))::VARCHAR), 1, 16) AS version FROM (SELECT DISTINCT book_id, path, title FROM chapters"
    " WHERE path IS NOT NULL) GROUP BY book_id",
)
def glossary_versions(spark, d):
    """Hash of a sorted list of pairs (a book's chapters and titles)."""
    rows = table(spark, d, "chapters").where("path is not null").select("book_id", "path", "title").distinct()
    pairs = F.collect_list(F.array("path", F.coalesce("title", F.lit(""))))
    return rows.groupBy("book_id").agg(J.glossary_version(pairs).alias("version"))


@query(
    """SELECT DISTINCT r.state_key, substr(sha256(CASE WHEN p.family = 'llm' AND r.provider_id = 'llm-umbra' THEN array_to_string([r.book_id, coalesce(r.source_language, ''), r.target_language, coalesce(r.model, ''), 'hibrido', 'v1'], chr(0))
      ELSE array_to_string([r.book_id, p.family, r.provider_id, p.transport_variant, coalesce(r.source_language, ''), r.target_language, CASE WHEN p.family = 'llm' THEN coalesce(r.model, '') ELSE '' END, CASE WHEN p.family = 'llm' THEN 'hibrido' ELSE '' END, CASE WHEN p.family = 'llm' THEN 'v1' ELSE '' END], chr(0)) END), 1, 16) AS compat
    FROM runs r JOIN providers p USING (provider_id)"""
)
def state_keys(spark, d):
    """X15; one provider plays the old default."""
    rows = table(spark, d, "runs").join(table(spark, d, "providers").select("provider_id", "family", "transport_variant"), "provider_id")
    c = F.col
    provider = F.when(c("provider_id") == "llm-umbra", "").otherwise(c("provider_id"))
    key = T.state_key(
        c("book_id"),
        c("source_language"),
        c("target_language"),
        c("model"),
        F.lit("hibrido"),
        F.lit("v1"),
        c("family"),
        provider,
        c("transport_variant"),
    )
    return rows.select("state_key", key.alias("compat")).distinct()


KEYS_SQL = ORACLE["state_keys"]


@query(
    f"""WITH k AS ({KEYS_SQL}), s AS (SELECT k.compat, count(DISTINCT t.block_id) AS n FROM translation_state t JOIN k USING (state_key) GROUP BY k.compat)
    SELECT k.state_key, coalesce(s.n, 0) AS saved, s.n IS NOT NULL AS resumable FROM k LEFT JOIN s USING (compat)"""
)
def cache_status(spark, d):
    """A run goes on from what was saved under its own key, the hash of all that a state depends on; what was saved
    under another key counts for nothing."""
    keys = state_keys(spark, d)
    saved = table(spark, d, "translation_state").select("state_key", "block_id").join(small_side(keys), "state_key")
    counts = saved.groupBy("compat").agg(F.count_distinct("block_id").alias("n"))
    return keys.join(counts, "compat", "left").select(
        "state_key",
        F.coalesce("n", F.lit(0)).alias("saved"),
        F.col("n").isNotNull().alias("resumable"),
    )


@query(
    """SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM (SELECT state_key, CASE WHEN count(prompt_tokens) = count(*) THEN sum(prompt_tokens)::BIGINT END AS prompt_tokens,
      CASE WHEN count(completion_tokens) = count(*) THEN sum(completion_tokens)::BIGINT END AS completion_tokens, coalesce(sum(characters), 0)::BIGINT AS characters, coalesce(sum(blocks), 0)::BIGINT AS blocks, count(*) AS batches
    FROM (SELECT DISTINCT * FROM usage_log) GROUP BY state_key)"""
)
def usage_sums(spark, d):
    """A3, A4: a sum of tokens is unknown as soon as one part is."""
    return sequence.usage_totals(table(spark, d, "usage_log"))


@query(
    f"WITH {B}, {LATEST} SELECT t.state_key, t.batch_id, sum(length(b.text))::BIGINT AS characters, count(*) AS blocks FROM t"
    f" JOIN (SELECT DISTINCT state_key, book_id FROM runs) r USING (state_key) JOIN b ON b.book_id = r.book_id"
    f" AND b.block_id = t.block_id WHERE b.text IS NOT NULL GROUP BY ALL",
)
def batch_usage(spark, d):
    """Characters and blocks of each batch."""
    return answered(spark, d).groupBy("state_key", "batch_id").agg(
        F.sum(F.length("source")).cast("long").alias("characters"),
        F.count(F.lit(1)).alias("blocks"),
    )


@query(
    "SELECT state_key, batch_id, (sum(blocks) OVER (PARTITION BY state_key"
    " ORDER BY batch_id))::BIGINT AS done, (sum(blocks) OVER (PARTITION BY state_key))::BIGINT AS total FROM (SELECT DISTINCT *"
    " FROM usage_log)",
)
def progress_counter(spark, d):
    """W8."""
    return sequence.progress(table(spark, d, "usage_log"))


@query(
    f"""WITH {B}, n AS (SELECT book_id, count(*) AS total FROM b WHERE {OPEN} GROUP BY book_id),
    s AS (SELECT state_key, count(DISTINCT block_id) AS done, epoch_us(max(saved_at)) - epoch_us(min(saved_at)) AS us FROM translation_state GROUP BY state_key)
    SELECT state_key, done, total, CASE WHEN done > 0 AND us > 0 THEN floor(greatest(total - done, 0) * us / done / 1e6 + 0.5)::BIGINT END AS seconds_left
    FROM (SELECT DISTINCT state_key, book_id FROM runs) JOIN n USING (book_id) JOIN s USING (state_key)"""
)
def remaining_time(spark, d):
    """What is left of each run at the rate of what is done."""
    return sequence.eta(table(spark, d, "runs"), table(spark, d, "blocks"), table(spark, d, "translation_state"))


@query(
    """SELECT event_id, round(coalesce(greatest(0, 0.25 - (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6), 0), 6)::DOUBLE AS wait FROM (SELECT DISTINCT event_id, user_id, ts FROM events)"""
)
def request_pacing(spark, d):
    """M7: the waits that keep a quarter of a second between the requests of each client."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts").distinct()
    return sequence.pacing(rows, "user_id", "ts", 0.25).select("event_id", F.round("wait", 6).alias("wait"))


@query(
    f"WITH {B} SELECT book_id, chapter_idx, arg_min(text, block_id) AS title FROM b WHERE kind = 'titulo' AND text IS NOT NULL"
    f" AND NOT {BLANK.format('text')} GROUP BY book_id, chapter_idx",
)
def chapter_titles(spark, d):
    """W10."""
    return sequence.first_heading(table(spark, d, "blocks"))


@query(
    "SELECT path, min(book_id) AS first_book, max(book_id) AS last_book, count(DISTINCT book_id) AS books FROM chapters"
    " WHERE path IS NOT NULL GROUP BY path",
)
def distinct_paths(spark, d):
    """First and last wins."""
    rows = table(spark, d, "chapters").where("path is not null").select("path", "book_id")
    first = sequence.first_of(rows, ["path"], ["book_id"]).withColumnRenamed("book_id", "first_book")
    last = sequence.first_of(rows, ["path"], ["book_id"], last=True).withColumnRenamed("book_id", "last_book")
    return first.join(last, "path").join(rows.groupBy("path").agg(F.count_distinct("book_id").alias("books")), "path")


@query(f"WITH {B} SELECT book_id, block_id, replace(replace(text, 'lamp', '***'), 'the', '***') AS redacted FROM b WHERE text IS NOT NULL")
def redacted(spark, d):
    """X11."""
    secrets = F.array(F.lit("lamp"), F.lit(""), F.lit("the"))
    return blocks(spark, d).where("text is not null").select("book_id", "block_id", T.redact(F.col("text"), secrets).alias("redacted"))


@query(
    """SELECT DISTINCT book_id, opf_path, regexp_replace(opf_path, '\\.[^./]*$', '') || '-pt' || regexp_extract(opf_path, '(\\.[^./]*)$', 1) AS out_path,
      regexp_replace(coalesce(title, ''), '[^\\p{L}\\p{N}_-]', '-', 'g') AS slug, lower(split_part(trim(language), '-', 1)) AS subtag, upper(book_id) || '_API_KEY' AS key_name,
      coalesce(CASE lower(split_part(trim(language), '-', 1)) WHEN 'pt' THEN 1.2 WHEN 'es' THEN 1.05 WHEN 'fr' THEN 1.05 WHEN 'it' THEN 1.05 WHEN 'de' THEN 1.1 END, 1.0)::DOUBLE AS factor FROM books"""
)
def book_names(spark, d):
    """K12, X12, X13, X17, J6."""
    c = F.col
    return table(spark, d, "books").select(
        "book_id",
        "opf_path",
        T.output_path(c("opf_path"), F.lit("pt")).alias("out_path"),
        T.slug(F.coalesce("title", F.lit(""))).alias("slug"),
        T.primary_subtag(c("language")).alias("subtag"),
        T.key_name(c("book_id")).alias("key_name"),
        T.growth_factor(c("language")).alias("factor"),
    ).distinct()


@query(
    """SELECT provider_id, family || ':' || provider_id || ':' || version || ':' || transport_variant AS cache_key, coalesce(max_batch_chars >= 1, true) AND coalesce(max_batch_items >= 1, true) AND max_concurrency >= 1 AND delay_seconds >= 0 AND (family <> 'llm' OR reports_token_usage) AS valid,
      reports_token_usage OR reports_character_usage AS metered, least(6, max_concurrency) AS parallel, count(*) OVER (PARTITION BY family, provider_id) > 1 AS doubled, row_number() OVER (ORDER BY family, provider_id) AS place FROM providers"""
)
def provider_checks(spark, d):
    """F11, F12, A7, L1, X14, M6, J7."""
    from pyspark.sql import Window

    c = F.col
    ok = F.coalesce(c("max_batch_chars") >= 1, F.lit(True)) & F.coalesce(c("max_batch_items") >= 1, F.lit(True)) & (c("max_concurrency") >= 1) & (c("delay_seconds") >= 0) & ((c("family") != "llm") | c("reports_token_usage"))
    n = F.count(F.lit(1)).over(Window.partitionBy("family", "provider_id")) > 1
    place = F.row_number().over(Window.orderBy("family", "provider_id"))  # nine rows, fixed
    return table(spark, d, "providers").select(
        "provider_id",
        T.cache_key(c("family"), c("provider_id"), c("version"), c("transport_variant")).alias("cache_key"),
        ok.alias("valid"),
        (c("reports_token_usage") | c("reports_character_usage")).alias("metered"),
        F.least(F.lit(6), "max_concurrency").alias("parallel"),
        n.alias("doubled"),
        place.alias("place"),
    )


@query("SELECT DISTINCT r.provider_id FROM providers r WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.provider_id = r.provider_id)")
def unused_providers(spark, d):
    """Anti join."""
    used = table(spark, d, "runs").select("provider_id")
    return table(spark, d, "providers").select("provider_id").join(used, "provider_id", "left_anti").distinct()


@query(
    """SELECT event_id, CASE WHEN s = 429 OR s >= 500 THEN 'transient' WHEN s IN (401, 403) THEN 'auth' WHEN s >= 400 THEN 'definitive' ELSE 'ok' END AS class, least(60.0, power(2.0, event_id % 9))::DOUBLE AS ceiling, greatest(coalesce(try_cast(props AS BIGINT), 0), 0)::BIGINT AS whole,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, ((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts))::BIGINT AS dos_date, (hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::BIGINT AS dos_time
    FROM (SELECT *, [200, 400, 401, 403, 404, 429, 500, 503][event_id % 8 + 1] AS s FROM events)"""
)
def transport_rules(spark, d):
    """S17, S18 (classifier), M5 (ceiling), M8, M9, T1, over the events."""
    c = F.col
    s = F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 404, 429, 500, 503))), (c("event_id") % 8 + 1).cast("int"))
    dos = T.dos_datetime(c("ts"))
    return table(spark, d, "events").select(
        "event_id",
        T.retry_class(s).alias("class"),
        T.backoff_ceiling(c("event_id") % 9).alias("ceiling"),
        T.at_least_zero(c("props")).alias("whole"),
        T.utc_stamp(c("ts")).alias("stamp"),
        dos["date"].alias("dos_date"),
        dos["time"].alias("dos_time"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(60.0, (event_id % 90 - 10)::DOUBLE) ELSE least(60.0, power(2.0, event_id % 9)) END::DOUBLE AS model,
      CASE WHEN event_id % 4 = 0 THEN least(60.0, greatest(0.0, (event_id % 90 - 10)::DOUBLE)) ELSE least(60.0, power(2.0, event_id % 9)) END::DOUBLE AS machine FROM events"""
)
def retry_delays(spark, d):
    """N10, M5 (Retry-After): the header capped, for machine translation not under 0; a date or none leaves the ceiling."""
    k = F.col("event_id")
    header = F.when(k % 4 == 0, (k % 90 - 10).cast("string")).when(k % 4 == 1, F.lit("Wed, 21 Oct 2026 07:28:00 GMT"))
    told = J.retry_after(header)
    return table(spark, d, "events").select(
        "event_id",
        T.retry_delay(k % 9, told).alias("model"),
        T.retry_delay(k % 9, told, least=0.0).alias("machine"),
    )


@query(
    "SELECT DISTINCT doc_id, len(string_split(tags, ';'))::BIGINT AS terms, split_part(tags, ';', 1) AS term,"
    " 'T' || doc_id AS translation FROM documents WHERE tags IS NOT NULL UNION ALL SELECT DISTINCT doc_id, 0, NULL, NULL"
    " FROM documents WHERE tags IS NULL",
)
def glossary_files(spark, d):
    """A glossary file for each document with tags, read strictly; no file is an empty glossary."""
    rows = table(spark, d, "documents").select("doc_id", "tags").distinct()
    entries = F.transform(F.split("tags", ";"), lambda x: F.struct(x.alias("termo"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("traducao")))
    body = F.when(F.col("tags").isNotNull(), F.to_json(entries))
    got = rows.select("doc_id", J.strict_glossary(F.concat(F.lit("glossary-"), F.col("doc_id").cast("string"), F.lit(".json")), body).alias("g"))
    return got.select(
        "doc_id",
        F.size("g").cast("long").alias("terms"),
        F.get("g", F.lit(0))["term"].alias("term"),
        F.get("g", F.lit(0))["translation"].alias("translation"),
    )


@query(
    """WITH v AS (SELECT DISTINCT 'v' || block_id || '.' || chapter_idx AS v FROM blocks), p AS (SELECT v, list_transform(string_split(regexp_replace(v, '^[vV]+', ''), '.'), lambda x: x::INT) AS p FROM v)
    SELECT v, array_to_string(p, '.') AS parts, p > [100, 2] AS newer FROM p"""
)
def versions(spark, d):
    """X18, L6."""
    v = table(spark, d, "blocks").select(
        F.concat(F.lit("v"), F.col("block_id").cast("string"), F.lit("."), F.col("chapter_idx").cast("string")).alias("v"),
    ).distinct()
    p = T.version_parts(F.col("v"))
    return v.select("v", F.array_join(p.cast("array<string>"), ".").alias("parts"), (p > F.array(F.lit(100), F.lit(2))).alias("newer"))


@query(
    f"""WITH {LATEST} SELECT state_key, sum(length(text))::BIGINT AS characters, count(text) AS texts, count(*) AS blocks,
      sum(('0x' || md5(block_id || '=' || coalesce(text, ''))[1:8])::BIGINT)::BIGINT AS digest FROM t GROUP BY state_key"""
)
def flattened_state(spark, d):
    """The state of each run after all its saves, the last write winning; the digest is a sum of the hashes of
    its texts, so that no run is gathered in one row."""
    rows = sequence.latest_state(table(spark, d, "translation_state"))
    entry = F.md5(F.concat(F.col("block_id").cast("string"), F.lit("="), F.coalesce("text", F.lit(""))))
    number = F.conv(F.substring(entry, 1, 8), 16, 10).cast("long")
    return rows.groupBy("state_key").agg(
        F.sum(F.length("text")).cast("long").alias("characters"),
        F.count("text").alias("texts"),
        F.count(F.lit(1)).alias("blocks"),
        F.sum(number).alias("digest"),
    )


@query(
    "SELECT doc_id, array_to_string(list_filter(string_split(tags, ';'), lambda x: list_contains(['ben', 'stol', 'zind'], x)),"
    " ';') AS kept, len(string_split(tags, ';')) AS n FROM (SELECT DISTINCT doc_id, tags FROM documents WHERE tags IS NOT NULL)",
)
def tag_sets(spark, d):
    """Intersection with a fixed set, in order."""
    tags = F.split("tags", ";")
    rows = table(spark, d, "documents").where("tags is not null").select("doc_id", "tags").distinct()
    return rows.select(
        "doc_id",
        F.array_join(F.filter(tags, lambda x: x.isin("ben", "stol", "zind")), ";").alias("kept"),
        F.size(tags).cast("long").alias("n"),
    )


@query(
    "SELECT DISTINCT q.doc_id AS question_id, a.doc_id AS answer_id, a.answer_rank FROM documents q"
    " JOIN documents a ON a.question_id = q.doc_id WHERE q.post_kind = 'question' AND a.post_kind = 'answer'",
)
def threads(spark, d):
    """Equi-join of two roles of one table."""
    docs = table(spark, d, "documents")
    q = docs.where("post_kind = 'question'").select(F.col("doc_id").alias("question_id"))
    return q.join(
        docs.where("post_kind = 'answer'").select("question_id", F.col("doc_id").alias("answer_id"), "answer_rank"),
        "question_id",
    ).distinct()


@query(
    f"WITH {B}, {LATEST}, a AS (SELECT r.state_key, b.block_id, b.text AS s FROM (SELECT DISTINCT state_key, book_id FROM runs) r"
    f" JOIN b USING (book_id)) SELECT a.state_key, a.block_id, a.s = t.text AS same FROM a JOIN t ON t.state_key = a.state_key"
    f" AND t.block_id = a.block_id WHERE a.s IS NOT NULL AND t.text IS NOT NULL",
)
def sources_and_answers(spark, d):
    """Sources and answers side by side by position."""
    return answered(spark, d).where("text is not null").select("state_key", "block_id", (F.col("source") == F.col("text")).alias("same"))


@query(
    f"""WITH {B}, l AS (SELECT book_id, chapter_idx, max(title) AS title, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) AS pos, count(*) OVER (PARTITION BY book_id) AS n FROM chapters WHERE book_id IS NOT NULL GROUP BY book_id, chapter_idx),
    r AS (SELECT book_id, chapter_idx, arg_min(text, block_id) AS head, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) AS pos, count(*) OVER (PARTITION BY book_id) AS n
      FROM b WHERE kind = 'titulo' AND text IS NOT NULL AND NOT {BLANK.format('text')} GROUP BY book_id, chapter_idx)
    SELECT book_id, l.pos, title AS label, head AS text, NULL::VARCHAR AS error FROM l JOIN r USING (book_id, pos) WHERE l.n = r.n
    UNION ALL SELECT DISTINCT book_id, NULL::BIGINT, NULL, NULL, coalesce(l.n, 0) || ' against ' || coalesce(r.n, 0) FROM l FULL JOIN r USING (book_id) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)"""
)
def positional_zip(spark, d):
    """The labels of a book and its chapters' headings side by side, in order; another number of them is an error."""
    labels = table(spark, d, "chapters").where("book_id is not null").groupBy("book_id", "chapter_idx").agg(F.max("title").alias("label"))
    heads = sequence.first_heading(table(spark, d, "blocks")).withColumnRenamed("title", "text")
    return sequence.zip_strict(labels, heads, "book_id", "chapter_idx")


@query(
    """WITH w AS (SELECT DISTINCT split_part(provider_id, '-', 1) AS wanted FROM runs UNION ALL SELECT DISTINCT provider_id FROM runs UNION ALL SELECT 'nobody')
    SELECT wanted, count(DISTINCT p.provider_id) AS matches, CASE count(DISTINCT p.provider_id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome
    FROM w LEFT JOIN providers p ON p.provider_id = w.wanted OR p.family = w.wanted GROUP BY wanted"""
)
def provider_lookup(spark, d):
    """What a name leads to among ids and families: one translator, none, or several."""
    used = table(spark, d, "runs").select("provider_id").distinct()
    names = used.select(F.split_part("provider_id", F.lit("-"), F.lit(1)).alias("wanted")).distinct().unionByName(used.withColumnRenamed("provider_id", "wanted"))
    wanted = names.unionByName(spark.createDataFrame([("nobody",)], "wanted string"))
    p = table(spark, d, "providers").select("provider_id", F.explode(F.array_distinct(F.array("provider_id", "family"))).alias("wanted"))
    n = F.count_distinct("provider_id")
    return wanted.join(p, "wanted", "left").groupBy("wanted").agg(
        n.alias("matches"),
        F.when(n == 0, "unknown").when(n == 1, "found").otherwise("ambiguous").alias("outcome"),
    )


@query(
    "SELECT doc_id, sha256(text) AS digest, array_to_string(string_split(tags, ';')[1:3], ';') AS head"
    " FROM (SELECT DISTINCT doc_id, text, tags FROM documents WHERE text IS NOT NULL)",
)
def content_hashes(spark, d):
    """SHA-256 of contents; the first three of a list."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "tags").distinct()
    return rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.array_join(F.slice(F.split("tags", ";"), 1, 3), ";").alias("head"))
