"""Column functions on text: placeholders, markup, marks of machine output, names and keys. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.session import is_blank

NUL = "\u0000"

#: Patterns of inline tags, mask tokens and placeholders.
TAG = r"</?[A-Za-z][\w:-]*(?:\s[^>]*)?/?>"
MASK = r"@@(\d+)@@"
PLACEHOLDER = r"\{\{(\d+)\}\}"
ESCAPED = NUL + r"\{\{\d+\}\}" + NUL

#: Marks that betray machine output, as case-blind patterns.
MACHINE_MARKS = [
    r"\[[^\]]*(?:tradu[çc][aã]o|original|nt\.)[^\]]*\]",
    r"\(\s*n\.?\s*t\.?\s*\)",
    r"nota\s+(?:do|da)\s+tradutor",
    r"traduzid[oa]\s+(?:por|com)\s+(?:ia|intelig[eê]ncia\s+artificial)",
    r"tradu[çc][aã]o\s+(?:automatica|automática|gerada|feita)\s+(?:por|com|via)",
    r"(?m)^\s*original:",
]

#: The kind of block each tag makes; other tags make DEFAULT_KIND.
DEFAULT_KIND = "texto"
KINDS = {
    "p": "paragrafo", "h1": "titulo", "h2": "titulo", "h3": "titulo", "h4": "titulo", "h5": "titulo", "h6": "titulo",
    "li": "item_lista", "td": "celula_tabela", "th": "celula_tabela", "dt": "termo", "dd": "definicao",
    "blockquote": "citacao", "figcaption": "legenda", "caption": "legenda", "div": "divisao", "section": "secao",
    "article": "artigo", "aside": "nota", "header": "cabecalho", "footer": "rodape", "pre": "codigo", "code": "codigo",
    "script": "codigo", "style": "codigo", "svg": "grafico", "math": "formula",
}

#: How much a text grows when translated into a language.
GROWTH = {"pt": 1.2, "en": 1.0, "es": 1.05, "fr": 1.05, "it": 1.05, "de": 1.1, "nl": 1.0, "ja": 0.7, "zh": 0.6, "ko": 0.7}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def word_count(text: Column) -> Column:
    """Tokens by white space; null counts as 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")), F.lit(0)).cast("long")


def translatable(text: Column, protected: Column) -> Column:
    """Not protected and not blank."""
    return ~F.coalesce(protected, F.lit(False)) & ~is_blank(text)


def kind_of(tag: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(KINDS), F.lower(tag)), F.lit(DEFAULT_KIND))


def primary_subtag(language: Column) -> Column:
    return F.lower(F.split_part(F.trim(language), F.lit("-"), F.lit(1)))


def growth_factor(language: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(GROWTH), primary_subtag(language)), F.lit(1.0))


def clean_placeholders(text: Column) -> Column:
    """Takes blanks out of {{ 0 }} and @ @ 0 @ @."""
    text = F.regexp_replace(text, r"(?U)\{\{\s*(\d+)\s*\}\}", "{{$1}}")
    return F.regexp_replace(text, r"(?U)@\s*@\s*(\d+)\s*@\s*@", "@@$1@@")


def placeholder_sequence(text: Column) -> Column:
    """Numbers of the placeholders in order, escaped ones left out."""
    bare = F.regexp_replace(clean_placeholders(text), ESCAPED, "")
    return F.transform(F.regexp_extract_all(bare, F.lit(PLACEHOLDER), F.lit(1)), lambda x: x.cast("long"))


def markup_sequence(text: Column) -> Column:
    """Inline tags in order, with white space normalised."""
    tidy = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), " +/>", "/>"), " +>", ">")
    return F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), tidy)


def strip_markup(text: Column) -> Column:
    """Text without tags and mask tokens; runs of blanks become one."""
    text = F.regexp_replace(F.regexp_replace(text, TAG, ""), MASK, "")
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def has_machine_mark(text: Column) -> Column:
    got = F.lit(False)
    for p in MACHINE_MARKS:
        got = got | text.rlike("(?iu)" + p)
    return got


def escapes(text: Column) -> Column:
    """Number of escape marks."""
    return F.length(text) - F.length(F.replace(text, F.lit(NUL), F.lit("")))


def faithful(original: Column, translated: Column) -> Column:
    """Same placeholders in the same order, and as many escape marks."""
    fixed = clean_placeholders(translated)
    return (placeholder_sequence(original) == placeholder_sequence(fixed)) & (escapes(original) == escapes(fixed))


def formatting_faithful(original: Column, translated: Column) -> Column:
    return faithful(original, translated) & (markup_sequence(original) == markup_sequence(clean_placeholders(translated)))


def reject_reason(original: Column, translated: Column) -> Column:
    """Why an answer is sent back, or null: empty, mark, markup (in this order)."""
    fixed = clean_placeholders(translated)
    return (
        F.when(is_blank(fixed), "empty")
        .when(has_machine_mark(fixed) & ~has_machine_mark(original), "mark")
        .when(~formatting_faithful(original, fixed), "markup")
    )


def salvage(original: Column, translated: Column) -> Column:
    """After the last attempt: null where nothing can be kept; without tags where only tags differ."""
    fixed = clean_placeholders(translated)
    lost = is_blank(fixed) | (has_machine_mark(fixed) & ~has_machine_mark(original)) | ~faithful(original, fixed)
    return F.when(~lost, F.when(formatting_faithful(original, fixed), fixed).otherwise(strip_markup(fixed)))


def glossary_lines(text: Column) -> Column:
    """array<struct<term, translation>> of lines "term -> translation" (or "term: translation")."""
    def parse(line: Column) -> Column:
        bare = F.trim(F.rtrim(F.regexp_replace(F.trim(line), r'^[",\[\]]+|[",\[\]]+$', "")))
        locate = lambda sep: F.locate(sep, bare)
        build = lambda sep: F.struct(
            F.trim(F.substring_index(bare, sep, 1)).alias("term"),
            F.trim(bare.substr(locate(sep) + len(sep), F.length(bare))).alias("translation"),
        )
        return F.when(locate("->") > 0, build("->")).when(locate(":") > 0, build(":"))

    return F.filter(F.transform(F.split(text, r"\R"), parse), lambda p: p.isNotNull() & (p["term"] != "") & (p["translation"] != ""))


def redact(text: Column, secrets: Column) -> Column:
    """Replaces every non-empty secret of an array, in order."""
    return F.aggregate(secrets, text, lambda t, s: F.when(F.coalesce(s, F.lit("")) == "", t).otherwise(F.replace(t, s, F.lit("***"))))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-")


def output_path(path: Column, language: Column) -> Column:
    """<stem>-<language>.<suffix> beside the source."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("-"), language, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def key_name(provider: Column) -> Column:
    return F.concat(F.upper(provider), F.lit("_API_KEY"))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def state_key(
    book_hash: Column,
    source: Column,
    target: Column,
    model: Column,
    policy: Column,
    glossary: Column,
    family: Column,
    provider: Column,
    variant: Column,
) -> Column:
    """First 16 hex digits of the SHA-256 of the fields that a saved state depends on.

    The default model family keeps an older form with fewer fields; others leave model, policy and glossary out."""
    e = F.lit("")
    c = lambda x: F.coalesce(x, e)
    plain = c(family).isin("", "llm") & c(provider).isin("", "deepseek")
    is_llm = c(family) == "llm"
    own = lambda x: F.when(is_llm, c(x)).otherwise(e)
    short = F.concat_ws(NUL, c(book_hash), c(source), c(target), c(model), c(policy), c(glossary))
    long = F.concat_ws(
        NUL,
        c(book_hash),
        F.when(c(family) == "", "llm").otherwise(family),
        c(provider),
        F.when(c(variant) == "", "default").otherwise(variant),
        c(source),
        c(target),
        own(model),
        own(policy),
        own(glossary),
    )
    return F.substring(F.sha2(F.when(plain, short).otherwise(long), 256), 1, 16)


def version_parts(text: Column) -> Column:
    """[1,2,3] of v1.2.3; [0] where any part is no number."""
    parts = F.transform(F.split(F.regexp_replace(text, "^[vV]+", ""), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array(F.lit(0))).otherwise(parts)


def retry_class(status: Column) -> Column:
    """transient, auth, definitive or ok by HTTP status."""
    return F.when((status == 429) | (status >= 500), "transient").when(status.isin(401, 403), "auth").when(status >= 400, "definitive").otherwise("ok")


def backoff_ceiling(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def retry_delay(attempt: Column, told: Column, least: float | None = None, most: float = 60.0) -> Column:
    """Seconds that a server told to wait, capped (and not under ``least``); the ceiling of the backoff where it told none."""
    floored = told if least is None else F.greatest(told, F.lit(least))
    return F.when(told.isNotNull(), F.least(floored, F.lit(most))).otherwise(backoff_ceiling(attempt, most=most))


def at_least_zero(text: Column) -> Column:
    """The number in a text if positive, else 0."""
    return F.greatest(F.coalesce(text.try_cast("bigint"), F.lit(0)), F.lit(0)).cast("long")


def dos_datetime(ts: Column) -> Column:
    """struct<date, time>: the packed fields of archive headers."""
    date = F.shiftleft(F.year(ts) - 1980, 9) + F.shiftleft(F.month(ts), 5) + F.dayofmonth(ts)
    time = F.shiftleft(F.hour(ts), 11) + F.shiftleft(F.minute(ts), 5) + F.floor(F.second(ts) / 2)
    return F.struct(date.cast("long").alias("date"), time.cast("long").alias("time"))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
