"""Column functions on JSON text: answers of models and services, saved state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of an answer that may hold its translations, and keys of a translation itself.
HOLDERS = ("translations", "translation", "data", "results")
LEAVES = ("translatedText", "translated", "text", "translationText")


def answers_in(value: object) -> list[str]:
    """The translations in a parsed answer, whatever its shape: under the first holder that has any, else the first leaf
    that is a string; of a list its strings if it has nothing else, else what each object holds and the head of each list
    (or of a list in it)."""
    found: list[str] = []
    if isinstance(value, dict):
        held = (answers_in(value[k]) for k in HOLDERS if k in value)
        leaf = (value[k] for k in LEAVES if isinstance(value.get(k), str))
        return next((h for h in held if h), None) or [*leaf][:1]
    if not isinstance(value, list):
        return found
    if all(isinstance(x, str) for x in value):
        return value
    for x in value:
        if isinstance(x, dict):
            found += answers_in(x)
        elif isinstance(x, list) and x:
            head = x[0][0] if isinstance(x[0], list) and x[0] else x[0]
            if isinstance(x[0], list) or isinstance(head, str):
                found.append(str(head))
    return found


def aligned_answers(body: str | None, n: int, markup: bool = False) -> list[str] | None:
    """The ``n`` translations of an answer; null where it is no JSON, has another number of them or a blank one. An answer
    of the markup service may be a list whose first element is the list of translations."""
    try:
        value = json.loads(body or "")
    except ValueError:
        return None
    direct = markup and isinstance(value, list) and value and isinstance(value[0], list)
    got = value[0] if direct else answers_in(value)
    return got if len(got) == n and all(isinstance(x, str) and x.strip() for x in got) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def answers_udf(body: pd.Series, n: pd.Series, markup: pd.Series) -> pd.Series:
    return pd.Series([aligned_answers(b, k, m) for b, k, m in zip(body, n, markup)])


def strings_in_chatter(text: Column) -> Column:
    """The JSON array of strings between the first [ and the last ]; null if there is none, or an element is no string."""
    raw = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    variant = F.try_parse_json(F.nullif(raw, F.lit("")))
    got = F.try_variant_get(variant, "$", "array<variant>")
    ok = F.forall(got, lambda v: F.schema_of_variant(v) == "STRING")
    return F.when(ok, F.from_json(raw, "array<string>"))


def message_content(body: Column) -> Column:
    """choices[0].message.content where it is a string."""
    v = F.try_variant_get(F.try_parse_json(body), "$.choices[0].message.content", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def usage_counts(body: Column) -> Column:
    """struct<prompt, completion>; what is missing or null counts as 0, what is no whole number from 0 on is an error."""
    v = F.try_parse_json(body)

    def get(path: str) -> Column:
        raw = F.try_variant_get(v, path, "variant")
        kind = F.schema_of_variant(raw)
        number = F.when(kind == "BIGINT", F.try_variant_get(v, path, "bigint"))
        missing = raw.isNull() | (kind == "VOID")
        return F.when(missing, F.lit(0).cast("long")).when(number >= 0, number).otherwise(
            F.raise_error(F.concat(F.lit("no token count: "), F.to_json(raw))).cast("long"),
        )

    return F.struct(get("$.usage.prompt_tokens").alias("prompt"), get("$.usage.completion_tokens").alias("completion"))


def model_ids(body: Column) -> Column:
    """Ids of the listed models that have one."""
    rows = F.from_json(body, "struct<data:array<struct<id:string>>>")["data"]
    return F.transform(F.filter(rows, lambda r: r["id"].isNotNull()), lambda r: r["id"])


def retry_after(header: Column) -> Column:
    return header.try_cast("double")


def saved_texts(body: Column) -> Column:
    """array<struct<path, block_id, text>> of a state document; texts that are no strings and ids that are no integers
    are dropped, anything unreadable is empty."""
    v = F.try_variant_get(F.try_parse_json(body), "$.translations", "map<string,variant>")
    per_path = F.transform(F.map_entries(v), lambda e: F.struct(e["key"].alias("path"), F.try_variant_get(e["value"], "$", "map<string,variant>").alias("texts")))
    flat = F.flatten(
        F.transform(per_path, lambda p: F.transform(F.coalesce(F.map_entries(p["texts"]), F.array().cast("array<struct<key:string,value:variant>>")), lambda t: F.struct(p["path"].alias("path"), t["key"].try_cast("bigint").alias("block_id"), F.when(F.schema_of_variant(t["value"]) == "STRING", F.try_variant_get(t["value"], "$", "string")).alias("text")))),
    )
    empty = F.array().cast("array<struct<path:string,block_id:bigint,text:string>>")
    return F.coalesce(F.filter(flat, lambda x: x["block_id"].isNotNull() & x["text"].isNotNull()), empty)


def strict_glossary(path: Column, body: Column) -> Column:
    """array<struct<term, translation>> of a glossary file; empty where there is no file, an error that names the path
    where anything in it is malformed."""
    text = lambda r, k: F.when(F.schema_of_variant(F.try_variant_get(r, k, "variant")) == "STRING", F.try_variant_get(r, k, "string"))
    rows = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    got = F.transform(rows, lambda r: F.struct(text(r, "$.termo").alias("term"), text(r, "$.traducao").alias("translation")))
    ok = F.coalesce(F.forall(got, lambda g: g["term"].isNotNull() & g["translation"].isNotNull()), F.lit(False))
    empty = F.array().cast("array<struct<term:string,translation:string>>")
    return F.when(body.isNull(), empty).when(ok, got).otherwise(F.raise_error(F.concat(F.lit("malformed glossary: "), path)))


def glossary_json(pairs: Column) -> Column:
    """Compact JSON of an array of [term, translation], sorted by code point."""
    return F.to_json(F.sort_array(pairs))


def glossary_version(pairs: Column) -> Column:
    return F.substring(F.sha2(glossary_json(pairs), 256), 1, 16)
