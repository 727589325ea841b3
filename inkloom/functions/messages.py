"""Texts for models and people: prompts, and advice for each class of error. Column expressions around fixed wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a model is told by task; {source} and {target} are languages.
ROLE = {
    "translate": (
        "Translate passages of a book from {source} into {target}, in the voice of a printed book, without remarks of your own. "
        "Tokens like {{0}} and all tags with their attributes stay exactly as they are and where they are."
    ),
    "glossary": (
        "From the passage, list technical terms, jargon and proper names that must be translated alike throughout, with their "
        "translation into {target}: a JSON array of one string, one 'term -> translation' a line, and nothing else."
    ),
    "priming": (
        "Describe style and tone of the passage in three to six sentences of {target}, as guidance for a translator: a JSON "
        "array of one string, and nothing else."
    ),
}
ASK = {
    "translate": "Return a JSON array with the translation of each item, in the same order, and nothing else. Keep paragraphs within an item.",
    "glossary": "Passage from the first chapters:",
    "priming": "Passage from the first chapters:",
}
#: What is done with technical terms, by policy.
TERMS = {
    "traduzir": "Translate technical terms.",
    "manter": "Leave technical terms in the original language.",
    "hibrido": "Translate technical terms; where one occurs first, add the original in brackets.",
}

#: Titles and advice for people, by class of error.
ADVICE = {
    "drm": ("The book is protected", "Its content is encrypted and cannot be translated. Use a copy without protection."),
    "not_epub": ("Not an e-book", "The file is no e-book archive. Choose a file that ends in .epub."),
    "malformed": ("The book is damaged", "Try another copy, or have the archive rebuilt."),
    "auth": ("The key was refused", "Check the key of the service, or make a new one."),
    "rate": ("Too many requests", "The service slows down requests. Send fewer at a time and resume: what is done is saved."),
    "transient": ("The service cannot be reached", "Check the connection and resume: what is done is saved."),
    "definitive": ("The service refused the request", "See its message."),
    "quality": ("An answer was not usable", "Placeholders or markup were lost again and again. Resume to send the batch once more."),
    "misaligned": ("An answer was not usable", "It had another number of texts. Resume to send the batch once more."),
    "config": ("The settings are not valid", "Correct the file and try again."),
}
OTHER_ADVICE = ("Something went wrong", "The details are in the log.")


def _choose(key: Column, values: dict[str, str], otherwise: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def advice(error_class: Column) -> Column:
    """struct<title, advice> for an error class; unknown ones have a common one."""
    titles = {k: v[0] for k, v in ADVICE.items()}
    texts = {k: v[1] for k, v in ADVICE.items()}
    return F.struct(_choose(error_class, titles, OTHER_ADVICE[0]).alias("title"), _choose(error_class, texts, OTHER_ADVICE[1]).alias("advice"))


def system_prompt(task: Column, source: Column, target: Column, priming: Column, glossary: Column, policy: Column) -> Column:
    """Role, style, glossary (array<struct<term, translation>>) and policy of a request; the latter three for
    translations only, where they are given."""
    role = F.replace(F.replace(_choose(task, ROLE, ROLE["translate"]), F.lit("{source}"), F.coalesce(source, F.lit("?"))), F.lit("{target}"), target)
    lines = F.array_join(F.transform(glossary, lambda g: F.concat(F.lit("- "), g["term"], F.lit(" -> "), g["translation"])), "\n")
    style = F.when(F.length(priming) > 0, F.concat(F.lit("Style and tone:\n"), priming))
    terms = F.when(F.size(glossary) > 0, F.concat(F.lit("Use exactly these translations:\n"), lines))
    whole = F.concat_ws("\n\n", role, style, terms, _choose(policy, TERMS, TERMS["hibrido"]))
    return F.when(task == "translate", whole).otherwise(role)


def user_prompt(task: Column, texts: Column) -> Column:
    """What is asked, and the texts as a JSON array."""
    return F.concat_ws("\n", _choose(task, ASK, ASK["translate"]), F.to_json(texts))


def system_text(task: str, source: str, target: str, priming: str, glossary: tuple[tuple[str, str], ...], policy: str) -> str:
    """The same as ``system_prompt`` for one request, for translators that run within a task."""
    role = ROLE[task].replace("{source}", source or "?").replace("{target}", target)
    if task != "translate":
        return role
    parts = [role]
    if priming:
        parts.append("Style and tone:\n" + priming)
    if glossary:
        parts.append("Use exactly these translations:\n" + "\n".join(f"- {a} -> {b}" for a, b in glossary))
    return "\n\n".join([*parts, TERMS.get(policy, TERMS["hibrido"])])
