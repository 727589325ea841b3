"""Reversible protection of snippets and markup: Arrow UDFs around plain functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import TAG

NUL = "\0"
LITERAL = re.compile(r"\{\{\d+\}\}")
#: A fenced literal, or the number of a free placeholder.
HELD = re.compile(rf"{NUL}\{{\{{\d+\}}\}}{NUL}|\{{\{{(\d+)\}}\}}")
#: What mask() numbers: tags, and whatever of the text could be read as part of a number's own marks.
UNIT = re.compile(rf"{TAG}|@(?:\s*@)+")
MARK = re.compile(r"@\s*@\s*(\d+)\s*@\s*@")
TAG_NAME = re.compile(r"[A-Za-z][\w:-]*")
#: What stands between the marks of an empty element, as services drop marks without anything to translate.
FILLER = "\u00a0"


def escape(text: str) -> str:
    return LITERAL.sub(lambda m: f"{NUL}{m.group()}{NUL}", text)


def protect(text: str, snippets: list[str]) -> tuple[str, dict[int, str]]:
    """(template, {N: snippet}): longest snippets win, N counts first occurrences; what looks like a placeholder in the
    text is fenced by NUL and never matched into."""
    wanted = sorted({escape(s) for s in snippets if s}, key=lambda s: (-len(s), s))
    parts = [*map(re.escape, wanted), f"{NUL}[^{NUL}]*(?:{NUL}|$)"]
    numbers: dict[str, int] = {}
    known = set(wanted)

    def put(m: re.Match) -> str:
        hit = m.group()
        if hit not in known:
            return hit
        return "{{%d}}" % numbers.setdefault(hit, len(numbers))

    template = re.sub("|".join(parts), put, escape(text), flags=re.S)
    return template, {n: s for s, n in numbers.items()}


def restore(template: str, saved: dict[int, str]) -> str:
    """Inverse of protect; a number without a snippet is an error."""

    def put(m: re.Match) -> str:
        if m.group(1) is None:
            return m.group()
        n = int(m.group(1))
        if n not in saved:
            raise ValueError(f"placeholder {n} has no protected content")
        return saved[n]

    return HELD.sub(put, template).replace(NUL, "")


def units(text: str) -> list[str]:
    """The text cut into units: plain text at even places, at odd ones what is to be numbered."""
    out, at = [], 0
    for m in UNIT.finditer(text):
        out += [text[at : m.start()], m.group()]
        at = m.end()
    return [*out, text[at:]]


def is_hollow(start: str, gap: str, end: str) -> bool:
    """Whether two units and the text between them are an element without content."""
    if gap.strip() or start[0] != "<" or start[1] == "/" or start.endswith("/>") or not end.startswith("</"):
        return False
    return TAG_NAME.search(start).group() == TAG_NAME.search(end).group()


def mask(text: str) -> tuple[str, list[str], dict[int, str]]:
    """(masked text, units, gaps): the text with a mark @@N@@ for its N-th unit. An element without content keeps a
    filler between its marks; ``gaps`` has what stood there, by the number of its first mark."""
    parts = units(text)
    kept, gaps = parts[1::2], {}
    shown = parts[0::2]
    for n, (start, end) in enumerate(zip(kept, kept[1:])):
        if is_hollow(start, shown[n + 1], end):
            gaps[n] = shown[n + 1]
            shown[n + 1] = FILLER
    out = shown[0] + "".join(f"@@{n}@@{t}" for n, t in enumerate(shown[1:]))
    return out, kept, gaps


def unmask(text: str, kept: list[str], gaps: dict[int, str]) -> str:
    """Inverse of mask, for a text whose marks may have moved or been pulled apart by blanks. Numbers that were never
    given out stay as they are."""
    parts = MARK.split(text)
    numbers = [int(n) for n in parts[1::2]]
    shown = parts[0::2]
    for k, (n, after) in enumerate(zip(numbers, numbers[1:])):
        if n in gaps and after == n + 1 and not shown[k + 1].strip():
            shown[k + 1] = gaps[n]
    units_back = [kept[n] if n < len(kept) else f"@@{n}@@" for n in numbers]
    return shown[0] + "".join(u + t for u, t in zip(units_back, shown[1:]))


STRING = T.StringType()
PROTECTED = T.StructType().add("template", STRING).add("protected", T.MapType(T.IntegerType(), STRING))
MASKED = T.StructType().add("masked", STRING).add("kept", T.ArrayType(STRING)).add("gaps", T.MapType(T.IntegerType(), STRING))


@F.pandas_udf(PROTECTED)
def protect_udf(text: pd.Series, snippets: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else protect(t, list(s) if s is not None else []) for t, s in zip(text, snippets)]
    return pd.DataFrame(rows, columns=["template", "protected"])


@F.pandas_udf(STRING)
def restore_udf(template: pd.Series, saved: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else restore(t, dict(s) if s is not None else {}) for t, s in zip(template, saved)])


@F.pandas_udf(MASKED)
def mask_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if t is None else mask(t) for t in text], columns=["masked", "kept", "gaps"])


@F.pandas_udf(STRING)
def unmask_udf(text: pd.Series, kept: pd.Series, gaps: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unmask(t, list(a), dict(g)) for t, a, g in zip(text, kept, gaps)])
