"""Translators that speak to services: requests, answers and their errors. The transport itself is given.

``post(url, headers, body) -> (status, headers, text)`` is a picklable function; it raises OSError where the service
cannot be reached. Keys are given by name and read from the environment of the task that sends, never pickled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from inkloom.functions.json import aligned_answers
from inkloom.functions.messages import ASK, system_text
from inkloom.operators.run import Context, Definitive, Degrading, Transient, Unauthorised

Post = Callable[[str, dict, str], tuple[int, dict, str]]


def told(headers: dict) -> float | None:
    """Seconds of a Retry-After header; a date or nothing tells none."""
    value = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    try:
        return None if value is None else float(value)
    except ValueError:
        return None


def checked(post: Post, url: str, headers: dict, body: str) -> str:
    """The text of an answer; its status as an error."""
    try:
        status, got, text = post(url, headers, body)
    except OSError as e:
        raise Transient(str(e)) from None
    if status == 429 or status >= 500:
        raise Transient(f"HTTP {status}", told(got))
    if status in (401, 403):
        raise Unauthorised(f"HTTP {status}")
    if status >= 400:
        raise Definitive(f"HTTP {status}")
    return text


@dataclass(frozen=True)
class Chat:
    """A chat model: the batch as a JSON array, its answer the array between the first [ and the last ]."""

    post: Post
    url: str
    model: str
    key_name: str | None = None
    tasks: tuple[str, ...] = ("translate", "glossary", "priming")

    def translate(self, texts: list[str], context: Context) -> list[str]:
        key = os.environ.get(self.key_name, "") if self.key_name else ""
        if self.key_name and not key:
            raise Definitive(f"{self.key_name} is not set")
        system = system_text(context.task, context.source, context.target, context.priming, context.glossary, context.policy)
        messages = [
            {"role": "system", "content": system},
            {"role": "user", "content": f"{ASK[context.task]}\n{json.dumps(texts, ensure_ascii=False)}"},
        ]
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        text = checked(self.post, self.url, headers, json.dumps({"model": self.model, "messages": messages}, ensure_ascii=False))
        try:
            content = json.loads(text)["choices"][0]["message"]["content"]
            found = re.search(r"\[.*\]", content, re.S)
            got = json.loads(found.group()) if found else None
        except (ValueError, KeyError, IndexError, TypeError):
            raise Transient("an answer that cannot be read") from None
        if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
            raise Transient("an answer without texts")
        return got


@dataclass(frozen=True)
class Plain:
    """One mode of a translation service: of markup as it is, or of text."""

    post: Post
    url: str
    markup: bool

    def translate(self, texts: list[str], context: Context) -> list[str]:
        body = json.dumps({"texts": texts, "source": context.source or "auto", "target": context.target}, ensure_ascii=False)
        got = aligned_answers(checked(self.post, self.url, {"Content-Type": "application/json"}, body), len(texts), self.markup)
        if got is None:
            raise Definitive("an answer of another shape")
        return got


@dataclass(frozen=True)
class Service:
    """A translation service with a mode for markup, and one for text where the former loses any or is refused: from then
    on, or for one batch where it only fails for the time being."""

    markup: Plain
    text: Plain
    state: list = field(default_factory=list, compare=False)
    tasks: tuple[str, ...] = ("translate",)

    def translate(self, texts: list[str], context: Context) -> list[str]:
        return Degrading(self.markup, self.state, self.text).translate(texts, context)

