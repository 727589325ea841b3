"""Running a translator over batches: retries, pace, quality gate, salvage, one row of outcome per block.

A translator is any picklable object with ``translate(texts, context) -> texts``; it raises ``Transient`` for what may
pass and ``Definitive`` for what will not. A batch that fails gives rows with its error class and does not fail the
job, so the others' results are kept and a later run resumes from them.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import MACHINE_MARKS, MASK, TAG
from inkloom.session import ship

MARKS = [re.compile(p, re.I) for p in MACHINE_MARKS]


class Transient(Exception):
    """May pass: too many requests, server errors, unreadable answers. ``retry_after``: seconds the server told to wait."""

    def __init__(self, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class Definitive(Exception):
    """Will not pass: the request itself is refused."""


class Unauthorised(Definitive):
    """The key is refused, or there is none."""


@dataclass(frozen=True)
class Backoff:
    """How long to wait before the n-th try again (from 0): what the server told, at most ``most``; else a random part of
    a ceiling that doubles. ``least`` keeps what a server tells from being negative."""

    base: float = 1.0
    most: float = 60.0
    least: float | None = None

    def delay(self, attempt: int, told: float | None, rng: random.Random) -> float:
        if told is not None:
            return min(self.most, told if self.least is None else max(self.least, told))
        return rng.uniform(0.0, min(self.most, self.base * 2.0**attempt))


@dataclass
class Pace:
    """Keeps ``seconds`` between the requests of a task."""

    seconds: float = 0.0
    last: float | None = None

    def keep(self, now: Callable[[], float], sleep: Callable[[float], None]) -> None:
        if self.last is not None and now() - self.last < self.seconds:
            sleep(self.seconds - (now() - self.last))
        self.last = now()


@dataclass(frozen=True)
class Context:
    """What a translator is told besides the texts."""

    source: str = ""
    target: str = ""
    glossary: tuple[tuple[str, str], ...] = ()
    priming: str = ""
    #: translate, glossary or priming
    task: str = "translate"
    policy: str = "hibrido"


@dataclass(frozen=True)
class Prefix:
    """The deterministic translator of tests and checks: puts a prefix before each text."""

    prefix: str = "TR: "

    def translate(self, texts: list[str], context: Context) -> list[str]:
        return [self.prefix + t for t in texts]


@dataclass(frozen=True)
class Tagless(Prefix):
    """As Prefix, but loses tags, as endpoints for plain text do; masked ones stay."""

    def translate(self, texts: list[str], context: Context) -> list[str]:
        return super().translate([re.sub(TAG, "", t) for t in texts], context)


@dataclass(frozen=True)
class Degrading:
    """Sends texts with their markup; where an answer comes back unfaithful or is refused, sends them again with tags
    masked (by ``plain``, if that is another mode), and all later ones so; where it fails for the time being, masks this
    batch only."""

    inner: object
    seen: list = field(default_factory=list, compare=False)
    plain: object = None

    def translate(self, texts: list[str], context: Context) -> list[str]:
        from inkloom.functions.placeholders import mask, unmask

        if not self.seen:
            try:
                got = self.inner.translate(texts, context)
                if len(got) == len(texts) and all(tidy(b).strip() and same_markup(a, b) for a, b in zip(texts, got)):
                    return got
                self.seen.append(True)  # from here on this task masks at once
            except Definitive:
                self.seen.append(True)
            except Transient:
                pass
        masked = [mask(t) for t in texts]
        answers = (self.plain or self.inner).translate([m[0] for m in masked], context)
        if len(answers) != len(texts):
            return answers
        return [unmask(t, kept, gaps) for t, (_, kept, gaps) in zip(answers, masked)]


class Loose(str):
    """An answer that need not keep the markup of what was sent."""


def tidy(text: str) -> str:
    if isinstance(text, Loose):
        return text
    text = re.sub(r"\{\{\s*(\d+)\s*\}\}", r"{{\1}}", text)
    return re.sub(r"@\s*@\s*(\d+)\s*@\s*@", r"@@\1@@", text)


def holes(text: str) -> list[str]:
    return re.findall(r"\{\{(\d+)\}\}", re.sub("\0\\{\\{\\d+\\}\\}\0", "", tidy(text)))


def tags(text: str) -> list[str]:
    return [re.sub(r"\s+(/?>)", r"\1", re.sub(r"\s+", " ", m.group())) for m in re.finditer(TAG, text)]


def same_holes(a: str, b: str) -> bool:
    return holes(a) == holes(b) and a.count("\0") == b.count("\0")


def same_markup(a: str, b: str) -> bool:
    return same_holes(a, b) and tags(a) == tags(tidy(b))


def marked(text: str) -> bool:
    return any(m.search(text) for m in MARKS)


def clean(source: str, answer: str) -> bool:
    if isinstance(answer, Loose):
        return bool(answer.strip())
    return bool(answer.strip()) and not (marked(answer) and not marked(source)) and same_markup(source, answer)


def without_markup(text: str) -> str:
    return re.sub(" +", " ", re.sub(MASK, "", re.sub(TAG, "", text))).strip()


def salvaged(source: str, answer: str) -> str | None:
    if not answer.strip() or marked(answer) and not marked(source) or not same_holes(source, answer):
        return None
    return answer if same_markup(source, answer) else without_markup(answer)


def attempt_batch(
    texts: list[str],
    translator,
    context: Context,
    attempts: int = 3,
    retries: int = 4,
    backoff: Backoff = Backoff(),
    sleep: Callable[[float], None] = time.sleep,
    rng: random.Random | None = None,
    pace: Pace | None = None,
) -> tuple[list[str | None], str | None]:
    """(texts or nulls, error class). Each of ``attempts`` for the answer's quality may try ``retries`` times again where
    the transport fails for the time being."""
    rng = rng or random.Random(0)
    answers: list[str] = []
    for _ in range(attempts):
        for r in range(retries + 1):
            try:
                if pace is not None:
                    pace.keep(time.monotonic, sleep)
                answers = translator.translate(texts, context)
                break
            except Transient as e:
                if r == retries:
                    return [None] * len(texts), "transient"
                sleep(backoff.delay(r, e.retry_after, rng))
            except Unauthorised:
                return [None] * len(texts), "auth"
            except Definitive:
                return [None] * len(texts), "definitive"
            except Exception:  # noqa: BLE001 - a translator's own failure must not end the job
                return [None] * len(texts), "unknown"
        if len(answers) == len(texts):
            answers = [tidy(a) for a in answers]
            if all(map(clean, texts, answers)):
                return answers, None
    if len(answers) != len(texts):
        return [None] * len(texts), "misaligned"
    kept = [salvaged(s, a) for s, a in zip(texts, answers)]
    return (kept, None) if None not in kept else ([None] * len(texts), "quality")


def translate_batches(
    rows: DataFrame,
    translator,
    context: Context = Context(),
    attempts: int = 3,
    retries: int = 4,
    backoff: Backoff = Backoff(),
    in_flight: int | None = None,
    pause: float = 0.0,
) -> DataFrame:
    """``rows``: state_key, batch, block_id, text, with batches of bounded size. Gives state_key, batch, block_id, text,
    error_class; text is null where there is an error.

    ``in_flight`` is the most batches at one time: batches are dealt to so many tasks, each of which works on one after
    the other, ``pause`` seconds apart. After an error that others would meet as well (auth), a task sends no more: its
    remaining batches come out as "not sent"; what is done is kept."""
    ship(rows.sparkSession)
    n = in_flight or rows.sparkSession.sparkContext.defaultParallelism
    item = F.sort_array(F.collect_list(F.struct("block_id", "text")))
    batches = rows.groupBy("state_key", "batch").agg(item.alias("items")).repartition(n, "state_key", "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, stopped = Pace(pause), False
        for part in batches:
            for key, batch, items in zip(*[part.column(k).to_pylist() for k in ("state_key", "batch", "items")]):
                if stopped:
                    out, error = [None] * len(items), "not sent"
                else:
                    rng = random.Random(f"{key}/{batch}")
                    out, error = attempt_batch([x["text"] for x in items], translator, context, attempts, retries, backoff, rng=rng, pace=pace)
                stopped = stopped or error == "auth"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(items)),
                        pa.array([batch] * len(items), pa.int64()),
                        pa.array([x["block_id"] for x in items], pa.int64()),
                        pa.array(out, pa.string()),
                        pa.array([error] * len(items), pa.string()),
                    ],
                    ["state_key", "batch", "block_id", "text", "error_class"],
                )

    return batches.mapInArrow(run, "state_key string, batch long, block_id long, text string, error_class string")
