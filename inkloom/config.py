"""Settings from a TOML file: read, checked, written. A control table for the driver; no data pass through it."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


class ConfigError(Exception):
    """A setting that is not valid; the message begins with its place."""


@dataclass(frozen=True)
class Translator:
    """Settings of one translator. A model has a name of its own and of its key; a service has a variant."""

    family: str = "llm"
    model: str | None = None
    base_url: str | None = None
    key_name: str | None = None
    transport_variant: str = "default"
    max_batch_chars: int | None = None
    max_batch_items: int | None = None
    parallelism: int = 4
    delay_seconds: float = 0.0


@dataclass(frozen=True)
class Settings:
    target: str = "pt-BR"
    policy: str = "hibrido"
    translator: str | None = None
    batch_tokens: int = 4000
    translators: dict[str, Translator] = field(default_factory=dict)


#: Fields that make no sense for a family.
NOT_FOR = {"machine_translation": ("model", "key_name"), "llm": ()}
LEAST = {"max_batch_chars": 1, "max_batch_items": 1, "parallelism": 1, "delay_seconds": 0, "batch_tokens": 1}
KINDS = {"str": str, "int": int, "float": (int, float)}
POLICIES = ("traduzir", "manter", "hibrido")
KEY = re.compile(r"[A-Za-z0-9_-]+")


def _checked(cls: type, given: dict, place: str) -> dict:
    """The given values, each of its field's kind and within its bounds."""
    known = {f.name: str(f.type) for f in fields(cls)}
    for name, value in given.items():
        where = f"{place}.{name}" if place else name
        if name not in known:
            raise ConfigError(f"{where}: unknown")
        if known[name].startswith("dict"):
            continue
        if isinstance(value, bool) or not isinstance(value, KINDS[known[name].split(" ")[0]]):
            raise ConfigError(f"{where}: not a {known[name].split(' ')[0]}")
        if name in LEAST and value < LEAST[name]:
            raise ConfigError(f"{where}: under {LEAST[name]}")
    return given


def parse(text: str) -> Settings:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"file: {e}") from None
    tables = data.pop("translators", {})
    if not isinstance(tables, dict):
        raise ConfigError("translators: not a table")
    translators = {}
    for name, given in sorted(tables.items()):
        place = f"translators.{name}"
        if not isinstance(given, dict):
            raise ConfigError(f"{place}: not a table")
        one = Translator(**_checked(Translator, given, place))
        if one.family not in NOT_FOR:
            raise ConfigError(f"{place}.family: unknown {one.family}")
        wrong = next((k for k in NOT_FOR[one.family] if k in given), None)
        if wrong:
            raise ConfigError(f"{place}.{wrong}: not for {one.family}")
        translators[name] = one
    got = Settings(**_checked(Settings, data, ""), translators=translators)
    if got.policy not in POLICIES:
        raise ConfigError(f"policy: unknown {got.policy}")
    if got.translator is not None and got.translator not in translators:
        raise ConfigError(f"translator: unknown {got.translator}")
    return got


def load(path: str | Path) -> Settings:
    """Settings of a file; the defaults where there is none."""
    path = Path(path)
    return parse(path.read_text(encoding="utf-8")) if path.exists() else Settings()


def dump(settings: Settings) -> str:
    """The settings as TOML, in one order whatever order they were given in; what is null is left out."""
    def lines(item: object) -> list[str]:
        values = ((f.name, getattr(item, f.name)) for f in fields(item))
        return [f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in values if v is not None and not isinstance(v, dict)]

    out = lines(settings)
    for name in sorted(settings.translators):
        key = name if KEY.fullmatch(name) else json.dumps(name, ensure_ascii=False)
        out += ["", f"[translators.{key}]", *lines(settings.translators[name])]
    return "\n".join(out) + "\n"


def save(settings: Settings, path: str | Path) -> None:
    """Writes beside the file and renames, so that no half-written one is left."""
    path = Path(path)
    part = path.with_name(path.name + ".part")
    part.write_text(dump(settings), encoding="utf-8")
    part.replace(path)


def with_translator(settings: Settings, name: str, **changes) -> Settings:
    """The settings with one translator added or changed."""
    _checked(Translator, changes, f"translators.{name}")
    one = replace(settings.translators.get(name, Translator()), **changes)
    return parse(dump(replace(settings, translators=settings.translators | {name: one})))
