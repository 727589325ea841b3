"""Translators by family and id: registration, lookup, making one.

A registry is filled on the driver; what it makes is picklable and runs within tasks.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field

#: Families of translators.
FAMILIES = ("llm", "machine_translation")


class RegistryError(Exception):
    """A name that leads to no translator or to several, or a description that is not valid."""


@dataclass(frozen=True)
class Description:
    """What is known of a translator before one is made. Limits that are null are none."""

    family: str
    provider_id: str
    display_name: str
    version: str = "1"
    transport_variant: str = "default"
    max_batch_chars: int | None = None
    max_batch_items: int | None = None
    max_concurrency: int = 1
    delay_seconds: float = 0.0
    reports_token_usage: bool = False
    #: What it can be asked for besides translations; passes it does not support are passed by.
    tasks: tuple[str, ...] = ("translate",)

    def check(self) -> None:
        if self.family not in FAMILIES:
            raise RegistryError(f"{self.provider_id}: no family {self.family}")
        if not self.provider_id.strip() or not self.display_name.strip():
            raise RegistryError("a translator needs an id and a name")
        for name in ("max_batch_chars", "max_batch_items"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise RegistryError(f"{self.provider_id}: {name} is under 1")
        if self.max_concurrency < 1 or self.delay_seconds < 0:
            raise RegistryError(f"{self.provider_id}: limits are not valid")
        if self.family == "llm" and not self.reports_token_usage:
            raise RegistryError(f"{self.provider_id}: a model has to report its usage")


@dataclass
class Registry:
    entries: dict[tuple[str, str], tuple[Description, Callable[..., object]]] = field(default_factory=dict)

    def register(self, description: Description, factory: Callable[..., object]) -> None:
        """Adds a translator; a second one of the same family and id is an error."""
        description.check()
        key = description.family, description.provider_id
        if key in self.entries:
            raise RegistryError(f"{key[0]}/{key[1]} is there already")
        self.entries[key] = description, factory

    def discover(self, package: str) -> None:
        """Registers every module of a package that has ``DESCRIPTION`` and a callable ``create``; one without them is an
        error."""
        for info in pkgutil.iter_modules(importlib.import_module(package).__path__):
            if info.name.startswith("_"):
                continue
            module = importlib.import_module(f"{package}.{info.name}")
            description, create = getattr(module, "DESCRIPTION", None), getattr(module, "create", None)
            if not isinstance(description, Description) or not callable(create):
                raise RegistryError(f"{module.__name__} has no DESCRIPTION or no create()")
            self.register(description, create)

    def listed(self, family: str | None = None) -> list[Description]:
        """All descriptions, by family and id."""
        return [self.entries[k][0] for k in sorted(self.entries) if family in (None, k[0])]

    def find(self, provider_id: str, family: str | None = None) -> Description:
        got = [d for d in self.listed(family) if d.provider_id == provider_id]
        if not got:
            raise RegistryError(f"unknown: {provider_id}" + (f" in {family}" if family else ""))
        if len(got) > 1:
            raise RegistryError(f"ambiguous: {provider_id}")
        return got[0]

    def create(self, provider_id: str, family: str | None = None, **options) -> object:
        d = self.find(provider_id, family)
        return self.entries[d.family, d.provider_id][1](**options)
