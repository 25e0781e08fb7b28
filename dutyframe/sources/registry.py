"""The known sources."""

from __future__ import annotations

from dutyframe.sources.base import Source
from dutyframe.sources.hospitals import Hospitals
from dutyframe.sources.pharmacies import Pharmacies


def all_sources() -> list[Source]:
    return [Pharmacies(), Hospitals()]


def by_id(name: str) -> Source:
    for source in all_sources():
        if source.id == name:
            return source
    raise KeyError(f"no source {name!r}; known: {', '.join(s.id for s in all_sources())}")
