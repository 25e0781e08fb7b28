"""Settings, from environment variables over defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

PREFIX = "DUTYFRAME_"


@dataclass(frozen=True)
class Settings:
    store: str = "store"
    landing: str = "landing"
    #: Minutes between refreshes; None leaves refreshing to single runs.
    refresh_minutes: int | None = 180
    reparse: bool = False

    @property
    def trigger(self) -> dict[str, object]:
        """Arguments of a stream's trigger: the interval, or once over what is there."""
        return {"availableNow": True} if self.refresh_minutes is None else {"processingTime": f"{self.refresh_minutes} minutes"}


def from_env(values: Mapping[str, str] | None = None) -> Settings:
    """DUTYFRAME_STORE, _LANDING, _REFRESH_MINUTES (0: off) and _REPARSE (1 or 0); a value that can't be read is an error."""
    values = os.environ if values is None else values
    found = {k[len(PREFIX) :].lower(): v for k, v in values.items() if k.startswith(PREFIX)}
    settings = replace(Settings(), **{k: found[k] for k in ("store", "landing") if k in found})
    if "refresh_minutes" in found:
        try:
            minutes = int(found["refresh_minutes"])
        except ValueError:
            minutes = -1
        if minutes < 0:
            raise ValueError(f"{PREFIX}REFRESH_MINUTES is no number of minutes: {found['refresh_minutes']!r}")
        settings = replace(settings, refresh_minutes=minutes or None)
    if "reparse" in found:
        if found["reparse"] not in ("0", "1"):
            raise ValueError(f"{PREFIX}REPARSE is neither 0 nor 1: {found['reparse']!r}")
        settings = replace(settings, reparse=found["reparse"] == "1")
    return settings
