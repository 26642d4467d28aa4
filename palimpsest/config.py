"""Settings of a cohort: what statuses mean, when silence counts as a lapse, and where landmarks lie.

Settings are a mapping of sections, so that they can come from a file; `study` overlays them on
SETTINGS and checks them. What was known before an origin is no setting: operators that read
versions take `before`.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from typing import Any, NamedTuple

# Status names of the registry by meaning, and the default grid.
SETTINGS: dict[str, dict[str, Any]] = {
    "status": {
        "open": ["NOT_YET_RECRUITING", "RECRUITING", "ENROLLING_BY_INVITATION", "ACTIVE_NOT_RECRUITING", "SUSPENDED"],
        "stopped": ["TERMINATED", "WITHDRAWN"],
        "completed": ["COMPLETED"],
        "unknown": ["UNKNOWN"],
    },
    "silence": {"status": ["NOT_YET_RECRUITING", "RECRUITING", "ENROLLING_BY_INVITATION", "ACTIVE_NOT_RECRUITING"], "months": 24},
    "window": {"first": date(1995, 1, 1), "last": date(2001, 8, 1)},
    "landmarks": {"months": 6, "last": 6},
    "intervals": {"months": 6, "count": 4},
}


class Statuses(NamedTuple):
    open: list[str]
    stopped: list[str]
    completed: list[str]
    unknown: list[str]

    @property
    def ended(self) -> list[str]:
        return [*self.stopped, *self.completed]


class Silence(NamedTuple):
    status: list[str]
    months: int


class Window(NamedTuple):
    first: date
    last: date


class Steps(NamedTuple):
    """months between steps, and how many there are."""

    months: int
    count: int


class Study(NamedTuple):
    status: Statuses
    silence: Silence
    window: Window
    landmarks: Steps
    intervals: Steps


def study(settings: Mapping[str, Mapping[str, Any]] | None = None) -> Study:
    """SETTINGS overlaid with settings, section by section; ValueError if the parts contradict each other."""
    of = {name: section | dict((settings or {}).get(name, {})) for name, section in SETTINGS.items()}
    status, silence = Statuses(**of["status"]), Silence(**of["silence"])
    named = [s for group in status for s in group]
    if len(set(named)) < len(named):
        raise ValueError("one status has two meanings")
    if stray := set(silence.status) - set(status.open):
        raise ValueError(f"only open records can fall silent, not {sorted(stray)}")
    landmarks = Steps(of["landmarks"]["months"], of["landmarks"]["last"])
    intervals = Steps(**of["intervals"])
    if min(silence.months, landmarks.months, *intervals) < 1 or landmarks.count < 0:
        raise ValueError("months and counts start at one")
    return Study(status, silence, Window(**of["window"]), landmarks, intervals)
