"""Settings and the reader's preferences: a few values on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

MOST_INTERESTS = 24


class SettingsError(ValueError):
    """A setting that is unknown or has a wrong type."""


@dataclass(frozen=True)
class Settings:
    """What the engine goes by. Times are in hours unless named otherwise."""

    retention_days: int = 21
    lookback: float = 36.0
    recluster: int = 48
    failures_allowed: int = 10
    per_feed: int = 40
    briefings_kept: int = 30
    briefing_minutes: float = 720.0
    history_turns: int = 12
    answers: int = 8

    def with_values(self, given: Mapping[str, object]) -> Settings:
        """These settings with ``given``, converted to the type of each; unknown names are an error."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := sorted(set(given) - set(kinds)):
            raise SettingsError(f"unknown settings: {', '.join(unknown)}")
        try:
            return replace(self, **{k: kinds[k](v) for k, v in given.items()})
        except (TypeError, ValueError) as why:
            raise SettingsError(str(why)) from why


def load_settings(path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "PRESSLOOM_") -> Settings:
    """Defaults, then a TOML file, then variables of the environment, each over the one before."""
    import tomllib

    out = Settings()
    if path and Path(path).exists():
        try:
            out = out.with_values(tomllib.loads(Path(path).read_text()))
        except tomllib.TOMLDecodeError as why:
            raise SettingsError(str(why)) from why
    known = {f.name for f in fields(out)}
    seen = os.environ if environment is None else environment
    return out.with_values({n: v for k, v in seen.items() if k.startswith(prefix) and (n := k[len(prefix) :].lower()) in known})


@dataclass
class Preferences:
    """A reader's interests in their own words, and whatever else a front end keeps."""

    interests: list[str] = field(default_factory=list)
    extras: dict = field(default_factory=dict)

    @property
    def onboarded(self) -> bool:
        return bool(self.interests)

    @classmethod
    def load(cls, path: str) -> Preferences:
        """The stored preferences; none for a file that is missing or unreadable."""
        try:
            data = json.loads(Path(path).read_text())
            return cls(list(data["interests"]), dict(data.get("extras") or {}))
        except (OSError, ValueError, KeyError, TypeError):
            return cls()

    def save(self, path: str) -> Preferences:
        """Store them, each interest once, at most :data:`MOST_INTERESTS`; the file changes at once or not at all."""
        once = list({i.strip().lower(): i.strip() for i in reversed(self.interests) if i.strip()}.values())[::-1]
        kept = Preferences(once[:MOST_INTERESTS], self.extras)
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        beside = target.with_suffix(".new")
        beside.write_text(json.dumps(asdict(kept), ensure_ascii=False))
        beside.replace(target)
        return kept

    @staticmethod
    def reset(path: str) -> None:
        Path(path).unlink(missing_ok=True)
