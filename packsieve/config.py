"""Settings of a scan from a TOML file. A file that can't be read as such is an error; one that is absent means the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from packsieve.functions.severity import SEVERITIES
from packsieve.operators import rulebook
from packsieve.operators.catalog import RULES, Rule


class ConfigError(ValueError):
    """A settings file that is there and wrong."""


@dataclass(frozen=True)
class Cache:
    enabled: bool = True
    max_size_mb: int = 100
    ttl_hours: int = 24


@dataclass(frozen=True)
class Reputation:
    """Which verdict tables a scan may ask; keys of remote services have no use here."""

    urlhaus_enabled: bool = False
    cache_duration_hours: int = 24


@dataclass(frozen=True)
class Config:
    rules_path: str | None = None
    rule_folders: tuple[str, ...] = ()
    min_severity: str = "low"
    enable_threat_intel: bool = False
    threat_intel: Reputation = field(default_factory=Reputation)
    cache: Cache = field(default_factory=Cache)
    timeout_seconds: int = 30

    def rules(self) -> tuple[list[Rule], dict[str, str]]:
        """The catalog with the rules of ``rule_folders`` in order and of ``rules_path`` behind it, and the files there that
        couldn't be read. A folder of ``rule_folders`` may be missing, ``rules_path`` may not."""
        more, bad = rulebook.read_folders(list(self.rule_folders))
        if self.rules_path:
            last, wrong = rulebook.read_folder(self.rules_path)
            more, bad = more + last, bad | wrong
        return rulebook.add(list(RULES), more), bad


def _made(kind, told: dict, where: str):
    wanted = {f.name: f for f in fields(kind)}
    values = {}
    for name, value in told.items():
        if name not in wanted:
            continue  # settings of other versions are passed by
        default = getattr(kind(), name)
        if isinstance(default, (Cache, Reputation)):
            if not isinstance(value, dict):
                raise ConfigError(f"{where}: {name} is no table")
            value = _made(type(default), value, where)
        elif isinstance(default, tuple):
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ConfigError(f"{where}: {name} should be a list of texts")
            value = tuple(value)
        elif default is not None and type(value) is not type(default):
            raise ConfigError(f"{where}: {name} should be {type(default).__name__}")
        values[name] = value
    return kind(**values)


def read(path: str) -> Config:
    """The settings of a file."""
    try:
        told = tomllib.loads(Path(path).read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    out = _made(Config, told, path)
    if out.min_severity not in SEVERITIES:
        raise ConfigError(f"{path}: unknown severity {out.min_severity!r}")
    return out


def read_or_default(path: str) -> Config:
    return read(path) if Path(path).exists() else Config()
