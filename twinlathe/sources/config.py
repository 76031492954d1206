"""TOML configuration and the choice of a collection's root."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

from twinlathe.errors import ConfigError
from twinlathe.schema import SOURCE_DIRS

CONFIG_NAME = "twinlathe.toml"
ROOT_VARIABLE = "TWINLATHE_ROOT"


def load_config(folder: str | Path) -> dict:
    """{} where there is no file."""
    path = Path(folder, CONFIG_NAME)
    if not path.exists():
        return {}
    try:
        return tomllib.loads(path.read_text())
    except tomllib.TOMLDecodeError as err:
        raise ConfigError(f"invalid {CONFIG_NAME}: {err}") from None


@dataclass(frozen=True)
class SyncConfig:
    remote: str
    remote_root: str
    local_settings: str | None = None
    remote_settings: str | None = None


def load_sync(folder: str | Path) -> SyncConfig:
    section = load_config(folder).get("sync") or {}
    missing = [k for k in ("remote", "remote_root") if not section.get(k)]
    if missing:
        raise ConfigError(f"[sync] in {CONFIG_NAME} is missing: {', '.join(missing)}")
    return SyncConfig(section["remote"], section["remote_root"], section.get("local_settings") or None, section.get("remote_settings") or None)


def detect_root(start: str | Path) -> Path | None:
    """The nearest folder, from ``start`` upwards, with a source folder in it."""
    start = Path(start).resolve()
    return next((p for p in (start, *start.parents) if any((p / d).is_dir() for d in SOURCE_DIRS.values())), None)


def resolve_root(flag: str | None, folder: str | Path, start: str | Path = ".") -> Path:
    """By flag, environment, configuration, or detection, in this order."""
    chosen = flag or os.environ.get(ROOT_VARIABLE) or load_config(folder).get("root")
    root = Path(chosen).expanduser() if chosen else detect_root(start)
    if root is None or not root.is_dir():
        raise ConfigError(f"no collection root: pass one, set {ROOT_VARIABLE}, or configure it ({root or 'none found'})")
    return root
