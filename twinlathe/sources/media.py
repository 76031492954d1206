"""Tags, stream properties and fingerprints of audio files, read on the executors.

The tag library and the probe tools are optional: without them tags are empty and values
null, and names guessed from file names take their place. Nothing here raises for an
unreadable file.
"""

from __future__ import annotations

import importlib
import json
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

PROBE_SECONDS, PRINT_SECONDS, VERSION_SECONDS = 60, 300, 10

# Tag names by container, the first that is filled counts.
TAG_NAMES = {
    "title": ("title", "TIT2", "©nam"), "artist": ("artist", "TPE1", "©ART"), "album": ("album", "TALB", "©alb"), "track_no": ("tracknumber", "TRCK", "trkn"),
}
INFO_DDL = "rel string, title string, artist string, album string, track_no string, duration double, sample_rate int, bits int, bitrate int, warning string"
PRINT_DDL = "rel string, fingerprint string, fp_duration double"


def first_text(value: Any) -> str | None:
    """The value, or the first element of a (nested) list, stripped; None where empty."""
    while isinstance(value, (list, tuple)):
        if not value:
            return None
        value = value[0]
    text = "" if value is None else str(value).strip()
    return text or None


def first_tag(tags: Any, names: tuple[str, ...]) -> str:
    for name in names:
        try:
            text = first_text(tags.get(name))
        except Exception:  # noqa: BLE001 - tag objects of some formats refuse foreign names
            continue
        if text:
            return text
    return ""


def _tool(args: list[str], seconds: int) -> str | None:
    if shutil.which(args[0]) is None:
        return None
    try:
        run = subprocess.run(args, capture_output=True, text=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout if run.returncode == 0 else None


def tool_version(tool: str, flag: str) -> str | None:
    """First line of the tool's version; None where it isn't there or says nothing."""
    if shutil.which(tool) is None:
        return None
    try:
        run = subprocess.run([tool, flag], capture_output=True, text=True, timeout=VERSION_SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return next(iter((run.stdout or run.stderr).strip().splitlines()), None)


def parse_probe(text: str | None) -> dict[str, Any]:
    """duration, sample_rate and bits from the probe's JSON; {} where it is none."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return {}
    stream = (data.get("streams") or [{}])[0]
    found = {"duration": (data.get("format") or {}).get("duration"), "sample_rate": stream.get("sample_rate"), "bits": stream.get("bits_per_sample")}
    kinds = {"duration": float, "sample_rate": int, "bits": int}
    return {k: kinds[k](v) for k, v in found.items() if v}


def probe(path: str) -> dict[str, Any]:
    fields = "format=duration:stream=sample_rate,bits_per_sample,codec_name"
    return parse_probe(_tool(["ffprobe", "-v", "error", "-select_streams", "a:0", "-show_entries", fields, "-of", "json", path], PROBE_SECONDS))


def read_info(path: str) -> dict[str, Any]:
    out: dict[str, Any] = dict.fromkeys(TAG_NAMES, "") | {"duration": None, "sample_rate": None, "bits": None, "bitrate": None, "warning": None}
    info = None
    try:
        audio = importlib.import_module("mutagen").File(path)
        info, tags = getattr(audio, "info", None), getattr(audio, "tags", None) or {}
        out |= {k: first_tag(tags, names) for k, names in TAG_NAMES.items()}
        out |= {"duration": getattr(info, "length", None) or None, "sample_rate": getattr(info, "sample_rate", None), "bits": getattr(info, "bits_per_sample", None), "bitrate": getattr(info, "bitrate", None)}
    except Exception:  # noqa: BLE001 - no tag library, or a file it can't read
        info = None
    if info is None or out["duration"] is None:
        probed = probe(path)
        out |= {k: v for k, v in probed.items() if out[k] is None}
        if info is None and not probed:
            out["warning"] = f"could not read audio info: {Path(path).name}"
    return out


def _infos(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = pd.DataFrame([read_info(p) for p in batch["path"]], columns=[c.split()[0] for c in INFO_DDL.split(", ")[1:]])
        yield rows.assign(rel=batch["rel"].to_numpy())[[c.split()[0] for c in INFO_DDL.split(", ")]]


def with_info(files: DataFrame) -> DataFrame:
    """Tags and stream properties by rel for files (path, rel)."""
    return files.select("path", "rel").mapInPandas(_infos, INFO_DDL)


def fingerprint(path: str) -> tuple[str | None, float | None]:
    lines = dict(line.split("=", 1) for line in (_tool(["fpcalc", "-raw", path], PRINT_SECONDS) or "").splitlines() if "=" in line)
    try:
        seconds = float(lines.get("DURATION", ""))
    except ValueError:
        seconds = None
    words = lines.get("FINGERPRINT", "").strip() or None
    return words, seconds if words else None


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [fingerprint(p) for p in batch["path"]]
        yield pd.DataFrame({"rel": batch["rel"], "fingerprint": [f for f, _ in found], "fp_duration": [d for _, d in found]})


def with_fingerprints(files: DataFrame) -> DataFrame:
    """Fingerprints by rel for files (path, rel): call for distinct files that need one."""
    return files.select("path", "rel").mapInPandas(_prints, PRINT_DDL)
