"""Schemas of the record-linkage tables and the fixed domains of their columns."""

from __future__ import annotations

# Domains of the columns.
SOURCES = ("library", "tracks", "incoming")
SOURCE_DIRS = {"library": "Library", "tracks": "Tracks", "incoming": "Incoming"}
CATEGORIES = ("EXACT_DUPLICATE", "VERY_LIKELY_SAME_RECORDING", "POSSIBLE_SAME_RECORDING", "POSSIBLE_ALTERNATE_VERSION")
ACTIONS = ("remove", "rename", "keep_both")
AUDIO_LABELS = {".flac": "FLAC", ".mp3": "MP3", ".m4a": "M4A", ".aac": "AAC", ".ogg": "OGG", ".opus": "Opus", ".wav": "WAV"}
TRASH_DIR = ".Trash"

TRACK_DDL = "path string, rel string, source string, size long, mtime_ns long, sha256 string, duration double, title string, artist string, album string, track_no string, format_desc string, fingerprint string, fp_duration double"
CACHE_DDL = "root string, rel string, size long, mtime_ns long, sha256 string, duration double, title string, artist string, album string, track_no string, format_desc string, fingerprint string, fp_duration double"
DECISION_DDL = "root string, id string, created string, action string, kept string, removed string, a string, b string, renames array<struct<`from`: string, `to`: string>>, seq long"
