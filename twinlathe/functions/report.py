"""Human-readable values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlathe.functions.text import suffix
from twinlathe.schema import AUDIO_LABELS


def fmt_duration(seconds: Column) -> Column:
    """m:ss.t, tenths rounded half to even, never below zero; 'unknown' for null."""
    tenths = F.greatest(F.lit(0), F.bround(seconds * 10, 0).cast("long"))
    text = F.format_string("%d:%02d.%d", F.floor(tenths / 600).cast("long"), F.floor(tenths % 600 / 10).cast("long"), tenths % 10)
    return F.when(seconds.isNull(), "unknown").otherwise(text)


def fmt_bytes(n: Column) -> Column:
    """B, KiB, MiB or GiB with one decimal, rounded half to even."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB")):
        out = out.when(n / 1024.0**power < 1024, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1)))
    return out.otherwise(F.format_string("%.1f GiB", F.bround(n / 1024.0**3, 1)))


def display(tag: Column, guess: Column) -> Column:
    """The tag, else the guess marked as one, else '(unknown)'."""
    return F.when(F.coalesce(tag, F.lit("")) != "", tag).when(F.coalesce(guess, F.lit("")) != "", F.concat(guess, F.lit(" (from filename)"))).otherwise("(unknown)")


def describe_format(path: Column, sample_rate: Column, bits: Column, bitrate: Column) -> Column:
    """'FLAC 44.1 kHz / 16 bit' and shorter forms as far as known (null or 0: unknown)."""
    ext = suffix(path)
    labels = F.create_map(*[F.lit(x) for kv in AUDIO_LABELS.items() for x in kv])
    bare = F.upper(F.regexp_replace(ext, r"^\.", ""))
    label = F.coalesce(F.element_at(labels, ext), F.when(bare == "", "AUDIO").otherwise(bare))
    known = lambda c: F.coalesce(c, F.lit(0)) != 0
    khz = F.format_string("%.1f kHz", sample_rate / 1000)
    kbps = F.concat(F.floor(bitrate / 1000).cast("string"), F.lit(" kbps"))
    return (
        F.when(known(sample_rate) & known(bits), F.concat(label, F.lit(" "), khz, F.lit(" / "), bits.cast("string"), F.lit(" bit")))
        .when(known(sample_rate) & known(bitrate), F.concat(label, F.lit(" "), khz, F.lit(" / "), kbps))
        .when(known(sample_rate), F.concat(label, F.lit(" "), khz))
        .when(known(bitrate), F.concat(label, F.lit(" "), kbps))
        .otherwise(label)
    )


def pair_measures() -> list[Column]:
    """The measures of a pair as text, and the choices that are open (removing the library's copy of a
    cross-source pair is not). They need no column of a single file, so pairs of groups have them too."""
    share = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.1f%%", F.col(c) * 100))
    seconds = F.when(F.col("duration_diff").isNull(), "n/a").otherwise(F.format_string("%.1f s", F.col("duration_diff")))
    protected = (F.col("a_source") == "library") & (F.col("b_source") != "library")
    return [
        share("title_sim").alias("title"), share("artist_sim").alias("artist"), seconds.alias("duration"), share("fp_sim").alias("fingerprint"),
        F.when(protected, "a,k,v,s").otherwise("a,b,k,v,s").alias("choices"),
    ]


def pair_report(pairs: DataFrame) -> DataFrame:
    """Pairs as they are shown for review: both members and ``pair_measures``."""
    side = lambda s: F.concat(
        display(F.col(f"{s}_artist"), F.col(f"{s}_filename_artist")), F.lit(" - "), display(F.col(f"{s}_title"), F.col(f"{s}_filename_title")), F.lit("  "), fmt_duration(F.col(f"{s}_duration"))
    )
    return pairs.select("a_rel", "b_rel", "category", side("a").alias("a_text"), side("b").alias("b_text"), *pair_measures(), "note")


def file_report(tracks: DataFrame) -> DataFrame:
    """Everything known of a file, as text."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    modified = F.date_format(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    tags = F.concat(*[x for c in ("title", "artist", "album", "track_no") for x in (F.lit(f"{c}="), known(c), F.lit(" "))])
    return tracks.select(
        "rel", fmt_bytes(F.col("size")).alias("size"), modified.alias("modified"), F.coalesce("sha256", F.lit("(not computed)")).alias("sha256"), F.rtrim(tags).alias("tags"),
        F.concat_ws(" - ", "filename_artist", "filename_title").alias("from_name"), fmt_duration(F.col("duration")).alias("duration"), F.coalesce(F.nullif(F.col("format_desc"), F.lit("")), F.lit("unknown")).alias("format"),
    )


def describe_decision() -> Column:
    """One line for a decision row."""
    text = lambda name: F.coalesce(F.col(name), F.lit("None"))
    head = F.concat(F.coalesce("id", F.lit("?")), F.lit("  "), F.coalesce("created", F.lit("")), F.lit("  "))
    moves = F.array_join(F.transform("renames", lambda r: F.concat(r["from"], F.lit(" -> "), r["to"])), "; ")
    return F.concat(
        head,
        F.when(F.col("action") == "remove", F.concat(F.lit("remove "), text("removed"), F.lit("  (keep "), text("kept"), F.lit(")")))
        .when(F.col("action") == "rename", F.concat(F.lit("rename: "), F.coalesce(moves, F.lit(""))))
        .when(F.col("action") == "keep_both", F.concat(F.lit("keep both ("), text("a"), F.lit(", "), text("b"), F.lit(")")))
        .otherwise(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("?")))),
    )


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")


def day_folder(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd")
