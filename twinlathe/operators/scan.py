"""From a file listing to hashed, cached and featured tracks.

Rows are ordered where needed by ``order_key``, (source rank, path components), which
agrees with path order; no global numbering is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlathe.functions.text import core_or_whole, file_name, guess_from_stem, stem, suffix, with_normalized
from twinlathe.schema import AUDIO_LABELS, SOURCE_DIRS, SOURCES
from twinlathe.storage import materialized

CACHED = ("sha256", "duration", "title", "artist", "album", "track_no", "format_desc", "fingerprint", "fp_duration")
TAGS = ("title", "artist", "album", "track_no", "format_desc")


def source_rank(source: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)])
    return F.element_at(ranks, source)


def source_of(rel: Column) -> Column:
    """The source by the first path component; library where unknown."""
    first = F.lower(F.substring_index(rel, "/", 1))
    return F.when(first.isin(*SOURCES), first).otherwise("library")


def order_key(source: Column, rel: Column) -> Column:
    return F.struct(source_rank(source).alias("rank"), F.split(rel, "/").alias("path"))


def hidden(rel: Column) -> Column:
    return F.exists(F.split(rel, "/"), lambda part: part.startswith("."))


def is_audio(rel: Column) -> Column:
    return suffix(rel).isin(*AUDIO_LABELS)


def in_source(rel: Column, source: Column) -> Column:
    """``rel`` without its source's folder."""
    dirs = F.create_map(*[F.lit(x) for s, d in SOURCE_DIRS.items() for x in (s, d + "/")])
    prefix = F.element_at(dirs, source)
    return F.when(F.startswith(rel, prefix), F.substring(rel, F.length(prefix) + 1, F.length(rel))).otherwise(rel)


def collection(listing: DataFrame) -> DataFrame:
    """Visible audio files of a listing with rel."""
    return listing.where(~hidden(F.col("rel")) & is_audio(F.col("rel")))


def with_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with what the cache knows of them. ``state`` is cached where size and mtime
    agree, stale where they don't, new where the cache has no row."""
    known = cache.select(F.col("rel").alias("c_rel"), F.col("size").alias("c_size"), F.col("mtime_ns").alias("c_mtime"), *[F.col(c).alias(f"c_{c}") for c in CACHED if c in cache.columns])
    hit = (F.col("c_size") == F.col("size")) & (F.col("c_mtime") == F.col("mtime_ns"))
    state = F.when(F.col("c_rel").isNull(), "new").when(F.coalesce(hit, F.lit(False)), "cached").otherwise("stale")
    joined = files.join(known, F.col("rel") == F.col("c_rel"), "left").withColumn("state", state)
    values = [
        (F.coalesce(F.when(F.col("state") == "cached", F.col(f"c_{c}")), F.lit("")) if c in TAGS else F.when(F.col("state") == "cached", F.col(f"c_{c}"))).alias(c)
        for c in CACHED if c in cache.columns
    ]
    return joined.select(*files.columns, "state", *values)


def scan_counters(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: cached, new (stale ones included), stale, ignored_non_audio."""
    visible = with_cache(listing.where(~hidden(F.col("rel"))), cache.select("rel", "size", "mtime_ns"))
    audio = is_audio(F.col("rel"))
    return visible.agg(
        F.count_if(audio & (F.col("state") == "cached")).alias("cached"), F.count_if(audio & (F.col("state") != "cached")).alias("new"),
        F.count_if(audio & (F.col("state") == "stale")).alias("stale"), F.count_if(~audio).alias("ignored_non_audio"),
    )


def source_counts(files: DataFrame) -> DataFrame:
    """source, n; sources without files count 0."""
    every = files.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    counts = files.groupBy("source").agg(F.count("*").alias("n"))
    return every.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shared_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")


def hashed(files: DataFrame, content: str) -> DataFrame:
    """``files`` with sha256 of the column ``content``, where another file has the same size.
    Sizes are counted without the content; only files in a shared size are hashed."""
    gated = files.join(shared_sizes(files.select("size")), "size", "left_semi")
    return gated.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def featured(tracks: DataFrame) -> DataFrame:
    """Tracks with guessed, normalised and core titles and artists, and the block key."""
    guess = guess_from_stem(stem(F.col("rel")))
    df = tracks.withColumn("_guess", guess).withColumns({
        "filename_artist": F.coalesce(F.col("_guess.artist"), F.lit("")), "filename_title": F.coalesce(F.col("_guess.title"), F.lit("")),
    }).drop("_guess")
    tag_or = lambda tag, other: F.coalesce(F.nullif(F.col(tag), F.lit("")), F.col(other))
    df = materialized(with_normalized(df, (file_name(F.col("rel")), F.col("title"), F.col("artist")), norm_title=tag_or("title", "filename_title"), norm_artist=tag_or("artist", "filename_artist")), "normalized")
    df = df.withColumns({"core_title": core_or_whole(F.col("norm_title")), "core_artist": core_or_whole(F.col("norm_artist"))})
    key = F.concat_ws("|", F.nullif(F.col("core_artist"), F.lit("")), F.nullif(F.col("core_title"), F.lit("")))
    # Both self-joins read the features twice, and pushed-down conditions would repeat their
    # expressions: they are computed once and written out.
    return materialized(df.withColumn("block_key", key), "features")
