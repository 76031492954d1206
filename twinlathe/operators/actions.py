"""Plans of what to do with files: review outcomes, quarantine, promotion, pruning.

Plans are DataFrames; ``twinlathe.sources.filesystem.apply_moves`` carries them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlathe.functions.naming import canonicalize_version, stem_base, with_name
from twinlathe.functions.text import file_name, stem, suffix
from twinlathe.operators.linkage import library_pair
from twinlathe.operators.scan import order_key
from twinlathe.schema import SOURCE_DIRS, TRASH_DIR


def review_outcomes(pairs: DataFrame, choices: DataFrame, mode: str = "dedupe") -> DataFrame:
    """Pairs (id, a_rel, a_source, b_rel, b_source) with their choice's outcome.

    ``choices``: id, choice (a: keep a, b: keep b, k: keep both, v: version, s: skip). The
    library's copy of a cross-source pair is protected: removing it is refused.
    """
    return outcomes(pairs.join(choices, "id", "left"), mode)


def outcomes(pairs: DataFrame, mode: str = "dedupe") -> DataFrame:
    """``review_outcomes`` of pairs that have their choice with them."""
    remove = F.when(F.col("choice") == "a", F.col("b_rel")).when(F.col("choice") == "b", F.col("a_rel"))
    removed_source = F.when(F.col("choice") == "a", F.col("b_source")).when(F.col("choice") == "b", F.col("a_source"))
    has_incoming = (F.col("a_source") == "incoming") | (F.col("b_source") == "incoming")
    outcome = (
        F.when(F.col("choice").isNull(), "pending")
        .when(F.col("choice").isin("a", "b") & (removed_source == "library") & ~library_pair(), "refused")
        .when(F.col("choice").isin("a", "b"), "quarantined")
        .when((F.col("choice") == "k") & F.lit(mode == "ingest") & has_incoming, "promoted")
        .when(F.col("choice") == "k", "kept")
        .when(F.col("choice") == "v", "renamed")
        .otherwise("skipped")
    )
    joined = pairs.withColumn("outcome", outcome)
    recorded = ((F.col("outcome") == "quarantined") & library_pair()) | F.col("outcome").isin("promoted", "kept", "renamed")
    return joined.withColumns({"remove_rel": F.when(F.col("outcome") == "quarantined", remove), "recorded": recorded})


def review_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counters over reviewed pairs (outcome): a refused removal and a version that was
    there already keep both files; pending, obsolete and cancelled pairs are not processed."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        n("quarantined", "promoted", "renamed", "kept", "refused").alias("processed"), n("quarantined").alias("quarantined"), n("promoted").alias("promoted"),
        n("renamed").alias("renamed"), n("kept", "refused").alias("kept"), n("skipped").alias("skipped"), n("pending", "cancelled").alias("remaining"),
    )


def version_plan(pairs: DataFrame, choices: DataFrame) -> DataFrame:
    """New names for the pairs chosen 'v'. ``choices``: id, which (a, b or x for both), label_a,
    label_b. ``pairs``: id and both members' rel, title, artist, filename_title, filename_artist.
    One row for each member to name: id, side, rel, dest (in the same folder). A side without a
    label has no row, so a choice without usable labels plans nothing."""
    wanted = choices.where("choice = 'v'").select("id", "which", "label_a", "label_b").dropDuplicates(["id"]).join(pairs, "id")
    fields = ("rel", "title", "artist", "filename_title", "filename_artist")

    def side(s: str) -> DataFrame:
        mine = wanted.where(F.col("which").isin(s, "x") & (F.trim(F.coalesce(f"label_{s}", F.lit(""))) != ""))
        return mine.select("id", F.lit(s).alias("side"), F.col(f"label_{s}").alias("qualifier"), *[F.col(f"{s}_{f}").alias(f) for f in fields])

    return with_version_name(side("a").unionByName(side("b")), F.col("qualifier")).select("id", "side", "rel", "dest")


def with_version_name(files: DataFrame, qualifier: Column) -> DataFrame:
    """``files`` with dest, the name with the label ``qualifier`` in the same folder."""
    folder = F.regexp_extract("rel", r"^(.*/)[^/]*$", 1)
    return with_track_names(files, qualifier).withColumn("dest", F.concat(folder, F.col("name"))).drop("name")


def version_sides(pairs: DataFrame) -> DataFrame:
    """``version_plan`` of pairs that have their choice with them: id, which, and both members' rel and
    dest. Nothing is joined by id, which is short enough for two pairs of many millions to share one."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_rel").alias("rel"), F.col(f"{s}_dest").alias("dest"))
    each = pairs.select("id", "which", F.explode(F.array(side("a"), side("b"))).alias("s"))
    return each.where((F.col("which") == "x") | (F.col("which") == F.col("s.side"))).select("id", "s.side", "s.rel", "s.dest")


#: The largest number that a taken name gets.
LAST_NUMBER = 999
#: Endings that numbering may have given: ' - 2' and on, also several.
_NUMBERED = r"(?: - (?:[2-9]|[1-9][0-9]+))+$"


def _allocate(last: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rel, dest of files sorted by family and order; names that are there come first in a family."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    for _, mine in groupby(rows(), itemgetter(0)):
        taken: set[str] = set()
        reached: dict[str, int] = {}  # names don't become free again
        out: list[tuple[str, str | None]] = []
        for _, rel, want, start, ext in mine:
            if rel is None:
                taken.add(want)
                continue
            name, n = want, reached.get(want, 1)
            while (last is None or n <= last) and (name := want if n == 1 else f"{start} - {n}{ext}") in taken:
                n += 1
            reached[want] = n
            if last is not None and n > last:
                name = None
            else:
                taken.add(name)
            out.append((rel, name))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["rel", "dest"])


def allocated(files: DataFrame, taken: DataFrame | None = None, last: int | None = LAST_NUMBER) -> DataFrame:
    """rel, dest: the names that files (rel, source, want, start, ext; want is start and ext) get one
    after another in path order: the wanted one, or the first of 'start - 2' to 'start - {last}' that
    neither is there (``taken``: dest) nor was given before; null where none is free. With ``last``
    None the numbers don't end.

    A numbered name may be another file's wanted one, so names that differ in such endings form a
    family, which is gone through in order by one task. Of a name's files the first ``last`` are all
    that can get one; the others are told apart while the names are ranked, by every task for
    itself, so that a name that many files want doesn't land in one task."""
    order = order_key(F.col("source"), F.col("rel"))
    first = files.withColumn("ord", order)
    if last is not None:
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy("want").orderBy("ord"))).where(F.col("nth") <= last).drop("nth")
    family = lambda start, ext: F.struct(F.regexp_replace(start, _NUMBERED, "").alias("start"), ext.alias("ext"))
    rows = first.select(family(F.col("start"), F.col("ext")).alias("family"), "rel", "want", "start", "ext", "ord")
    if taken is not None:
        there = taken.select(F.col("dest").alias("want")).distinct().withColumn("ext", F.regexp_extract("want", r"(?<=[^/])(\.[^./]+)$", 1))
        there = there.withColumn("start", F.expr("substring(want, 1, length(want) - length(ext))"))
        names = rows.select("family").distinct()
        known = there.select(family(F.col("start"), F.col("ext")).alias("family"), F.lit(None).cast("string").alias("rel"), "want", "start", "ext", F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"))
        rows = rows.unionByName(known.join(names, "family", "left_semi"))
    sorted_ = rows.repartition("family").sortWithinPartitions("family", F.col("ord").asc_nulls_first())
    given = sorted_.select(F.to_json("family").alias("family"), "rel", "want", "start", "ext").mapInArrow(partial(_allocate, last), "rel string, dest string")
    return files.select("rel").join(given, "rel", "left")


def quarantine_plan(files: DataFrame, day: str, taken: DataFrame | None = None, last: int | None = LAST_NUMBER) -> DataFrame:
    """rel, dest below the trash; a taken name gets ' - 2', ' - 3', ... up to ``last`` in path order (``allocated``).
    ``taken``: dest of what the trash already holds (the executor checks again)."""
    name = file_name(F.col("rel"))
    base = F.concat(F.lit(f"{TRASH_DIR}/{day}/"), F.col("source"), F.lit("/"))
    ext = F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)
    wanted = files.select("rel", "source", F.concat(base, name).alias("want"), F.concat(base, stem(F.col("rel"))).alias("start"), ext.alias("ext"))
    return allocated(wanted, taken, last)


def trash_by_day(entries: DataFrame) -> DataFrame:
    return entries.groupBy("day").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def with_track_names(tracks: DataFrame, qualifier: Column | None = None) -> DataFrame:
    """``tracks`` (featured) with the derived name as ``name``."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename_title"))
    artist = F.coalesce(F.nullif(F.col("artist"), F.lit("")), F.col("filename_artist"))
    return with_name(tracks, F.col("rel"), title, artist, qualifier)


def promotion_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Named incoming tracks with dest and action: promoted, or collision where the tracks
    folder (``existing``: rel) or an earlier incoming file has the name."""
    dest = F.concat(F.lit(SOURCE_DIRS["tracks"] + "/"), F.col("name"))
    there = existing.select(F.col("rel").alias("dest"), F.lit(True).alias("there")).distinct()
    nth = F.row_number().over(Window.partitionBy("dest").orderBy(order_key(F.col("source"), F.col("rel"))))
    plan = incoming.select("rel", "source", dest.alias("dest")).join(there, "dest", "left").withColumn("nth", nth)
    clash = F.col("there").isNotNull() | (F.col("nth") > 1)
    return plan.select("rel", "dest", F.when(clash, "collision").otherwise("promoted").alias("action"))


def resolved_collisions(collisions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Collisions (rel, dest) with ``resolutions`` (rel, choice v/e/b/s, incoming, existing
    labels): action, the incoming file's dest and the existing file's new name. Labels are
    needed, must differ for b, and names are never numbered: anything else is skipped."""
    base = F.concat(F.lit(SOURCE_DIRS["tracks"] + "/"), stem_base(stem(F.col("dest"))))
    label = lambda c: canonicalize_version(F.array(F.coalesce(F.col(c), F.lit(""))))
    df = collisions.join(resolutions, "rel", "left").withColumns({"_in": label("incoming"), "_ex": label("existing")})
    named = lambda c: F.concat(base, F.lit(" ["), F.col(c), F.lit("]"), suffix(F.col("dest")))
    v = (F.col("choice") == "v") & (F.col("_in") != "")
    e = (F.col("choice") == "e") & (F.col("_ex") != "")
    b = (F.col("choice") == "b") & (F.col("_in") != "") & (F.col("_ex") != "") & (F.col("_in") != F.col("_ex"))
    action = F.when(v, "renamed").when(e, "renamed-existing").when(b, "renamed-both").otherwise("skipped")
    return df.select(
        "rel", "dest", action.alias("action"), F.when(v | b, named("_in")).when(e, F.col("dest")).alias("incoming_dest"), F.when(e | b, named("_ex")).alias("existing_dest")
    )


def remaining_incoming(incoming: DataFrame, moved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Incoming files that no review moved; had_candidate tells those that were in a pair."""
    members = pairs.select(F.explode(F.array("a_rel", "b_rel")).alias("rel")).distinct().withColumn("had_candidate", F.lit(True))
    return incoming.join(moved.select("rel"), "rel", "left_anti").join(members, "rel", "left").withColumn("had_candidate", F.coalesce("had_candidate", F.lit(False)))


def empty_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (dir) that hold no file (rel) at any depth."""
    parts = F.split("rel", "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    above = files.where(F.size(parts) > 1).select(F.explode(F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir")).distinct()
    return dirs.select("dir").distinct().join(above, "dir", "left_anti")
