"""Whole commands: scan, dedupe, ingest, trash, cache, decisions, sync, doctor.

They are the non-interactive forms: where a person would be asked, a table of choices is
an argument, and what needs a choice and has none comes back as rows.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinlathe.errors import ConfigError, ConfirmationRequired
from twinlathe.functions.report import describe_decision, describe_format, iso_now
from twinlathe.operators import actions, decisions, diff, linkage, scan
from twinlathe.operators import replay as replays
from twinlathe.schema import SOURCE_DIRS
from twinlathe.sources import config, filesystem, media, state
from twinlathe.storage import materialized


@dataclass
class Scan:
    tracks: DataFrame
    counters: DataFrame
    counts: DataFrame
    pairs: DataFrame
    resolved: DataFrame


def scan_root(spark: SparkSession, root: str | Path, state_folder: str | Path, use_cache: bool = True) -> Scan:
    """Scan with cache, hash, features, candidates; the cache is written last."""
    root = str(root)
    listed = materialized(filesystem.listing(spark, root), "listing")
    known = state.load_cache(spark, state_folder, root) if use_cache else state.load_cache(spark, state_folder, root).limit(0)
    known = materialized(known, "cache")
    files = scan.with_cache(scan.collection(listed), known)
    fresh = media.with_info(files.where("state <> 'cached'")).withColumn("_format", describe_format(F.col("rel"), F.col("sample_rate"), F.col("bits"), F.col("bitrate")))
    fresh = fresh.select("rel", *[F.col(c).alias(f"_{c}") for c in ("title", "artist", "album", "track_no", "duration")], "_format")
    new = F.col("state") != "cached"
    full = files.join(fresh, "rel", "left")
    for name in ("title", "artist", "album", "track_no"):
        full = full.withColumn(name, F.coalesce(F.when(new, F.col(f"_{name}")), F.col(name), F.lit("")))
    full = full.withColumn("duration", F.coalesce("duration", "_duration")).withColumn("format_desc", F.when(new, F.coalesce("_format", F.lit(""))).otherwise(F.col("format_desc")))
    full = full.drop(*[c for c in full.columns if c.startswith("_")])
    tracks = scan.featured(filesystem.with_hashes(materialized(full, "files")))
    resolved = decisions.resolved_pairs(state.load_decisions(spark, state_folder, root), tracks)
    pairs = materialized(linkage.candidates(tracks, resolved), "pairs")
    state.save_cache(tracks, state_folder, root)
    return Scan(tracks, scan.scan_counters(listed, known), scan.source_counts(tracks), pairs, resolved)


def replay(spark: SparkSession, root: str | Path, state_folder: str | Path) -> dict[str, int]:
    """Recorded decisions applied to the files, in order. What each of them does is found in Spark;
    only moves that are to be carried out come to the driver, a part of them at a time."""
    plan = materialized(replays.replayed(state.load_decisions(spark, state_folder, str(root)), filesystem.listing(spark, root)), "replayed")
    counts = replays.totals(plan).first().asDict() | {"removed": 0, "renamed": 0}
    for row in plan.where("status IN ('removed', 'renamed')").orderBy("seq", "id", "at").toLocalIterator():
        src = row["src"]
        trash = f"{actions.TRASH_DIR}/{filesystem.today()}/{src.split('/', 1)[0].lower()}/{src.rsplit('/', 1)[-1]}"
        removed = row["status"] == "removed"
        ((_, _, said),) = filesystem.apply_moves(root, [(src, trash if removed else row["dst"])], numbered=removed)
        counts[row["status"]] += said == "moved"
    return counts


CHOICES_DDL = "id string, choice string, which string, label_a string, label_b string"
RESOLUTIONS_DDL = "rel string, choice string, incoming string, existing string"


def with_fingerprints(pairs: DataFrame, prints: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs reclassified with fingerprints, each file's computed once. Without the tool (and
    without ``prints`` in its place) they stay as they are."""
    if prints is None:
        if shutil.which("fpcalc") is None:
            return pairs
        prints = media.with_fingerprints
    found = materialized(prints(linkage.files_to_print(pairs)), "prints")
    return linkage.enriched(linkage.with_prints(pairs, found))


def _table(spark: SparkSession, df: DataFrame | None, ddl: str) -> DataFrame:
    """``df`` with all columns of ``ddl``, null where it lacks them."""
    empty = spark.createDataFrame([], ddl)
    return empty if df is None else empty.unionByName(df, allowMissingColumns=True).select(*empty.columns)


class _Files:
    """Moves below one root, on the driver, in the order in which choices are carried out."""

    def __init__(self, root: str | Path, resolved: dict[str, Row]):
        self.root, self.resolved = Path(root), resolved

    def there(self, rel: str) -> bool:
        return (self.root / rel).exists()

    def move(self, rel: str, dest: str, numbered: bool = False) -> str | None:
        """Where the file is now; None if nothing moved."""
        done = filesystem.apply_moves(self.root, [(rel, dest)], numbered)[0]
        return done[1] if done[2] == "moved" else None

    def promote(self, rel: str, dest: str) -> tuple[str, str | None]:
        """(action, new path): a taken name is left to the resolution given for the file."""
        if not self.there(dest):
            return "promoted", self.move(rel, dest)
        answer = self.resolved.get(rel)
        if answer is None or answer["action"] == "skipped":
            return "skipped", None
        names = [n for n in (answer["incoming_dest"], answer["existing_dest"]) if n and n != dest]
        if any(self.there(n) for n in names):
            return "skipped", None
        if answer["existing_dest"]:
            self.move(dest, answer["existing_dest"])
        return answer["action"], self.move(rel, answer["incoming_dest"])


def _promotions(spark: SparkSession, named: DataFrame, resolutions: DataFrame | None) -> tuple[dict[str, str], dict[str, Row]]:
    """(dest by rel, resolution by rel) of named incoming files that a choice may move."""
    wanted = materialized(named.select("rel", F.concat(F.lit(SOURCE_DIRS["tracks"] + "/"), F.col("name")).alias("dest")), "wanted")
    answers = actions.resolved_collisions(wanted, _table(spark, resolutions, RESOLUTIONS_DDL).where("choice IS NOT NULL"))
    return {r["rel"]: r["dest"] for r in wanted.collect()}, {r["rel"]: r for r in answers.collect()}


def dedupe(spark: SparkSession, root: str | Path, state_folder: str | Path, choices: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Replay, scan, then the outcomes of ``choices`` carried out and recorded."""
    replay(spark, root, state_folder)
    return _review(spark, root, state_folder, scan_root(spark, root, state_folder).pairs, choices, resolutions, "dedupe")


def _review(spark: SparkSession, root, state_folder, pairs: DataFrame, choices: DataFrame, resolutions: DataFrame | None, mode: str) -> DataFrame:
    """Choices (``CHOICES_DDL``) carried out in the order of the review queue: id, a_rel, b_rel,
    choice, outcome, remove_rel, now_a, now_b (where the files are after it). A pair of which a
    file has gone by then is obsolete; a version without usable labels, or whose name is taken,
    is cancelled. Only pairs with a choice come to the driver."""
    choices = _table(spark, choices, CHOICES_DDL)
    queue = materialized(linkage.ranked(with_fingerprints(pairs)).withColumn("id", decisions.decision_id(F.col("a_rel"), F.col("b_rel"))), "queue")
    chosen = actions.review_outcomes(queue, choices.select("id", "choice"), mode).where("outcome <> 'pending'")
    members = ("title", "artist", "filename_title", "filename_artist", "rel", "source")
    both = chosen.where("outcome = 'promoted'")
    side = lambda s: both.select(*[F.col(f"{s}_{c}").alias(c) for c in members])
    incoming = side("a").unionByName(side("b")).where("source = 'incoming'").distinct()
    dests, answers = _promotions(spark, actions.with_track_names(incoming), resolutions)
    names = {(r["id"], r["side"]): r["dest"] for r in actions.version_plan(queue, choices).collect()}
    files, done, final = _Files(root, answers), [], []
    for row in chosen.orderBy("rank").select("id", "a_rel", "b_rel", "a_source", "b_source", "choice", "outcome", "remove_rel", "recorded").collect():
        now = {"a": row["a_rel"], "b": row["b_rel"]}
        outcome, entry = row["outcome"], None
        if not all(map(files.there, now.values())):
            outcome = "obsolete"
        elif outcome == "quarantined":
            gone = "a" if row["remove_rel"] == now["a"] else "b"
            source = row[f"{gone}_source"]
            files.move(row["remove_rel"], f"{actions.TRASH_DIR}/{filesystem.today()}/{source}/{Path(row['remove_rel']).name}", numbered=True)
            if row["recorded"]:
                entry = {"action": "remove", "kept": now["b" if gone == "a" else "a"], "removed": row["remove_rel"]}
            now[gone] = None
        elif outcome in ("promoted", "kept"):
            moved = {s: files.promote(now[s], dests[now[s]])[1] for s in "ab" if outcome == "promoted" and row[f"{s}_source"] == "incoming"}
            now |= {s: rel for s, rel in moved.items() if rel}
            outcome = "promoted" if any(moved.values()) else "kept"
            entry = {"action": "keep_both", "a": now["a"], "b": now["b"]}
        elif outcome == "renamed":
            planned = [(s, names[row["id"], s]) for s in "ab" if (row["id"], s) in names]
            fresh = [(s, dest) for s, dest in planned if dest != now[s]]
            if not planned or len({d for _, d in fresh}) < len(fresh) or any(files.there(d) for _, d in fresh):
                outcome = "cancelled"
            else:
                entry = {"action": "rename" if fresh else "keep_both", "a": now["a"], "b": now["b"], "renames": [(now[s], dest) for s, dest in fresh]}
                now |= {s: files.move(now[s], dest) for s, dest in fresh}
                outcome = "renamed" if fresh else "kept"
        if entry:
            done.append(entry | {"n": len(done)})
        final.append((row["id"], outcome, now["a"], now["b"]))
    _record(spark, root, state_folder, done)
    said = spark.createDataFrame(final, "id string, said string, now_a string, now_b string")
    every = queue.select("id", "rank", "a_rel", "b_rel", "a_source", "b_source").join(choices.select("id", "choice"), "id", "left").join(said, "id", "left")
    outcome = F.coalesce("said", F.lit("pending"))
    removed = F.when(outcome == "quarantined", F.when(F.col("now_a").isNull(), F.col("a_rel")).otherwise(F.col("b_rel")))
    return every.select("id", "rank", "a_rel", "b_rel", "choice", outcome.alias("outcome"), removed.alias("remove_rel"), "now_a", "now_b")


def _record(spark: SparkSession, root, state_folder, done: list[dict]) -> None:
    """Decisions of the actions carried out, after those recorded so far."""
    if not done:
        return
    names = ("n", "action", "kept", "removed", "a", "b", "renames")
    ddl = "n long, action string, kept string, removed string, a string, b string, renames array<struct<`from`: string, `to`: string>>"
    rows = spark.createDataFrame([tuple(d.get(n) for n in names) for d in done], ddl).coalesce(1)
    state.put(decisions.entries(rows, str(root), iso_now(), -1), state_folder, "decisions")


def ingest(
    spark: SparkSession, root: str | Path, state_folder: str | Path, choices: DataFrame, promote: bool = False, resolutions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(outcomes of cross-source pairs, promotion of the incoming files left). With ``promote``
    it is carried out: names that are taken follow ``resolutions`` (``RESOLUTIONS_DDL``), files
    without one stay and are collisions."""
    found = scan_root(spark, root, state_folder)
    outcomes = materialized(_review(spark, root, state_folder, found.pairs.where(linkage.cross_source()), choices, resolutions, "ingest"), "outcomes")
    gone = outcomes.where("outcome <> 'pending'").select(F.explode(F.array(F.struct(F.col("a_rel").alias("rel"), F.col("now_a").alias("now")), F.struct(F.col("b_rel").alias("rel"), F.col("now_b").alias("now")))).alias("x"))
    moved = gone.where("x.now IS NULL OR x.now <> x.rel").select("x.rel").distinct()
    left = materialized(actions.with_track_names(actions.remaining_incoming(found.tracks.where("source = 'incoming'"), moved, found.pairs)), "left")
    existing = filesystem.listing(spark, root).where("source = 'tracks'").select("rel")
    plan = materialized(actions.promotion_plan(left, existing), "promotion")
    if not promote:
        filesystem.prune(root, "incoming")
        return outcomes, plan
    dests, answers = _promotions(spark, left, resolutions)
    files = _Files(root, answers)
    done = [(rel, *files.promote(rel, dests[rel])) for rel in (r["rel"] for r in plan.orderBy(F.split("rel", "/")).select("rel").collect())]
    filesystem.prune(root, "incoming")
    said = spark.createDataFrame(done, "rel string, said string, now string")
    action = F.when(F.col("said") == "skipped", F.col("action")).otherwise(F.col("said"))
    return outcomes, plan.join(said, "rel").select("rel", F.coalesce("now", "dest").alias("dest"), action.alias("action"))


def trash_list(spark: SparkSession, root: str | Path) -> DataFrame:
    return actions.trash_by_day(filesystem.trash_entries(spark, root)).orderBy("day")


def trash_files(spark: SparkSession, root: str | Path) -> DataFrame:
    """Files in the trash by day and path."""
    return filesystem.trash_entries(spark, root).orderBy("day", "rel")


def cache_status(spark: SparkSession, root: str | Path, state_folder: str | Path) -> dict[str, int]:
    """Entries known of a root, and bytes of the table (of all roots)."""
    return {"entries": state.load_cache(spark, state_folder, str(root)).count(), "bytes": state.size(spark, state_folder, "cache")}


def cache_clear(spark: SparkSession, root: str | Path, state_folder: str | Path) -> int:
    return state.clear(spark, state_folder, "cache", state.CACHE_DDL, str(root))


def decisions_list(spark: SparkSession, root: str | Path, state_folder: str | Path) -> DataFrame:
    return state.load_decisions(spark, state_folder, str(root)).orderBy("seq").select("id", describe_decision().alias("line"))


def decisions_remove(spark: SparkSession, root: str | Path, state_folder: str | Path, id_: str) -> int:
    """Removes one decision of a root; returns how many rows went."""
    mine = materialized(state.load_decisions(spark, state_folder, str(root)).where(F.col("id") == id_).select("root", "id"), "decisions")
    n = mine.count()
    if n:
        state.remove(mine, state_folder, "decisions")
    return n


def decisions_clear(spark: SparkSession, root: str | Path, state_folder: str | Path) -> int:
    return state.clear(spark, state_folder, "decisions", state.DECISION_DDL, str(root))


def sync_status(local: DataFrame, remote: DataFrame, direction: str) -> tuple[int, list[str]]:
    """(number of files that a transfer would send, the first of them) from two listings, or from
    two digest trees, of which only folders that differ are opened."""
    trees = "parent" in local.columns and "parent" in remote.columns
    return diff.transfer_summary(diff.descended(local, remote)[0] if trees else diff.tree_diff(local, remote), direction)


@dataclass
class Leg:
    """One transfer of a synchronisation: planned, done or failed (with the tool's exit code)."""

    label: str
    command: list[str]
    status: str
    code: int | None = None


def sync(
    root: str | Path, direction: str, settings: config.SyncConfig, dry_run: bool = False, delete: bool = False, yes: bool = False,
    run: Callable[[list[str]], int] | None = None, running: Callable[[config.SyncConfig], tuple[bool, bool | None]] | None = None,
) -> tuple[list[Leg], str | None]:
    """Push or pull: plan, guard, confirmation, then each leg in turn; (legs, warning). Without
    ``yes`` (or ``dry_run``) the plan comes back undone in a ``ConfirmationRequired``. Settings of
    an application are not transferred while it runs (``running``: here, there). The first leg
    that fails is the last one tried. ``run`` carries a command out and returns its exit code."""
    if direction not in ("push", "pull"):
        raise ConfigError(f"unknown direction: {direction}")
    plan = diff.sync_plan(str(root), settings.remote, settings.remote_root, direction, settings.local_settings, settings.remote_settings)
    legs = [Leg(label, diff.rsync_command(src, dst, dry_run, delete), "planned") for label, src, dst in plan]
    warning = None
    if any(label == "settings" for label, _, _ in plan):
        error, warning = diff.running_guard(*(running or (lambda _: (False, None)))(settings))
        if error:
            raise ConfigError(error)
    if diff.needs_confirmation(dry_run, yes):
        raise ConfirmationRequired("; ".join(f"{label}: {src} -> {dst}" for label, src, dst in plan))
    run = run or (lambda command: subprocess.run(command, check=False).returncode)
    for leg in legs:
        leg.code = run(leg.command)
        leg.status = "failed" if leg.code else "dry run" if dry_run else "done"
        if leg.code:
            break
    return legs, warning


def doctor() -> dict[str, str | None]:
    """The first line of what each optional tool says of its version; None where it isn't there."""
    flags = {"ffprobe": "-version", "fpcalc": "-version", "rsync": "--version", "ssh": "-V"}
    return {tool: media.tool_version(tool, flag) for tool, flag in flags.items()}
