"""Track-shaped views of the test tables, as DataFrames and as the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.functions.text import VERSION_TERMS
from twinlathe.operators.scan import featured

DIRS = ("Library", "Tracks", "Incoming")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing: one file per document, some hidden, some not audio."""
    d = F.col("doc_id")
    rel = F.concat(pick(DIRS, d), F.lit("/"), "source", F.lit("/"), F.when(d % 37 == 0, ".cache/").otherwise(""), d.cast("string"), F.when(d % 10 == 9, ".txt").otherwise(".flac"))
    return table(spark, sf_dir, "documents").select(rel.alias("rel"), F.lower(pick(DIRS, d)).alias("source"), F.col("n_chars").alias("size"), (d * 1000).alias("mtime_ns"), d.alias("id"))


LISTING_SQL = """listing AS (
  SELECT ['Library', 'Tracks', 'Incoming'][doc_id % 3 + 1] || '/' || source || '/' || CASE WHEN doc_id % 37 = 0 THEN '.cache/' ELSE '' END
           || doc_id || CASE WHEN doc_id % 10 = 9 THEN '.txt' ELSE '.flac' END AS rel,
         ['library', 'tracks', 'incoming'][doc_id % 3 + 1] AS source, n_chars AS size, doc_id * 1000 AS mtime_ns, doc_id AS id FROM documents)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier scan knew: three of four files, a fifth of them changed since."""
    return listing(spark, sf_dir).where("id % 4 <> 0").select("rel", "size", F.when(F.col("id") % 5 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"))


CACHE_SQL = "cache AS (SELECT rel, size, CASE WHEN id % 5 = 0 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns FROM listing WHERE id % 4 <> 0)"


def docs_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rel = F.concat(pick(DIRS, d), F.lit("/"), "source", F.lit("/"), d.cast("string"), F.lit(".flac"))
    return table(spark, sf_dir, "documents").select(rel.alias("rel"), F.lower(pick(DIRS, d)).alias("source"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


DOCS_SQL = """docs AS (
  SELECT ['Library', 'Tracks', 'Incoming'][doc_id % 3 + 1] || '/' || source || '/' || doc_id || '.flac' AS rel,
         ['library', 'tracks', 'incoming'][doc_id % 3 + 1] AS source, doc_id % 3 AS rank, n_chars AS size, text AS content FROM documents)"""

VERSIONS = (" (Radio Edit)", " (Live)", " - Remastered", "")


def part_tracks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Tagged tracks whose titles carry versions; some without title or duration. Copies
    share a hash where name, brand and size class agree. ``spread``: over tasks, as a table that is
    one small file is read by one."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    rel = F.concat(pick(DIRS, k), F.lit("/"), F.regexp_replace("p_brand", "#", " "), F.lit("/"), k.cast("string"), F.lit(".flac"))
    title = F.when(k % 11 == 0, "").otherwise(F.concat("p_name", pick(VERSIONS, F.col("p_size").cast("long"))))
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((k % 64 * 67108859 + i * 2654435) % 4294967296).cast("string")), ",")
    return (parts.repartition("p_partkey") if spread else parts).select(
        rel.alias("rel"), F.lower(pick(DIRS, k)).alias("source"), title.alias("title"), F.col("p_brand").alias("artist"),
        F.when(k % 13 != 0, 180.0 + F.floor(F.col("p_retailprice")).cast("long") % 60).alias("duration"),
        F.sha2(F.concat_ws("|", "p_name", "p_brand", (F.col("p_size") % 8).cast("string"), F.when(k % 11 == 0, k.cast("string")).otherwise("")), 256).alias("sha256"),
        words.alias("fingerprint"), k.alias("id"),
    )


def part_featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(part_tracks(spark, sf_dir, spread=True))


#: The version terms for RE2. The text is ASCII here, so its ASCII word boundary will do.
TERMS_RE2 = r"\b(?:" + "|".join(VERSION_TERMS) + r")\b"
FEAT_RE2 = r"\b(?:feat(?:uring)?(?:\.|\b)|ft(?:\.|\b))"


def norm_sql(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(replace(replace(lower({x}), '&', ' and '), '’', ''''), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g'))"""


def core_sql(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?s){FEAT_RE2}.*$', ''), '{TERMS_RE2}', ' ', 'g'), '\s+', ' ', 'g'))"""


def terms_sql(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '{TERMS_RE2}')))"


PART_SQL = f"""parts AS (
  SELECT ['Library', 'Tracks', 'Incoming'][p_partkey % 3 + 1] || '/' || replace(p_brand, '#', ' ') || '/' || p_partkey || '.flac' AS rel,
         ['library', 'tracks', 'incoming'][p_partkey % 3 + 1] AS source, p_partkey % 3 AS rank,
         CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || [' (Radio Edit)', ' (Live)', ' - Remastered', ''][p_size % 4 + 1] END AS title,
         p_brand AS artist, CASE WHEN p_partkey % 13 <> 0 THEN 180.0::DOUBLE + floor(p_retailprice)::BIGINT % 60 END AS duration,
         sha256(p_name || '|' || p_brand || '|' || (p_size % 8) || '|' || CASE WHEN p_partkey % 11 = 0 THEN p_partkey::VARCHAR ELSE '' END) AS sha256,
         list_transform(range(4), lambda i: (p_partkey % 64 * 67108859 + i * 2654435) % 4294967296) AS words, p_partkey AS id
  FROM part),
normed AS (
  SELECT *, {norm_sql("title")} AS norm_title, {norm_sql("artist")} AS norm_artist FROM parts),
cored AS (
  SELECT *, CASE WHEN {core_sql("norm_title")} = '' THEN norm_title ELSE {core_sql("norm_title")} END AS core_title, {core_sql("norm_artist")} AS core_artist FROM normed),
tracks AS (
  SELECT *, concat_ws('|', core_artist, nullif(core_title, '')) AS block_key, {terms_sql("norm_title")} AS terms, string_split(rel, '/') AS path FROM cored)"""

_ORDER = "(a.rank < b.rank OR (a.rank = b.rank AND a.path < b.path))"
_FIELDS = "a.rel AS a_rel, b.rel AS b_rel, a.source AS a_source, b.source AS b_source, a.terms AS ta, b.terms AS tb, a.words AS wa, b.words AS wb, a.rank AS ra, b.rank AS rb, a.path AS pa, b.path AS pb"
PAIRS_SQL = PART_SQL + f""",
pairs AS (
  SELECT 0 AS stage, a.sha256 AS grp, true AS exact, {_FIELDS}, 1.0::DOUBLE AS title_sim, 1.0::DOUBLE AS artist_sim,
         a.duration AS da, b.duration AS db
  FROM tracks a JOIN tracks b ON a.sha256 = b.sha256 AND {_ORDER}
  UNION ALL
  SELECT 1, a.block_key, false, {_FIELDS}, 1.0, 1.0, a.duration, b.duration
  FROM tracks a JOIN tracks b ON a.block_key = b.block_key AND a.core_title <> '' AND a.sha256 <> b.sha256 AND {_ORDER}),
measured AS (
  SELECT *, abs(da - db) AS duration_diff,
         CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN abs(da - db) <= greatest(2.0::DOUBLE, 0.05::DOUBLE * greatest(da, db)) END AS dur_close FROM pairs)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided pairs: neighbours in key order of two sources of one brand."""
    t = part_tracks(spark, sf_dir).select("rel", "id")
    other = t.select(F.col("rel").alias("b"), (F.col("id") - 25).alias("id2"))
    near = t.join(other, F.col("id") == F.col("id2")).select(F.col("rel").alias("a"), "b")
    decided = part_featured(spark, sf_dir).where("title <> ''").groupBy("block_key").agg(F.min("rel").alias("a"), F.max("rel").alias("b")).where("a <> b").select("a", "b")
    return near.unionByName(decided)


RESOLVED_SQL = """resolved AS (
  SELECT a.rel AS a, b.rel AS b FROM parts a JOIN parts b ON b.id = a.id + 25
  UNION ALL SELECT min(rel), max(rel) FROM tracks WHERE title <> '' GROUP BY block_key HAVING min(rel) <> max(rel))"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded decisions of all three kinds over the part tracks."""
    t = part_tracks(spark, sf_dir).select("rel", "id")
    nxt = t.select(F.col("rel").alias("rel2"), (F.col("id") - 1).alias("id2"))
    rows = t.join(nxt, F.col("id") == F.col("id2"))
    a, b, k = F.col("rel"), F.col("rel2"), F.col("id") % 4
    renames = F.array(F.struct(a.alias("from"), F.concat(F.lit("Tracks/"), (F.col("id") + 2).cast("string"), F.lit(".flac")).alias("to")), F.struct(b.alias("from"), F.concat(b, F.lit(".new")).alias("to")))
    from twinlathe.operators.decisions import decision_id

    return rows.select(
        F.lit("root").alias("root"), decision_id(a, b).alias("id"), F.lit("2024-01-01T00:00:00+00:00").alias("created"),
        F.when(k == 0, "remove").when(k == 1, "rename").when(k == 2, "keep_both").otherwise("rename").alias("action"),
        F.when(k == 0, a).alias("kept"), F.when(k == 0, b).alias("removed"), F.when(k.isin(1, 2), a).alias("a"), F.when(k.isin(1, 2), b).alias("b"),
        F.when(k.isin(1, 3), renames).alias("renames"), F.col("id").alias("seq"),
    )


DECISIONS_SQL = """decisions AS (
  SELECT substr(sha1(least(a.rel, b.rel) || '|' || greatest(a.rel, b.rel)), 1, 10) AS id, a.id % 4 AS kind, a.rel AS x, b.rel AS y,
         'Tracks/' || (a.id + 2) || '.flac' AS x_to, b.rel || '.new' AS y_to, a.id AS seq
  FROM parts a JOIN parts b ON b.id = a.id + 1),
inventory AS (SELECT rel FROM parts WHERE id % 7 <> 0 UNION ALL SELECT 'Tracks/' || id || '.flac' FROM parts WHERE id % 3 = 0)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in a shuffled order that chain: in blocks of forty parts each file is renamed to the
    next one's name, or removed in favour of it, or of one file that all keep."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    k = F.col("id")
    name = lambda n: F.concat(F.lit("Library/"), n.cast("string"), F.lit(".flac"))
    after = F.when(k % 40 == 39, k - 39).otherwise(k + 1)
    kind = k % 5
    moves = F.array(F.struct(name(k).alias("from"), name(after).alias("to")))
    return t.select(
        F.lit("root").alias("root"), F.substring(F.sha1(k.cast("string").cast("binary")), 1, 10).alias("id"), F.lit("2024-01-01T00:00:00+00:00").alias("created"),
        F.when(kind < 3, "rename").otherwise("remove").alias("action"), F.when(kind == 3, name(after)).when(kind == 4, F.lit("Library/kept.flac")).alias("kept"), F.when(kind >= 3, name(k)).alias("removed"),
        F.when(kind < 3, name(k)).alias("a"), F.when(kind < 3, name(after)).alias("b"), F.when(kind < 3, moves).alias("renames"), (k * 7919 % 1000003).alias("seq"),
    )


def chained_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three of the chained decisions' files, and the one that many keep."""
    t = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("Library/"), F.col("p_partkey").cast("string"), F.lit(".flac")).alias("rel"))
    return t.unionByName(spark.createDataFrame([("Library/kept.flac",)], "rel string"))


CHAINED_SQL = """steps AS (
  SELECT p_partkey * 7919 % 1000003 AS seq, substr(sha1(p_partkey::VARCHAR), 1, 10) AS id, 0 AS at_, CASE WHEN p_partkey % 5 < 3 THEN 'rename' ELSE 'remove' END AS kind,
         'Library/' || p_partkey || '.flac' AS src,
         CASE WHEN p_partkey % 5 = 4 THEN 'Library/kept.flac' ELSE 'Library/' || CASE WHEN p_partkey % 40 = 39 THEN p_partkey - 39 ELSE p_partkey + 1 END || '.flac' END AS dst FROM part),
inventory AS (SELECT 'Library/' || p_partkey || '.flac' AS rel FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'Library/kept.flac')"""

#: Steps one after another, each on the list of files that the one before left.
REPLAY_SQL = """told AS (SELECT list({'src': src, 'dst': dst, 'kind': kind} ORDER BY seq, id, at_) AS steps, list({'seq': seq, 'id': id, 'at': at_} ORDER BY seq, id, at_) AS places FROM steps),
folded AS (
  SELECT places, steps, list_reduce(steps, lambda acc, s: list_transform([
      CASE WHEN NOT list_contains(acc.have, s.src) THEN 'absent' WHEN list_contains(acc.have, s.dst) <> (s.kind = 'remove') THEN 'skipped' WHEN s.kind = 'remove' THEN 'removed' ELSE 'renamed' END],
      lambda said: {'have': CASE said WHEN 'removed' THEN list_filter(acc.have, lambda x: x <> s.src) WHEN 'renamed' THEN list_append(list_filter(acc.have, lambda x: x <> s.src), s.dst) ELSE acc.have END,
                    'said': list_append(acc.said, said)})[1],
    {'have': (SELECT list(DISTINCT rel) FROM inventory), 'said': []::VARCHAR[]}) AS r FROM told)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that exist now."""
    t = part_tracks(spark, sf_dir)
    return t.where("id % 7 <> 0").select("rel").unionByName(t.where("id % 3 = 0").select(F.concat(F.lit("Tracks/"), F.col("id").cast("string"), F.lit(".flac")).alias("rel")))


def emb_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word fingerprints from the signs of the embeddings."""
    bit = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, 1 << (31 - i % 32)).otherwise(0).cast("bigint")
    word = lambda w: sum([bit(i) for i in range(32 * w, 32 * w + 32)], F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(word(0), word(1)).alias("words"))


EMB_SQL = """prints AS (
  SELECT vec_id, label, [
    list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << (31 - i)::BIGINT) ELSE 0::BIGINT END))::BIGINT,
    list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN (1::BIGINT << (31 - i)::BIGINT) ELSE 0::BIGINT END))::BIGINT] AS words
  FROM embeddings)"""
