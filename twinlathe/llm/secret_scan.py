"""Operator 13 [native]: secrets, by form and by tests of randomness.

The base kinds are patterns (``assign``, ``access``, ``hex``). The kind ``random`` is what
looks drawn at random without their help: tokens of at least ``LEAST`` symbols outside the
base spans. A token's encoding is inferred as the smallest of ``ENCODINGS`` that holds all its
symbols; in that alphabet a battery tests that symbols are equally frequent (chi-squared), that
they cross the alphabet's middle as often as chance does (runs), and that neighbours don't
depend on each other (serial correlation). The three, each close to normal for random tokens,
are combined as a sum of squares (3 degrees of freedom); a token beyond its 0.999 quantile
isn't random.

What the battery can't refute need not be a secret: short tokens pass it easily. So each is
held against ordinary writing too, in which letters coincide more often (``COINCIDE``) and
classes of characters change less often (``CHANGES``); the p-value of that says how seldom
writing of that length looks so. Those values depend on the length, and are held to a rate of
false discoveries (``FALSE_RATE``, Benjamini and Hochberg) within each encoding and band of
lengths, over the tokens of all documents. Only counts by (stratum, bin) reach the driver.

All work on texts is in DataFrame functions, row by row; the one shuffle is of those counts.

Defined cases: null text is empty; empty text and text without matches have no spans; very long
texts and tokens are read whole; rows that repeat, or share a doc_id, are judged alone (and each
counts as a test); spans are sorted by start, ties by kind; a document's result doesn't depend
on doc_id, which may be null; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.llm.storage import Scratch

KINDS = ("assign", "access", "hex", "random")

# The words of assignments.
WORDS = ("password", "passwd", "secret", "token", "api_?key")

_either_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = f"({'|'.join(map(_either_case, WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kinds by (pattern, group, least length of the group). A run that is too short as a whole holds no
#: shorter one that is long enough, so the last two have their length in the pattern.
BASE = {"assign": (ASSIGN, 2, 12), "access": ("AKIA[A-Z0-9]{14,}", 0, 18), "hex": ("[0-9a-f]{16,}", 0, 16)}

#: Symbols that a token needs to be tested.
LEAST = 16
TOKEN = f"([A-Za-z0-9+/_-]{{{LEAST},}})={{0,2}}"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name: (pattern of the whole token, alphabet in its order), smallest alphabet first. Digits alone encode nothing.
ENCODINGS = {
    "base16": ("[0-9A-F]*[A-F][0-9A-F]*", _DIGITS + "ABCDEF"), "lower": ("[a-z]+", _LOWER), "upper": ("[A-Z]+", _UPPER), "base32": ("[A-Z2-7]*[A-Z][A-Z2-7]*", _UPPER + "234567"),
    "base36": ("[0-9a-z]*[a-z][0-9a-z]*", _DIGITS + _LOWER), "base36_upper": ("[0-9A-Z]*[A-Z][0-9A-Z]*", _DIGITS + _UPPER), "letters": ("[A-Za-z]+", _UPPER + _LOWER),
    "base62": ("[0-9A-Za-z]*[A-Za-z][0-9A-Za-z]*", _DIGITS + _UPPER + _LOWER), "base64": ("[A-Za-z0-9+/]*[A-Za-z][A-Za-z0-9+/]*", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*", _UPPER + _LOWER + _DIGITS + "-_"),
}
#: The 0.999 quantile of chi-squared with 3 degrees of freedom.
NOT_RANDOM = 16.266
#: Ordinary writing: chance that two symbols coincide, the spread that unequal symbols add to
#: their count (a part of n cubed), chance that the next character is of another class.
COINCIDE, SPREAD, CHANGES = 0.06, 0.0012, 0.3
#: Rate of false discoveries within each stratum.
FALSE_RATE = 0.001
#: Bands of lengths begin here; the last one is open.
BANDS = [b for k in range(4, 13) for b in (1 << k, 3 << (k - 1))]
#: p-values are binned by tenths of their decimal logarithm; the last bin is open.
LAST_BIN = 400
BIN = 10 * math.log10(math.e) / 2

_CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _running(steps: Column) -> Column:
    """Sums of the steps up to each, by chunks, so that long arrays cost about their length."""
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")
    sums = lambda s: F.transform(F.sequence(F.lit(0), chunk(F.size(s) - 1)), lambda c: _sum(F.slice(s, c * _CHUNK + 1, _CHUNK)))
    heads = lambda t: F.transform(t, lambda _, c: _sum(F.slice(t, F.lit(1), c)))
    within = lambda s, i: _sum(F.slice(s, chunk(i) * _CHUNK + 1, i % _CHUNK + 1))
    return _let(steps, lambda s: _let(_let(sums(s), heads), lambda h: F.transform(s, lambda _, i: F.get(h, chunk(i)) + within(s, i))))


_SPANS = "array<struct<start:int,end:int,held:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (code points, end exclusive) and the group's text of each leftmost match."""
    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    sizes = F.transform(found(0), F.length)
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = _let(sizes, lambda s: F.zip_with(F.slice(between, F.lit(1), F.size(s)), F.concat(F.array(F.lit(0)), s), lambda a, b: a + b))
    starts = F.filter(steps, lambda x: x.isNotNull())
    whole = F.zip_with(_running(starts), sizes, lambda a, n: F.struct(a.alias("start"), (a + n).alias("end")))
    spans = F.zip_with(whole, found(group), lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), g.alias("held")))
    return F.when(text.rlike(pattern), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def masked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with blanks in place of matches whose group is long enough."""
    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    kept = F.zip_with(found(0), found(group), lambda m, g: F.when(F.length(g) < least, m).otherwise(F.repeat(F.lit(" "), F.length(m))))
    parts = F.zip_with(F.split(text, pattern, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _by_encoding(encoding: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), encoding)


def encoding_of(token: Column) -> Column:
    """Number, from 1, of the smallest encoding that holds all symbols; null without one."""
    out = None
    for k, (pattern, _) in enumerate(ENCODINGS.values(), 1):
        fits = token.rlike(f"^(?:{pattern})$")
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out


def battery(token: Column, encoding: Column) -> Column:
    """chi (uniformity), runs, serial: standard scores under randomness; coincide, changes: under
    ordinary writing, large where the token is unlike it. ``token`` has at least two symbols."""
    sizes = [len(a) for _, a in ENCODINGS.values()]
    n, k = F.length(token).cast("double"), _by_encoding(encoding, sizes).cast("double")
    alphabet = _by_encoding(encoding, [a for _, a in ENCODINGS.values()])
    times = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("long")
    squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a + times(c) * times(c))).cast("double")
    # places in the alphabet, doubled and centred: odd numbers around zero
    centred = F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), lambda c: (2 * F.position(c, alphabet) - 1 - k).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("crossed"), F.lit(0).cast("long").alias("products"))
    walk = lambda v: F.aggregate(
        F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), zero,
        lambda s, p: F.struct((s["crossed"] + ((p["a"] > 0) != (p["b"] > 0)).cast("long")).alias("crossed"), (s["products"] + p["a"] * p["b"]).alias("products")),
    )
    classes = (F.length(F.regexp_replace(token, "[A-Z]+|[a-z]+|[0-9]+|[+/_-]+", "x")) - 1).cast("double")
    pairs = n * (n - 1) / 2
    spread = F.sqrt(pairs * COINCIDE * (1 - COINCIDE) + n * (n - 1) * (n - 2) * SPREAD)

    def scores(sq: Column, w: Column) -> Column:
        return F.struct(
            ((k * sq / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("chi"), ((2 * w["crossed"] - (n - 1)) / F.sqrt(n - 1)).alias("runs"),
            (3 * w["products"] / ((k * k - 1) * F.sqrt(n - 1))).alias("serial"), ((pairs * COINCIDE - (sq - n) / 2) / spread).alias("coincide"),
            ((classes - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))).alias("changes"),
        )

    return _let(squares, lambda sq: _let(_let(centred, walk), lambda w: scores(sq, w)))


def tested(token: Column) -> Column:
    """stratum and bin of a token's p-value under ordinary writing (bin 0 where it isn't random);
    a null stratum where it has no encoding."""

    def judge(encoding: Column) -> Column:
        def binned(s: Column) -> Column:
            random = s["chi"] * s["chi"] + s["runs"] * s["runs"] + s["serial"] * s["serial"] <= NOT_RANDOM
            # twice the smaller of two tail bounds exp(-z*z/2)/2
            z = F.greatest(s["coincide"], s["changes"], F.lit(0.0))
            return F.when(random, F.least(F.floor(z * z * BIN), F.lit(LAST_BIN))).otherwise(0).cast("int")

        band = sum([(F.length(token) >= b).cast("int") for b in BANDS], F.lit(0))
        return F.struct((encoding * 64 + band).alias("stratum"), F.when(encoding.isNotNull(), _let(battery(token, encoding), binned)).alias("bin"))

    return _let(encoding_of(token), judge)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by kind) and tokens (start, end, stratum, bin) of each document."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = lambda pattern, group, least: F.transform(
        F.filter(located(F.col("text"), pattern, group), lambda s: F.length(s["held"]) >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    )
    df = df.select("doc_id", "text", *[base(*how).alias(kind) for kind, how in BASE.items()])
    for p, g, least in BASE.values():
        df = df.withColumn("text", masked(F.col("text"), p, g, least))
    tokens = F.transform(located(F.col("text"), TOKEN, 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tested(s["held"]).alias("t")))
    tokens = F.transform(F.filter(tokens, lambda s: s["t"]["stratum"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["t"]["stratum"].alias("stratum"), s["t"]["bin"].alias("bin")))
    return df.select("doc_id", *BASE, tokens.alias("tokens"))


def thresholds(counts: list[tuple[int, int, int]], rate: float = FALSE_RATE) -> dict[int, int]:
    """The least bin of each stratum whose tokens are discoveries, from (stratum, bin, count): the
    largest p-value at which, were all tokens ordinary, at most ``rate`` of its discoveries would be expected."""
    out: dict[int, int] = {}
    for stratum in {s for s, _, _ in counts}:
        mine = sorted(((b, n) for s, b, n in counts if s == stratum), reverse=True)
        total, above = sum(n for _, n in mine), 0
        for b, n in mine:
            above += n
            if b and 10 ** (-b / 10) * total <= rate * above:
                out[stratum] = b
    return out


def scan(docs: DataFrame, scratch: Scratch, rate: float = FALSE_RATE) -> DataFrame:
    """doc_id, counts and spans of each document."""
    table = scratch.cut(found(docs), "found")
    counts = table.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    least = thresholds([tuple(r) for r in counts], rate)
    cut = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv]) if least else None
    is_random = lambda t: F.lit(False) if cut is None else F.coalesce(t["bin"] >= F.element_at(cut, t["stratum"]), F.lit(False))
    placed = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(*[placed(F.col(k), k) for k in BASE]))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    random = F.filter("tokens", is_random)
    return table.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.size(random).cast("long").alias("n_random"),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.array_sort(F.concat(base, placed(random, "random")))).alias("spans"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "secrets"))


def _sql() -> str:
    """The same spans by DuckDB: matches are numbered rows with running sums of lengths, and the
    tests are aggregates over the symbols of a token."""
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(table: str, pattern: str, group: int, least: int, kind: int) -> str:
        return f"""
  SELECT row_, held, {kind} AS kind, (sum(gap + n) OVER (PARTITION BY row_ ORDER BY nth) - n)::BIGINT AS s, (sum(gap + n) OVER (PARTITION BY row_ ORDER BY nth))::BIGINT AS e, length(held) >= {least} AS ok
  FROM (SELECT row_, unnest(range(len(m))) AS nth, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(g) AS held, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap
        FROM (SELECT row_, regexp_extract_all(t, {q(pattern)}, 0) AS m, regexp_extract_all(t, {q(pattern)}, {group}) AS g, string_split_regex(t, {q(pattern)}) AS gaps FROM {table} WHERE regexp_matches(t, {q(pattern)})))"""

    def mask(name: str, table: str, pattern: str, group: int, least: int) -> str:
        return f"""{name} AS (
  SELECT row_, doc_id, CASE WHEN regexp_matches(t, {q(pattern)}) THEN list_reduce(list_transform(list_zip(string_split_regex(t, {q(pattern)}), regexp_extract_all(t, {q(pattern)}, 0), regexp_extract_all(t, {q(pattern)}, {group})),
    lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN length(z[3]) < {least} THEN z[2] ELSE repeat(' ', length(z[2])) END), lambda a, b: a || b) ELSE t END AS t FROM {table})"""

    case = lambda values: "CASE " + " ".join(f"WHEN regexp_full_match(held, {q(p)}) THEN {v}" for (p, _), v in zip(ENCODINGS.values(), values)) + " END"
    alphabets = [f"'{a}'" for _, a in ENCODINGS.values()]
    bands = " + ".join(f"(n >= {b})::INT" for b in BANDS)
    text = [f"text{k}" for k in range(4)]
    masks = ",\n".join(mask(text[k + 1], text[k], *v) for k, v in enumerate(BASE.values()))
    base = "\nUNION ALL".join(spans("text0", p, g, least, k) for k, (p, g, least) in enumerate(BASE.values()))
    named = "list_extract(" + str(list(KINDS)) + ", kind + 1) || ':' || s || ':' || e"
    return f"""
WITH text0 AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t FROM documents),
{masks},
base AS (SELECT row_, kind, s, e FROM ({base}) WHERE ok),
tokens AS (
  SELECT row_number() OVER () AS id, row_, s, e, held, length(held)::DOUBLE AS n, {case(range(1, len(ENCODINGS) + 1))} AS encoding, {case(alphabets)} AS alphabet
  FROM ({spans("text3", TOKEN, 1, 0, 3)})),
symbols AS (SELECT id, unnest(range(n::INT)) AS nth, unnest(string_split(held, '')) AS c, n, alphabet, length(alphabet)::DOUBLE AS k FROM tokens WHERE encoding IS NOT NULL),
centred AS (SELECT *, (2 * strpos(alphabet, c) - 1 - k)::BIGINT AS v, lag((2 * strpos(alphabet, c) - 1 - k)::BIGINT) OVER (PARTITION BY id ORDER BY nth) AS u FROM symbols),
walked AS (SELECT id, any_value(k) AS k, count_if((u > 0) <> (v > 0))::DOUBLE AS crossed, sum(u * v)::DOUBLE AS products FROM centred GROUP BY id),
squared AS (SELECT id, sum(f * f)::DOUBLE AS sq FROM (SELECT id, c, count(*) AS f FROM symbols GROUP BY id, c) GROUP BY id),
scored AS (
  SELECT t.*, encoding * 64 + {bands} AS stratum, (k * sq / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, (2 * crossed - (n - 1)) / sqrt(n - 1) AS runs,
         3 * products / ((k * k - 1) * sqrt(n - 1)) AS serial,
         (n * (n - 1) / 2 * {COINCIDE}::DOUBLE - (sq - n) / 2) / sqrt(n * (n - 1) / 2 * {COINCIDE}::DOUBLE * {1 - COINCIDE}::DOUBLE + n * (n - 1) * (n - 2) * {SPREAD}::DOUBLE) AS coincide,
         (length(regexp_replace(held, '[A-Z]+|[a-z]+|[0-9]+|[+/_-]+', 'x', 'g')) - 1 - (n - 1) * {CHANGES}::DOUBLE) / sqrt((n - 1) * {CHANGES}::DOUBLE * {1 - CHANGES}::DOUBLE) AS changes
  FROM tokens t JOIN walked USING (id) JOIN squared USING (id)),
binned AS (
  SELECT *, CASE WHEN chi * chi + runs * runs + serial * serial <= {NOT_RANDOM}::DOUBLE
                 THEN least(floor(greatest(coincide, changes, 0.0::DOUBLE) * greatest(coincide, changes, 0.0::DOUBLE) * {BIN!r}::DOUBLE), {LAST_BIN})::INT ELSE 0 END AS bin FROM scored),
counted AS (SELECT stratum, bin, count(*) AS n FROM binned GROUP BY stratum, bin),
ranked AS (SELECT stratum, bin, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS above, sum(n) OVER (PARTITION BY stratum) AS total FROM counted),
cuts AS (SELECT stratum, min(bin) AS cut FROM ranked WHERE bin > 0 AND pow(10, -bin / 10.0::DOUBLE) * total <= {FALSE_RATE}::DOUBLE * above GROUP BY stratum),
every AS (SELECT row_, kind, s, e FROM base UNION ALL SELECT row_, 3, s, e FROM binned JOIN cuts USING (stratum) WHERE bin >= cut),
told AS (
  SELECT row_, {", ".join(f"count_if(kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))}, string_agg({named}, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base,
         string_agg({named}, ',' ORDER BY s, kind) AS spans FROM every GROUP BY row_)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0)::BIGINT AS n_{name}" for name in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM text0 LEFT JOIN told USING (row_)"""


QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLE_SQL = {"op13_secret_scan": _sql()}
