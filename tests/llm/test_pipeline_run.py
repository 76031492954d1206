import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
import duckdb  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402
from twinlathe.llm import mixing  # noqa: E402
from twinlathe.llm.storage import shared_dir  # noqa: E402


def planted():
    """(doc_id, text, lang, source, n_chars) with what each row is: good, bad (base or learned rule), or in no language."""
    rng, rows, kinds = random.Random(5), [], []

    def add(kind, text, lang="en", doc_id=0):
        rows.append((doc_id if doc_id is None else len(rows) + 1, text, lang, "abc"[rng.randrange(3)], None if text is None else len(text)))
        kinds.append(kind)

    words = {lang: [a + b + c for a in s for b in s for c in s] for lang, s in {"en": ("th", "an", "er", "is", "ow", "ly", "ng"), "fr": ("eu", "qu", "oi", "le", "ai", "es", "ou")}.items()}
    prose = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    for k in range(80):
        lang = ("en", "fr")[k % 2]
        text = prose(lang, rng.randrange(40, 120))
        add("good", "\n".join(" ".join(text[i : i + 20]) for i in range(0, len(text), 20)), lang)
        if k % 5 == 0:
            for changes in (0, 1, 2, 4):
                copy = list(text)
                for _ in range(changes):
                    copy[rng.randrange(len(copy))] = rng.choice(words[lang])
                add("good", " ".join(copy), lang)
    # linked only through a row whose doc_id is null
    base = prose("en", 100)
    add("good", " ".join(base[:-8] + prose("en", 8)))
    add("good", " ".join(base), doc_id=None)
    add("good", " ".join(prose("en", 8) + base[8:]))
    for _ in range(30):
        add("bad", " ".join(w + rng.choice((" #", " $", " |")) for w in prose("en", rng.randrange(40, 120))))
    for text in ("only nine words are in this one text here", " ".join(prose("en", 6) * 8), "", None):
        add("bad", text)
    for k in range(3):
        add("unknown", " ".join(str(rng.randrange(10**6)) for _ in range(20 + k)))
    return rows, kinds


def first_of_linked(rows, n=5, percent=80):
    """Rows whose doc_id is the smallest of those reachable by links."""
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (r[1].split() for r in rows)]
    near = [[j for j, y in enumerate(sets) if 100 * len(x & y) >= percent * len(x | y)] for x in sets]
    out = []
    for i, row in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            todo += (new := set(near[todo.pop()]) - reached)
            reached |= new
        if row[0] == min(rows[j][0] for j in reached if rows[j][0] is not None):
            out.append(row)
    return out


def test_run_equals_brute_force(spark, tmp_path):
    """Every row of run(): planted verdicts, all pairs compared in Python, mixing by its SQL, ids by the tokenizers library."""
    import corpus_pipeline as cp

    rows, kinds = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(k != "bad"), 0) for r, k in zip(rows, kinds) if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    good = [r for r, k in zip(rows, kinds) if k == "good"]
    left = first_of_linked(good)
    assert 80 <= len(left) < len(good) - 20
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", left)
    copies = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL['op1_source_mixing']})").fetchall()}
    assert {1, 2} <= set(copies.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, text, *_ in left:
        ids = library.encode(text, add_special_tokens=False).ids
        expected += [(i, ids, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] * copies[i]

    tables = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("*"))
    before = tables()
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r[0], list(r[1]), *r[2:]) for r in out.collect()) == sorted(expected)
    assert [p.name.rsplit("-", 1)[0] for p in tables() - before] == ["pipeline-BPE-encoding"]
