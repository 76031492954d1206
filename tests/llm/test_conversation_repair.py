"""Repair of conversations against a search of all edits, by brute force, and against SQL."""

import binascii
import hashlib
import random
import re
from itertools import product

import duckdb
import oracle
import pandas as pd
import pytest

from twinlathe.llm import conversation_repair as cr
from twinlathe.llm.storage import Scratch

DDL = "conv_id long, turn long, role string, text string, copies int, h1 long"
COLUMNS = ["conv_id", *[c.split()[0] for c in cr.RESULT_DDL.split(", ")]]


def _damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        left = out.setdefault(conv, [])
        spaced = lambda v: " " if v is None else v
        kind = binascii.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        left += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def _every_edit(rows, inserts):
    """All (cost, audit, repaired) of at most ``inserts`` insertions at each place, by trying them all."""
    roles, flags = [], []
    for at, (_, role, text) in enumerate(rows):
        said = text.strip(" \t\n\x0b\x0c\r")
        dup = any((r, t) == (role, text) for _, r, t in rows[:at])
        flags.append((not said or dup, bool(said) and not dup and said[-1] not in ".!?"))
        roles.append(role)
    places = [[p for n in range(inserts + 1) for p in product(("user", "assistant"), repeat=n)] for _ in range(len(rows) + 1)]
    choices = [[("D", None)] if gone else [("K", role), ("D", None), ("R", "user"), ("R", "assistant")] for role, (gone, _) in zip(roles, flags)]
    for added in product(*places):
        for edits in product(*choices):
            cost, audit, said = 0, "", []
            for at in range(len(rows) + 1):
                for role in added[at]:
                    cost, audit = cost + 2, audit + "I"
                    said.append((role, ""))
                if at < len(rows):
                    edit, role = edits[at]
                    cost, audit = cost + {"K": 0, "R": 2, "D": 3}[edit] + (edit != "D" and flags[at][1]), audit + edit
                    if edit != "D":
                        said.append((role, rows[at][2]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in said)):
                yield cost, audit, "\n".join(f"{r}:{t}" for r, t in said)


def _brute(rows, inserts=1):
    cost, audit, said = min(_every_edit(rows, inserts))
    turns = [t for t, _, _ in rows if t is not None]
    return cost, audit, hashlib.sha256(said.encode()).hexdigest(), (max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0


def _random_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \n", "Yes.", "so on,", "Why? ", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [
        (c if c else None, rng.choice([t, t, t, None, 2]), rng.choice(roles), rng.choice(texts), 9, 9)
        for c in range(convs) for t in range(rng.randint(1, most))
    ]


def test_equals_every_edit_tried(spark):
    rows = _random_rows(3, 150, 4)
    got = {r["conv_id"]: r for r in cr.repair(cr.damaged(spark.createDataFrame(rows, DDL)), Scratch(spark, "t")).collect()}
    left = _damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, turns in left.items():
        cost, audit, digest, gaps = _brute(turns)
        r = got[conv]
        assert (r["cost"], r["audit"], r["repaired_sha256"], r["gaps"]) == (cost, audit, digest, gaps), (conv, turns)


def test_two_insertions_in_one_place_are_never_cheapest_unless_nothing_is_kept():
    """The brute force tries one insertion a place; two are tried here on short rows."""
    rng = random.Random(5)
    for _ in range(40):
        rows = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c."])) for k in range(rng.randint(0, 2))]
        conversation, before = cr.Conversation(), set()
        for turn, role, text in rows:
            conversation.add(turn, role, text, (role, text) in before)
            before.add((role, text))
        assert conversation.result()[5:7] == min(_every_edit(rows, 2))[:2]


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_segments_change_nothing(segment):
    rng = random.Random(segment)
    for _ in range(60):
        whole, cut = cr.Conversation(), cr.Conversation(segment)
        for turn in range(rng.randint(0, 40)):
            row = (turn, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["a.", "b", "", "c?"]), rng.random() < 0.1)
            whole.add(*row)
            cut.add(*row)
        assert whole.result() == cut.result()


def test_long_conversation_keeps_one_segment(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("cast(1 as long) conv_id", "id turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END role", "concat('t', id, '.') text", "1 copies")
    (r,) = cr.repair(rows, Scratch(spark, "t")).collect()
    said = "\n".join(f"{'assistant' if k % 2 else 'user'}:t{k}." for k in range(n))
    assert (r["cost"], r["audit"], r["repaired_sha256"]) == (0, "K" * n, hashlib.sha256(said.encode()).hexdigest())


def test_empty_table_and_string_ids(spark):
    assert cr.repair(cr.damaged(spark.createDataFrame([], DDL)), Scratch(spark, "t")).count() == 0
    text = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", None, None, None)], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r for r in cr.repair(cr.damaged(text), Scratch(spark, "t")).collect()}
    assert set(got) == {"a", "b"}
    assert (got["b"]["blank"], got["b"]["audit"], got["b"]["gaps"]) in ((1, "D", 0), (2, "DD", 0), (0, "", 0))


def test_query_equals_its_oracle(spark):
    for sf in ("sf0.001", "sf0.01"):
        oracle.same(spark, f"/root/testdata/{sf}", cr.op12_conversation_repair, cr.ORACLE_SQL["op12_conversation_repair"])


def test_oracle_on_damaged_edges(spark, tmp_path):
    frame = pd.DataFrame([r[:4] for r in _random_rows(11, 60, 6)], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    frame.to_parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    theirs = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({cr.ORACLE_SQL['op12_conversation_repair']})").fetchall()
    ours = [tuple(r[c] for c in COLUMNS) for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
