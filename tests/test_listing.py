"""The listing made by tasks against a plain walk."""

import os
import random

import pytest

from twinlathe.sources import filesystem


def _tree(top, rng, depth):
    os.makedirs(top, exist_ok=True)
    for k in range(rng.randint(0, 6)):
        with open(f"{top}/{rng.choice(['f', '.h', '_u', 'é ü', 'x.flac'])}{k}", "wb") as f:
            f.write(b"x" * rng.randint(0, 50))
    for k in range(rng.randint(0, 4) if depth else 0):
        _tree(f"{top}/{rng.choice(['d', '.cache', '_x', 'a b'])}{k}", rng, depth - 1)


def _plain(root):
    out = set()
    for source, folder in filesystem.SOURCE_DIRS.items():
        for at, _, names in os.walk(f"{root}/{folder}"):
            for name in names:
                path = f"{at}/{name}"
                if os.path.isfile(path):
                    st = os.stat(path)
                    out.add((path, os.path.relpath(path, root), source, st.st_size, st.st_mtime_ns))
    return out


@pytest.mark.parametrize("seed, listed", [(1, 20_000), (2, 3), (3, 1)])
def test_equals_a_walk(spark, tmp_path, seed, listed, monkeypatch):
    rng = random.Random(seed)
    for folder in ("Library", "Incoming"):
        _tree(f"{tmp_path}/{folder}", rng, 4)
    target = tmp_path / "outside"
    _tree(str(target), rng, 1)
    (target / "file").write_bytes(b"abc")
    os.symlink(target / "file", tmp_path / "Library/link to file")
    os.symlink(target, tmp_path / "Library/link to folder")
    os.symlink(tmp_path / "nowhere", tmp_path / "Library/broken link")
    os.symlink(tmp_path / "Library", tmp_path / "Library/circle")
    monkeypatch.setattr(filesystem.walked, "__defaults__", (listed,))
    got = filesystem.listing(spark, tmp_path).collect()
    assert {tuple(r) for r in got} == _plain(tmp_path) and len(got) == len(_plain(tmp_path))
    assert "Library/link to file" in {r["rel"] for r in got}


def test_missing_and_unreadable_folders(spark, tmp_path):
    import pyarrow as pa

    assert filesystem.listing(spark, tmp_path).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a/f").write_bytes(b"1")
    # a folder that has gone, or can't be read, by the time it is listed
    open_ = pa.RecordBatch.from_pydict({"tag": ["t", "t"], "top": [str(tmp_path)] * 2, "path": [str(tmp_path / "gone"), str(tmp_path / "a")]})
    assert [r for b in filesystem._walk(10, iter([open_])) for r in b.column("rel").to_pylist()] == ["a/f"]


def test_trash_by_day_folder(spark, tmp_path):
    day = tmp_path / filesystem.TRASH_DIR / "2024-05-01/library"
    day.mkdir(parents=True)
    (day / "x.flac").write_bytes(b"12")
    (tmp_path / filesystem.TRASH_DIR / "stray").write_bytes(b"1")
    assert [(r["day"], r["rel"], r["size"]) for r in filesystem.trash_entries(spark, tmp_path).collect()] == [("2024-05-01", "library/x.flac", 2)]
