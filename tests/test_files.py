"""Lines and splits from files: exact places wherever the files are cut."""

import json
import os

import pytest

from shotloom.sources.files import load_splits, load_txt_records, numbered_lines


@pytest.fixture
def cut(spark):
    """Set the size at which files are cut into read blocks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, "1k"))]
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["700", "10k", "150k", "64m"])
def test_places_of_lines_in_many_files(spark, tmp_path, cut, size):
    cut(size)
    want = []
    for f, n in enumerate([0, 1, 400, 3, 900, 1]):  # an empty file, single lines, lines longer than a block
        lines = [f"file {f} line {i} " + "y" * (i * 37 % 900) for i in range(n)]
        (tmp_path / f"part-{f:03d}.txt").write_text("".join(x + "\n" for x in lines[:-1]) + "".join(lines[-1:]))
        want += lines
    got = {r.pos: r.value for r in numbered_lines(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))
    plan = numbered_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and "Repartition" not in plan  # lines are neither sorted nor dealt anew


def test_lines_are_stripped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n\ttwo \nlast")
    got = sorted(map(tuple, load_txt_records(spark, str(tmp_path / "a.txt")).collect()))
    assert got == [(0, "one"), (1, ""), (2, "two "), (3, "last")]


def test_every_split_with_its_own_places(spark, tmp_path, cut):
    cut("2k")
    rows = {"train": 300, "dev": 40, "test": 0}
    for split, n in rows.items():
        os.makedirs(tmp_path / split)
        (tmp_path / split / "data.jsonl").write_text("".join(
            json.dumps({"question": f"{split}\n{i}", "db_id": f"d{i % 3}", "more": 1}) + "\n" for i in range(n)))
    paths = {s: str(tmp_path / s) for s in rows} | {"extra": None}
    got = load_splits(spark, paths, "question string, db_id string, evidence string")
    assert got.columns == ["split", "idx", "question", "db_id", "evidence"]
    want = {(s, i, f"{s}\n{i}", f"d{i % 3}", None) for s, n in rows.items() for i in range(n)}
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(FileNotFoundError, match="dev"):
        load_splits(spark, {"train": paths["train"], "dev": str(tmp_path / "nothing")}, "question string")
    assert load_splits(spark, {"train": None}, "question string").columns == ["split", "idx", "question"]
