"""Records of CSV files against the csv module, with block borders everywhere."""

import csv
import io
import random

import pytest

from caseloom.sources import catalogue as src
from caseloom.sources.records import csv_records

CELLS = ["", "plain", "two words", "a,b", 'say ""hi""', "\n", "x\ny", "\r\n", "a\rb", ",", '""', '"",""\n"",', "é\n\n€,", "\n" * 9, "ends\n", 'it said "" twice']


def text_of(seed, rows, end):
    rng = random.Random(seed)
    lines = []
    for i in range(rows):
        cells = []
        for _ in range(rng.randrange(1, 5)):
            cell = rng.choice(CELLS)
            bare = not set(cell) & set(',"\r\n') and rng.random() < 0.5
            cells.append(cell if bare else rng.choice(["", " "]) * rng.randrange(2) + f'"{cell}"')
        lines.append(f"{i}," + ",".join(cells))
    return end.join(lines)


def plain(text):
    return [r for r in csv.reader(io.StringIO(text, newline=""), skipinitialspace=True) if r]


@pytest.fixture
def blocks_of(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size,end", [(3, "\n"), (17, "\r\n"), (64, "\n"), (1 << 20, "\r")])
def test_records_do_not_depend_on_block_borders(spark, tmp_path, blocks_of, size, end):
    texts = {f"{seed}.csv": text_of(seed, 16 if size < 10 else 80, end) for seed in (1, 2)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    blocks_of(size)
    got = {}
    for r in csv_records(spark, str(tmp_path)).orderBy("file", "ordinal").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.ordinal, r.record))
    for name, text in texts.items():
        assert [plain(record)[0] for _, record in got[name]] == plain(text)
        assert len({ordinal for ordinal, _ in got[name]}) == len(got[name])


def test_odd_quotes_marks_and_bytes(spark, tmp_path, blocks_of):
    lines = ['﻿"Title",Agency', 'a 5" disk,A', '"b ""c"" d" tail,"B', 'still B"', "", "  ", 'e,"never', "closed,"]
    body = "\n".join(lines).encode() + b"\xff\n\n"
    (tmp_path / "a.csv").write_bytes(body)
    (tmp_path / "empty.csv").write_bytes(b"")
    wanted = ['"Title",Agency', 'a 5" disk,A', '"b ""c"" d" tail,"B\nstill B"', 'e,"never\nclosed,�']
    for size in (4, 1000):
        blocks_of(size)
        got = csv_records(spark, str(tmp_path)).orderBy("ordinal").collect()
        assert [r.record for r in got] == wanted
    rows = src.read_raw_csv(spark, str(tmp_path / "a.csv")).orderBy("ordinal").collect()
    assert [r.title for r in rows][0] == 'a 5" disk' and rows[1].agency == "B\nstill B"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_bytes(b"")
    assert src.read_raw_csv(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        src.read_catalogue_csv(spark, str(tmp_path / "none"))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, blocks_of):
    (tmp_path / "a.csv").write_text("Title,Agency\n" + '"x\ny",B\n' * 500 + "last,C\n")
    blocks_of(512)
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
    rows = src.read_raw_csv(spark, str(tmp_path / "a.csv"))
    assert rows.groupBy("title", "agency").count().collect().__len__() == 2 and rows.count() == 501
