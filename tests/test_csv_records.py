"""Records cut in parallel: equal to reading each file in one task, wherever the splits lie."""

import contextlib
import csv
import os
import random

import pytest

from effortlab.sources import csv as CSV
from effortlab.sources import records as R

HEAD = ",".join(CSV.SEED_COLUMNS)


@contextlib.contextmanager
def split_size(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def whole(spark, path):
    """The same file read by Spark's CSV reader, which reads a quoted file in one task."""
    rows = (spark.read.schema(", ".join(f"`{c}` string" for c in CSV.SEED_COLUMNS)).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path).collect())
    return sorted(map(str, rows))


def cut(spark, path):
    return sorted(map(str, CSV._parsed(spark, path, CSV.SEED_COLUMNS).collect()))


TRICKY = (HEAD + "\n"
          'K-1,"multi\nline ""quoted""\n\n""",d,28800,3,r,s,c\n'
          "\n"
          'K-2,"",5" disk,1,2,"a\n,b",s,"c"\n'
          'K-3,"closed" and more,d"d,"1\n\n\n2",2,r,s,"x,y"\n'
          'K-4,плюс,"日\n本 ""😀""",1,2,r,s,c\n'
          'K-5,,,,,,,"last\n"')


def test_equal_at_every_byte_offset(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "seed.csv"), TRICKY)
    want = whole(spark, path)
    assert len(want) == 5
    for size in [*range(1, 40, 3), 64, 101, 150, len(TRICKY.encode()) + 1]:
        with split_size(spark, size):
            assert cut(spark, path) == want, size


def test_generated_files(spark, tmp_dir):
    """Several files with headers of their own, against Python's csv module."""
    rng = random.Random(12)
    want = []
    for k in range(4):
        rows = [[f"K-{k}-{i}", *("".join(rng.choice(['a', '"', ',', "\n", ' ', '""', "é", "x\ny", "'"]) for _ in range(rng.choice([1, 3, 30])))
                                for _ in range(7))] for i in range(rng.choice([0, 1, 40]))]
        with open(os.path.join(tmp_dir, f"part-{k}.csv"), "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL)
            w.writerow(CSV.SEED_COLUMNS)
            w.writerows(rows)
        want += rows
    for size in (17, 300, 1 << 20):
        with split_size(spark, size):
            got = [list(r) for r in CSV._parsed(spark, tmp_dir, CSV.SEED_COLUMNS, emptyValue="").collect()]
        assert sorted(got) == sorted(want)


def test_line_ends_headers_and_empty_files(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "crlf.csv"), "\r\n" + HEAD + '\r\nK-1,"a\r\nb",d,1,2,r,s,c\r\n\r\nK-2,x\r\n')
    for size in (5, 1 << 20):
        with split_size(spark, size):
            rows = {r.key: r for r in CSV.read_seed(spark, path).collect()}
            assert set(rows) == {"K-1", "K-2"} and rows["K-1"].summary == "a\r\nb" and rows["K-1"].commitments == "c"
    split_head = write(os.path.join(tmp_dir, "head.csv"), 'key,"sum\nmary",description\nK-1,a,b\n')
    with split_size(spark, 6):
        assert [r.record for r in R.records(spark, split_head).collect()] == ["K-1,a,b"]
    assert len(R.records(spark, split_head, skip_header=False).collect()) == 2
    for text in ("", "\n\n", HEAD, HEAD + "\n"):
        assert CSV.read_seed(spark, write(os.path.join(tmp_dir, "e.csv"), text)).count() == 0


def test_one_megabyte_fields(spark, tmp_dir):
    """A long description of quotes, and an overlong row with one: nothing recurses per character."""
    body = 'say ""hi"", then\n' * 62_500
    path = write(os.path.join(tmp_dir, "long.csv"), HEAD + f'\nK-1,s,"{body}",1,2,r,s,c\nK-2,s,"{body}",1,2,r,s,c,too,many\nK-3,s,d,1,2,r,s,c\n')
    with split_size(spark, 100_000):
        got = {r.key: r.description for r in CSV.read_seed(spark, path).collect()}
    assert got == {"K-1": body.replace('""', '"'), "K-3": "d"}


@pytest.mark.parametrize("line,outside,inside", [
    (b"", False, True), (b"a,b", False, True), (b'"a', True, False), (b'"a"', False, False), (b'a"b', False, False),
    (b'"a""', True, False), (b'"a"""', False, False), (b'x,"', True, False), (b'",a', True, False), (b'"a"x"y', False, False), (b'a,"b",', False, False), (b'a,"",b', False, True),
])
def test_how_a_line_ends(line, outside, inside):
    assert R.ends_inside(line, False) == outside
    assert R.ends_inside(line, True) == inside


def test_splits_do_not_read_whole_files(spark, tmp_dir):
    """Every split has its own row of facts; one record may cross many of them."""
    path = write(os.path.join(tmp_dir, "s.csv"), HEAD + "\n" + "".join(f'K-{i},"a\nb\n\nc",d,1,2,r,s,c\n' for i in range(200)))
    with split_size(spark, 500):
        state = R.splits(spark, path).collect()
        assert len(state) > 10 and sum(r.header for r in state) == 1 and any(r.inside for r in state)
        assert all((r.owner is not None) for r in state if r.inside)
        assert CSV.read_seed(spark, path).count() == 200
