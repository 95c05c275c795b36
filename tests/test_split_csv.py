"""CSV files with line breaks, read in byte ranges, against Spark's read in one task."""

import random
from collections import Counter

import pytest

from pagoscope.sources import files, split_csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of about ``size`` bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield use
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def field(rng):
    kind = rng.randrange(8)
    if kind < 3:
        return rng.choice(["", "a", " x ", "ñ→🙂", "12.5", "N/D"])
    text = "".join(rng.choice(['\n', '""', ",", "a", "\r\n", " ", "\n\n", "é", '""\n""']) for _ in range(rng.randrange(1, 12)))
    return f'"{text}"' if kind < 7 else f'"{text * 40}"'


def write(path, rng, rows, end="\n", last=True):
    lines = ["a,b,c"] + [",".join(field(rng) for _ in range(3)) for _ in range(rows)]
    path.write_bytes((end.join(lines) + (end if last else "")).encode())


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


@pytest.mark.parametrize("size", [40, 300, 2500, 10**7])
def test_ranges_give_the_rows_of_one_task(spark, small_ranges, tmp_path, size):
    rng = random.Random(size)
    for number, (rows, end, last) in enumerate([(120, "\n", True), (30, "\n", False), (0, "\n", True), (40, "\n\n", True)]):
        write(tmp_path / f"{number}.csv", rng, rows, end, last)
    small_ranges(size)
    options = dict(schema=files.T.StructType([]), na_tokens=())
    split = files.read_csv(spark, str(tmp_path), split=True, **options)
    whole = files.read_csv(spark, str(tmp_path), split=False, **options)
    assert rows_of(split.select("a", "b", "c")) == rows_of(whole.select("a", "b", "c"))
    assert split.count() == 190
    assert size > 10**6 or split.rdd.getNumPartitions() > 4


def test_a_record_over_many_ranges(spark, small_ranges, tmp_path):
    long = "line\n" * 400
    (tmp_path / "x.csv").write_text(f'"a\nhead",b\n1,"{long}"\n"{long}",2\n3,4\n')
    small_ranges(100)
    rows = files.read_csv(spark, str(tmp_path / "x.csv"), files.T.StructType([]), split=True)
    assert rows.columns == ["a\nhead", "b"]
    assert rows_of(rows) == Counter([("1", long), (long, "2"), ("3", "4")])


def test_line_ends_of_other_systems(spark, small_ranges, tmp_path):
    (tmp_path / "x.csv").write_bytes('a,b\r\n1,"x\r\ny"\r\n2,z\r\n'.encode() * 1)
    small_ranges(8)
    options = dict(schema=files.T.StructType([]), na_tokens=())
    split = files.read_csv(spark, str(tmp_path / "x.csv"), split=True, **options)
    whole = files.read_csv(spark, str(tmp_path / "x.csv"), split=False, **options)
    assert split.columns == whole.columns and rows_of(split) == rows_of(whole)


def test_large_files_are_split_by_themselves(spark, small_ranges, tmp_path, monkeypatch):
    write(tmp_path / "x.csv", random.Random(1), 100)
    used = []
    monkeypatch.setattr(files.split_csv, "read", lambda *a: used.append(a) or split_csv.spark_read(*a))
    monkeypatch.setattr(split_csv, "spark_read", lambda s, path, names, options: s.read.options(**options).csv(path), raising=False)
    small_ranges(10**7)
    files.read_csv(spark, str(tmp_path / "x.csv"), files.T.StructType([]))
    assert not used
    small_ranges(500)
    files.read_csv(spark, str(tmp_path / "x.csv"), files.T.StructType([]))
    files.read_csv(spark, str(tmp_path / "x.csv"), files.T.StructType([]), multi_line=False)
    assert len(used) == 1


def test_stray_quotes_fail_the_read(spark, small_ranges, tmp_path):
    body = "".join(f"{i},plain text of row {i}\n" for i in range(50))
    small_ranges(200)
    (tmp_path / "odd.csv").write_text(f'a,b\n{body}60,5" pipe\n{body}')
    with pytest.raises(ValueError, match="balanced"):
        files.read_csv(spark, str(tmp_path / "odd.csv"), files.T.StructType([]), split=True)
    (tmp_path / "even.csv").write_text(f'a,b\n{body}60,5" pipe\n{body}61,6" pipe\n{body}')
    with pytest.raises(Exception, match="unquoted field"):
        files.read_csv(spark, str(tmp_path / "even.csv"), files.T.StructType([]), split=True).collect()
    assert files.read_csv(spark, str(tmp_path / "even.csv"), files.T.StructType([]), split=False).count() == 152


def test_a_deviating_header_fails_the_split_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path), files.T.StructType([]), split=True).collect()
