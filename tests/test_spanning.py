"""Files with cells over several lines: the split reader against the multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.sources import files, spanning


@pytest.fixture
def small_blocks(spark):
    """Byte ranges of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng):
    kind = rng.randrange(9)
    plain = "".join(rng.choice("abc xyzé") for _ in range(rng.randrange(9)))
    if kind < 4:
        return plain
    if kind == 4:
        return plain.replace(" ", "") + 'x"y' + rng.choice(["", '"'])  # a quote inside an open cell
    inner = "".join(rng.choice(["a", " ", ",", '""', "\n", "\n\n", "word"]) for _ in range(rng.choice([2, 9, 80])))
    return f'"{inner}"'


def lines_of(rng, rows, end):
    return "".join(",".join(cell(rng) for _ in range(3)) + end for _ in range(rows))


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_equal_to_the_multi_line_reader(spark, tmp_path, small_blocks, seed, end):
    rng = random.Random(seed)
    text = f"id,note,more{end}" + lines_of(rng, 120, end) + end + lines_of(rng, 60, end)
    text += f'1,"{"line" + chr(10)}{("long, " * 30 + chr(10)) * 12}",z{end}last,"q""",x'
    (tmp_path / "a.csv").write_bytes(text.encode())
    reader = spark.read.options(header=True, escape='"', multiLine=True)
    want = [tuple(r) for r in reader.csv(str(tmp_path / "a.csv")).collect()]
    got = files.read_upload(spark, str(tmp_path), na_tokens=())
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    lines = spanning._lines(spark, [str(tmp_path / "a.csv")])
    assert lines.rdd.getNumPartitions() > 20 and lines.select("block").distinct().count() > 20


def test_rows_keep_their_order_and_header(spark, tmp_path, small_blocks):
    body = "".join(f'{i},"first\nsecond {i}"\n' for i in range(100))
    (tmp_path / "b.csv").write_text("\n\nno,text\n" + body)
    (tmp_path / "c.csv").write_text("no,text\n7,plain\n")
    headers, rows = files.read_uploads(spark, str(tmp_path))
    mine = rows.where(F.col("file").endswith("b.csv")).orderBy("row").collect()
    assert [r.cells for r in mine] == [[str(i), f"first\nsecond {i}"] for i in range(100)]
    assert headers.count() == 4 and rows.count() == 101
    assert files.read_upload(spark, str(tmp_path)).count() == 101


def test_a_cell_that_never_ends_and_another_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"open\n2,z\n')
    with pytest.raises(ValueError, match="never ends"):
        files.read_upload(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    (tmp_path / "b.csv").write_text('x,other\n1,"two\nlines"\n')
    with pytest.raises(ValueError, match="header"):
        files.read_upload(spark, str(tmp_path)).count()
