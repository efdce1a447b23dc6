"""Types inferred from all cells, against pandas where its rules are the same."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.operators.infer import infer_types, with_types
from tallywright.sources import files

KINDS = {"bigint": "int64", "double": "float64", "boolean": "bool", "string": "object", "timestamp_ntz": "object"}


def test_types_are_those_of_pandas(spark, tmp_path):
    rng = random.Random(3)
    pools = {
        "whole": ["1", "-20", "+3", "007"], "number": ["1.5", ".5", "3.", "1e3", "-2"], "truth": ["True", "false", "TRUE"],
        "text": ["a", "1,000", "12d", "0x10"], "late": ["1"], "truth_and_number": ["true", "1"], "huge": ["1e400", "5"],
    }
    rows = [{c: rng.choice(p) for c, p in pools.items()} for _ in range(200)]
    rows[150]["late"] = "end"
    text = pd.DataFrame(rows).to_csv(index=False)
    (tmp_path / "t.csv").write_text(text)
    want = pd.read_csv(io.StringIO(text))
    got = {r["column"]: r for r in infer_types(files.read_upload(spark, str(tmp_path))).collect()}
    assert {c: KINDS[r.type] for c, r in got.items()} == {c: "object" if str(t) in ("str", "string") else str(t) for c, t in want.dtypes.items()}
    typed = files.read_typed(spark, str(tmp_path))
    assert [t for _, t in typed.dtypes] == [got[c].type for c in pools]
    assert [r.whole for r in typed.collect()] == want["whole"].tolist()


@pytest.mark.parametrize("parts", [1, 7])
def test_facts_merge_in_any_order(spark, parts):
    cells = [("a", "1", "NA", "2024-01-05"), ("a", "", "true", "2024-01-05T10:00:00"), ("a", " 12.250 ", "False", None),
             ("b", "99999999999999999999", None, "2024-13-01"), ("b", "1e5", "n/a", "x")] * 3
    df = spark.createDataFrame(cells, "file STRING, `odd name` STRING, b STRING, c STRING").repartition(parts)
    got = sorted(tuple(r) for r in infer_types(df, ("file",)).collect())
    assert got == [
        ("a", 0, "odd name", "double", 3, 9, 3, 2, 3), ("a", 1, "b", "boolean", 4, 9, 3, None, None),
        ("a", 2, "c", "timestamp_ntz", 8, 9, 3, None, None), ("b", 0, "odd name", "double", 2, 6, 0, 20, 0),
        ("b", 1, "b", "double", 0, 6, 6, None, None), ("b", 2, "c", "string", 16, 6, 0, None, None),
    ]
    plan = infer_types(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and plan.count("Scan") == 1
    empty = infer_types(df.limit(0)).collect()
    assert [(r["column"], r.type, r.n_rows) for r in empty][1:] == [("odd name", "double", 0), ("b", "double", 0), ("c", "double", 0)]
    assert with_types(df).select("c").dtypes == [("c", "string")]


def test_what_runs_for_a_cell_does_not_grow_with_the_columns(spark):
    """Generated code beyond 8000 bytes is not compiled and runs many times slower."""
    wide = spark.range(1).select(*[F.lit("1.5").alias(f"c{n}") for n in range(60)])
    for df in (infer_types(wide), with_types(wide, {f"c{n}": "double" for n in range(60)})):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") <= 4 and len(df.collect()) in (1, 60)


def test_facts_of_odd_cells(spark):
    cells = {
        "9223372036854775807": (1, 19, 0), "-9223372036854775808": (1, 19, 0), "9223372036854775808": (2, 19, 0),
        "-9223372036854775809": (2, 19, 0), " +00012 ": (1, 2, 0), "000": (1, 0, 0), "-0.50": (2, 0, 2), "7.": (2, 1, 0),
        ".25": (2, 0, 2), "1E3": (2, None, None), "1e400": (16, None, None), "1" * 400: (16, 400, 0), "\t4\n": (1, 1, 0),
        "12\u2028": (16, 2, 0), ".": (16, None, None), "+-1": (16, None, None), "e": (16, None, None), " 2024-02-29 ": (8, None, None),
        "2024-02-30": (16, None, None), "2024-1-5T10:00:00": (8, None, None), "TRUE": (4, None, None), "1,5": (16, None, None),
        "\uff11": (16, None, None), ":1": (16, None, None), "nan": (0, None, None),
    }
    df = spark.createDataFrame([(c, c) for c in cells], "file STRING, cell STRING")
    got = {r.file: (r.kinds, r.whole_digits, r.scale) for r in infer_types(df, ("file",)).collect()}
    assert got == cells
