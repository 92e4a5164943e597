"""Queries over stored tables: folders of part files, lines whose order the SQL leaves open."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

from hyposcape.sources import tables  # noqa: E402


def test_folders_of_part_files_are_datasets(spark, tmp_path):
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "part"))
    one = next(f for f in os.listdir(tmp_path / "part") if f.startswith("part-"))
    os.link(tmp_path / "part" / one, tmp_path / "single.parquet")
    got = {r.dataset: r.length for r in tables.list_datasets(spark, str(tmp_path)).collect()}
    assert set(got) == {"many", "single"} and min(got.values()) > 0
    counts = {r.dataset: r.n for r in entry.queries()["list_datasets"](spark, str(tmp_path)).collect()}
    assert counts == {"many": 5, "single": 3}


def test_keep_first_of_equal_keys_is_the_first_stored(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    lines = [(p, o, 1, float((7 * i) % 50 + 1)) for i in range(40) for p in range(30) for o in (p % 3, 5)]
    df = spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = sorted(tuple(r) for r in entry.queries()["keep_first"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(entry.oracle_sql()["keep_first"]).fetchall())
    assert {r[2] for r in got} == {lines[0][3]}
