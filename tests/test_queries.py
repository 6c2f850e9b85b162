"""Every query against its SQL on the smallest tables, and the package without its subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gridloom.plans import registries

DATA = Path("/root/testdata/sf0.001")
QUERIES = {n: f for reg in registries() for n, f in reg.queries.items()}
ORACLES = {n: s for reg in registries() for n, s in reg.oracles.items()}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name, tmp_path):
    out = str(tmp_path / "out")
    QUERIES[name](spark, str(DATA)).write.parquet(out)
    if name not in ORACLES:
        return
    duck.execute(f"CREATE OR REPLACE TEMP TABLE o AS {ORACLES[name]}")
    columns = sorted(c[0] for c in duck.execute("DESCRIBE o").fetchall())
    assert sorted(spark.read.parquet(out).columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    mine = f"SELECT {names} FROM '{out}/*.parquet'"
    for a, b in ((f"SELECT {names} FROM o", mine), (mine, f"SELECT {names} FROM o")):
        assert duck.execute(f"{a} EXCEPT ALL {b} LIMIT 3").fetchall() == []


def test_core_does_not_need_llm():
    code = "import sys; sys.modules['gridloom.llm'] = None\nimport __spark_entry__ as e\nassert 'p6_found' in e.queries() and 'p1_found' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
