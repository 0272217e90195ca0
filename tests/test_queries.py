"""Every registered query with checking SQL against DuckDB on the smallest tables."""

import json
import math

import duckdb
import pytest
from conftest import TESTDATA

from tidelog.plans import catalog, queries

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in TESTDATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(TESTDATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(catalog.ORACLES[name])
    places = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
    assert got == want


def test_enrichment_is_given_the_examples(spark, monkeypatch):
    class Echo:
        name = "echo"

        def analyze(self, prompt):
            return json.dumps({"explanation": prompt, "root_cause": None, "suggestions": []})

    monkeypatch.setattr(queries, "MockProvider", Echo)
    got = {r.pattern: r.explanation for r in catalog.QUERIES["enrich_groups"](spark, str(TESTDATA)).collect()}
    assert got and got == {r.pattern: r.prompt for r in catalog.QUERIES["prompt_build"](spark, str(TESTDATA)).collect()}
