"""Every core query against its SQL on the smallest tables; the library without its text part."""

import datetime
import glob
import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from specweave.plans import oracles, queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tidy(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "\0"
        if isinstance(x, (datetime.date, pd.Timestamp)):
            return str(pd.Timestamp(x))
        return repr(round(float(x), 6)) if hasattr(x, "__float__") and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    mine, other = queries.queries()[name](spark, sf).toPandas(), duck.execute(oracles.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert tidy(mine) == tidy(other)


def test_queries_without_sql(spark, sf):
    """What these give is held against plain results elsewhere; here against one another and the tables."""
    assert {*queries.queries()} - {*oracles.oracle_sql()} == {"latex_sections", "p2_amounts", "p2_found"}
    every = queries.p2_amounts(spark, sf).toPandas()
    found = queries.p2_found(spark, sf).toPandas()
    assert len(found) > 50 and set(found.itertuples(index=False, name=None)) == set(every[every["mixed"]][["claim_id", "common_value"]].itertuples(index=False, name=None))
    docs = pd.read_parquet(f"{sf}/documents.parquet")["text"].dropna()
    sections = queries.latex_sections(spark, sf).toPandas()
    assert sections["doc_id"].nunique() == docs.str.contains(r"\\(?:sub){0,2}section\*?\{|\\begin\{(?:abstract|document)\}").sum() > 0


def test_core_does_not_need_the_text_part():
    code = "import sys; sys.modules['specweave.llm'] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    found = subprocess.run(["grep", "-rln", "specweave.llm", "specweave", "--include=*.py"], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert all(f.startswith("specweave/llm/") for f in found)
