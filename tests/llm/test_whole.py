"""The text operators do the whole job; their queries against SQL on the smallest tables."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest

from specweave.llm import namelist, queries, subjects


def test_a_sentence_counts_for_every_sure_subject():
    p = np.array([[0.9, 0.8], [0.8, 0.9], [0.6, 0.5], [0.9, 0.0], [0.9, 0.1], [0.1, 0.9], [0.1, 0.1]], np.float32)
    row = np.array([0, 0, 1, 1, 1, 2, 3])
    # Two sentences on both; a word of several senses counts in that of the text; one sentence; none.
    assert subjects.sentence_subjects(p, row, 5).tolist() == [[2, 2], [3, 0], [0, 1], [0, 0], [0, 0]]
    assert subjects.sentence_subjects(p[:0], row[:0], 2).tolist() == [[0, 0], [0, 0]]


def test_names_of_long_entries_in_any_order(spark, monkeypatch):
    entry = ("maximum", "number", "training", "update", "steps")
    entries = spark.createDataFrame([(7, " ".join(entry), []), (8, "maximum number training update epochs", [])], "name_id int, canonical_name string, aliases array<string>")
    typed = {"steps update training number maximum": 7, "update maximum epochs number training": 8, "trainng steps maximum updates number": 7, "stepsupdate training number maximum": 7, "stepsupdatetrainingnumbermaximum": 7, "steps update training number weights": 0}
    got = namelist.match_names(spark.createDataFrame([(t,) for t in typed], "name string"), entries).collect()
    assert {r["name"]: r["name_id"] for r in got} == typed
    # The same costs as by listing all orders.
    rng, pool, known = random.Random(3), ["step", "steps", "stop", "rate", "rat", "ratio", "layer", "later", "size"], frozenset(entry)
    cases = [(rng.choices(pool, k=5), tuple(rng.choices(pool, k=5))) for _ in range(150)]
    cases += [(rng.sample(e, 5), e) for _, e in cases[:40]] + [([a + b, *rest], e) for _, e in cases[:20] for a, b, *rest in [rng.sample(e, 5)]] + [(["".join(rng.sample(e, 5)).replace("s", "", 1)], e) for _, e in cases[:10]]
    mine = [namelist.name_cost(w, e, known, False) for w, e in cases]
    monkeypatch.setattr(namelist, "MOST_ORDERED", 5)
    listed = [namelist.name_cost(w, e, known, False) for w, e in cases]
    near = lambda xs: [x if x is None else round(x, 9) for x in xs]
    assert near(mine) == near(listed) and sum(x is not None for x in mine) > 60


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    mine, other = queries.queries()[name](spark, sf).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    tidy = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert tidy(mine) == tidy(other)


def test_p1_classes_hold_the_links_of_p1_found(spark, sf):
    pairs = queries.p1_found(spark, sf).collect()
    n = {}
    for r in pairs:
        for x in (r["id_a"], r["id_b"]):
            n[r["field"], x] = n.get((r["field"], x), 0) + 1
    classes = queries.p1_classes(spark, sf).groupBy("field", "id").agg({"n_links": "sum"}).collect()
    assert {(r[0], r[1]): r[2] for r in classes} == n
