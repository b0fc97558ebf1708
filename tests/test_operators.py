"""Core operators on small tables, held against plain Python or stated pins."""

import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specweave.functions import fuzz, ids, text, values
from specweave.operators import align, claims, conflicts, documents, gaps, operations, policy, snapshots, synthesis, units


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, col, **data):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in data.items())
    return spark.createDataFrame([tuple(data.values())], schema).select(col.alias("x")).first()["x"]


# Problem 2 --------------------------------------------------------------------------------------

AMOUNTS = [
    # value, unit, quote, kind, common unit, amount in it (None: no case)
    ("38.31 hr", None, "", "ms", 137916000), ("0,56", "ms", "", "µs", 560), ("1,234", "ms", "", "µs", 1234000), ("2 h 30 min", None, "", "ms", 9000000), ("1d 2h", None, "", "ms", 93600000), ("1:02:03", "hh:mm:ss", "", "ms", 3723000),
    ("ca. 7", "steps", "", "steps", None), ("7 step", None, "", "steps", None), ("3.7 k", None, "", "steps", 3700), ("5", "epochs", "", "steps", None), ("5", None, "We ran 5 epochs.", "steps", None), ("12 345", "k tokens", "", "tokens", 12345000), ("4.51E+04s", None, "", "ms", 45100000),
    ("0.1", None, "", "ppm", 100000), ("≈ 44", "‰", "", "ppm", 44000), ("12.49 bp", None, "", "ppm", 1249), ("26", None, "It was 26 ‰ throughout.", "ppm", 26000), ("100", "parts per million", "", "ppm", None), ("1.5×10⁻³", None, "", "ppm", 1500),
    ("1", "GiB", "", "byte", 1 << 30), ("1", "GB", "", "byte", 10**9), ("2", "GB/s", "", "bit/s", 16 * 10**9), ("2", "Gb/s", "", "bit/s", 2 * 10**9), ("3", "MBps", "", "bit/s", 24 * 10**6), ("20", "°C", "", "mK", 293150), ("-40", "deg F", "", "mK", 233150), ("300", "K", "", "mK", 300000), ("300", "millikelvin", "", "mK", None),
    ("1", "in", "", "µm", 25400), ("5", "um", "", "µm", None), ("1", "PFLOP/s-day", "", "GFLOP", 86400 * 10**6), ("2", "EFLOP", "", "GFLOP", 2 * 10**9), ("1", "kWh", "", "J", 3600000), ("2", "kW", "", "mW", 2000000), ("see Table 2", "kW", "", "mW", None), ("n/a", None, "", "mW", None), ("20", None, "On a 24-core node it came to 20 W.", "mW", 20000), ("", "W", "", "mW", None), (None, "W", "", "mW", None),
]


def test_amounts_with_written_units(spark):
    data = [(f"c{i}", common, v, u, q, "x") for i, (v, u, q, common, _) in enumerate(AMOUNTS)]
    df = spark.createDataFrame(data + data[:2], "claim_id string, canonical_name string, value string, unit string, quote string, common_unit string")
    names = spark.createDataFrame([(x, x) for x in sorted({a[3] for a in AMOUNTS})], "canonical_name string, common_unit string")
    want = sorted((f"c{i}", a[4]) for i, a in enumerate(AMOUNTS) if a[4] is not None)
    assert rows(units.mixed_amounts(df, names)) == want
    assert rows(units.mixed_amounts(df.limit(0), names)) == [] and rows(units.mixed_amounts(df, names.limit(0))) == []


def test_missing_units_by_mixture(spark):
    rng = random.Random(1)
    data = [(f"k{i}", "t", f"{rng.lognormvariate(7, 0.3):.3f}", "s", None) for i in range(300)]
    data += [(f"m{i}", "t", f"{1000 * rng.lognormvariate(7, 0.3):.3f}", None, None) for i in range(60)] + [("z", "t", "0", None, None)]
    df = spark.createDataFrame(data, "claim_id string, canonical_name string, value string, unit string, quote string")
    out = {r["claim_id"]: r for r in units.convert_units(df, spark.createDataFrame([("t", "ms")], "canonical_name string, common_unit string")).collect()}
    assert len(out) == 361 and out["k0"]["origin"] == "unit" and out["z"]["uncertain"]
    assert sum(out[f"m{i}"]["assigned_unit"] == "ms" and not out[f"m{i}"]["uncertain"] for i in range(60)) > 50


def test_bare_ppm_numbers_go_through_the_mixture(spark):
    rng = random.Random(5)
    data = [(f"k{i}", "d", f"{rng.lognormvariate(3, 0.4):.3f}", "%", None) for i in range(200)] + [(f"b{i}", "d", f"{rng.lognormvariate(-1.6, 0.4):.4f}", None, None) for i in range(50)]
    data += [("zero", "d", "0", None, None), ("far", "d", "250000", None, None)]
    df = spark.createDataFrame(data, "claim_id string, canonical_name string, value string, unit string, quote string")
    names = spark.createDataFrame([("d", "ppm")], "canonical_name string, common_unit string")
    out = {r["claim_id"]: r for r in units.convert_units(df, names).collect()}
    assert all(out[f"b{i}"]["assigned_unit"] == "ratio" or out[f"b{i}"]["assigned_unit"] == "fraction" for i in range(50))
    assert all(out[f"b{i}"]["common_value"] == round(Fraction(v) * 10**6) for i, v in ((i, dict((c, v) for c, _, v, _, _ in data)[f"b{i}"]) for i in range(50)))
    assert out["far"]["assigned_unit"] in ("ratio", "fraction")  # the prior stands for the rule, also far from all others
    assert out["zero"]["common_value"] == 0 and out["zero"]["uncertain"]
    found = units.mixed_amounts(df, names)
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().toString()
    assert {r["claim_id"] for r in found.collect()} == {c for c, *_ in data}


def test_hidden_units_are_assigned(spark):
    """Units that were written and are hidden come out again where the mixture is certain."""
    rng, factor = random.Random(9), {"ms": 1, "s": 1000, "h": 3600000}
    data, true = [], {}
    for i in range(600):
        ms, unit = rng.lognormvariate(13, 0.5), rng.choice(["ms", "s", "s", "h"])
        hidden = i % 4 == 0
        data.append((f"c{i}", "t", f"{ms / factor[unit]:.6f}", None if hidden else unit, None))
        true[f"c{i}"] = unit if hidden else None
    df = spark.createDataFrame(data, "claim_id string, canonical_name string, value string, unit string, quote string")
    got = units.convert_units(df, spark.createDataFrame([("t", "ms")], "canonical_name string, common_unit string")).where("origin = 'none'").collect()
    sure = [r for r in got if not r["uncertain"]]
    right = [r for r in sure if r["assigned_unit"] == true[r["claim_id"]]]
    assert len(got) == 150 and len(sure) >= 100 and len(right) >= 0.95 * len(sure)


def test_no_amounts_take_a_bare_fraction_away(spark):
    """Where ppm are common a bare number is a fraction of one, however near it lies to the others in ppm."""
    data = [(f"k{i}", "d", f"{5 + i % 3 / 10:.1f}", "ppm", None) for i in range(300)] + [("b", "d", "3", None, None)]
    df = spark.createDataFrame(data, "claim_id string, canonical_name string, value string, unit string, quote string")
    names = spark.createDataFrame([("d", "ppm")], "canonical_name string, common_unit string")
    assert rows(units.mixed_amounts(df, names)) == [("b", 3000000)]
    b = units.convert_units(df, names).where("claim_id = 'b'").first()
    assert (b["common_value"], b["mixed"], b["uncertain"]) == (3000000, True, True) and b["posterior"] < 0.01
    assert (b["likely_unit"], b["likely_value"]) == ("ppm", 3)


def test_posterior_of_bare_fractions_comes_from_the_amounts(spark):
    """Of bare ratios some are fractions and some lost their percent sign: the mixture tells them apart."""
    rng = random.Random(3)
    draw = lambda: f"{rng.lognormvariate(-1.6, 0.3):.6f}"
    data = [(f"k{i}", "d", draw(), "fraction", None) for i in range(200)] + [(f"f{i}", "d", draw(), None, None) for i in range(60)]
    lost = {f"p{i}": f"{100 * float(draw()):.4f}" for i in range(60)}
    df = spark.createDataFrame(data + [(c, "d", v, None, None) for c, v in lost.items()], "claim_id string, canonical_name string, value string, unit string, quote string")
    names = spark.createDataFrame([("d", "ppm")], "canonical_name string, common_unit string")
    out = {r["claim_id"]: r for r in units.convert_units(df, names).where("origin = 'none'").collect()}
    assert all(r["uncertain"] == (c in lost) and r["mixed"] for c, r in out.items()) and len(out) == 120
    assert all((out[c]["common_value"], out[c]["likely_unit"], out[c]["likely_value"]) == (round(Fraction(v) * 10**6), "%", round(Fraction(v) * 10**4)) for c, v in lost.items())
    assert all(r["likely_value"] == r["common_value"] for c, r in out.items() if c not in lost)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**12), st.sampled_from([",", " ", "_", " "]))
def test_grouped_numbers_round_trip(n, sep):
    m = units.NUMBER.fullmatch(f"{n:,}".replace(",", sep))
    assert m and units.read_number(m) == Fraction(n)


# Problem 5 --------------------------------------------------------------------------------------


def test_snapshot_changes(spark):
    v = [("a", 1, "c", "n", None, "16"), ("a", 1, "c", "n", None, "16"), ("a", 3, "c", "n", "", "1.6e1 "), ("a", 3, "c", "m", "x", "Adam"), ("a", 4, "c", "m", "x", " adam"), ("a", 4, "c", "p", "x", "2"), ("a", 5, "c", "p", "x", "3"), ("b", 1, "c", "n", None, "1"), ("a", 5, None, "q", None, None)]
    values_ = spark.createDataFrame([(*r, "z") for r in v], "spec_id string, snapshot_no int, component_id string, canonical_name string, condition string, value string, item string")
    con = spark.createDataFrame([("a", 1, "k1"), ("a", 3, "k1"), ("a", 3, "k2"), ("a", 3, "k2"), ("a", 2, "k9")], "spec_id string, snapshot_no int, contradiction_id string")
    gap = spark.createDataFrame([("a", 3, "f", "c1"), ("a", 3, "f", "c2"), ("a", 4, "f", "c2")], "spec_id string, snapshot_no int, field string, component_id string")
    want = [("a", 3, "conflict_opened", "k2"), ("a", 3, "gap_opened", "f"), ("a", 3, "value_added", "c|m|x"), ("a", 4, "conflict_closed", "k1"), ("a", 4, "conflict_closed", "k2"), ("a", 4, "value_added", "c|p|x"), ("a", 4, "value_removed", "c|n|"), ("a", 5, "gap_closed", "f"), ("a", 5, "value_added", "|q|"), ("a", 5, "value_changed", "c|p|x"), ("a", 5, "value_removed", "c|m|x")]
    assert rows(snapshots.snapshot_changes(values_, con, gap)) == want
    assert rows(snapshots.snapshot_changes(values_, con, gap, leaf_bits=4, level_bits=2)) == want
    assert rows(snapshots.snapshot_changes(values_.limit(0), con, gap)) == []


# Text, ids, values ------------------------------------------------------------------------------


def test_ids(spark):
    assert one(spark, ids.slugify(F.col("t")), t="  Learning-Rate (β) ") == "learning_rate"
    assert one(spark, ids.slugify(F.col("t")), t="–") == "unnamed"
    assert one(spark, ids.scope_id(F.col("t")), t="p#s3.p1.20") == "p#s3" and one(spark, ids.scope_id(F.col("t")), t="x") == "x"
    assert one(spark, ids.parse_span(F.col("t")), t="p#s3.p1.20").asDict() == {"paper": "p", "section": 3, "paragraph": 1, "offset": 20}
    assert one(spark, ids.parse_span(F.col("t")), t="p#s3.p1") is None
    assert one(spark, ids.quote_hash(F.col("t")), t=" a \n b") == one(spark, ids.quote_hash(F.col("t")), t="a b")


@pytest.mark.parametrize(("a", "b"), [("efﬁ-\ncient", "efficient"), ("a\xa0 b ", "a b"), ("x\r\n\r\n\n y", "x\ny"), ("“q”", '"q"')])
def test_normalize_text(spark, a, b):
    assert one(spark, text.normalize_text(F.col("t")), t=a) == b


def test_numbers_in(spark):
    assert one(spark, text.numbers_in(F.col("t")), t="1e-4, 0.0001 and 1.0 × 10^4; 100,000 of x2 in v1.5") == [1e4, 1e-4, 1e-4, 1.0, 10.0, 4.0, 100000.0]
    for t, v in (("set to 1e-4.", 1e-4), ("is 1 x 10^-4 here", 1e-4), ("is 1.0 × 10−4", 1e-4), ("of 100,000 steps", 1e5)):
        assert any(abs(x - v) < 1e-12 for x in one(spark, text.numbers_in(F.col("t")), t=t))
    assert one(spark, text.numbers_in(F.col("t")), t="BERT2 v1.x") == []


@pytest.mark.parametrize(("latex", "fine"), [(r"\frac{a}{b} + c", True), (r"\{ a, b \} = S", True), (r"\left( x \right) = 1", True), ("a=b", False), (r"\left( x = 12 ", False), (r"f(x = {12}", False), (" = 12", False), ("", False)])
def test_formula_quality(spark, latex, fine):
    assert (one(spark, text.formula_quality(F.col("t")), t=latex) is None) == fine


def test_citations_suggestions_json_and_years(spark):
    assert one(spark, text.citation_keys(F.col("t")), t="[MASK] [CLS] [smith2020] [unknownkey2020] [12]") == ["smith2020", "unknownkey2020"]
    assert one(spark, text.strip_suggestion(F.col("t")), t="Which rate? Probably 0.1.") == "Which rate?"
    for t in ('{"a": 1}', 'Sure:\n```json\n{"a": 1,}\n```', 'x {"a": 1} y', '{"a": 1, }'):
        assert one(spark, F.variant_get(text.parse_json_reply(F.col("t")), "$.a", "int"), t=t) == 1
    assert one(spark, text.parse_json_reply(F.col("t")).isNull(), t='{"a": ') is True
    assert one(spark, text.arxiv_id(F.col("t")), t="https://arxiv.org/abs/1706.03762v5") == "1706.03762" and one(spark, text.arxiv_id(F.col("t")), t="cs.CL/0101001") == "cs.CL/0101001"
    assert one(spark, text.tex_plain(F.col("t")), t=r"\textbf{50\%} of~$d_k$ \cite[p.~3]{a,b}") == "50% of d_k [a]"


def test_value_keys(spark):
    key = lambda v: one(spark, values.value_key(F.col("v")), v=v)
    assert key("1e-4") == key("0.0001") == key(" 0.00010") and key("Adam") == key(" adam") and key("1d") == "1d" and key(None) is None and key("-0") == key("0")
    assert one(spark, values.condition_key(F.col("v")), v=" Base  model.; ") == "base model"


# Similarity -------------------------------------------------------------------------------------

SAME = [("80% mask token, 10% random token, 10% unchanged", "80% [MASK] token, 10% random token, 10% unchanged token"), ("case-preserving WordPiece", "WordPiece"), ("next sentence prediction (NSP)", "NSP")]
OTHER = [("WordPiece", "SentencePiece"), ("sinusoidal positional encoding", "learned positional encoding"), ("next sentence prediction", "sentence order prediction"), ("linear decay", "cosine decay")]


def test_same_approach(spark):
    for pairs, n in ((SAME, 1), (OTHER, 2)):
        df = spark.createDataFrame([(str(i), t) for i, p in enumerate(pairs) for t in p], "s string, t string")
        got = conflicts.same_approach(df, ["s"], "t").groupBy("s").agg(F.count_distinct("answer").alias("n")).collect()
        assert [r["n"] for r in got] == [n] * len(pairs)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzz.common_length(a, b) == table[-1][-1]
    assert 0 <= fuzz.token_set_ratio(a, b) <= 100 and fuzz.token_set_ratio(a, b) == fuzz.token_set_ratio(b, a)


# Graphs -----------------------------------------------------------------------------------------


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (500, 500), (None, 3)] + [(1000, 1001 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(rows(align.connected_components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {n: find(n) for n in parent}
    assert rows(align.connected_components(spark.createDataFrame([], "a int, b int"))) == []


def test_cycles(spark):
    edge = lambda *e: synthesis.cycle_members(spark.createDataFrame(list(e), "source string, target string"))
    assert rows(edge(("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a"))) == [("a",), ("b",), ("c",)]
    assert rows(edge(("a", "b"), ("b", "c"), ("a", "c"))) == [] and rows(edge(("a", "a"))) == [("a",)]


def test_split_clusters(spark):
    members = spark.createDataFrame([("k", c) for c in "abcd"] + [("q", "e")], "cluster_id string, claim_id string")
    labels = spark.createDataFrame([("k", "a", " X "), ("k", "c", "x"), ("k", "b", "y"), ("q", "e", " ")], "cluster_id string, claim_id string, label string")
    assert rows(align.split_clusters(members, labels)) == [("k", "k_1", "a"), ("k", "k_1", "c"), ("k", "k_2", "b"), ("k", "k_3", "d"), ("q", "q", "e")]


# Claims -----------------------------------------------------------------------------------------


def view(spark, data):
    """(claim_id, paper_id, type, name, value, value_type, condition, unit, stated)"""
    schema = "claim_id string, paper_id string, type string, canonical_name string, value string, value_type string, condition string, unit string, stated_explicitly boolean"
    df = spark.createDataFrame(data, schema).withColumns({"status": F.lit("verified"), "applies_to": F.lit("global"), "confidence": F.lit(0.9), "scope_id": F.lit("p#s1"), "section": F.lit("S"), "quote": F.lit("it is 0.1"), "trace_result": F.lit("pass"), "symbol_result": F.lit("n/a")})
    return claims.typed(claims.canonical_names(df))


def hyper(i, paper, name, value, cond=None, unit=None, stated=True, kind="float"):
    return (f"c{i}", paper, "hyperparameter", name, value, kind, cond, unit, stated)


def test_value_conflicts_and_severity(spark):
    data = [hyper(1, "a", "lr", "0.0001"), hyper(2, "b", "learning_rate", "3e-4"), hyper(3, "c", "learning-rate", "1e-4"), hyper(4, "a", "dropout", "0.1"), hyper(5, "b", "dropout", ".1"), hyper(6, "a", "optimizer", "Adam"), hyper(7, "b", "optimizer", "SGD"), hyper(8, "a", "num_layers", "6"), hyper(9, "b", "num_layers", "12"), hyper(10, "a", "momentum", "0.1"), hyper(11, "b", "momentum", "0.1000000000001"), hyper(12, "a", "batch_size", "1", cond="Base"), hyper(13, "b", "batch_size", "2", cond="large"), hyper(14, "a", "beam_size", "1"), hyper(15, "a", "beam_size", "2"), hyper(16, "a", "weight_decay", "0.0001"), hyper(17, "b", "weight_decay", "0.1")]
    got = {r["name_key"]: (r["severity"], [p["claim_id"] for p in r["positions"]]) for r in conflicts.value_conflicts(view(spark, data)).collect()}
    assert got == {"learning_rate": ("MATERIAL", ["c1", "c2"]), "optimizer": ("BLOCKING", ["c6", "c7"]), "num_layers": ("BLOCKING", ["c8", "c9"]), "weight_decay": ("BLOCKING", ["c16", "c17"])}
    assert rows(conflicts.value_conflicts(view(spark, data).limit(0))) == []


def test_result_conflicts_collapse(spark):
    res = lambda i, p, v, c=None: (f"r{i}", p, "result", "BLEU", v, "float", c, None, True)
    df = view(spark, [res(1, "a", "27.3"), res(2, "b", "28.4"), res(3, "c", "27.30000001"), res(4, "a", "5", "x"), res(5, "b", "6", "y")])
    got = conflicts.result_conflicts(df).collect()
    assert len(got) == 1 and got[0]["n_values"] == 2 and got[0]["low"] == 27.3
    overlap = spark.createDataFrame([([27.3, 27.6], [0.5, 0.4]), ([27.3, 29.0], [0.1, 0.1]), ([27.3, 27.9], [None, 0.4])], "v array<double>, s array<double>")
    assert [r[0] for r in overlap.select(conflicts.spreads_overlap(F.col("v"), F.col("s"))).collect()] == [True, False, False]


def test_method_and_definition_conflicts(spark):
    m = lambda i, p, v, kind="method", name="tokenizer": (f"m{i}", p, kind, name, v, "categorical", None, None, True)
    df = view(spark, [m(1, "a", "WordPiece"), m(2, "b", "case-preserving WordPiece"), m(3, "c", "SentencePiece"), m(4, "a", "linear decay", name="schedule"), m(5, "a", "cosine decay", name="schedule"), m(6, "a", "the agent calls a tool outside the granted set", "definition", "misuse"), m(7, "b", "agent calls a tool outside the granted set", "definition", "misuse")])
    got = conflicts.method_conflicts(df).collect()
    assert [(r["name_key"], r["severity"], r["n_values"]) for r in got] == [("tokenizer", "BLOCKING", 2)]
    assert conflicts.definition_conflicts(df).collect() == []


def test_methods_by_stance(spark):
    m = lambda i, p, v, adopted=True, own="own", cond=None: (f"m{i}", p, "method", "optimizer_choice", v, "categorical", cond, None, True, adopted, own, "it is slow" if not adopted else None)
    schema = "claim_id string, paper_id string, type string, canonical_name string, value string, value_type string, condition string, unit string, stated_explicitly boolean, adopted boolean, attribution string, rationale string"

    def found(*data):
        df = spark.createDataFrame(list(data), schema).withColumns({"status": F.lit("verified"), "applies_to": F.lit("global"), "section": F.lit("S")})
        return [(r["severity"], [p["position"] for p in r["positions"]]) for r in conflicts.method_conflicts(claims.typed(claims.canonical_names(df))).collect()]

    assert found(m(1, "a", "NSP"), m(2, "b", "next sentence prediction (NSP)", adopted=False)) == [("BLOCKING", ["NSP", "removes next sentence prediction (NSP) - it is slow"])]
    assert found(m(1, "a", "NSP"), m(2, "b", "NSP"), m(3, "b", "sentence order", adopted=False)) == []  # an alternative declined
    assert found(m(1, "a", "Adam"), m(2, "b", "SGD")) == [("MATERIAL", ["Adam", "SGD"])]
    assert found(m(1, "a", "Adam"), m(2, "b", "SGD", own="prior_work")) == [] and found(m(1, "a", "Adam"), m(2, "b", "SGD", cond="large")) == []


def test_results_by_scope_and_spread(spark):
    schema = "claim_id string, paper_id string, value string, dataset string, split string, conditions map<string,string>, reported_variance double"

    def found(*data):
        df = spark.createDataFrame(list(data), schema).withColumns({"type": F.lit("result"), "canonical_name": F.lit("BLEU score"), "value_type": F.lit("float"), "condition": F.lit(None).cast("string"), "unit": F.lit(None).cast("string"), "stated_explicitly": F.lit(True), "status": F.lit("verified"), "applies_to": F.lit("global"), "section": F.lit("S")})
        return [(r["name_key"], r["severity"], [p["position"] for p in r["positions"]]) for r in conflicts.result_conflicts(claims.typed(claims.canonical_names(df))).collect()]

    row = lambda i, p, v, var=None, ds="wmt", split="test", **cond: (f"r{i}", p, v, ds, split, cond or None, var)
    assert found(row(1, "a", "27.3", 0.5), row(2, "b", "27.6", 0.4)) == []  # within each other's spread
    assert found(row(1, "a", "27.3", 0.1), row(2, "b", "27.6", 0.4)) == [("bleu", "MATERIAL", ["27.3 +/- 0.1", "27.6 +/- 0.4"])]
    assert found(row(1, "a", "27.3"), row(2, "b", "27.6", 0.4)) == [("bleu", "MATERIAL", ["27.3", "27.6 +/- 0.4"])]
    assert found(row(1, "a", "27"), row(2, "b", "28", split="dev")) == [] and found(row(1, "a", "27"), row(2, "b", "28", ds="WMT ")) != []
    assert found(row(1, "a", "27", beam="4"), row(2, "b", "28", beam="5")) == [] and found(row(1, "a", "27", beam="4", lp="1"), row(2, "b", "28", lp="1", beam="4")) != []


def test_definitions_by_criterion(spark):
    schema = "claim_id string, paper_id string, value string, criterion string"

    def found(*data):
        df = spark.createDataFrame(list(data), schema).withColumns({"type": F.lit("definition"), "canonical_name": F.lit("failure"), "value_type": F.lit("categorical"), "condition": F.lit(None).cast("string"), "unit": F.lit(None).cast("string"), "stated_explicitly": F.lit(True), "status": F.lit("verified"), "applies_to": F.lit("global"), "section": F.lit("S")})
        return [(r["name_key"], r["severity"], [p["position"] for p in r["positions"]]) for r in conflicts.definition_conflicts(claims.typed(claims.canonical_names(df))).collect()]

    assert found(("d1", "a", "it fails", "exit code is 1"), ("d2", "b", "it fails", "no answer in ten minutes")) == [("task_failure", "BLOCKING", ["exit code is 1", "no answer in ten minutes"])]
    assert found(("d1", "a", "it fails", None), ("d2", "b", "the user gives up", " ")) == [("task_failure", "MATERIAL", ["it fails", "the user gives up"])]
    assert found(("d1", "a", "x y", None), ("d2", "a", "other words", None), ("d3", "b", "x y", None)) == []  # the representatives are of one paper


def test_similar_texts_lose_no_pair(spark):
    rng = random.Random(12)
    words = ["sinusoidal", "learned", "positional", "encoding", "encodings", "wordpiece", "wordpieces", "piece", "mask", "masked", "token", "tokens", "a", "the", "80%", "random", "linear", "cosine", "decay"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(160)} | {"", "  "})
    df = spark.createDataFrame([("s", t) for t in texts], "g string, t string")
    for least in (90.0, 88.0):
        got = {(r["l"], r["r"]) for r in conflicts.similar_texts(df, ["g"], "t", F.array("t"), least).collect()}
        want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if fuzz.token_set_ratio(a, b) >= least}
        assert got == want and len(want) > 50


def test_trace(spark):
    docs = spark.createDataFrame([(1, "p", "s", "Short.\n\nThe dropout rate is set to 0.1 for all.\n\nWe use 4,096 units in the hidden layer."), (2, "q", "s", "Nothing to see here at all, 0.1.")], "doc_id bigint, paper_id string, section string, text string")
    texts = documents.addressed(docs)
    hash_of = lambda t: "sha256:" + __import__("hashlib").sha256(" ".join(t.split()).encode()).hexdigest()
    a, b = "The dropout rate is set to 0.1 for all.", "We use 4,096 units in the hidden layer."
    data = [("ok", "p", "p#s0.p0.0", None, hash_of(a), "0.1"), ("part", "p", "p#s0.p1.3", 12, hash_of(b[3:12]), "4096"), ("warn", "p", "p#s0.p0.0", None, hash_of(a), "0.3"), ("word", "p", "p#s0.p0.4", 999, hash_of(a[4:]), "x"), ("hash", "p", "p#s0.p0.0", None, hash_of(b), "0.1"), ("far", "p", "p#s0.p0.500", None, hash_of(a), "0.1"), ("gone", "p", "p#s0.p7.0", None, hash_of(a), "0.1"), ("foreign", "p", "q#s0.p0.0", None, hash_of(a), "0.1"), ("odd", "p", "p, page 3", None, hash_of(a), "0.1"), ("null", "p", None, None, None, None), ("no", "p", "p#s0.p0.0", None, hash_of(a), "0.1")]
    c = claims.typed(spark.createDataFrame(data, "claim_id string, paper_id string, span_id string, char_end int, quote_hash string, value string").withColumns({"condition": F.lit(None).cast("string"), "value_type": F.lit("float")}))
    verdicts = spark.createDataFrame([(r[0], r[0] != "no") for r in data if r[0] != "word"], "claim_id string, entailed boolean")
    got = {r["claim_id"]: (r["trace_result"], r["trace_reason"]) for r in claims.trace(c, texts, verdicts).collect()}
    gone, differs, untrue = ("fail", "span does not resolve"), ("fail", "text at span differs from recorded hash"), ("fail", "not entailed")
    assert got == {"ok": ("pass", None), "part": ("pass", None), "warn": ("warn", "number not in span"), "word": untrue, "hash": differs, "far": gone, "gone": gone, "foreign": gone, "odd": gone, "null": gone, "no": untrue}
    assert {r["claim_id"]: r["trace_result"] for r in claims.trace(c, texts).collect()}["word"] == "pass"
    assert claims.trace(c, texts.limit(0)).where("trace_result <> 'fail'").isEmpty() and claims.trace(c.limit(0), texts).isEmpty()


def test_anchored_admission(spark):
    p = '{"canonical_name": "lr", "value": 1, "quote": "%s"}'
    cand = spark.createDataFrame([(1, "a", "s", p % "it is  set"), (2, "a", "s", p % "not there"), (3, "b", "s", p % "it is set"), (4, "a", "s", p % "")], "record_id bigint, paper_id string, scope_id string, payload string")
    docs = spark.createDataFrame([(9, "a", "Here it\nis set."), (7, "b", None)], "doc_id bigint, paper_id string, text string")
    got = {r["record_id"]: (r["reject_reason"], r["doc_id"], r["at"]) for r in claims.admit(cand, docs).collect()}
    assert got == {1: (None, 9, 5), 2: ("quote does not appear in the document", None, None), 3: ("quote does not appear in the document", None, None), 4: ("no supporting quote supplied", None, None)}


def test_claim_schema_values_and_citations(spark):
    df = view(spark, [hyper(1, "a", "dropout", "0.1"), hyper(2, "a", "Drop out", "x", kind="odd"), ("r1", "a", "result", "em", "high", "float", None, None, None)]).withColumn("confidence", F.when(F.col("claim_id") == "c2", 1.5).otherwise(F.col("confidence")))
    assert rows(claims.valid_claims(df)) == [("c2", "canonical_name", "pattern"), ("c2", "confidence", "range"), ("c2", "value_type", "enum"), ("r1", "stated_explicitly", "required"), ("r1", "value", "number")]
    v = spark.createDataFrame([("1,024", "int"), ("0.5", "int"), ("true", "int"), ("7", None), ("−3", "float"), ("Adam", "categorical"), (None, "odd")], "value string, value_type string")
    assert [tuple(r) for r in claims.typed_values(v).select("value", "value_type").collect()] == [("1024", "int"), ("0.5", "float"), ("true", "bool"), ("7", "int"), ("-3", "float"), ("Adam", "categorical"), (None, "categorical")]
    q = spark.createDataFrame([("1", "p", "as [MASK] in [known] and [smith2020]"), ("2", "p", "see [smith2020]"), ("3", "p", "[12] none"), ("4", "p", None)], "claim_id string, paper_id string, quote string")
    refs = spark.createDataFrame([("p", "known", "1706.03762"), ("p", "known", None), ("x", "smith2020", "1")], "paper_id string, ref_key string, arxiv_id string")
    assert rows(claims.cited(q, refs)) == [("1", "known", "1706.03762"), ("2", "smith2020", None)]
    f = spark.createDataFrame([("1", ["a"], []), ("2", [], []), ("3", ["a"], ["b"]), ("4", None, None)], "id string, symbols array<string>, undefined array<string>")
    assert [r["symbol_check"] for r in claims.symbol_check(f).orderBy("id").collect()] == ["pass", "fail", "fail", "fail"]


def test_merge_proposals(spark):
    data = [hyper(1, "a", "warm up", "10", unit="steps"), hyper(2, "b", "warmup_length", "3", unit="epochs"), hyper(3, "c", "warmup_phase", "10", unit="steps"), hyper(4, "a", "dropout", "0.1"), hyper(5, "b", "dropout", "0.1"), hyper(6, "a", "warmer", "1")]
    df = view(spark, data)
    cand = align.merge_candidates(df)
    assert rows(cand.select("name_key", "description"))[0] == ("warm_up", "warm up steps (section: S)") and cand.count() == 4
    props = spark.createDataFrame([("hyperparameter", 1, k) for k in ("warm_up", "warmer")] + [("hyperparameter", 2, k) for k in ("warm_up", "warmup_length", "warmup_phase", "dropout")] + [("hyperparameter", 3, k) for k in ("warmup_phase", "warmer")] + [("hyperparameter", None, "warmer")], "type string, proposal int, name_key string")
    merges = align.valid_merges(props, cand)  # the first is of one paper; the third has one free key
    assert rows(merges) == [("hyperparameter", 2, "warm_up"), ("hyperparameter", 2, "warmup_length"), ("hyperparameter", 2, "warmup_phase")]
    assert rows(align.merged_keys(df, merges)) == [("hyperparameter", "warm_up", "warm_up"), ("hyperparameter", "warmup_phase", "warm_up")]  # epochs are no steps
    kids = spark.createDataFrame([("k", "k_1", "c1"), ("k", "k_2", "c3"), ("k", "k_3", "c2")], "cluster_id string, child_id string, claim_id string")
    assert rows(align.merge_identical(kids, df)) == [("k", "k_1", "c1"), ("k", "k_1", "c3"), ("k", "k_3", "c2")]
    named = spark.createDataFrame([("1", None, " Loss "), ("2", " ", None)], "claim_id string, canonical_name string, term string")
    assert [r["name_key"] for r in align.aligned(named).orderBy("claim_id").collect()] == ["loss", "2"]


def test_checks(spark):
    data = [hyper(1, "a", "dropout", "1.7"), hyper(2, "a", "dropout", "1.0"), hyper(3, "a", "lr", "0.5"), hyper(4, "a", "batch_size", "-8"), hyper(5, "a", "batch_size", "large"), hyper(6, "a", "unknown", "5"), hyper(7, "a", "dropout", "0.1")]
    r = {x["claim_id"]: x for x in claims.verify(claims.numeric_check(claims.range_check(view(spark, data)))).collect()}
    assert [r[f"c{i}"]["range_result"] for i in range(1, 8)] == ["fail", "warn", "warn", "fail", "fail", "n/a", "pass"]
    assert r["c1"]["new_status"] == "rejected" and r["c2"]["new_confidence"] == 0.72 and r["c2"]["new_explicit"] is False and r["c7"]["new_confidence"] == 0.9


def test_admission_keeps_the_first(spark):
    p = '{"canonical_name": "LR", "value": %s, "quote": "q", "value_type": "float"}'
    data = [(2, "a", "s", p % "1e-4"), (1, "a", "s", p % "0.0001"), (3, "a", "s", '{"canonical_name": "x", "value": 1}'), (4, "a", "s", "{"), (5, "a", "s", None), (6, "a", "s", '{"canonical_name": "9x", "value": 1, "quote": "q"}')]
    got = {r["record_id"]: r["reject_reason"] for r in claims.admit(spark.createDataFrame(data, "record_id bigint, paper_id string, scope_id string, payload string")).collect()}
    assert got == {1: None, 2: "duplicate", 3: "no supporting quote supplied", 4: "unreadable reply", 5: "unreadable reply", 6: "schema violation: canonical_name"}


def test_judged_fails_closed_and_vote(spark):
    df = view(spark, [hyper(1, "a", "dropout", "0.1"), hyper(2, "a", "dropout", "0.10"), hyper(3, "a", "dropout", "0.2")])
    verdicts = spark.createDataFrame([("c1", True), ("c1", True)], "claim_id string, entailed boolean")
    assert {r["claim_id"]: r["entailed"] for r in claims.judged(df, verdicts).collect()} == {"c1": True, "c2": False, "c3": False}
    v = claims.vote(df.withColumn("pass", F.substring("claim_id", 2, 1).cast("int")), 3)
    assert rows(v.select("claim_id", "self_consistency", "confidence")) == [("c1", "2/3", 0.6), ("c3", "1/3", 0.3)]


# Policy -----------------------------------------------------------------------------------------


def position(i, spec=0.5, stated=True, cond=False, primary=False, year=None, reviewed=False):
    return (f"p{i}", f"paper{i}", "v", spec, stated, cond, primary, year, reviewed)


POSITION = "array<struct<claim_id:string,paper_id:string,position:string,specificity:double,stated_explicitly:boolean,has_condition:boolean,is_primary:boolean,year:int,peer_reviewed:boolean>>"
CASES = [
    ("VALUE_CONFLICT", "MATERIAL", [position(1, cond=True), position(2)], ("prefer_scoped_over_global", "SCOPED", "p1")),
    ("VALUE_CONFLICT", "MATERIAL", [position(1, 0.55), position(2)], (None, "ESCALATED", None)),
    ("VALUE_CONFLICT", "MATERIAL", [position(1, 0.9), position(2)], ("prefer_specific_over_general", "SELECTED", "p1")),
    ("VALUE_CONFLICT", "BLOCKING", [position(1, 0.9), position(2)], ("prefer_specific_over_general", "ESCALATED", None)),
    ("VALUE_CONFLICT", "MATERIAL", [position(1, 0.9, stated=False), position(2)], ("prefer_specific_over_general", "ESCALATED", None)),
    ("VALUE_CONFLICT", "MATERIAL", [position(1, primary=True), position(2, primary=True)], (None, "ESCALATED", None)),
    ("DEFINITION_CONFLICT", "MATERIAL", [position(1, primary=True), position(2)], ("prefer_primary_source", "SELECTED", "p1")),
    ("VALUE_CONFLICT", "MATERIAL", [position(1, year=2017), position(2, year=2026, reviewed=True)], ("prefer_recent_peer_reviewed", "DEFERRED", "p2")),
    ("RESULT_CONFLICT", "MATERIAL", [position(1), position(2)], ("never_auto_resolve_results", "ESCALATED", None)),
    ("VALUE_CONFLICT", "COSMETIC", [position(2), position(1)], ("cosmetic_conflicts_auto_resolve", "SELECTED", "p1")),
    ("METHOD_CONFLICT", "MATERIAL", [position(1), position(2)], ("method_conflicts_escalate", "ESCALATED", None)),
    ("SCOPE_CONFLICT", "MATERIAL", [position(1), position(2)], (None, "ESCALATED", None)),
]


def test_policy(spark):
    df = spark.createDataFrame([(f"{i:02}", t, s, p) for i, (t, s, p, _) in enumerate(CASES)], f"contradiction_id string, conflict_type string, severity string, positions {POSITION}")
    got = policy.resolve(df).orderBy("contradiction_id").collect()
    assert [(r["rule_fired"], r["outcome"], r["selected_claim_id"]) for r in got] == [c[3] for c in CASES]
    with pytest.raises(ValueError):
        policy.resolve(df, [("r", [], "no such", "SELECTED", None, False)])
    up = policy.decided(policy.resolve(df), spark.createDataFrame([("01", "p2")], "contradiction_id string, selected_claim_id string"))
    assert up.where("contradiction_id = '01'").first()["resolved_by"] == "human" and up.count() == len(CASES)


# Gaps and synthesis -----------------------------------------------------------------------------


def test_gaps(spark):
    df = view(spark, [hyper(1, "a", "lr", "1"), hyper(2, "a", "num_epochs", "3"), hyper(3, "b", "vocab_size", "3"), hyper(4, "a", "optimizer", "Adam")])
    got = gaps.gaps(df.withColumn("status", F.when(F.col("claim_id") == "c4", "rejected").otherwise("verified")))
    assert {(r["paper_id"], r["field"]) for r in got.collect()} == {("a", f) for f in ("optimizer", "batch_size", "weight_decay", "warmup_steps", "weight_initialization", "random_seed", "dropout")}


SAME_FIELD = [("warmup_steps", "steps_warmup"), ("learning_rate", "learn_rate"), ("tokenizer_type", "tokenizer"), ("dropout", "dropout_rate"), ("optimizer", "optimiser"), ("init_std_weight", "initialization_weight"), ("weight init", "weight_initialization")]
OTHER_FIELD = [("data_split", "data_order"), ("encoder layers", "decoder layers"), ("max", "min"), ("num_heads", "numerator_heads"), ("", "x"), ("weight learning decay", "weight learning rate")]


def test_same_field_and_its_join(spark):
    pairs = SAME_FIELD + OTHER_FIELD
    df = spark.createDataFrame(pairs, "a string, b string").select(gaps.same_field(F.col("a"), F.col("b")).alias("x"), gaps.same_field(F.col("b"), F.col("a")).alias("y"))
    assert [tuple(r) for r in df.collect()] == [(True, True)] * len(SAME_FIELD) + [(False, False)] * len(OTHER_FIELD)
    # The keys bring together all that mean one field: no pair is lost.
    rng = random.Random(3)
    words = ["optimizer", "optimiser", "init", "initialization", "rate", "rates", "steps", "step", "data", "layer", "later", "num", "weights", "weighta"]
    names = sorted({"_".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)})
    n = spark.createDataFrame([("s", x) for x in names], "g string, field string")
    every = n.select(F.col("field").alias("l")).crossJoin(n.select(F.col("field").alias("r"))).where(gaps.same_field(F.col("l"), F.col("r")))
    assert rows(gaps.matching_fields(n, n, "g").select("l", "r")) == rows(every)


def test_proposed_gaps(spark):
    old = spark.createDataFrame([("a", "g1", "tokenizer", "Which?", "BLOCKING"), ("a", "g2", "seed", "Seed?", "COSMETIC")], "paper_id string, gap_id string, field string, question string, criticality string")
    new = [("a", 1, "Tokenizer Type", "Which subwords? Probably BPE.", None), ("a", 2, "dropout_rate", "Which dropout?", "BLOCKING"), ("a", 3, "data order", "Is it shuffled?", "odd"), ("a", 4, "data_order", "Again?", "BLOCKING"), ("a", 5, "x", "We suggest 5.", "BLOCKING"), ("a", 6, "how", "Which learning rate holds?", "BLOCKING"), ("a", 7, None, "What?", None)]
    p = spark.createDataFrame(new, "paper_id string, rank int, field string, question string, criticality string")
    name = lambda *xs: spark.createDataFrame([("a", x) for x in xs], "paper_id string, field string")
    got = rows(gaps.add_proposed(old, p, name("dropout"), name("learning_rate")).select("field", "question", "criticality", "origin"))
    assert got == [("data_order", "Is it shuffled?", "MATERIAL", "proposed"), ("seed", "Seed?", "COSMETIC", "checklist"), ("tokenizer", "Which subwords?", "BLOCKING", "checklist")]
    assert len(rows(gaps.add_proposed(old, p.limit(0), name("dropout"), name("x")))) == 2


def test_synthesis(spark):
    data = [hyper(1, "a", "dropout", "0.1"), hyper(2, "b", "dropout", "0.10"), hyper(3, "c", "dropout", "0.3"), hyper(4, "a", "odd_thing", "4"), ("r1", "a", "result", "dropout", "0.5", "float", None, None, True)]
    df = view(spark, data)
    res = spark.createDataFrame([("x", "SELECTED", "c1")], "contradiction_id string, outcome string, selected_claim_id string")
    lost = synthesis.superseded(df, res)
    assert rows(lost) == [("c3",)]  # not r1: another kind of claim on the same name
    none = spark.createDataFrame([], "type string, name_key string, cond string")
    comp = synthesis.components(df, none, lost)
    refs = synthesis.component_links(df, none, lost).groupBy("value_id").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), ",").alias("refs"))
    got = comp.join(refs, "value_id").collect()
    assert sorted((r["component_id"], r["name_key"], r["refs"], r["cond"], r["n_refs"], r["n_papers"]) for r in got) == [("cmp_global", "dropout", "c1,c2", "", 2, 2), ("cmp_p_s1", "odd_thing", "c4", "reported in section 'S'", 1, 1)]
    links = spark.createDataFrame([("v", "c1"), ("v", "zz"), ("w", "c2")], "value_id string, claim_id string")
    mixed = df.withColumn("status", F.when(F.col("claim_id") == "c2", "rejected").otherwise("verified"))
    assert rows(synthesis.provenance_closure(links, mixed)) == [(3, 1, 1, 1, 0.3333)]
    assert rows(synthesis.provenance_closure(links.limit(0), df)) == [(0, 0, 0, 0, 1.0)]


def test_gates_in_order(spark):
    some, none = spark.range(1), spark.range(0)
    closure = lambda c: spark.createDataFrame([(2, c)], "total int, closed int")
    assert synthesis.first_problem(some, closure(1), some, some) == "blocking"
    assert synthesis.first_problem(none, closure(1), some, some) == "provenance"
    assert synthesis.first_problem(none, closure(2), some, some) == "cycle"
    assert synthesis.first_problem(none, closure(2), none, some) == "schema"
    assert synthesis.first_problem(none, closure(2), none, none) is None


def test_decisions_conflict_states_and_contribution(spark):
    data = [("m1", "a", "method", "tokenizer", "BPE", "categorical", None, None, True), hyper(1, "a", "dropout", "0.1"), hyper(2, "b", "dropout", "0.2")]
    df = view(spark, data)
    d = synthesis.design_decisions(df)
    assert rows(d) == [("cmp_global", "tokenizer", "BPE", True, "m1")]
    earlier = df.withColumn("attribution", F.lit("prior_work"))
    assert rows(synthesis.design_decisions(earlier)) == []
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    assert rows(synthesis.contribution(papers, df)) == [("a", 2), ("b", 1), ("c", 0)]
    assert rows(synthesis.contributing_papers(papers, df)) == [("a",), ("b",)]
    con = spark.createDataFrame([("1", "BLOCKING"), ("2", "MATERIAL"), ("3", "MATERIAL"), ("4", "COSMETIC")], "contradiction_id string, severity string")
    res = spark.createDataFrame([("2", "SELECTED"), ("3", "DEFERRED")], "contradiction_id string, outcome string")
    assert rows(synthesis.split_conflicts(con, res).select("contradiction_id", "state")) == [("1", "blocking"), ("2", "resolved"), ("3", "open")]


# Documents, operations --------------------------------------------------------------------------


def test_find_spans_and_packing(spark):
    t = spark.createDataFrame([(1, "p", "xx one two three four five six seven eight"), (2, "p", "one two\nthree four five six seven eight"), (3, "q", "short text"), (4, "q", None)], "doc_id bigint, paper_id string, text string")
    n = spark.createDataFrame([("a", "p", "one  two three four five six seven"), ("b", "q", "ort te"), ("c", "q", "none"), ("d", "q", ""), ("e", "q", None)], "nid string, paper_id string, needle string")
    assert rows(documents.find_spans(n, t, "paper_id", "nid", "doc_id")) == [("a", 1, 3), ("b", 3, 2)]
    docs = spark.createDataFrame([("p", i, "s", "x" * k) for i, k in enumerate((500, 400, 2000, 10, 900, 90))] + [("q", 9, None, None)], "paper_id string, doc_id bigint, section string, text string")
    assert [r["batch"] for r in documents.pack(docs, budget=1000).orderBy("paper_id", "doc_id").collect()] == [0, 0, 1, 2, 2, 3, 0]


def test_packing_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(documents, "PIECE", 7)
    rng = random.Random(4)
    data = [(p, i, "", "x" * rng.choice([0, 10, 300, 700, 2000])) for p in "ab" for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "paper_id string, doc_id bigint, section string, text string")
    want, state = [], {}
    for p, i, _, t in data:
        size = len(t) + 8
        batch, used = state.get(p, (0, 0))
        batch, used = (batch + 1, size) if used and used + size > 1000 else (batch, used + size)
        state[p] = batch, used
        want.append((p, i, size, batch))
    assert rows(documents.pack(df, budget=1000)) == sorted(want, key=repr)
    numbered = documents.in_order(df.select("paper_id", "doc_id"), "paper_id", "doc_id", "k")
    assert rows(numbered.select("paper_id", "doc_id", "k")) == sorted(((p, i, [x for q, x, *_ in data if q == p].index(i)) for p, i, *_ in data), key=repr)
    assert rows(documents.pack(df.limit(0))) == []


def test_find_spans_in_blocks(spark, monkeypatch):
    t = spark.createDataFrame([(3, "p", "aa  bb\ncc"), (1, "p", " x aa bb"), (2, "q", "aa bb"), (4, None, "aa bb")], "doc_id bigint, paper_id string, text string")
    n = spark.createDataFrame([(1, "p", "aa bb"), (2, "p", "bb cc"), (3, "q", "b"), (4, "q", "cc"), (5, None, "aa"), (1, "p", "aa bb")], "nid int, paper_id string, needle string")
    want = [(1, 1, 3), (2, 3, 4), (3, 2, 3)]
    assert rows(documents.find_spans(n, t, "paper_id", "nid", "doc_id")) == want
    monkeypatch.setattr(documents, "NEEDLE_BYTES", 6)
    assert rows(documents.find_spans(n, t, "paper_id", "nid", "doc_id")) == want
    assert rows(documents.find_spans(n.limit(0), t, "paper_id", "nid", "doc_id")) == rows(documents.find_spans(n, t.limit(0), "paper_id", "nid", "doc_id")) == []


def test_rounds_that_run_out_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError):
        align.connected_components(chain, most_rounds=1)
    with pytest.raises(RuntimeError):
        synthesis.cycle_members(chain.withColumnsRenamed({"a": "source", "b": "target"}), most_rounds=2)
    ring = spark.createDataFrame([("d", "b"), ("b", "c"), ("c", "d"), ("a", "b"), ("c", "x")], "source string, target string")
    assert synthesis.cycle_path(ring) == ["b", "c", "d"] and synthesis.cycle_path(ring.where("source = 'a'")) == []


def test_blocked_providers_and_lost_batches(spark):
    led = spark.createDataFrame([("2024-01-01 10:00:00", "a", True, 90), ("2024-01-01 11:00:00", "b", True, None), ("2024-01-01 12:00:00", "c", False, None)], "ts string, provider string, refused boolean, retry_after int").withColumn("ts", F.to_timestamp("ts"))
    assert [(p, str(t)) for p, t in rows(operations.blocked_until(led))] == [("a", "2024-01-01 10:01:30"), ("b", "2024-01-02 00:00:00")]
    runs = spark.createDataFrame([("p", "m", 5, 10, 2, 1), ("p", "m", 5, 10, 2, 2), ("q", "m", 0, 0, 0, 0)], "paper_id string, kind string, read_chars int, all_chars int, batches int, batches_ok int")
    assert rows(operations.lost_batches(runs)) == [("p", "m", 0.5, 1), ("q", "m", None, 0)]


def test_resolution_changes(spark):
    v = spark.createDataFrame([("s", 1, "r1"), ("s", 2, "r1"), ("s", 2, "r2"), ("s", 4, "r2"), ("s", 5, None), ("t", 1, "r9")], "spec_id string, snapshot_no int, resolved_from string")
    got = snapshots.resolution_changes(v)
    assert rows(got) == [("s", 2, "resolution_added", "r2"), ("s", 4, "resolution_withdrawn", "r1"), ("s", 5, "resolution_withdrawn", "r2")]
    assert rows(snapshots.change_summary(got)) == [("s", 2, 1, 0), ("s", 4, 1, 1), ("s", 5, 1, 1)]


def test_operations(spark):
    led = spark.createDataFrame([("2024-01-01 10:00:00", "a", False)] * 9 + [("2024-01-01 11:00:00", "b", False), ("2024-01-01 12:00:00", "b", True)], "ts string, provider string, cached boolean").withColumn("ts", F.to_timestamp("ts"))
    q = operations.quota_headroom(led, spark.createDataFrame([("a", 10)], "provider string, daily_limit int"))
    assert sorted((r["provider"], r["requests"], r["headroom"], r["exhausted"]) for r in q.collect()) == [("a", 9, 0, True), ("b", 1, None, None)]
