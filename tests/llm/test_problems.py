"""Each text operator on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import json
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specweave.llm import copies, leakage, lookform, namelist, subjects, tokenize


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Problem 1 --------------------------------------------------------------------------------------


def slow_form(t):
    look = {a: b for g in lookform.LOOK_ALIKES.values() for a, b in g.items()}
    out = ""
    for ch in t:
        cat, d = unicodedata.category(ch), unicodedata.decomposition(ch)
        if ch in lookform.BLANKS or cat == "Zs":
            out += " "
        elif ch in lookform.UNSEEN or cat in ("Cf", "Cc"):
            continue
        elif d.startswith(("<wide>", "<narrow>", "<font>")) or d.startswith("<compat>") and (0xFB00 <= ord(ch) < 0xFB50 or 0x2160 <= ord(ch) < 0x2180 or 0x132 <= ord(ch) < 0x1F4):
            out += unicodedata.normalize("NFKC", ch)
        else:
            out += ch
    return unicodedata.normalize("NFC", "".join(look.get(x, x) for x in unicodedata.normalize("NFD", out)))


def test_one_form_is_that_of_the_slow_way():
    rng = random.Random(4)
    letters = "aeoAΑеё ñṇ゙̃́̂̈て​ﬃﾊﾟÅÅệ한한각하₂³–-№\xa0　ｅＡ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "plain", "x" * 100_000 + "é"]
    assert lookform.one_form(pa.array(texts)).to_pylist() == [slow_form(t) for t in texts]
    assert lookform.one_form(pa.array([None, "ａ", None])).to_pylist() == [None, "a", None]


def test_look_alikes_stated_here():
    """Pairs that look the same and pairs that do not, stated without the operator's tables."""
    same = ["аpple apple", "сосоа cocoa", "ΑΒΕ ABE", "Оrder Order", "ρure pure", "ﬁle file", "ĳs ijs", "Ⅳ IV", "ⅼist list", "ｆｕｌｌ full", "𝐚𝐛 ab", "ℎello hello", "Ꭺlpha Alpha", "Օ O", "e\u0301 é", "x\u200by xy", "a\u00a0b|a b", "a\u3000b|a b", "ѵ v", "к κ", "ﾊﾟ パ", "Å Å", "Ꮃord Word", "Ⲟn On"]
    apart = ["A a", "é e", "x² x2", "H₂ H2", "a–b a-b", "a—b a–b", "a.b ab", "к k", "№ No", "a  b|a b", "Ⅳ iv", "γ y", "τ t", "ß ss", "“a” \"a\""]
    for pairs, want in ((same, True), (apart, False)):
        for p in pairs:
            a, b = p.split("|") if "|" in p else p.split(" ")
            x, y = lookform.one_form(pa.array([a, b])).to_pylist()
            assert (x == y) == want, p


def test_look_classes(spark):
    data = [("a", "s", "fine"), ("b", "s", "ﬁne"), ("c", "s", "fine"), ("c", "s", "fine"), ("d", "t", "fine"), ("e", "s", None), ("f", "s", ""), ("g", None, "x"), ("h", None, "ｘ"), ("i", "s", "fi\u200bne")]
    df = spark.createDataFrame(data, "id string, scope string, txt string")
    assert rows(lookform.look_classes(df, "id", "txt", ["scope"])) == [("a", "a", 3, 4, 2), ("b", "a", 3, 4, 3), ("c", "a", 3, 4, 2), ("g", "g", 2, 2, 1), ("h", "g", 2, 2, 1), ("i", "a", 3, 4, 3)]
    hot = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("scope"), F.when(F.col("id") == 7, "ａ").otherwise("a").alias("txt"))
    got = lookform.look_classes(hot, "id", "txt", ["scope"])
    assert got.count() == 4000 and got.agg(F.sum("n_links")).first()[0] == 2 * 3999
    assert rows(lookform.look_classes(df.limit(0), "id", "txt", ["scope"])) == []


def test_equal_looking(spark):
    data = [("a", "s", "fine", 1), ("b", "s", "ﬁne", 1), ("c", "s", "fine", 1), ("c", "s", "fine", 1), ("d", "t", "fine", 1), ("e", "s", None, 1), ("f", "s", "", 1), ("g", "s", "​", 1), ("h", "s", "Fine", 1), ("i", "s", "fi​ne", 1)]
    df = spark.createDataFrame(data, "id string, scope string, txt string, form int")
    assert rows(lookform.equal_looking(df, "id", "txt", ["scope"])) == [("a", "b"), ("a", "i"), ("b", "c"), ("b", "i"), ("c", "i")]
    assert rows(lookform.equal_looking(df.limit(0), "id", "txt", ["scope"])) == []


# Problem 3 --------------------------------------------------------------------------------------


def test_copies(spark):
    base = {"canonical_name": "batch_size", "value": 2644, "unit": None, "quote": "Set to 2,644 – naïve.", "ok": True}
    same = [json.dumps(base), json.dumps(dict(reversed(base.items())), indent=2), json.dumps({"CANONICAL-NAME": " Batch_Size ", "value": "2,644", "quote": "SET TO 2644 NAÏVE!", "ok": "true"}, ensure_ascii=False), json.dumps(base).replace("ï", "\\u00ef")]
    other = [json.dumps({**base, "value": x}) for x in (-2644, 26.44, "1e-4", "1e4", 26440)] + [json.dumps({**base, "unit": "steps"})]
    unreadable = [same[0][:-9], None, "", "[1]", "null"]
    long = [json.dumps({"q": "Word. " * 20_000}), json.dumps({"q": "word " * 20_000})]
    data = [(i, "s", p, "x") for i, p in enumerate([*same, *other, *unreadable, *long])] + [(100, "t", same[0], "x"), (101, None, same[0], "x"), (102, None, same[1], "x")]
    df = spark.createDataFrame(data, "record_id bigint, scope_id string, payload string, members string")
    n = len(same) + len(other) + len(unreadable)
    assert rows(copies.copies(df)) == [(0, 1), (0, 2), (0, 3), (n, n + 1), (101, 102)]
    counts = {r["record_id"]: r["n_copies"] for r in copies.distinct_records(df).collect()}
    assert counts[0] == 4 and counts[4] == 1 and counts[n] == 2 and len(counts) == 10
    assert rows(copies.copies(df.limit(0))) == []


def alike(texts):
    """For each text the texts that read the same; hashes and pointers must agree."""
    import numpy as np

    f = copies.Folded(pa.array(texts))
    h, n = f.hashes(), len(texts)
    every = np.arange(n)
    out = []
    for i in range(n):
        same = copies.same_records(f, np.full(n, i), f, every)
        assert (same == ((h[0] == h[0][i]) & (h[1] == h[1][i]))).all()
        out.append({texts[j] for j in every[same]})
    return out


def test_signs_of_numbers():
    v = lambda *xs: [json.dumps({"v": x}, ensure_ascii=False) for x in xs]
    for group in (v("- 5", -5, "−  5", " -5", "-\"5\""), v("5", "+5", "+ 5", "(5)"), v("-.5", "- .5"), v("0.5", "+0.5"), v("- 0.5", "−0.5"), v("set to -5", "Set to:  −5"), v("set to 5", "set to - 5", "Set to – 5"), v("covid-19", "covid 19"), v("1e-4", "1E-4"), v("1e4", "1e+4"), v("3+5"), v("35", "3-5"), ['{"v": null}', "{}", '{"v": "-"}']):
        assert alike(group)[0] == set(group), group
    apart = v("- 5", "5", "-.5", "0.5", "- 0.5", "set to -5", "set to 5", "1e-4", "1e4", "3+5", "35")
    assert all(len(x) == 1 for x in alike(apart))


def test_letter_case_that_takes_several_letters():
    v = lambda *xs: [json.dumps({"v": x}, ensure_ascii=False) for x in xs]
    for group in (v("STRASSE", "straße", "Straſſe", "STRAẞE"), v("ΟΔΟΣ", "οδος", "Οδοσ"), v("ﬃ", "FFI")):
        assert alike(group)[0] == set(group)
    assert all(len(x) == 1 for x in alike(v("strase", "straße", "οδο", "οδος")))


def slow_record(text):
    """The record as a sorted list of folded fields, made character by character."""
    out = []
    for k, x in json.loads(text).items():
        fold = lambda t: "".join(c for c in t.casefold() if unicodedata.category(c)[0] not in "PZC")
        if x not in (None, "") and fold(str(x)):
            out.append((fold(k), fold(str(x))))
    return sorted(out)


def test_two_pointers_equal_the_plain_way():
    rng = random.Random(8)
    words = ["ab", "AB", "Straße", "strasse", "οδός", "ΟΔΌΣ", "12", "x,y", "", " ", "É", "é", "漢字", "long " * 40]
    texts = []
    for _ in range(120):
        fields = [(rng.choice(["A", "a", "b_c", "B c", "d"]), rng.choice(["", " ", ". "]).join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(0, 3))]
        fields = list({slow_record(json.dumps({k: "x"}))[0][0]: (k, x) for k, x in fields}.values())
        rng.shuffle(fields)
        texts.append(json.dumps(dict(fields), ensure_ascii=rng.random() < 0.5))
    texts = sorted(set(texts))
    assert alike(texts) == [{t for t in texts if slow_record(t) == slow_record(x)} for x in texts]


def test_copies_of_a_hot_group_and_nested_records(spark):
    df = spark.range(3000).select(F.col("id").alias("record_id"), F.lit("s").alias("scope_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"a": "x", "n": '), F.col("id"), F.lit("}"))).otherwise(F.lit('{"b": {"k": [1, 2]},  "a": "Y."}')).alias("payload"))
    found = copies.copies(df).collect()
    assert len(found) == 1999 and {r[0] for r in found} == {1}


def test_colliding_hashes_are_told_apart():
    texts = ['{"a": "x"}', '{"a": "y"}', '{"a":"X."}']
    folded = copies.Folded(pa.array(texts))
    import numpy as np

    assert copies.same_records(folded, np.array([0, 0]), folded, np.array([1, 2])).tolist() == [False, True]
    batch = pa.RecordBatch.from_arrays([pa.array(["s"] * 3), pa.array([7] * 3), pa.array([7] * 3), pa.array([1, 2, 3]), pa.array([[], [], []], pa.list_(pa.int64())), pa.array(texts)], ["scope", "h1", "h2", "id", "members", "payload"])
    out = pa.Table.from_batches(list(copies._unite(iter([batch.slice(0, 1), batch.slice(1)]), "id")))
    assert out.column("rep").to_pylist() == [1, 2, 1]


# Problem 4 --------------------------------------------------------------------------------------

LIST = [(1, "learning_rate", ["lr", "eta"]), (2, "weight_decay", ["wd"]), (3, "warmup_ratio", []), (4, "fallback_escalation", None), (5, "hidden_dim", ["d_model"]), (6, None, None)]
TYPED = {"Learning Rate": 1, "rate.learnng": 1, "LR": 1, "24) the learningrate (Tab. 3)": 1, "cfg.lr = 3": 1, "learn_rate": 1, "learning_ratio": 0, "weihgtDecays*": 2, "decayweight": 2, "ROLLBACK_ESCALATION": 0, "D Model": 5, "model_d": 5, "learning_lantern": 0, "rate": 0, "": 0, "???": 0, "n/a": 0, "dim-hdiden, p. 4": 5, "warmup ratio setting": 3}


def test_names(spark):
    entries = spark.createDataFrame(LIST, "name_id bigint, canonical_name string, aliases array<string>")
    names = spark.createDataFrame([(n,) for n in TYPED], "name string")
    assert {r["name"]: r["name_id"] for r in namelist.match_names(names, entries).collect()} == TYPED
    data = [("a", "learning_rate", 9), ("b", "LR", 9), ("b", "LR", 9), ("c", None, 9), ("d", "lantern", 9)]
    df = spark.createDataFrame(data, "id string, typed string, score int")
    assert rows(namelist.map_names(df, entries, F.col("typed")).select("id", "name_id")) == [("b", 1), ("b", 1), ("c", 0), ("d", 0)]
    assert rows(namelist.map_names(df.limit(0), entries, F.col("typed"))) == []
    assert {r["name_id"] for r in namelist.map_names(df, entries.limit(0), F.col("typed")).collect()} == {0}


# Problem 6 --------------------------------------------------------------------------------------


def test_token_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(f"{tokenize.DEFAULT_DIR}/{tokenize.DEFAULT_VOCAB}.json")
    whole.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", "Naïve tuning of 漢字 🙂  \n\n x", "<|endoftext|>", "a" * 5000, " " * 700 + "b", "\x00\x01"] + ["".join(rng.choice(rng.choice(["ab", "etaoin shrdlu", "é漢🙂 a", "==--__", "0123 "])) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        assert tokenize.encode_text(t) == whole.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts[:6], None])] + [(1, texts[1], 0)], "doc_id bigint, text string, ids int")
    got = tokenize.token_ids(df).collect()
    assert len(got) == 8 and {r["doc_id"]: r["ids"] for r in got}[6] == [] and [r["ids"] for r in got if r["doc_id"] == 1] == [tokenize.encode_text(texts[1])] * 2
    assert tokenize.token_ids(df.limit(0)).collect() == []


# Problem 7 --------------------------------------------------------------------------------------


def slow_leaks(docs, items):
    words = lambda t: [w.casefold() for w in re.findall(r"[^\W_]+", t or "")]
    out = set()
    for j, item in items:
        w = words(item)
        n = min(13, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for i, doc in docs:
            d = words(doc)
            if n and any(tuple(d[k : k + n]) in grams for k in range(len(d) - n + 1)):
                out.add((i, j))
    return sorted(out)


def test_leaks(spark):
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "γάμμα", "ΟΔΟΣ", "οδος", "4", "x9", "straße", "STRASSE", "de"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(40)), (2, text(20)), (3, "Alpha beta"), (4, "One"), (5, None), (6, " .. "), (7, text(13)), (8, text(12))]
    cut_out = lambda t, a, n: " ".join(t.split()[a : a + n])
    docs = [(10, text(30) + " " + cut_out(items[0][1], 7, 13).upper().replace(" ", "\n– ") + " " + text(5)), (11, text(9) + " " + cut_out(items[0][1], 3, 12)), (12, None), (13, ""), (14, "one"), (15, items[7][1] + "!"), (16, text(30_000)), (17, items[1][1] + items[6][1]), (18, "alpha"), (19, "beta gone")]
    d = spark.createDataFrame([(*x, 1) for x in docs + docs[:1]], "doc_id bigint, text string, sig int").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, passage int")
    assert rows(leakage.leaks(d, i)) == slow_leaks(docs, items)
    assert rows(leakage.leaks(d.limit(0), i)) == [] and rows(leakage.leaks(d, i.limit(0))) == []


def test_leaks_by_shuffled_passages(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", 0)
    docs, items = [(1, "one two " * 40), (2, "two"), (3, None)], [(7, "One, two"), (8, "two one " * 9)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(leakage.leaks(d, i)) == slow_leaks(docs, items) == [(1, 7), (1, 8)]


def test_bloom_has_no_false_negative():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    bloom = leakage.Bloom(5000)
    bloom.add(keys)
    assert bloom.has(keys).size == 5000 and bloom.has(keys ^ np.uint64(12345)).size < 100


# Problem 8 --------------------------------------------------------------------------------------


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(6)
    topics = {"music": ["violin", "sonata", "orchestra", "rhythm", "chord"], "food": ["soup", "oven", "recipe", "flour", "kitchen"]}
    plain = ["We report all of the numbers in table %d.", "The run was repeated with %d seeds as before.", "See the appendix for the full list of %d settings."]
    docs, truth, labels = [], {}, []
    for i in range(160):
        mine = rng.sample(sorted(topics), rng.choice([0, 1, 1, 2]))
        sents = [rng.choice(plain) % rng.randint(2, 99) for _ in range(6)]
        for t in mine:
            sents += ["We compare the {} with the {} in this part.".format(*rng.sample(topics[t], 2)) for _ in range(4)]
        if (aside := rng.choice(sorted(topics))) not in mine:
            sents.append(f"One reader likened all this to a {rng.choice(topics[aside])} for fun.")
        rng.shuffle(sents)
        docs.append((i, " ".join(sents), "z"))
        truth[i] = set(mine)
        if i < 110:
            labels += [(i, t) for t in mine] or [(i, None)]
    docs += [(900, None, "z"), (901, "", "z"), (902, "...", "z"), (903, "word " * 50_000, "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    lab = spark.createDataFrame([*labels, labels[0], (5000, "food"), (1, "no such")], "doc_id bigint, subject string")
    sub = spark.createDataFrame([("music",), ("food",), (None,)], "subject string")
    got = {(r[0], r[1]) for r in subjects.document_subjects(d, lab, sub).collect()}
    want = {(i, t) for i in range(110, 160) for t in truth[i]}
    held = {x for x in got if 110 <= x[0] < 160}
    assert len(held & want) >= 0.85 * max(len(held), len(want))
    assert not any(x[0] >= 900 for x in got)
    assert subjects.document_subjects(d, lab, sub.limit(0)).collect() == []
