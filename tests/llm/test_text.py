"""Classifiers, mixing, URL rules, token counts, decontamination and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symbolith.llm import decontaminate, mixing, quality, queries, token_counts, toxicity, url_filter

TEXT = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y"), (4, "é" * 70_000)]


def shout(df):
    return df.withColumns({c: F.lit("x") for c in ("score", "predicted", "held_out", "size", "target", "_u", "_id")})


# --- Classifiers ---


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_quality_learns_and_scores_whole_texts():
    rng = random.Random(1)
    rows = [(prose(rng, rng.randint(5, 200)), 1) for _ in range(150)] + [(prose(rng, 150) + " " + prose(rng, 20).replace(" ", "$$$ "), 0) for _ in range(150)]
    model = quality.fit(rows[:120] + rows[150:270])
    held = rows[120:150] + rows[270:]
    buf = np.frombuffer("".join(t for t, _ in held).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t, _ in held])))
    s = quality.score(model, buf, off)
    assert np.mean((s >= 0.5) == np.array([y for _, y in held])) >= 0.9
    # the same text in parts and in one go
    long = (prose(rng, 120_000)).encode()
    whole = quality.responses(model, quality.padded(np.frombuffer(long, np.uint8), np.array([0, len(long)]))[0])
    got = quality.pooled(model, np.frombuffer(long, np.uint8), np.array([0, len(long)]))
    assert len(long) > 2 * quality.PIECE
    assert np.allclose(got[0], np.maximum(whole[: quality.chunk_counts(np.array([len(long)]))[0]].max(0) + model["bias"], 0), atol=1e-4)


def test_toxicity_learns():
    rng = random.Random(2)
    bad = ["blarg", "zonk", "fribble"]
    rows = [(prose(rng, rng.randint(20, 80)), 0) for _ in range(200)]
    rows += [(" ".join(w if rng.random() > 0.1 else rng.choice(bad) for w in prose(rng, 60).split()), 1) for _ in range(200)]
    rng.shuffle(rows)
    model = toxicity.fit(rows[:300])
    buf, off = toxicity._join([t.encode() for t, _ in rows[300:]])
    s = toxicity.score(model, buf, off)
    assert np.mean((s >= 0.5) == np.array([y for _, y in rows[300:]])) >= 0.95
    buf, off = toxicity._join([b"bl4rg and z0nk you z0nk", b"nothing here"])
    a, b = toxicity.features(buf, off, model["lexicon"], model["you"])[:, toxicity.NAMES.index("hidden_hits")]
    assert a >= 1 and b == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    xs, ys = toxicity.isotonic(x, (x + rng.normal(size=300) > 0).astype(float), rng.uniform(0.5, 2, 300))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 <= ys.min() <= ys.max() <= 1


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_odd(spark, op, label):
    docs = shout(spark.createDataFrame(ODD, TEXT))
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = op.train(docs, none)  # nothing usable: constant
    rows = op.classify(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    rng = random.Random(3)
    model = op.fit([(prose(rng, 30), 1) for _ in range(30)] + [(prose(rng, 30).upper() + "!!", 0) for _ in range(30)])
    rows = op.classify(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert op.classify(docs.limit(0), model).count() == 0


def test_training_leaves_the_held_out_fold_alone(spark):
    import zlib

    from symbolith.llm.sampling import labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], TEXT)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 4, 2, per_class=30)
    ids = [int(t[1:]) for t, _ in got]
    assert len(got) == 60 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids) and all(y == i % 2 for i, (_, y) in zip(ids, got))


def test_training_skips_long_texts_only(spark):
    from symbolith.llm.sampling import balance, labelled_sample

    docs = spark.createDataFrame([(i, "x" * (200 if i % 10 else 20_000)) for i in range(100)], TEXT)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 5, 0, text_bytes=1000)
    assert 60 < len(got) and {len(t) for t, _ in got} == {200} and {y for _, y in got} == {0, 1}
    w = balance([1, 0, 0, 0])
    assert w[0] == sum(w[1:]) == 2


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    """Area under the ROC curve over the fold that isn't learned from, and the contract's columns."""
    import zlib
    from pathlib import Path

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    rows = queries.QUERIES[name](spark, sf).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    folds, out, cut = (4, 2, 0.7) if label == "quality" else (5, 0, 0.5)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) and r["predicted"] == int(r["score"] >= cut)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and good and bad
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= least


# --- Mixing ---


def filled_by_brute_force(sizes, weights, budget, cap):
    """Targets by bisection of the level at which all is used up, a second way to the same numbers."""
    used = lambda level: sum(min(weights[s] * level, cap * sizes[s]) for s in sizes)
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if used(mid) < budget else (low, mid)
    return {s: min(weights[s] * high, cap * sizes[s]) for s in sizes}


@pytest.mark.parametrize("sizes,budget", [({"a": 10, "b": 100, "c": 100}, 210), ({"a": 1, "b": 1, "c": 100}, 102), ({}, 0), ({"a": 0}, 0), ({c: 7 * k + 1 for k, c in enumerate("abcdefghijkl")}, 474)])
def test_water_filling(spark, sizes, budget):
    cycle = dict(zip(sorted(sizes), [5.0, 2.0, 1.0] * 9))
    rows = mixing.cyclic_weights(spark.createDataFrame(list(sizes.items()), "_source string, source_size long"))
    got = {r["_source"]: r for r in mixing.water_fill(rows, budget, 3).collect()}
    want = filled_by_brute_force(sizes, cycle, budget, 3)
    assert {s: r["weight"] for s, r in got.items()} == cycle
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 * (1 + budget) for s in sizes) and len(got) == len(sizes)


def test_any_number_of_sources_is_numbered(spark):
    names = [f"s{k}é"[:: 1 if k % 2 else -1] for k in range(500)] + [None, ""]
    rows = mixing.numbered(spark.createDataFrame([(n, 1) for n in names], "_source string, source_size long").repartition(7)).collect()
    want = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert [r["_source"] for r in sorted(rows, key=lambda r: r["_rank"])] == want


def mixed_rows(kind):
    rng = random.Random(4)
    if kind == "plain":
        return [(i, prose(rng, rng.randint(0, 40)) if i % 9 else None, rng.choice(["b", "a", "a", "é", None])) for i in range(400)]
    rows = [(1, "one two three four five six seven eight", "a")] * 1000 + [(2, prose(rng, 10), "b")] * 137  # a lot is cut
    return rows + [(rng.choice([None, 3, 4]), prose(rng, rng.randint(1, 30)), rng.choice(["b", "c", None])) for _ in range(300)] + [(5, "é " * 30_000, "d")]


@pytest.mark.parametrize("kind", ["plain", "repeated and null ids"])
def test_mixing(spark, kind):
    rows = mixed_rows(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(shout(df)).collect()
    again = mixing.plan(shout(df.repartition(3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = filled_by_brute_force({s: sizes[s] for s in order}, dict(zip(order, [5, 2, 1] * 9)), sum(sizes.values()), 3)
    taken, longest = dict.fromkeys(sizes, 0), {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    for r in got:
        assert r["source_size"] == sizes[r["_source"]] and abs(r["target"] - want[r["_source"]]) < 1e-3
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["_source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-3 for s in sizes)
    mixed = mixing.mix(shout(df))
    assert mixed.columns == [*shout(df).columns, "epoch"]
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert words == {s: n for s, n in taken.items() if n}
    per_row = lambda rs: sorted((str(i), n) for i, n in rs)
    if kind == "plain":
        assert per_row((r["doc_id"], r["count"]) for r in mixed.groupBy("doc_id").count().collect()) == per_row((r["_id"], r["_epochs"]) for r in got if r["taken"])
    assert mixing.plan(df.limit(0)).count() == 0 == mixing.mix(df.limit(0)).count()


# --- URL rules ---


def judged_by_brute_force(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xample.com", "net", "x.net", ""]
    paths = ["", "/", "/en/", "/en/7", "/de", "/en/77/8"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.5}.values())
    urls = [None, "", "nothing", "HTTP://A.Example.COM/en/7?q#x", "x://", "a://h?x/y", "://example.com/en/7"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/b', '#c'])}" for _ in range(300)]
    pages = shout(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: judged_by_brute_force(u, rules) for i, u in enumerate(urls)}
    no_rules = spark.createDataFrame([], "host string, path string, action string")
    assert {r["verdict"] for r in url_filter.judge(pages, no_rules, default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), no_rules).count() == 0
    twice = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, action string")
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string"), twice).first()["verdict"] == "block"


# --- Token counts ---


@pytest.fixture(scope="module")
def shared(spark):
    pytest.importorskip("public_tokenizers")
    return token_counts.load(spark)


def test_trees_equal_whole_encoding(shared):
    count, rng, bad = token_counts.counter(shared), random.Random(6), 0
    for k in range(300):
        data = "".join(rng.choice(["ab", "c", " ", "1", "\n", ".", "'s", "é", "  ", "Word"]) for _ in range(rng.randint(0, 80))).encode()
        t = token_counts.Tree.build(data, count, leaf=rng.choice([4, 16]))
        assert t.total == count(data)
        for _ in range(2):
            s = data.decode()
            at = sorted(rng.sample(range(len(s) + 1), min(len(s) + 1, 2 * rng.randint(0, 3))))
            at = [len(s[:x].encode()) for x in at[: len(at) // 2 * 2]]
            edits = [(a, b, rng.choice(["", "x", " ", "\n", " 12"]).encode()) for a, b in zip(at[::2], at[1::2])]
            want, last = b"", 0
            for a, b, new in edits:
                want, last = want + data[last:a] + new, b
            want += data[last:]
            data, _ = t.edit(data, edits, count)
            assert data == want and t.total == count(want)


def test_edit_touches_only_its_leaves(shared):
    count = token_counts.counter(shared)
    data = b"some words in a row " * 2000
    t = token_counts.Tree.build(data, count)
    new, encoded = t.edit(data, [(20_000, 20_004, b"other")], count)
    assert t.total == count(new) and encoded < 3 * token_counts.LEAF
    with pytest.raises(ValueError):
        t.edit(new, [(5, 9, b""), (8, 10, b"")], count)


def test_token_tables(spark, shared):
    docs = spark.createDataFrame([(1, "call 555 1234 now"), (2, ""), (3, None)], TEXT)
    count = token_counts.counter(shared)
    rows = {r["doc_id"]: r for r in token_counts.counts(docs, shared).collect()}
    assert rows[1]["n_edits"] == 2 and rows[1]["n_tokens_edited"] == count(b"call 0 0 now") and rows[3]["n_tokens"] == 0
    edits = spark.createDataFrame([(1, 0, 4, "ring"), (9, 0, 1, "x")], "doc_id long, start int, end int, replacement string")
    out = {r["doc_id"]: r for r in token_counts.apply_edits(docs, token_counts.trees(docs, shared), edits, shared).collect()}
    assert out[1]["text"] == "ring 555 1234 now" and out[1]["n_tokens_edited"] == count(b"ring 555 1234 now") and out[2]["n_edits"] == 0
    assert token_counts.counts(docs.limit(0), shared).count() == 0
    twice = spark.createDataFrame([(None, "ab cd"), (None, "xy zw"), (4, "same"), (4, "same"), (5, "one two"), (5, "six ten")], TEXT)
    edits = spark.createDataFrame([(5, 0, 3, "0")], "doc_id long, start int, end int, replacement string")
    kept = token_counts.trees(shout(twice), shared)
    out = token_counts.apply_edits(shout(twice), kept, edits, shared).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("None", "ab cd"), ("None", "xy zw"), ("4", "same"), ("4", "same"), ("5", "0 two"), ("5", "0 ten")])
    assert all(r["n_tokens_edited"] == count(r["text"].encode()) for r in out)


def test_token_query_equals_whole_encoding(spark, shared):
    """Each count of the query against tiktoken on whole texts."""
    import re
    from pathlib import Path

    import tiktoken

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    pattern, ranks = shared.value
    own = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries.op5_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        t, r = d["text"] or "", got[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(own.encode_ordinary(t)))
        assert r["n_tokens_edited"] == len(own.encode_ordinary(re.sub("[0-9]+", "0", t))) and r["n_edits"] == len(re.findall("[0-9]+", t))


# --- Decontamination ---


def test_wand_equals_all_scores(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words[: 10 + i % 40]) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    ix = decontaminate.Index([(i, t, *decontaminate.split_item(t)) for i, t in items])
    for _ in range(150):
        terms = rng.sample(range(len(ix.terms)), rng.randint(1, 25))
        full = np.zeros(len(ix.ids))
        for t in terms:
            np.add.at(full, ix.item[ix.first[t] : ix.first[t + 1]], ix.weight[ix.first[t] : ix.first[t + 1]])
        got = dict(decontaminate.wand(ix, terms))
        assert set(got) == set(np.flatnonzero(full >= ix.threshold - 1e-9).tolist())


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(12, 40)) + ". " + prose(rng, 8) + ".") for i in range(30)] + [(40, None), (41, "")]
    docs = [(i, prose(rng, rng.randint(0, 300))) for i in range(40)]
    docs += [(100 + i, prose(rng, 90) + " " + items[i][1].upper() + " " + prose(rng, 150)) for i in range(20)]
    docs += [(200, " ".join(items[3][1].split()[:6])), (201, None), (202, ""), (None, items[5][1])]
    rows = decontaminate.contaminated(shout(spark.createDataFrame(docs, TEXT)), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r["doc_id"], r["item_id"]) for r in rows.collect()), key=str) == sorted([*((100 + i, i) for i in range(20)), (None, 5)], key=str)
    left = decontaminate.drop_contaminated(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string"))
    assert left.count() == len(docs) - 21
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, TEXT), none).count() == 0


def bm25_by_brute_force(docs, items):
    """(doc, item) of all passages against all items, from the formula, then the same verification in words."""
    import math
    import re
    import string

    terms = lambda t: [w if len(w) == 1 else (w.strip(string.punctuation) or w[-1]) for w in re.findall(r"[^ \t-\r]+", (t or "").lower())]
    held = [(i, terms(t), *map(terms, decontaminate.split_item(t or ""))) for i, t in items if terms(t)]
    df = {}
    for _, w, *_ in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    mean, longest = sum(len(w) for _, w, *_ in held) / len(held), max(len(w) for _, w, *_ in held)
    idf = {x: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for x, n in df.items()}

    def score(w, own):
        return sum(idf[x] * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w) & set(own))

    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {(x,) for x in w}
    out, half = set(), max(longest, decontaminate.LEAST_PASSAGE // 2)
    for d, t in docs:
        w = terms(t)
        for start in range(0, max((-(-len(w) // half) - 1) * half, 1), half):
            own = w[start : start + 2 * half]
            for i, its, q, a in held:
                if own and score(its, own) >= 0.5 * score(its, its) - 1e-9:
                    have = grams(own) | {(x,) for x in own}
                    q_share = len(grams(q) & have) / len(grams(q)) if q else 1
                    a_share = len(set(a) & set(own)) / len(set(a)) if a else 1
                    if q_share >= decontaminate.QUESTION and a_share >= decontaminate.ANSWER:
                        out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [64_000_000, 1500])
def test_decontamination_equals_all_pairs(spark, monkeypatch, shard):
    """All passages against all items, with items cut and changed so that many are near the thresholds."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = random.Random(19)
    words = [prose(rng, 1) for _ in range(150)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(rng.randint(8, 30)).capitalize() + "? " + some(rng.randint(3, 9)) + ".") for i in range(50)] + [(50, None), (51, " ")]

    def part(t):
        w = t.split()
        w = [x for x in w if rng.random() < rng.choice([0.95, 0.8, 0.65])]
        return " ".join(w)

    docs = [(i, some(rng.randint(0, 120)) + " " + part(rng.choice(items[:50])[1]) + " " + some(rng.randint(0, 120))) for i in range(150)]
    want = bm25_by_brute_force(docs, items)
    rows = decontaminate.contaminated(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert 20 < len({d for d, _ in want}) < 140
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("shard", [64_000_000, 400])
def test_drop_contaminated_judges_each_row(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = random.Random(12)
    items = spark.createDataFrame([(i, prose(rng, 25) + ". " + prose(rng, 8) + ".") for i in range(6)], "item_id long, text string")
    held = [r["text"] for r in items.collect()]
    clean = [(None, prose(rng, 80)), (None, prose(rng, 90)), (7, prose(rng, 70)), (8, prose(rng, 60)), (None, None), (9, "")]
    bad = [(i, prose(rng, 40) + " " + held[k] + " " + prose(rng, 40)) for k, i in enumerate([None, 7, None, 9, 10, 11])]
    docs = shout(spark.createDataFrame([x for pair in zip(clean, bad) for x in pair], TEXT))
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(clean, key=str)


def test_hopeful_loses_nothing(monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 30)))) for i in range(60)]
    ix = decontaminate.Index([(i, t, *decontaminate.split_item(t)) for i, t in items])
    text = " ".join(rng.choice(words) for _ in range(300)) + " " + items[7][1] + " " + " ".join(rng.choice(words) for _ in range(200)) + " " + items[9][1]
    data = np.frombuffer(text.encode(), np.uint8)
    h, row = decontaminate.terms_of(data, np.array([0, len(data)]))
    term, p = ix.known(h), decontaminate.Passages(row, 1, ix.longest)
    assert p.start[0] == 0 and p.end[-1] == len(h) and (p.start[1:] <= p.end[:-1]).all()
    want = [k for k in range(len(p.row)) if decontaminate.wand(ix, [t for t in set(term[p.start[k] : p.end[k]].tolist()) if t >= 0])]
    assert set(want) <= set(decontaminate.hopeful(ix, term, row, p).tolist()) and want


# --- Queries and pipeline ---


def test_each_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "jaccard_join", "decontaminate", "mixing"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(10)
    good = lambda: ". ".join(prose(rng, 12).capitalize() for _ in range(6))
    texts = [good() for _ in range(120)]
    texts += [prose(rng, 60).replace(" ", "$$$ ") for _ in range(60)]
    texts += [texts[0], texts[1]]
    near = texts[2].split()
    near[-1] = "changed"
    item = prose(rng, 25) + ". " + prose(rng, 8) + "."
    texts += [" ".join(near), good() + " " + item + " " + good()]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, names).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 120), 0) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, df = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name != "mixing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = seen["quality"]
    assert len(kept & set(range(120))) >= 115 and len(kept & set(range(120, 180))) <= 6
    assert seen["exact_dedup"] == kept - {180, 181}
    assert seen["jaccard_join"] == seen["exact_dedup"] - {182} and {2, 182} <= seen["exact_dedup"]
    assert seen["decontaminate"] == seen["jaccard_join"] - {183} and 183 in seen["jaccard_join"]
    assert seen["mixing"] <= seen["decontaminate"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == seen["mixing"]


def test_url_filter_keeps_large_ids(spark):
    big = 2**60
    rows = [(big + 1, "http://a.com/en/x"), (None, "http://a.com/en/y"), (big + 3, "http://b.net/"), (-(2**63), None), (2**63 - 1, "http://c.org/" + "p" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("org", "/ppp", "block")], "host string, path string, action string")
    got = {(r["page_id"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {(big + 1, "block"), (None, "block"), (big + 3, "allow"), (-(2**63), "allow"), (2**63 - 1, "block")}


def test_quality_scores_equal_a_plain_forward_pass(spark):
    rng = random.Random(9)
    model = quality.fit([(prose(rng, 30), 1) for _ in range(20)] + [(prose(rng, 30) + "$$$ !!", 0) for _ in range(20)])
    texts = [None, "", "a", "é" * 5, "x" * 12, "x" * 13, prose(rng, 50), prose(rng, 20) + "$$$", "w " * 400_000]

    def plain(text):
        data = (text or "").encode()
        kernel = model["kernel"].reshape(quality.WIDTH, quality.DIM, quality.FILTERS).astype(float)
        best = np.full(quality.FILTERS, -np.inf)
        for start in range(0, max(len(data) - quality.WIDTH + quality.STRIDE, 1), quality.STRIDE):
            chunk = data[start : start + quality.WIDTH].ljust(quality.WIDTH, b"\0")
            best = np.maximum(best, sum(model["embed"][c].astype(float) @ kernel[k] for k, c in enumerate(chunk)))
        z = float(np.maximum(best + model["bias"], 0) @ model["out"].astype(float) + model["shift"][0])
        return 1 / (1 + np.exp(-z))

    short = {i: plain(t if t is None or len(t) < 10_000 else t[:600]) for i, t in enumerate(texts)}  # a period repeats
    got = {r["doc_id"]: r["score"] for r in quality.classify(spark.createDataFrame(list(enumerate(texts)), TEXT), model).collect()}
    assert all(abs(got[i] - short[i]) < 1e-4 for i in short)


def test_toxicity_scores_equal_a_plain_tree_walk(spark):
    rng = random.Random(10)
    bad = lambda: " ".join(w if rng.random() > 0.15 else rng.choice(["blarg", "zonk"]) for w in prose(rng, 40).split())
    model = toxicity.fit([(prose(rng, 40), 0) for _ in range(80)] + [(bad(), 1) for _ in range(80)])
    texts = [None, "", "a", prose(rng, 30), bad(), bad().upper() + "!!", "you zonk", "é" * 3000]
    buf, off = toxicity._join([(t or "").encode() for t in texts])
    features = toxicity.features(buf, off, model["lexicon"], model["you"])

    def plain(x):
        z = 0.0
        for feature, cut, leaf in model["gbt"]["trees"]:
            node = 0
            while node < len(feature):
                below = sum(1 for e in model["gbt"]["edges"][feature[node]] if e < x[feature[node]])
                node = 2 * node + (2 if below > cut[node] else 1)
            z += leaf[node - len(feature)]
        xs, ys = model["xs"], model["ys"]
        if z <= xs[0] or z >= xs[-1]:
            at = ys[0] if z <= xs[0] else ys[-1]
        else:
            k = next(i for i in range(1, len(xs)) if xs[i] >= z and xs[i] > xs[i - 1])
            at = ys[k - 1] + (ys[k] - ys[k - 1]) * (z - xs[k - 1]) / (xs[k] - xs[k - 1])
        return min(max(0.999 * at + 0.001 / (1 + np.exp(-z)), 0), 1)

    got = {r["doc_id"]: r["score"] for r in toxicity.classify(spark.createDataFrame(list(enumerate(texts)), TEXT), model).collect()}
    assert all(abs(got[i] - plain(x)) < 1e-9 for i, x in enumerate(features))
    for t, x in zip(texts, features):  # some features by hand
        own = dict(zip(toxicity.NAMES, x))
        data, words = (t or "").encode(), (t or "").split()
        assert abs(own[toxicity.NAMES[-1]] - np.log1p(max(len(words), 1))) < 1e-9
        assert abs(own[toxicity.NAMES[10]] - sum(65 <= c <= 90 for c in data) / max(len(data), 1)) < 1e-9
        assert abs(own[toxicity.NAMES[13]] - data.count(b"!") / max(len(data), 1)) < 1e-9


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, ties, empty and null texts, a long text, clashing columns; then an empty table."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, prose(rng, 60), "en", f"s{i % 3}") for i in range(30)]
    rows += [(3, rows[3][1], "en", "s0"), (3, prose(rng, 60), None, None), (None, prose(rng, 60), "en", "s1"), (None, None, None, None), (40, None, "de", "s2"), (41, "", "de", "s2"), (42, prose(rng, 60_000), "en", "s1")]
    kind = TEXT + ", lang string, source string"
    clash = {c: F.lit("x") for c in ("epoch_", "k", "label", "size", "_u", "score")}
    for name, docs in (("odd", rows), ("none", [])):
        at = str(tmp_path / name)
        df = spark.createDataFrame(docs, kind).withColumns(clash)
        df.write.parquet(f"{at}/documents.parquet")
        labels = [(i, int(i % 4 > 0), 0) for i in range(30)] if docs else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, " ".join(rows[5][1].split()[:40]))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        mixed = corpus_pipeline.run(spark, at)
        out = mixed.collect()
        assert {r["text"] for r in out} <= {r[1] for r in docs} and set(df.columns) <= set(mixed.columns)
        assert not docs or all(r["text"] != rows[5][1] for r in out)
    assert not out
