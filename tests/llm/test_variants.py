"""Spelling variants, source divergence and MinHash near-dedup against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symbolith.llm import common, divergence, jaccard_join, minhash, spelling

TEXT = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- Spelling variants ---


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_brute_force(docs, mistakes, letters, least, ratio):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if mistakes and i is not None and h % mistakes == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def dictionary(rng, n=60):
    """Words and their variants, some repeated letters, some non-ASCII, one very long."""
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(n)] + ["aaaaaaaa", "aaaaaaa", "ÀÀÀÀÀÀ", "x" * 300]
    out = list(base)
    for w in base:
        for _ in range(3):
            at = rng.randrange(len(w))
            out.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + "c" + w[at:], w[:at] + "d" + w[at + 1 :]]))
    return out


@pytest.mark.parametrize("shard_words", [20_000, 7])
def test_near_words(spark, shard_words):
    rng = random.Random(4)
    words = {w: rng.randint(1, 500) for w in dictionary(rng)}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), shard_words)
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in got.collect()}
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want[w] = (len(near), words[best], best)
    assert got == want


@pytest.mark.parametrize("mistakes", [0, 7])
def test_variants(spark, mistakes):
    rng = random.Random(6)
    pool = dictionary(rng, 40)
    weights = [1 / (1 + k) for k in range(len(pool))]
    docs = [(rng.choice([None, *range(20)]), " ".join(rng.choices(pool, weights, k=120)).upper() if k % 9 == 0 else "-".join(rng.choices(pool, weights, k=120))) for k in range(40)]
    docs += [(50, None), (51, ""), (52, "1234 _"), (53, "same same"), (53, "same same"), (54, "trübsal " * 3000)]
    df = spark.createDataFrame(docs, TEXT).withColumns({c: F.lit("x") for c in ("word", "n", "key", "root")})
    rows = spelling.variants(df, mistakes, letters=5, least=2, ratio=2).collect()
    assert {r["word"]: tuple(r)[1:] for r in rows} == variants_by_brute_force(docs, mistakes, 5, 2, 2)
    assert any(r["root"] != r["form"] and r["form"] for r in rows)  # a chain


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], TEXT)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k:03}", f"w{k + 1:03}") for k in range(100)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w100"} and len(got) == 100


# --- Source divergence ---

ROWS = "doc_id long, text string, lang string, source string"


def audit_by_brute_force(docs, least, top):
    docs = [(lowered(t), l or "", s or "") for _, t, l, s in docs]
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t) for t, _, _ in docs]
    out = set()
    for lang in {l for _, l, _ in docs}:
        own = [(x, s) for x, (_, l, s) in zip(terms, docs) if l == lang]
        held = collections.Counter(t for x, _ in own for t in set(x))
        kept = {t for t, n in held.items() if n >= least}
        count = lambda xs: collections.Counter(t for x in xs for t in x if t in kept)
        groups = {s: count([x for x, o in own if o == s]) for s in {s for _, s in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in groups.items()}, p(count([x for x, _ in own]))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            best = sorted((-f(shares[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and shares[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(best[:top])}
    return out


@pytest.mark.parametrize(("sources", "slice_terms"), [(1, 8192), (2, 5), (7, 4), (12, 8192)])
def test_audit(spark, sources, slice_terms):
    rng = random.Random(sources)
    pool = ["été", "Ünï", *(f"t{chr(97 + k)}{chr(97 + k // 3)}" for k in range(24)), "same", "日本"]
    docs = [
        (k % 9, rng.choice([None, "", "12 ."]) if k % 7 == 0 else " ".join(rng.choices(pool, range(1, len(pool) + 1), k=rng.randint(1, 30))), rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}")
        for k in range(120)
    ]
    docs += [(1, "only", "xx", "a"), (2, None, "xx", None), (3, None, "yy", "a"), (4, "tie tie2", "en", None), (5, "word " * 50_000, "en", "s0")] + [(6, "Same same", "de", "s0")] * 5
    df = spark.createDataFrame(docs, ROWS).withColumns({c: F.lit("x") for c in ("term", "no", "value", "groups", "item")})
    rows = divergence.audit(df, least_docs=4, top=3, slice_terms=slice_terms).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    assert {tuple(r) for r in rows} == audit_by_brute_force(docs, 4, 3)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("seats", range(1, 12))
def test_meetings_are_a_tournament(seats):
    met = divergence.meetings(seats)
    assert len(met) == len({frozenset(m[1:]) for m in met}) == seats * (seats + 1) // 2
    for round_ in {r for r, a, b in met if a != b}:
        seated = [s for r, a, b in met if r == round_ for s in (a, b)]
        assert len(seated) == len(set(seated))  # nobody meets two at once
    at_home = collections.Counter(a for _, a, b in met if a != b)
    assert all(abs(at_home[s] - (seats - 1) / 2) <= 1 for s in range(seats))


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 10**15, 9 * 10**14 + 7], np.int64)
    assert divergence.share(n, 2 * 10**15, 1000).tolist() == [1 + 10**9 * (int(x) + 2) // (2 * 10**15 + 2000) for x in n]


# --- MinHash ---


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def components_by_brute_force(docs, size, num, den):
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(s), low.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))), key=repr)


def families(seed, n=10):
    """Texts that are near, nearly near, parts of each other, copies, short, empty and null."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Same", "é"]
    docs = []
    for f in range(n):
        words = rng.choices(vocabulary, k=rng.choice([4, 9, 12, 40, 130, 400]))
        template = rng.choices(vocabulary, k=20)
        for _ in range(rng.randint(1, 8)):
            own = list(words)
            cut = rng.randrange(1 + len(own) // 8)
            own = rng.choice([own[cut:], own[: len(own) - cut], own, own + template[:cut]])
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((len(docs) * 7 % 101, " ".join(own)))
    docs += [(500, None), (501, ""), (502, " \n"), (None, docs[0][1]), (None, "lone text here"), (503, "Two words"), (504, "two WORDS"), docs[1], docs[1]]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "num", "broadcast"), [(1, 85, 1000), (2, 80, 0), (3, 90, 1000)])
def test_minhash_components(spark, monkeypatch, seed, num, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    docs = families(seed)
    df = spark.createDataFrame(docs, TEXT).withColumns({c: F.lit("x") for c in ("s", "band", "label", "component_id", "kept")})
    rows = minhash.components(df, 3, num, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr) == components_by_brute_force(docs, 3, num, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_minhash_keeps_one_row_of_each_component(spark):
    docs = families(4)
    df = spark.createDataFrame(docs, TEXT).withColumns({c: F.lit("x") for c in ("s", "label", "k")})
    out = minhash.keep_one(df, 3, 85)
    want = components_by_brute_force(docs, 3, 85, 100)
    assert out.columns == df.columns
    linked = {c for i, n, c in want if n}
    assert {r["doc_id"] for r in out.where("text rlike '[^ \\n]'").collect()} == {c for c in linked}
    assert minhash.keep_one(df.limit(0)).count() == 0 and minhash.components(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n, same in ((2000, 1700), (40, 34), (7, 6)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[:same], rng.integers(0, 2**63, n - same).astype(np.uint64)))
        h, row = jaccard_join.unique(np.concatenate((a, b)), np.repeat([0, 1], n))
        x, y = minhash.signatures(h, row, 2)
        assert abs((x == y).mean() - same / (2 * n - same)) < 0.2
    assert not minhash.signatures(np.zeros(0, np.uint64), np.zeros(0, np.int64), 2).any()


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_join_of_parts(spark, seed):
    """Long texts that are parts of each other, beside a phrase that many rows hold."""
    rng = random.Random(seed)
    phrase = " ".join(f"p{k}" for k in range(10))
    docs = []
    for f in range(5):
        w = [f"f{f}x{k}" for k in range(rng.randint(100, 400))]
        cuts = [0, 1, len(w) // 12, len(w) // 11, len(w) // 20]
        docs += [(len(docs) + 100 * f, t) for t in (" ".join(w), " ".join(w[1:]) + " " + phrase, *(" ".join(w[: len(w) - c]) for c in cuts), *(" ".join(w[c:]) for c in cuts))]
        docs += [(9000 + 100 * f + k, " ".join(w[1 : len(w) - 12]) + " " + " ".join(f"own{f}y{k}y{j}" for j in range(20))) for k in range(10)]
    docs += [(20_000 + k, phrase + f" z{k}") for k in range(200)]
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    rows = jaccard_join.components(spark.createDataFrame(docs, TEXT), 3, 90, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr) == components_by_brute_force(docs, 3, 90, 100)


def test_minhash_runs_no_graph_where_no_pair_is_left(spark, monkeypatch):
    from symbolith.llm import minhash

    calls, own = [], minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda *a: calls.append(1) or own(*a))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "a b c d")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(docs, shingle=3, num=85, den=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(calls) == 1
