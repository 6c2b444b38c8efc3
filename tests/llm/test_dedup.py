"""Exact, line and suffix dedup and the Jaccard join against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from symbolith.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup
from symbolith.llm.common import connected_components

TEXT = "doc_id long, text string"
#: Nulls, empty and blank texts, ties, repeated rows, non-ASCII, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "same"), (5, "same"), (5, "same"), (None, "same"), (None, None), (6, "é" * 300), (7, "word " * 40_000)]


def shout(df):
    """Extra columns whose names clash with results and inner names."""
    return df.withColumns({c: F.lit("x") for c in ("keep_id", "kept", "n", "_h", "id", "h", "covers", "component_id", "size", "k1")})


# --- Exact dedup ---


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = exact_dedup.annotate(spark.createDataFrame(ODD, TEXT), keep=keep).collect()
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    assert len(rows) == len(ODD)
    for r in rows:
        own = groups[r["text"] or ""]
        ids = [i for i in own if i is not None]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == ((min if keep == "smallest" else max)(ids) if ids else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_exact_dedup_tells_collisions_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.unhex(F.md5(F.substring(text, 1, 1))))
    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab")], TEXT)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.annotate(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_exact_dedup_rows(spark):
    df = shout(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], TEXT))
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, 2}
    assert exact_dedup.annotate(df.limit(0)).count() == 0


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(5, "a", "x"), (5, "a", "y"), (5, "b", "x"), (None, "a", "z"), (None, "c", "x"), (None, "c", "x"), (None, None, "x"), (7, "", "y"), (8, "d", "x")]
    df = spark.createDataFrame(rows, TEXT + ", _keep string")
    out = exact_dedup.drop_duplicates(df)
    got = sorted((r["text"] or "", str(r["doc_id"])) for r in out.collect())
    assert out.columns == df.columns and got == [("", "7"), ("a", "5"), ("b", "5"), ("c", "None"), ("d", "8")]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_exact_dedup_by_key_or_broadcast(spark, monkeypatch, broadcast):
    from symbolith.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", *"abcdefgh"])) for _ in range(200)]
    df = spark.createDataFrame(rows, TEXT)
    size = collections.Counter(t or "" for _, t in rows)
    for r in exact_dedup.annotate(df).collect():
        assert r["group_size"] == size[r["text"] or ""]
    left = exact_dedup.drop_duplicates(df).collect()
    low = {t: min((i for i, x in rows if (x or "") == t and i is not None), default=None) for t in size}
    assert {r["text"] or "": r["doc_id"] for r in left} == low and len(left) == len(size)


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.annotate(spark.createDataFrame(ODD, TEXT))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- Line dedup ---


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def removed_by_brute_force(docs, near_from):
    order = sorted(((-1 if i is None else i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)))
    gone = collections.Counter()
    for k, (i, n, x) in enumerate(order):
        for j, m, y in order[:k]:
            if (j, m) < (i, n) and (x == y or (min(len(x), len(y)) >= near_from and one_edit(x, y))):
                gone[i, n] = 1
    return gone


def edited(rng, x):
    j, c = rng.randrange(len(x) + 1), rng.choice("abñ x")
    return rng.choice([x[:j] + c + x[j:], x[:j] + x[j + 1 :], x[:j] + c + x[j + 1 :]])


def test_line_dedup(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([4, 15, 16, 17, 40, 90]))) for _ in range(18)]
    pool = base + [edited(rng, b) for b in base for _ in range(2)] + [edited(rng, edited(rng, b)) for b in base] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(50)] + [(900, None), (901, ""), (None, base[0])]
    df = spark.createDataFrame(docs, TEXT)
    gone = removed_by_brute_force(docs, line_dedup.NEAR_FROM)
    got = {r["doc_id"]: r for r in line_dedup.report(df).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want = [n for n in range(len((t or "").split("\n"))) if gone[-1 if i is None else i, n]]
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["removed_lines"]) == (len((t or "").split("\n")), len(want), want)
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.clean(shout(df)).collect()}
    for i, t in docs:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not gone[-1 if i is None else i, n])
        assert cleaned[i] == kept


def test_line_dedup_odd(spark):
    assert line_dedup.report(spark.createDataFrame(ODD, TEXT)).count() == len(ODD)
    assert line_dedup.report(spark.createDataFrame([], TEXT)).count() == 0
    df = spark.createDataFrame([(1, "the first long line here"), (2, "the first long lin3 here\nab"), (3, "ac")], TEXT)
    assert [tuple(r) for r in line_dedup.removed_lines(df).collect()] == [(2, 0)]
    assert line_dedup.removed_lines(df, bound=0).count() == 0
    with pytest.raises(ValueError):
        line_dedup.removed_lines(df, bound=2)


def test_line_dedup_tells_rows_apart(spark):
    """Null and repeated ids: no unique line goes, and of equal lines one stays."""
    docs = [(None, "x first of them\nC"), (None, "C\nunique words"), (5, "a line that is here\nC"), (5, "C\nanother that is not"), (5, "C\nanother that is not"), (6, None)]
    df = spark.createDataFrame(docs, TEXT)
    left = [x for r in line_dedup.clean(shout(df)).collect() for x in (r["text"] or "").split("\n") if x]
    assert collections.Counter(left) == {"x first of them": 1, "C": 1, "unique words": 1, "a line that is here": 1, "another that is not": 2}
    assert sorted(r["n_removed"] for r in line_dedup.report(df).collect()) == [0, 0, 1, 1, 1, 1]


# --- Suffix-array dedup ---


def cut_by_brute_force(docs):
    n = suffix_dedup.LENGTH
    count = collections.Counter(b[j : j + n] for _, t in docs for b in [(t or "").encode()] for j in range(len(b) - n + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if count[b[j : j + n]] > 1:
                cover[j : j + n] = b"\1" * n
        spans = len([x for x in bytes(cover).split(b"\0") if x])
        left = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(left).hexdigest()))
    return out


def passages(rng):
    word = lambda: "".join(rng.choice("abcdefgñ") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, long = prose(45), prose(90)
    docs = [(i, prose(rng.randint(5, 60))) for i in range(12)]
    docs += [(20 + i, prose(20) + common + prose(20)) for i in range(8)]
    docs += [(40 + i, edited(rng, long)) for i in range(8)]
    docs += [(60, common[:199]), (61, common[:200]), (62, common[1:202]), (70, "a" * 200), (71, "a" * 201), (72, "ab" * 150), (73, "b" * 200), (74, long), (75, long)]
    return docs


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    docs = passages(random.Random(6))
    got = sorted(map(tuple, suffix_dedup.digest(shout(spark.createDataFrame(docs, TEXT))).collect()))
    assert got == sorted(cut_by_brute_force(docs))


def test_suffix_dedup_odd(spark):
    odd = ODD[:-1] + [(7, "word " * 4000)]
    got = sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(odd, TEXT)).collect()), key=str)
    assert got == sorted(cut_by_brute_force(odd), key=str)
    assert suffix_dedup.digest(spark.createDataFrame([], TEXT)).count() == 0
    two = spark.createDataFrame([(1, "x" * 150 + "q" * 250), (2, "q" * 250 + "z")], TEXT)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix_dedup.clean(two).collect()}
    assert spans == {1: [(150, 400)], 2: [(0, 250)]}


def test_suffix_dedup_one_passage_in_many_contexts(spark, monkeypatch):
    """A hot anchor over many batches: some contexts are shared, most aren't."""
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 100)
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefgñ") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, shared = prose(55), [prose(9) for _ in range(5)]
    docs = [(i, prose(6) + rng.choice([*shared, prose(9)]) + passage + rng.choice([*shared, prose(9)]) + prose(6)) for i in range(2000)]
    assert 250 < len(passage.encode()) < 400
    got = sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(docs, TEXT).repartition(12)).collect()))
    assert got == sorted(cut_by_brute_force(docs))


def test_equal_keys_of_unequal_runs():
    buf = np.frombuffer(b"abcdabceabcdabce", np.uint8)
    group, first = suffix_dedup.alike(buf, np.array([0, 4, 8, 12]), np.full(4, 4), np.zeros(4, np.int64))
    assert group[0] == group[2] != group[1] == group[3] and sorted(first.tolist()) == [0, 1]


def cut_long_by_brute_force(docs):
    """As cut_by_brute_force, for long texts: only windows around repeated blocks are counted.

    Each repeated window holds a whole block of half its length, cut at multiples of that.
    """
    n, half = suffix_dedup.LENGTH, suffix_dedup.LENGTH // 2
    data = [t.encode() for _, t in docs]
    blocks = {b[p : p + half] for b in data for p in range(0, len(b), half)}
    at = collections.defaultdict(list)
    for d, b in enumerate(data):
        for j in range(len(b) - half + 1):
            if b[j : j + half] in blocks:
                at[b[j : j + half]].append((d, j))
    starts = {(d, s) for x in at.values() if len(x) > 1 for d, j in x for s in range(max(j - half, 0), min(j, len(data[d]) - n) + 1)}
    count = collections.Counter(data[d][s : s + n] for d, s in starts)
    covers = [bytearray(len(b)) for b in data]
    for d, s in starts:
        if count[data[d][s : s + n]] > 1:
            covers[d][s : s + n] = b"\1" * n
    left = [np.frombuffer(b, np.uint8)[np.frombuffer(c, np.uint8) == 0].tobytes() for b, c in zip(data, covers)]
    spans = [len([x for x in bytes(c).split(b"\0") if x]) for c in covers]
    return [(i, len(b), sum(c), s, hashlib.sha256(x).hexdigest()) for (i, _), b, c, s, x in zip(docs, data, covers, spans, left)]


def test_suffix_dedup_reads_twins_once(spark, monkeypatch):
    """Rows of equal id and text: results as of any copies, but one row's segments only."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    text, short, part = prose(600), prose(8), prose(90)
    docs = [(None, text)] * 500 + [(3, short)] * 20 + [(4, prose(50) + text[700:1200] + prose(50)), (5, part), (6, "x" + part), (None, None), (None, None)]
    got = sorted(map(repr, map(tuple, suffix_dedup.digest(spark.createDataFrame(docs, TEXT).repartition(50)).collect())))
    assert got == sorted(map(repr, cut_by_brute_force(docs)))


def test_suffix_dedup_long_text(spark):
    letters = lambda seed, n: np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    long, cut = letters(1, 17_200_000), 1 << 24
    twice = letters(2, 450)
    places = {16_900_000: twice, 17_000_000: twice, 17_199_700: letters(3, 300)}
    for at, x in places.items():
        long = long[:at] + x + long[at + len(x) :]
    docs = [(1, long), (2, letters(4, 300) + long[17_100_000:17_100_260]), (3, long[cut - 500 : cut + 500]), (4, letters(5, 9) + long[cut - 120 : cut + 80])]
    docs += [(5, letters(3, 300)), (6, long[cut - 100 : cut + 99]), (7, long[1000:1300])]
    want = cut_long_by_brute_force(docs)
    assert want[0][2:4] == (450 * 2 + 260 + 1000 + 300 + 300, 6)
    got = sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(docs, TEXT)).collect()))
    assert got == sorted(want)


@pytest.mark.parametrize("long", [1, 137, 1000])
def test_suffix_dedup_pieces_change_nothing(spark, monkeypatch, long):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1)
    monkeypatch.setattr(suffix_dedup, "LONG", long)
    buf = np.frombuffer(passages(random.Random(9))[-1][1].encode() * 2 + b"a" * 300, np.uint8)
    pieces = list(suffix_dedup.anchors(buf, np.array([0, len(buf)])))
    starts = [base + int(s) + k for _, base, a in pieces for s, n in zip(a.start, a.size) for k in range(n - suffix_dedup.LENGTH + 1)]
    whole = suffix_dedup.Anchors(buf, np.array([0, len(buf)]))
    assert sorted(starts) == list(range(len(buf) - suffix_dedup.LENGTH + 1)) and len(pieces) > 1
    place = lambda base, a: {(base + int(s + o), int(g)) for s, o, g in zip(a.start, a.off, a.gram)}
    assert set().union(*(place(base, a) for _, base, a in pieces)) == place(0, whole)


# --- Jaccard join ---


def components_by_brute_force(docs, size, num):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(low))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (i, len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_jaccard_join(spark, size, num):
    rng = random.Random(7)
    prose = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(n)]
    docs, i = [], 0
    for _ in range(4):
        own = prose(rng.randint(30, 120))
        for _ in range(7):
            w = list(own)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "Z" + str(rng.randrange(99))
            docs.append((i, " ".join(w)))
            i += 1
    docs += [(100 + k, " ".join(prose(rng.randint(1, 40)))) for k in range(20)]
    for k in range(24):  # long texts, near the threshold, with two prefix shingles or more to share
        if k % 6 == 0:
            own = prose(rng.randint(150, 420))
        w = list(own)
        for _ in range(rng.randint(0, len(w) // 25)):
            w[rng.randrange(len(w))] = "Y" + str(rng.randrange(99))
        docs.append((300 + k, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "One"), (203, "one"), (204, "a b"), (205, "A\tB "), (206, "a a a a a a"), (207, " \n")]
    got = {r["doc_id"]: tuple(r) for r in jaccard_join.components(shout(spark.createDataFrame(docs, TEXT)), size, num, 100).collect()}
    assert got == components_by_brute_force(docs, size, num)


def test_jaccard_join_odd(spark):
    rows = jaccard_join.components(spark.createDataFrame(ODD, TEXT), 3, 90, 100).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    assert jaccard_join.components(spark.createDataFrame([], TEXT)).count() == 0
    only_null = jaccard_join.components(spark.createDataFrame([(None, "a b c"), (None, "a b c")], TEXT)).collect()
    assert [r["component_id"] for r in only_null] == [None, None]


def test_jaccard_join_tells_rows_apart(spark):
    """Null, repeated and very large ids; one row of each component stays."""
    rng = random.Random(17)
    prose = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(n)]
    a, b, c = prose(60), prose(60), prose(60)
    near = lambda w, x: " ".join([*w[:-1], x])
    big = 2**62
    rows = [(big + 9, near(a, "p")), (big + 5, near(a, "q")), (3, near(b, "p")), (3, near(c, "p")), (9, near(c, "q")), (8, near(b, "q"))]
    rows += [(None, near(b, "r")), (None, " ".join(prose(40))), (None, " ".join(prose(40))), (2**63 - 1, "lonely text here now")]
    df = shout(spark.createDataFrame(rows, TEXT))
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard_join.components(df, 3, 90, 100).collect() if r["component_id"] is not None)
    low = {0: big + 5, 1: big + 5, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 9: 2**63 - 1}
    assert got == sorted((str(rows[k][0]), v) for k, v in low.items())
    left = jaccard_join.keep_one(df, 3, 90, 100)
    assert left.columns == df.columns
    assert sorted(r["text"] for r in left.collect()) == sorted(rows[k][1] for k in (1, 2, 3, 7, 8, 9))
    twins = jaccard_join.keep_one(spark.createDataFrame([rows[0]] * 3 + [rows[1]] * 2 + [(1, "x")] * 2, TEXT), 3, 90, 100).collect()
    assert sorted(map(tuple, twins)) == sorted([rows[1], (1, "x")])


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, k) for k in range(201, 230)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == root
