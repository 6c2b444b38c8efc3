"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all from one vectorised pass over its bytes: densities of lexicon
words and lexicon stems, hits within three words of a second-person pronoun, capitals,
punctuation, obfuscated words (digits or symbols between letters, and those that match the
lexicon once undone), repeated letters, and length.

The lexicon is learned with the trees, from the same bounded sample of labelled rows
(``sampling.labelled_sample``): words and leading stems that occur in many more toxic
than clean texts. Features of the sample come from a lexicon of the other half, so trees
and calibration see densities as they are on unseen texts. Trees are grown on
histogram bins; out-of-fold margins are calibrated by pooling adjacent violators. Both classes
weigh the same, at any size of the corpus.

The model (a lexicon of at most ``LEXICON`` hashes, trees of a fixed number) is broadcast;
scoring is one pass without a shuffle, in pieces of bounded size; a longer text is a piece
by itself and takes some sixty bytes a byte.

Defined cases: null and empty texts have zero features and are scored; a null id is scored
and not held out; repeated rows are scored alike; extra columns are dropped; without
labelled rows of both classes the score is the constant share of label 1 (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _MARK, _powers, mix64, pieces, string_buffer, word_spans
from .sampling import balance, fold, labelled_sample

LEXICON = 4000
STEMS = (4, 5, 6, 7, 8, 9)
NEAR = 3
FOLDS, HELD_OUT = 5, 0
TOXIC_AT = 0.5
PIECE = 1 << 19

# Second-person pronouns of the corpus languages.
YOU = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

# Digits and symbols that commonly stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_PLAIN = _LOWER.copy()
for _k, _v in LEET.items():
    _PLAIN[ord(_k)] = ord(_v)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

NAMES = (
    "strong_rate", "strong_hits", "strong_kinds", "weak_rate", "weak_hits", "stem_rate", "stem_hits", "near_you", "hidden_hits",
    "odd_words", "capitals", "shouted", "marks", "exclaims", "repeats", "log_words",
)


class Words:
    """Words of a buffer, stripped of ASCII punctuation, with hashes of word and stems."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        s, e, self.row = word_spans(buf, offsets)
        for _ in range(4):
            cut = (e - s > 1) & _MARK[buf[e - 1]] if len(s) else np.zeros(0, bool)
            e = e - cut
            cut = (e - s > 1) & _MARK[buf[s]] if len(s) else np.zeros(0, bool)
            s = s + cut
        n = len(buf)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_PLAIN[buf]] * power[:n], out=self.sums[1:])
        self.s, self.e, self.buf, self.n_rows = s, e, buf, len(offsets) - 1
        self.length = e - s
        self.full = self._hash(s, e, 0)

    def _hash(self, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        return mix64((self.sums[e] - self.sums[s]) * self.inverse[s] + np.uint64(kind * 1_000_003) + (e - s).astype(np.uint64))

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of leading bytes of longer words, and which words those are."""
        for k in STEMS:
            at = np.flatnonzero(self.length > k)
            yield self._hash(self.s[at], self.s[at] + k, k), at


def _hash_words(words: list[str]) -> np.ndarray:
    parts = [w.encode() for w in words]
    return np.unique(Words(np.frombuffer(b" ".join(parts), np.uint8), np.array([0, sum(map(len, parts)) + len(parts) - 1])).full)


class Lookup:
    """Weights of hashes; most misses end at a bit table."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int8)
        if len(self.keys):
            at = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[i] == h[at]
            out[at[hit]] = self.weights[i[hit]]
        return out


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def learn_lexicon(texts: list[bytes], y: np.ndarray) -> Lookup:
    """Hashes with weight 3 (words seen in toxic texts only), 2 (words) or 1 (stems)."""
    keys, kinds, rows = [], [], []
    buf, offsets = _join(texts)
    for i, j in pieces(offsets, 1 << 20):
        w = Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for h, at, kind in [(w.full, np.arange(len(w.full)), 0), *((h, at, 1) for h, at in w.stems())]:
            pair = np.unique(np.stack([h, (w.row[at] + i).astype(np.uint64)], 1), axis=0)
            keys.append(pair[:, 0])
            rows.append(pair[:, 1].astype(np.int64))
            kinds.append(np.full(len(pair), kind, np.int8))
    key, kind, row = np.concatenate(keys), np.concatenate(kinds), np.concatenate(rows)
    uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
    bad = np.bincount(back, y[row], len(uniq))
    good = np.bincount(back, 1 - y[row], len(uniq))
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    ratio = ((bad + 0.3) / n1) / ((good + 0.3) / n0)
    word = kind[first] == 0
    need = max(3, 0.004 * n1)
    weight = np.where(word & (ratio >= 12) & (bad >= need), 3, np.where(word & (ratio >= 4) & (bad >= need), 2, np.where(~word & (ratio >= 5) & (bad >= need + 1), 1, 0)))
    pick = np.flatnonzero(weight)
    pick = pick[np.argsort(-(ratio * np.sqrt(bad))[pick], kind="stable")][:LEXICON]
    return Lookup(uniq[pick], weight[pick].astype(np.int8))


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: Lookup, you: np.ndarray) -> np.ndarray:
    w, n = Words(buf, offsets), len(offsets) - 1
    per = lambda mask, rows=w.row: np.bincount(rows[mask], minlength=n).astype(float)
    words, size = np.maximum(np.bincount(w.row, minlength=n), 1).astype(float), np.maximum(np.diff(offsets), 1).astype(float)
    weight = lexicon(w.full)
    stem = np.zeros(len(weight), bool)
    for h, at in w.stems():
        stem[at[lexicon(h) == 1]] = True
    strong, weak = weight == 3, weight >= 2
    own = np.flatnonzero(np.isin(w.full, you))
    near = np.zeros(len(weight), bool)
    for d in range(-NEAR, NEAR + 1):
        at = own + d
        ok = (at >= 0) & (at < len(near))
        ok[ok] = w.row[at[ok]] == w.row[own[ok]]
        near[at[ok]] = True

    def over(mask: np.ndarray) -> np.ndarray:
        """Bytes of each word that the mask holds for."""
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[w.e] - c[w.s]

    letters = over(_LETTER[buf]) if len(buf) else np.zeros(len(w.s))
    odd = (letters > 1) & (letters < w.length)
    shouted = (over(_UPPER[buf]) == w.length) & (w.length > 2) if len(buf) else odd
    same = np.zeros(len(buf), bool)
    if len(buf) > 2:
        same[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _LETTER[buf[2:]]
    row_of = lambda mask: np.add.reduceat(np.append(mask, False).astype(float), np.minimum(offsets[:-1], len(mask))) * (np.diff(offsets) > 0)
    strong_pairs = np.unique(np.stack([w.row[strong].astype(np.uint64), w.full[strong]], 1), axis=0)[:, 0].astype(np.int64)
    out = [
        per(strong) / words, per(strong), np.bincount(strong_pairs, minlength=n), per(weak) / words, per(weak), per(stem) / words, per(stem),
        per(weak & near), per(weak & odd), per(odd) / words, row_of(_UPPER[buf]) / size, per(shouted) / words, row_of(_MARK[buf]) / size,
        row_of(buf == 33) / size, row_of(same) / size, np.log1p(words),
    ]
    return np.stack(out, 1)


# --- Trees and calibration ---------------------------------------------------


def _edges(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for c, e in zip(x.T, edges)], 1).astype(np.int16)


def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A complete tree by level: split feature, split bin, leaf values."""
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 32_000, np.int64)
    node = np.zeros(len(b), np.int64)
    bins = int(b.max(initial=0)) + 1
    for level in range(depth):
        base, width = 2**level - 1, 2**level
        local = node - base
        gain = np.zeros(width)
        for f in range(b.shape[1]):
            slot = local * bins + b[:, f]
            gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)
            hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)
            ga, ha = gs[:, -1:], hs[:, -1:]
            value = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            value[(hs < least) | (ha - hs < least)] = 0
            best = value.argmax(1)
            top = value[np.arange(width), best]
            for k in np.flatnonzero(top > gain + 1e-9):
                gain[k], feature[base + k], cut[base + k] = top[k], f, best[k]
        node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
    leaf = node - (2**depth - 1)
    gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
    return feature, cut, -gs / (hs + ridge)


def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray, depth: int) -> np.ndarray:
    feature, cut, leaf = tree
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(depth):
        node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
    return leaf[node - (2**depth - 1)]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, least: float = 2.0) -> dict:
    """Log-loss boosting on histogram bins."""
    edges = _edges(x)
    b, margin = _binned(x, edges), np.zeros(len(x))
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, leaf = _grow(b, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), depth, ridge, least)
        grown.append((feature, cut, leaf * rate))
        margin += _walk(grown[-1], b, depth)
    return {"edges": edges, "trees": grown, "depth": depth}


def margins(m: dict, x: np.ndarray) -> np.ndarray:
    b = _binned(x, m["edges"])
    return sum((_walk(t, b, m["depth"]) for t in m["trees"]), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight of ones, weight, smallest x, largest x
    for a, v, w in zip(x[order], y[order], weight[order]):
        pools.append([v * w, w, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.repeat([(p[0] + 0.5) / (p[1] + 1) for p in pools], 2)
    return xs, np.maximum.accumulate(ys)


def fit(rows: list[tuple[str, int]], seed: int = 3) -> dict:
    """Lexicon, trees and calibration from (text, label) rows."""
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    texts, you = [t.encode() for t, _ in rows], _hash_words(YOU)
    weight = np.array(balance([v for _, v in rows]))
    part = np.random.default_rng(seed).permutation(len(rows)) % 4
    x = np.zeros((len(rows), len(NAMES)))
    for k in range(4):
        own, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        x[own] = features(*_join([texts[i] for i in own]), learn_lexicon([texts[i] for i in rest], y[rest]), you)
    out = np.zeros(len(rows))
    for k in range(4):
        out[part == k] = margins(boost(x[part != k], y[part != k], weight[part != k]), x[part == k])
    xs, ys = isotonic(out, y, weight)
    return {"lexicon": learn_lexicon(texts, y), "you": you, "gbt": boost(x, y, weight), "xs": xs, "ys": ys}


def score(m: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if "constant" in m:
        return np.full(len(offsets) - 1, m["constant"])
    z = margins(m["gbt"], features(buf, offsets, m["lexicon"], m["you"]))
    # the small share of the raw margin keeps the order inside a calibration step
    return np.clip(0.999 * np.interp(z, m["xs"], m["ys"]) + 0.001 / (1 + np.exp(-z)), 0, 1)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> dict:
    return fit(labelled_sample(documents, labels, label, folds, held_out, **options))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, off = string_buffer(b.column(2))
            got = [score(m, buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["doc_id", "held_out", "score"]
            )

    return run


def classify(documents: DataFrame, model: dict, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = TOXIC_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    rows = rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
