"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification.

The index holds the test items: postings by term in item order, cut in blocks that know
their largest weight. Weights are BM25 divided by the item's score for its own text, so one
threshold, a share of the item, fits all items. Every training document is cut in passages of
twice the longest item's words, half overlapping, so each occurrence of an item lies wholly in
one. Every passage is a query, and *all* items above the threshold are retrieved.

Most passages can't reach the threshold. A vectorised bound discards those first: of each
item, the commonest terms up to half the threshold are set aside; what is left of its
postings is added up per passage, and if that and all that was set aside stay below the
threshold for each item, so does the score. Words are compared lower-cased. WAND runs on the other passages: cursors in
item order, a pivot where term bounds reach the threshold, block maxima before scoring.

A retrieved item is verified on the passage itself: word trigrams of its question, words of
its answer. Without columns of their own, the answer is the text's last sentences of five
words or more and the question is what stands before.

The index is broadcast in shards of about ``SHARD_BYTES`` of item text; a larger test set takes
one pass over the documents per shard. Number of items, mean and largest length, and each term's
document frequency are counted over all items first, so scores and passages are the same
however many shards there are. Scoring is a map over documents without a shuffle; a
document's passages stay in one task.

Defined cases: null and empty documents have no passages; null and empty items are never
found; items with equal texts are all found; each row is judged by its own text, also where
rows share an id or have none; a null id is kept; ``contaminated`` drops extra columns and
``drop_contaminated`` keeps them; no documents or no items give no rows of ``contaminated``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MARK, index_ranges, lean, materialize, mix64, pieces, string_buffer, text_of, word_hashes, word_spans

THRESHOLD = 0.5  # share of an item's own BM25 score
QUESTION, ANSWER = 0.6, 0.6  # shares of trigrams and of words
ANSWER_WORDS = 5
BLOCK = 32
K1, B = 1.2, 0.75
SHARD_BYTES = 8_000_000
LEAST_PASSAGE = 64
PIECE = 1 << 19
OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passages int"


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of lower-cased text, ASCII punctuation around it cut off."""
    s, e, row = word_spans(buf, offsets)
    for _ in range(8):
        if len(s):
            e = e - ((e - s > 1) & _MARK[buf[e - 1]])
            s = s + ((e - s > 1) & _MARK[buf[s]])
    return word_hashes(buf, s, e), row


def _terms(text: str) -> np.ndarray:
    data = pc.utf8_lower(text).as_py().encode()
    return terms_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def _grams(terms: np.ndarray) -> np.ndarray:
    if len(terms) < 3:
        return terms
    c = np.uint64(0x9E3779B97F4A7C15)
    return mix64(mix64(terms[:-2] * c + terms[1:-1]) * c + terms[2:])


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if p.strip()]
    answer: list[str] = []
    while parts and sum(len(p.split()) for p in answer) < ANSWER_WORDS:
        answer.insert(0, parts.pop())
    question = " ".join(parts)
    return (question if len(question.split()) >= 3 else text), " ".join(answer)


class Statistics:
    """What BM25 needs to know of all items."""

    def __init__(self, items: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        order = np.argsort(terms)
        self.items, self.mean, self.longest, self.terms, self.df = items, mean, longest, terms[order], df[order]

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Statistics:
        sizes = [len(w) for w in words]
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(len(words), float(np.mean(sizes)) if words else 0.0, max(sizes, default=0), terms, df)

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


class Index:
    """Inverted index of items, weights as shares of each item's own score."""

    def __init__(self, items: list[tuple[int, str, str, str]], threshold: float = THRESHOLD, known: Statistics | None = None):
        """items: (item_id, text, question, answer); known: statistics of all items if these are some of them."""
        words = [(i, w, q, a) for i, w, q, a in ((i, _terms(t or ""), q, a) for i, t, q, a in items) if len(w)]
        known = known or Statistics.of([w for _, w, *_ in words])
        self.ids = [i for i, *_ in words]
        self.threshold = threshold
        self.longest = known.longest
        self.question = [np.unique(_grams(_terms(q))) for *_, q, _ in words]
        self.answer = [np.unique(_terms(a)) for *_, a in words]
        sizes = np.array([len(w) for _, w, *_ in words], float)
        term, item, tf = [], [], []
        for k, (_, w, *_) in enumerate(words):
            u, c = np.unique(w, return_counts=True)
            term.append(u)
            item.append(np.full(len(u), k))
            tf.append(c)
        term, item, tf = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((term, np.uint64), (item, np.int64), (tf, np.int64)))
        self.terms, by = np.unique(term, return_inverse=True)
        df = known.frequency(self.terms)
        idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
        weight = idf[by] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(known.mean, 1)))
        weight = weight / np.bincount(item, weight, max(len(words), 1))[item]
        # per item, its commonest terms are set aside up to half the threshold
        order = np.lexsort((term, -df[by], item))
        total = np.cumsum(weight[order])
        start = np.searchsorted(item[order], np.arange(len(words)))
        before = np.concatenate(([0.0], total))[start] if len(words) else np.zeros(0)
        aside = np.zeros(len(term), bool)
        aside[order] = total - before[item[order]] <= threshold / 2
        self.aside = np.bincount(item[aside], weight[aside], max(len(words), 1))
        order = np.lexsort((item, by))
        self.item, self.weight, rare = item[order], weight[order], ~aside[order]
        self.first = np.searchsorted(by[order], np.arange(len(self.terms) + 1))
        self.rare_item, self.rare_weight = self.item[rare], self.weight[rare]
        self.rare_first = np.searchsorted(by[order][rare], np.arange(len(self.terms) + 1))
        self.top = np.maximum.reduceat(self.weight, self.first[:-1]) if len(self.terms) else np.zeros(0)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.block_max, self.block_last = [], []
        for a, z in zip(self.first[:-1], self.first[1:]):
            cuts = range(a, z, BLOCK)
            self.block_max.append([float(self.weight[c : min(c + BLOCK, z)].max()) for c in cuts])
            self.block_last.append([int(self.item[min(c + BLOCK, z) - 1]) for c in cuts])
        self.postings = [(self.item[a:z].tolist(), self.weight[a:z].tolist()) for a, z in zip(self.first[:-1], self.first[1:])]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Term number of each hash, -1 if the index hasn't got it."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(self.terms) and len(at):
            k = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
            hit = self.terms[k] == h[at]
            out[at[hit]] = k[hit]
        return out


def wand(ix: Index, terms: list[int]) -> list[tuple[int, float]]:
    """Items of score >= threshold for a query of distinct terms, by block-max WAND."""
    need, eps = ix.threshold, 1e-9
    cursors = [[ix.postings[t][0][0], 0, float(ix.top[t]), t] for t in terms]  # item, position, bound, term
    found = []

    def advance(c: list, item: int) -> bool:
        items = ix.postings[c[3]][0]
        c[1] = bisect_left(items, item, c[1])
        if c[1] >= len(items):
            cursors.remove(c)
            return False
        c[0] = items[c[1]]
        return True

    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c[2]
            if bound >= need - eps:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        tops, ends = 0.0, []
        for c in cursors[: pivot + 1]:
            last = ix.block_last[c[3]]
            b = bisect_left(last, item)
            if b < len(last):
                tops += ix.block_max[c[3]][b]
                ends.append(last[b])
        if tops >= need - eps:
            if cursors[0][0] == item:
                score = sum(ix.postings[c[3]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= need - eps:
                    found.append((item, score))
                for c in list(cursors[: pivot + 1]):
                    advance(c, item + 1)
            else:
                for c in list(cursors[:pivot]):
                    if c[0] < item:
                        advance(c, item)
        else:
            after = min([*(e + 1 for e in ends), *([cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else [])], default=item + 1)
            after = max(after, item + 1)
            for c in list(cursors[: pivot + 1]):
                if c[0] < after:
                    advance(c, after)
    return found


class Passages:
    """Half-overlapping passages over the words of several rows."""

    def __init__(self, row: np.ndarray, n_rows: int, half: int):
        words = np.bincount(row, minlength=n_rows)
        first = np.cumsum(words) - words
        count = np.where(words > 0, np.maximum(-(-words // half) - 1, 1), 0)
        self.row = np.repeat(np.arange(n_rows), count)
        step = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.start = first[self.row] + step * half
        self.end = np.minimum(self.start + 2 * half, first[self.row] + words[self.row])


def hopeful(ix: Index, term: np.ndarray, row: np.ndarray, p: Passages) -> np.ndarray:
    """Passages whose bound reaches the threshold for some item."""
    rare = ix.rare_first[1:] - ix.rare_first[:-1]
    hit = np.flatnonzero((term >= 0) & (rare[term] > 0)) if len(ix.terms) else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(hit, p.start), np.searchsorted(hit, p.end)
    passage = np.repeat(np.arange(len(p.row)), hi - lo)
    t = term[hit[index_ranges(lo, hi - lo)]]
    pair = np.unique(passage * len(ix.terms) + t)
    passage, t = pair // max(len(ix.terms), 1), pair % max(len(ix.terms), 1)
    n = rare[t]
    at = index_ranges(ix.rare_first[t], n)
    key = np.repeat(passage, n) * len(ix.ids) + ix.rare_item[at]
    key, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, ix.rare_weight[at], len(key)) + ix.aside[key % max(len(ix.ids), 1)]
    return np.unique(key[total >= ix.threshold - 1e-9] // max(len(ix.ids), 1))


def matches(ix: Index, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, passages) of verified items."""
    h, row = terms_of(buf, offsets)
    half = max(ix.longest, LEAST_PASSAGE // 2)
    term, p = ix.known(h), Passages(row, len(offsets) - 1, half)
    best: dict[tuple[int, int], list] = {}
    for k in hopeful(ix, term, row, p).tolist():
        a, z = int(p.start[k]), int(p.end[k])
        own = np.unique(term[a:z])
        for item, score in wand(ix, own[own >= 0].tolist()):
            words = np.unique(h[a:z])
            grams = np.unique(np.concatenate([_grams(h[a:z]), h[a:z]]))
            q = float(np.isin(ix.question[item], grams).mean()) if len(ix.question[item]) else 1.0
            w = float(np.isin(ix.answer[item], words).mean()) if len(ix.answer[item]) else 1.0
            if q >= QUESTION and w >= ANSWER:
                got = best.setdefault((int(p.row[k]), item), [0.0, 0.0, 0.0, 0])
                got[:3] = [max(x, y) for x, y in zip(got, (score, q, w))]
                got[3] += 1
    return [(r, i, *v) for (r, i), v in best.items()]


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            buf, off = string_buffer(pc.utf8_lower(b.column(1)))
            rows = []
            for i, j in pieces(off, PIECE):
                for r, item, score, q, w, n in matches(ix, buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                    rows.append((b.column(0)[i + r].as_py(), ix.ids[item], score, q, w, n))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [x.split()[0] for x in OUT.split(", ")])

    return run


def _stay(shared, at: int):
    """Rows in whose text no item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            buf, off = string_buffer(pc.utf8_lower(b.column(at)))
            stay = np.ones(b.num_rows, bool)
            for i, j in pieces(off, PIECE):
                for r, *_ in matches(ix, buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                    stay[i + r] = False
            yield b.filter(pa.array(stay))

    return run


def _with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard, number of words and distinct terms of each item that has words."""
    for b in batches:
        rows = [(k, w) for k, w in ((k, _terms(t)) for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if len(w)]
        terms = pa.array([np.unique(w).view(np.int64) for _, w in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(w) for _, w in rows], pa.int64()), terms], ["shard", "n", "terms"])


def _shards(items: DataFrame, threshold: float) -> Iterator:
    """Broadcast indexes of all items, one a shard."""
    own = {"question", "answer"} <= set(items.columns)
    items = items.select("item_id", text_of("text").alias("text"), *([text_of("question").alias("question"), text_of("answer").alias("answer")] if own else []))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    counted = materialize(items.select("text", shard.alias("shard")).mapInArrow(_with_shard, "shard long, n long, terms array<long>"))
    n, mean, longest = counted.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    terms = materialize(counted.select("shard", F.explode("terms").alias("term")))
    frequency = materialize(terms.groupBy("term").agg(F.count("*").alias("df")))
    for k in range(shards):
        rows = items.where(shard == k).collect()  # about SHARD_BYTES
        listed = [(r["item_id"], r["text"], *((r["question"], r["answer"]) if own else split_item(r["text"]))) for r in sorted(rows, key=str)]
        df = terms.where(F.col("shard") == k).select("term").distinct().join(frequency, "term").toPandas()  # the terms of these items
        known = Statistics(n, mean or 0.0, longest or 0, df["term"].to_numpy(np.int64).view(np.uint64), df["df"].to_numpy(np.int64))
        yield items.sparkSession.sparkContext.broadcast(Index(listed, threshold, known))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and test item that it contains.

    ``items`` has item_id and text, or also question and answer.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = None
    for shared in _shards(items, threshold):
        found = texts.mapInArrow(_find(shared), OUT)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in whose own text no test item was found, whatever their ids."""
    at, out = docs.columns.index(text_col), docs
    for k, shared in enumerate(_shards(items, threshold)):
        # between shards, so that a task holds one index
        out = (materialize(out) if k else out).mapInArrow(lean(_stay(shared, at)), docs.schema)
    return out
