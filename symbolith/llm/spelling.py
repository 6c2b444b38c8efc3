"""Spelling variant grouping: words one edit apart, by a positional q-gram index with a count filter.

1. **Count.** Runs of letters are counted in Arrow batches; what leaves a task are its distinct words.
2. **Shards.** One edit leaves the first or the second half of a word as it was. Each word goes, for a pair
   whose shorter word has its own length and for one whose shorter word is one shorter, to the shard of either
   half: words that agree in that long gram and its position. Shards of more than SHARD_WORDS words are dealt in
   blocks of words that are indexed, all words of the shard being queried against each block.
3. **Index.** A block's postings are lists of words by (length, position, 2-gram), words being padded by one
   mark on both sides. A word of L letters has L + 1 grams. Of a word of equal length that is one edit away, all
   but two are found at their own positions; of a word longer by one, all but one at their own or the next.
4. **Merge.** So any three of a query's lists (two, for longer words) hold each partner: the shortest are
   merged by a heap, and their words' counts are completed by binary search in the longer lists, until too many
   are missing. Words above the bound are verified by comparing letters.
5. Each word's near words are counted in its shards and summed; pairs are never written out. A pair is found
   in the shard of its first half, or else in that of its second.

A word's *form* is its commonest near word if that is ``ratio`` times as common or more; *roots* follow forms to the
last, by doubling: a chain of n forms takes log2(n) rounds, and is short as counts grow by ``ratio`` each step.

``mistakes`` (0: none) deletes one letter of a run where crc32("<id>:<run>") is a multiple of it, which plants
spelling mistakes in clean text.

Defined cases: a null text has no words; runs of a row without id get no mistake; a repeated row counts each
time; ties of counts go to the smallest word in code-point order; words longer than any bound are compared
like others; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

LETTERS = "A-Za-zÀ-ÿ"
#: Distinct words that a counting task holds at a time.
HELD_WORDS = 300_000
#: Words of a shard that one task indexes at a time.
SHARD_WORDS = 20_000
PAD = "\0"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower(text: str) -> str:
    """``text`` with A-Z lower-cased, and nothing else."""
    return text.encode().translate(_LOWER).decode()


def misspelt(run: str, seed: int, mistakes: int) -> str:
    """``run``, without one of its letters if its hash says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % mistakes:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(mistakes: int, letters: int):
    runs = re.compile(f"[{LETTERS}]{{{letters},}}").findall

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for id_, text in zip(b.column(0), b.column(1)):
                found = runs(lower(text.as_py() or ""))
                own = id_.as_py()
                if not mistakes or own is None:
                    total.update(found)
                else:
                    seed = zlib.crc32(f"{own}:".encode())
                    for run, n in Counter(found).items():
                        word = misspelt(run, seed, mistakes)
                        if len(word) >= letters:
                            total[word] += n
                if len(total) > HELD_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return words


def word_counts(docs: DataFrame, mistakes: int = 0, letters: int = 6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words of at least ``letters`` letters that occur ``least`` times or more in all of ``docs``."""
    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_count(mistakes, letters), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- Index -------------------------------------------------------------------


def grams(word: str) -> list[str]:
    """The padded 2-grams, by position."""
    padded = PAD + word + PAD
    return [padded[k : k + 2] for k in range(len(word) + 1)]


def one_replaced(a: str, b: str) -> bool:
    """Words of equal length differ in exactly one letter."""
    return sum(x != y for x, y in zip(a, b)) == 1


def one_longer(short: str, long: str) -> bool:
    """``long`` is ``short`` with one letter put in."""
    at = next((k for k, x in enumerate(short) if x != long[k]), len(short))
    return short[at:] == long[at + 1 :]


def _holds(postings: list[int], word: int) -> bool:
    at = bisect_left(postings, word)
    return at < len(postings) and postings[at] == word


class Index:
    """Postings of words, by length, position and 2-gram; words are numbered in the order they come."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.counts: list[int] = []
        self.postings: dict[tuple[int, int, str], list[int]] = defaultdict(list)

    def add(self, word: str, n: int) -> None:
        for at, gram in enumerate(grams(word)):
            self.postings[len(word), at, gram].append(len(self.words))
        self.words.append(word)
        self.counts.append(n)

    def _above(self, lists: list[list[list[int]]], missing: int) -> Iterator[int]:
        """Words that all but ``missing`` of a query's grams hold; each gram has the lists of its possible positions."""
        lists.sort(key=lambda own: sum(map(len, own)))
        short, rest = lists[: missing + 1], lists[missing + 1 :]
        last, hits = -1, 0
        for word in heapq.merge(*(x for own in short for x in own), (len(self.words),)):
            if word != last:
                if last >= 0:
                    gone = len(short) - min(hits, len(short))
                    for own in rest:
                        if gone > missing:
                            break
                        gone += not any(_holds(x, last) for x in own)
                    if gone <= missing:
                        yield last
                last, hits = word, 0
            hits += 1

    def near(self, word: str) -> Iterator[int]:
        """Words of equal length, smaller than ``word``, and words longer by one, that are one edit away."""
        found, size, none = self.postings, len(word), []
        own = [[found.get((size, at, g), none)] for at, g in enumerate(grams(word))]
        for k in self._above(own, 2):
            if self.words[k] < word and one_replaced(word, self.words[k]):
                yield k
        longer = [[x for x in (found.get((size + 1, at, g)), found.get((size + 1, at + 1, g))) if x] for at, g in enumerate(grams(word))]
        for k in self._above(longer, 1):
            if one_longer(word, self.words[k]):
                yield k


def _better(n: int, word: str, best: tuple[int, str] | None) -> bool:
    return best is None or n > best[0] or (n == best[0] and word < best[1])


NEAR = "word string, near long, best_n long, best string"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (shard, block, indexed rows first); near words are credited to both words of a pair."""
    index, shard, found = Index(), None, {}

    def credit(word: str, n: int, other: str) -> None:
        own = found.setdefault(word, [0, None])
        own[0] += 1
        if _better(n, other, own[1]):
            own[1] = (n, other)

    def out() -> pa.RecordBatch:
        rows = [(w, c, *best) for w, (c, best) in found.items()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], [x.split()[0] for x in NEAR.split(", ")])

    def ask(word: str, n: int, m: int, side: int) -> None:
        if len(word) > m:
            return  # a word longer by one is found by its shorter partners
        for k in index.near(word):
            other = index.words[k]
            if side and word[: m // 2] == other[: m // 2]:
                continue  # found in the shard of the first half
            credit(word, index.counts[k], other)
            credit(other, n, word)

    for b in batches:
        c = b.to_pydict()
        for key, block, query, both, word, n, m, side in zip(c["key"], c["block"], c["query"], c["both"], c["word"], c["n"], c["m"], c["side"]):
            if (key, block) != shard:
                index, shard = Index(), (key, block)
                if len(found) > HELD_WORDS:
                    yield out()
                    found.clear()
            if not query:
                # of an undivided shard, each word is asked when all smaller and all longer ones are in
                if both:
                    ask(word, n, m, side)
                index.add(word, n)
            else:
                ask(word, n, m, side)
    yield out()


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) that has near words."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    # with a word of m + 1 letters, the second half is as long as that of a word of m
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.left("word", half).alias("gram")), F.struct(F.lit(1).alias("side"), F.right("word", F.col("m") - half).alias("gram"))
    )
    rows = rows.select("word", "n", "m", F.explode(halves).alias("h")).select(F.xxhash64("m", "h.side", "h.gram").alias("key"), "word", "n", "m", "h.side")
    hot = rows.groupBy("key").agg(F.ceil(F.count("*") / shard_words).cast("int").alias("blocks")).where("blocks > 1")
    hot = small(hot)
    role = lambda q, both: (F.lit(q).alias("query"), F.lit(both).alias("both"))
    cold = rows.join(hot, "key", "left_anti").select("key", F.lit(0).alias("block"), *role(False, True), "word", "n", "m", "side")
    dealt = rows.join(hot, "key")
    indexed = dealt.select("key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), *role(False, False), "word", "n", "m", "side")
    asked = dealt.where(F.char_length("word") == F.col("m")).select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *role(True, False), "word", "n", "m", "side")
    all_ = cold.unionByName(indexed).unionByName(asked)
    # longer words first, then by word: so a word is asked when its longer and its smaller partners are in the index
    ordered = all_.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "query", F.char_length("word").desc(), "word")
    found = ordered.mapInArrow(_merge, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word of (word, form), following forms to the last."""
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = small(state.select(F.col("word").alias("_at"), F.col("root").alias("_next")))
        state = materialize(state.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("word", "root")


def variants(
    docs: DataFrame, mistakes: int = 0, letters: int = 6, least: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    words = materialize(word_counts(docs, mistakes, letters, least, id_col, text_col))
    near = near_words(words)
    out = materialize(words.join(near, "word", "left").withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))))
    last = roots(out.where("form is not null").select("word", "form"))
    form_n = F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n)
