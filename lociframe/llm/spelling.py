"""Groups of spelling variants: words one code point apart, found through minimal acyclic automata.

Two words at a distance of one share a half: either the code points before the error or those behind it. So each
word goes to the groups of its halves, once as a word of its length and once as a word that is one code point longer
than its partner. Groups that share their first half meet in forward automata (of words as they are), groups that
share their second half in backward ones (of reversed words). An automaton is the minimal acyclic one of a block of
whole groups; its transitions carry how many words come before, so that the sum along a path is the word's number.
A word is looked up by following its half exactly and then allowing one error up to its end. Pairs that both
directions find are made one by a grouping.

Groups of more than CROWDED words are split: the stretch that may hold the error is halved, and words meet by what
is left on either side of it. That goes on until no group is crowded or the stretch is a single code point, so a
common beginning or ending, however frequent, is spread over tasks. The keys of crowded groups are at most one in
CROWDED / 2 of the rows, and only they are broadcast.

Null texts have no words. In the query a null doc_id counts as an empty string before the colon. Words of any length
are handled; equally frequent near words are taken in code-point order; repeated rows count as often as they occur.
An empty table gives no rows. Other columns of documents aren't used, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, small_batches, tidy

LEAST, TIMES = 7, 10
#: Words that a task counts before it hands them on; words of an automaton, unless a single group has more; words of a group that is split.
COUNTED, BLOCK, CROWDED = 300_000, 20_000, 50_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

Batches = Iterator[pa.RecordBatch]


class Automaton:
    """Minimal acyclic automaton of sorted words. Transitions are (state, words before): their sum along a word is its place in the order."""

    def __init__(self, words: list[str]):
        self.go: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.known: dict[tuple, int] = {}
        open_edges: list[list[tuple[str, int]]] = [[]]  # of the states along the last word, which may still grow
        ends, before = [False], ""
        for w in words:
            p = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                p += 1
            self._close(open_edges, ends, before, p)
            for _ in w[p:]:
                open_edges.append([])
                ends.append(False)
            ends[-1] = True
            before = w
        self._close(open_edges, ends, before, 0)
        self.root = self._state(ends[0], open_edges[0])
        del self.known

    def _close(self, open_edges: list, ends: list[bool], word: str, depth: int) -> None:
        while len(ends) > depth + 1:
            state = self._state(ends.pop(), open_edges.pop())
            open_edges[-1].append((word[len(ends) - 1], state))

    def _state(self, end: bool, edges: list[tuple[str, int]]) -> int:
        key = (end, *edges)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.go)
            total, go = int(end), {}
            for letter, to in edges:
                go[letter] = (to, total)
                total += self.count[to]
            self.go.append(go)
            self.final.append(end)
            self.count.append(total)
        return state

    def follow(self, state: int, number: int, rest: str) -> int:
        """Number of the word that rest completes, -1 if there is none."""
        go = self.go
        for letter in rest:
            step = go[state].get(letter)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str, a: int, b: int) -> Iterator[int]:
        """Numbers of words that differ from word by one replaced or inserted code point within word[a:b], found from the exact path along word[:a]."""
        go, state, number = self.go, self.root, 0
        for letter in word[:a]:
            step = go[state].get(letter)
            if step is None:
                return
            state, number = step[0], number + step[1]
        for i in range(a, b + 1):
            here, after, rest = word[i : i + 1], word[i + 1 : i + 2], word[i + 1 :]
            for letter, (to, before) in go[state].items():
                if letter == here:
                    continue  # the same word, or an insertion that a later place finds
                if i < b and (not after or after in go[to]) and (m := self.follow(to, number + before, rest)) >= 0:
                    yield m
                if (not here or here in go[to]) and (m := self.follow(to, number + before, word[i:])) >= 0:
                    yield m
            step = go[state].get(here) if i < b else None
            if step is None:
                return
            state, number = step[0], number + step[1]


def counting(edited: bool, least: int = LEAST) -> Callable[[Batches], Batches]:
    """(word, n) of Arrow batches (doc_id, text): words of `least` code points or more, as often as a task has met them since it last handed on."""
    found = re.compile(f"[a-z\xc0-\xff]{{{least},}}")

    def handed_on(total: dict[str, int]) -> Batches:
        words, counts = list(total), list(total.values())
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.string()), pa.array(counts[a : a + 50_000], pa.int64())], names=["word", "n"])

    def run(batches: Batches) -> Batches:
        total: dict[str, int] = {}
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                some = Counter(found.findall(text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()))
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for word, k in some.items():
                    if edited and not (h := crc32(word.encode(), start)) % 31:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + k
                if len(total) > COUNTED:
                    yield from handed_on(total)
                    total = {}
        yield from handed_on(total)

    return run


def word_counts(docs: DataFrame, edited: bool = False, least: int = LEAST) -> DataFrame:
    """(word, n) of docs(doc_id, text): maximal runs of Latin letters, A-Z lower-cased, of `least` code points or more. edited: the query's planted slips, a code point left out of some words of each document."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(counting(edited, least)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the key of their group: what stands on either side of the stretch from a to b, where the error is."""
    behind = F.expr("substring(form, b + 1 + longer)")
    return rows.withColumn("key", F.concat(F.expr("substring(form, 1, a)"), F.lit("|"), behind))


def _halves(words: DataFrame, least: int) -> DataFrame:
    """Each word forward and backward, of its own length and as one longer than its partner."""
    n = F.length("word")
    both = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), n.alias("size")).where(F.col("size") - F.col("longer") >= least)
    half = F.floor((F.col("size") - F.col("longer")) / 2).cast("int")
    both = both.withColumn("c", F.col("size") - F.col("longer")).withColumn("half", half)
    side = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("form"), F.col("half").alias("a")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("form"), (F.col("c") - F.col("half")).alias("a"))))
    return _keyed(both.select("n", "longer", "c", side.alias("s")).select("s.backward", "s.form", "n", "longer", "c", "s.a", F.col("c").alias("b")))


GROUP = ["backward", "c", "a", "b", "key"]


def _uncrowded(rows: DataFrame, scratch: Scratch, crowded: int) -> DataFrame:
    """rows in groups of at most `crowded`, or of a single code point that may be wrong."""
    done, level = None, 0
    while True:
        large = rows.where("b - a > 1").groupBy(*GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).drop("_n")
        large = scratch.table(large, f"crowded-{level}")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large)
        rest = rows.join(large, GROUP, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        split = rows.join(large, GROUP, "left_semi").withColumn("_m", F.expr("cast(floor((a + b) / 2) as int)"))
        parts = F.explode(F.array(F.struct(F.col("a").alias("_a"), F.col("_m").alias("_b")), F.struct(F.col("_m").alias("_a"), F.col("b").alias("_b"))))
        rows = split.withColumn("_p", parts).withColumn("a", F.col("_p._a")).withColumn("b", F.col("_p._b")).drop("_p", "_m", "key")
        rows = scratch.table(_keyed(rows), f"split-{level}")
        level += 1


def near_words(words: DataFrame, scratch: Scratch | None = None, least: int = LEAST, crowded: int = CROWDED) -> DataFrame:
    """(word, n, near, near_n) of words(word, n), once for each ordered pair of words that differ by exactly one code point."""
    scratch = scratch or Scratch(words.sparkSession, "spelling")

    def block_pairs(zone: tuple, block: list[tuple[str, int]]) -> pa.RecordBatch:
        backward, c, a, b = zone
        block.sort()
        forms = [f for f, _ in block]
        names = [f[::-1] for f in forms] if backward else forms
        automaton = Automaton(forms)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, (form, n) in enumerate(block):
            if len(form) != c:
                continue
            for m in automaton.near(form, a, b):
                both = [(names[i], n), (names[m], block[m][1])]
                for (word, k), (near, near_k) in (both, both[::-1]) if len(forms[m]) > c else (both,):
                    for column, x in zip(out, (word, k, near, near_k), strict=True):
                        column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "near", "near_n"])

    def run(batches: Batches) -> Batches:
        zone, key, block = None, None, []
        for batch in batches:
            for *at, k, form, n in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "form", "n")), strict=True):
                if tuple(at) != zone or (k != key and len(block) >= BLOCK):
                    if len(block) > 1:
                        yield block_pairs(zone, block)
                    block = []
                zone, key = tuple(at), k
                block.append((form, n))
        if len(block) > 1:
            yield block_pairs(zone, block)

    rows = _uncrowded(_halves(words, least), scratch, crowded).select(*GROUP, "form", "n")
    met = rows.repartition(partitions(words.sparkSession), *GROUP).sortWithinPartitions(*GROUP)
    pairs = met.mapInArrow(tidy(run), "word string, n long, near string, near_n long")
    return pairs.repartition(partitions(words.sparkSession), "word").groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def variants(words: DataFrame, scratch: Scratch | None = None, least: int = LEAST, times: int = TIMES, crowded: int = CROWDED) -> DataFrame:
    """words(word, n) with n_near, form (the near word of largest n, if that is `times` as large; ties: least in code-point order), form_n and root (the last of the forms from word on).

    Each form is `times` as frequent as what it stands for, so chains have few steps; roots double them each round.
    """
    spark = words.sparkSession
    scratch = scratch or Scratch(spark, "spelling")
    best = near_words(words, scratch, least, crowded).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    frequent = -F.col("best.less") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).cast("long").alias("form_n"))
    found = scratch.table(found, "forms")
    ahead, level = found.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = scratch.table(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{level}")
        if level:
            scratch.drop(f"roots-{level - 1}")
        if ahead.where("moved").isEmpty():
            break
        ahead, level = ahead.drop("moved"), level + 1
    return found.join(ahead.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents, some with a code point left out, that occur twice or more: near words, forms, roots."""
    scratch = Scratch(spark, "spelling")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(scratch.table(word_counts(docs, edited=True).where("n >= 2"), "words"), scratch)
