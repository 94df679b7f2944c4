"""Periodic runs of words, by a suffix automaton whose end-position sets are merged small into large.

A run is a stretch of words with least period q, at least max(LEAST, TIMES * q) long, that no neighbouring word
extends. In the automaton of a text a state stands for words strings with the same set of end positions; sets are
merged up the suffix links, the smaller into the larger, and kept in order. Where an inserted position becomes the
neighbour of another at a distance d of no more than the state's length, the d words before it repeat: a square.
Each square that no known run of its period holds is extended as far as words d apart are the same. Every run shows
up so: its last position and that one period before are neighbours in the state of their longest common string.

Only words that may lie in a run go into an automaton. A run is so long that each of its words lies in five words
of the run that occur in it twice; so words outside any five that occur twice in their stretch of the text can't be
in one. They are left out, which splits the text into stretches, until nothing more falls; most texts have none.

A text is one row and is worked on whole, in its task; memory is in proportion to its length. Null and empty texts
have no words and no runs. Ties between runs are broken as `strongest` says. Rows are judged each by itself, so
repeated rows get equal results, and an empty table none. Other columns are carried along; a column named like a
result's is replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WordHashes, shingles, small_batches, tidy

LEAST, TIMES = 6, 4
WIDTH, ROUNDS = 5, 12
_WORD = re.compile(r"[^ \t-\r]+")

Run = tuple[int, int, int]  # start, length, period


class Automaton:
    """Suffix automaton of a sequence of numbers. Transitions of all states are in one dictionary by state * letters + letter; `made` chains the letters of each state, for copies."""

    def __init__(self, sequence: list[int], letters: int):
        n = len(sequence)
        self.length, self.link, self.end = [0], [-1], [-1]  # end: the position that made the state; -1 for copies
        length, link, end = self.length, self.link, self.end
        go: dict[int, int] = {}
        made: list[tuple | None] = [None]
        last = 0
        for i, c in enumerate(sequence):
            new = len(length)
            length.append(i + 1)
            link.append(0)
            end.append(i)
            made.append(None)
            p = last
            while p >= 0 and (key := p * letters + c) not in go:
                go[key] = new
                made[p] = (c, made[p])
                p = link[p]
            if p >= 0:
                q = go[key]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(-1)
                    made.append(made[q])
                    at = made[q]
                    while at:
                        go[copy * letters + at[0]] = go[q * letters + at[0]]
                        at = at[1]
                    while p >= 0 and go.get(key := p * letters + c) == q:
                        go[key] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.size = n


class Ends:
    """Positions in order, in blocks of bounded size, so that a new one goes in without moving all others."""

    BLOCK = 1024
    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Puts x in its place and returns its neighbours."""
        blocks = self.blocks
        k = 0 if len(blocks) == 1 else max(0, bisect_right(blocks, x, key=_first) - 1)
        block = blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else blocks[k - 1][-1] if k else None
        after = block[at] if at < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        block.insert(at, x)
        self.size += 1
        if len(block) > self.BLOCK:
            half = len(block) // 2
            blocks.insert(k + 1, block[half:])
            del block[half:]
        return before, after


def _first(block: list[int]) -> int:
    return block[0]


def squares(sequence: list[int], letters: int) -> Iterator[tuple[int, int]]:
    """(end, period): new neighbours at a distance within their state's length, over all merges of end-position sets."""
    a = Automaton(sequence, letters)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in a.end]
    length, link = a.length, a.link
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, own = link[state], sets[state]
        sets[state] = None
        if up <= 0:
            continue  # the root's strings are empty
        large = sets[up]
        if large is None:
            sets[up] = own
            continue
        if large.size < own.size:
            large, own = own, large
        most = length[up]
        for x in own:
            before, after = large.insert(x)
            if before is not None and x - before <= most:
                yield x, x - before
            if after is not None and after - x <= most:
                yield after, after - x
        sets[up] = large


def _runs_of_stretch(words: list) -> list[Run]:
    letters: dict = {}
    seq = [letters.setdefault(w, len(letters)) for w in words]
    n = len(seq)
    known: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends of what was extended, in order
    least: dict[tuple[int, int], int] = {}
    for end, d in squares(seq, len(letters)):
        starts, ends = known.setdefault(d, ([], []))
        k = bisect_right(starts, end - 2 * d + 1)
        if k and ends[k - 1] >= end:
            continue
        lo, hi = end - d, end + 1
        while lo > 0 and seq[lo - 1] == seq[lo - 1 + d]:
            lo -= 1
        while hi < n and seq[hi] == seq[hi - d]:
            hi += 1
        starts.insert(k, lo)
        ends.insert(k, hi - 1)
        if hi - lo >= max(LEAST, TIMES * d):
            least[lo, hi] = min(d, least.get((lo, hi), d))
    return [(lo, hi - lo, d) for (lo, hi), d in least.items()]


def _stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of words that may lie in runs: covered by five words that occur twice in the stretch. After ROUNDS cuts a stretch stays as it is; that costs time, not runs."""
    out, todo = [], [(0, len(hashes), 0)]
    while todo:
        a, b, cuts = todo.pop()
        if b - a < LEAST:
            continue
        if cuts == ROUNDS:
            out.append((a, b))
            continue
        fives = shingles(hashes[a:b], WIDTH)
        order = np.argsort(fives, kind="stable")
        same = fives[order[1:]] == fives[order[:-1]]
        twice = np.zeros(len(fives), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.all():
            out.append((a, b))
            continue
        steps = np.zeros(b - a + 1, np.int32)
        at = np.nonzero(twice)[0]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + WIDTH, -1)
        held = np.concatenate([[False], np.cumsum(steps)[:-1] > 0, [False]])
        edges = np.nonzero(held[1:] != held[:-1])[0].tolist()
        parts = [(a + x, a + y, cuts + 1) for x, y in zip(edges[::2], edges[1::2], strict=True)]
        if len(parts) == 1 and parts[0][:2] == (a, b):
            out.append((a, b))
        else:
            todo += parts
    return out


def runs_of(words: list, hashes: np.ndarray) -> list[Run]:
    """All runs of a sequence of words, by start, then period. The hashes only tell which words needn't be looked at."""
    out: list[Run] = []
    for a, b in _stretches(hashes):
        out += [(a + start, length, period) for start, length, period in _runs_of_stretch(words[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, exactly; of equals that of least start, then of least period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2] or (r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps)[:-1] > 0


def with_tail(words: list[str], doc_id: int | None) -> list[str]:
    """The words as the query reads them: for a tenth of the ids a periodic tail takes the place of the end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


Batches = Iterator[pa.RecordBatch]
Edit = Callable[[list[str], int | None], list[str]]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def finding(text: str = "text", edit: Edit | None = None, key: str = "doc_id") -> Callable[[Batches], Batches]:
    """Adds the columns runs and collapsed to Arrow batches."""

    def run(batches: Batches) -> Batches:
        hashes = WordHashes()
        for b in batches:
            found, left = [], []
            keys = b.column(key).to_pylist() if edit else [None] * b.num_rows
            for k, t in zip(keys, b.column(text).to_pylist(), strict=True):
                words = _WORD.findall(t) if t else []
                if edit:
                    words = edit(words, k)
                runs = runs_of(words, hashes.of([*map(str.encode, words)])) if len(words) >= LEAST else []
                if runs:
                    words = [*compress(words, ~dropped(runs, len(words)))]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                left.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _RUNS), pa.array(left, pa.string())], names=[*b.schema.names, "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", edit: Edit | None = None, key: str = "doc_id") -> DataFrame:
    """docs with runs (array of start, length, period in words, by start, then period) and collapsed (the words no run holds after its first period, joined by spaces). edit(words, key) may change the words before. Rows stay where they are read."""
    docs = docs.drop("runs", "collapsed")
    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(finding(text, edit, key)), ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "runs array<struct<start: long, length: long, period: long>>", "collapsed string"]))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, some with periodic tails: number of runs, the strongest, digests of all runs and of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small_batches(spark)
    find = finding(edit=with_tail)

    def digest(batches: Batches) -> Batches:
        for b in find(batches):  # in one worker
            rows = []
            for doc, some, left in zip(*(b.column(c).to_pylist() for c in ("doc_id", "runs", "collapsed")), strict=True):
                runs = [(r["start"], r["length"], r["period"]) for r in some]
                best = strongest(runs)
                lines = "".join("%d,%d,%d\n" % r for r in runs)
                rows.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left))))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.mapInArrow(tidy(digest), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
