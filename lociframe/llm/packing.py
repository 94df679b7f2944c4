"""Best-fit packing of documents into sequences by bin completion with branch and bound.

Only lengths matter for what fits together, and there are at most `capacity` of them. So the search works
on the histogram of lengths, whose size doesn't grow with the corpus, and its plan, a list of patterns with
how often each is used, is laid over the pieces by their rank within their length.

The search takes the largest length left, enumerates fillings of the room beside it, least waste and large
items first, leaves out those that another dominates (their items fit into the other's items), and uses the
best as often as the counts allow. It goes back to the next filling when the waste so far can't beat the
incumbent. The first incumbent is best-fit decreasing; a quick dive, which looks at a few fillings of each room
only, mostly reaches the lower bound. Where it doesn't, the search itself goes through all undominated fillings
and all numbers of times that each may be used. It ends at the lower bound, when there is nothing left to try, or
after `nodes` steps with the best packing found; all pieces are packed in any case. The result says how many
sequences are needed at least, and whether no packing has fewer (`bound`, `proved`): short of a proof there may be
a gap, as with several hundred sequences that only fill up without any waste.

Null texts count as empty: one end id. Repeated rows are packed as often as they occur; which of equally long
pieces goes where follows from the keys, and from nothing for rows that are the same in all of them. Texts of any
length are cut. Rows without doc_id are packed like others. An empty table gives no sequences. Extra columns of
pieces are kept by `pack`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import Scratch, carried, partitions, small_batches, tidy

Pattern = tuple[tuple[int, int], ...]  # (length, how many), descending


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by the sum, and for each size s, items over capacity - s take one each, and what is left of those over half must hold the rest down to s."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for s in [x for x in lengths if 2 * x <= capacity] + [0]:
        big = sum(n for k, n in counts.items() if k > capacity - s)
        mid = [(k, n) for k, n in counts.items() if capacity - s >= k and 2 * k > capacity]
        small = sum(k * n for k, n in counts.items() if s <= k and 2 * k <= capacity)
        n_mid = sum(n for _, n in mid)
        room = n_mid * capacity - sum(k * n for k, n in mid)
        best = max(best, big + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with how often each is used; sequences with equal contents are kept as one entry."""
    open_: dict[int, list[list]] = {}  # room left: entries [contents, how many]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = min(left, capacity // length)
                n = left // each
                open_.setdefault(capacity - each * length, []).append([((length, each),), n])
                left -= n * each
                continue
            entry = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = min(room // length, left)
            n = min(entry[1], left // each)
            open_.setdefault(room - each * length, []).append([(*entry[0], (length, each)), n])
            if n < entry[1]:
                open_.setdefault(room, []).append([entry[0], entry[1] - n])
            left -= n * each
    return [(tuple(e[0]), e[1]) for entries in open_.values() for e in entries]


#: Steps after which a filling counts as not dominated, which costs time only; fillings that a new one is held against.
DOMINANCE, AGAINST = 100, 20


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of a can be put into the items of b as if these were bins."""

    tries = DOMINANCE

    def place(i: int, rooms: tuple[int, ...]) -> bool:
        nonlocal tries
        tries -= 1
        return i == len(a) or (tries > 0 and any(rooms[j] >= a[i] and place(i + 1, rooms[:j] + (rooms[j] - a[i],) + rooms[j + 1 :]) for j in range(len(rooms))))

    return sum(a) <= sum(b) and place(0, b)


def fillings(room: int, counts: np.ndarray, lengths: list[int], most: int, tries: int = 400) -> list[tuple[int, ...]]:
    """Undominated multisets of items (descending) that fit into the room, least waste first; `most` of them, found in `tries` steps."""
    found: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    steps = 0

    def go(room_left: int, below: int, chosen: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        # the largest lengths first, each leaving less room for what follows
        at = int(np.searchsorted(lengths, min(room_left, below), "right")) - 1
        if room_left <= below and room_left and counts[room_left] - used.get(room_left, 0) > 0:
            found.append((0, (*chosen, room_left)))
            return len(found) >= most
        full = True
        while at >= 0 and steps < tries:
            x = lengths[at]
            if counts[x] - used.get(x, 0) > 0:
                full = False
                used[x] = used.get(x, 0) + 1
                stop = go(room_left - x, x, (*chosen, x))
                used[x] -= 1
                if stop:
                    return True
            at -= 1
        if full:
            found.append((room_left, chosen))
        return len(found) >= 4 * most or steps >= tries

    go(room, room, ())
    found.sort(key=lambda f: (f[0], tuple(-x for x in f[1])))
    out: list[tuple[int, ...]] = []
    for _, items in found:
        if items not in out and not any(len(items) <= 6 and len(o) <= 6 and dominated(items, o) for o in out):  # a dive only asks where it costs little
            out.append(items)
            if len(out) >= most:
                break
    return out or [()]


def _dive(counts: dict[int, int], capacity: int, nodes: int, most: int = 4) -> list[tuple[Pattern, int]]:
    """A good packing soon: `most` fillings of each room, each as often as it goes, from best-fit decreasing on."""
    best = best_fit_decreasing(counts, capacity)
    n_best, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    lengths = sorted(counts)
    stack: list[dict] = []
    used = waste = 0

    def undo(level: dict) -> None:
        nonlocal used, waste
        for k, m in level["pattern"]:
            left[k] += m * level["times"]
        used -= level["times"]
        waste -= level["waste"] * level["times"]

    while n_best > bound and nodes > 0:
        nodes -= 1
        while lengths and not left[lengths[-1]]:
            lengths.pop()
        forward = bool(lengths) and waste <= (n_best - 1) * capacity - total
        if forward:
            top = lengths[-1]
            left[top] -= 1
            level = {"choices": fillings(capacity - top, left, lengths, most), "top": top, "lengths": list(lengths) if len(stack) % 64 == 0 else None}
            left[top] += 1
            stack.append(level)
        else:
            if not lengths and used < n_best:
                best, n_best = [(lv["pattern"], lv["times"]) for lv in stack], used
                continue
            while stack:
                undo(stack[-1])
                if len(stack[-1]["choices"]) > 0:
                    break
                stack.pop()
            if not stack:
                break
            level = stack[-1]
            lengths = sorted(np.nonzero(left)[0].tolist())
        items = level["choices"].pop(0)
        names, many = np.unique([level["top"], *items], return_counts=True)
        level["pattern"] = tuple(zip(names[::-1].tolist(), many[::-1].tolist(), strict=True))
        level["times"] = int(min(left[k] // m for k, m in level["pattern"]))
        level["waste"] = capacity - level["top"] - sum(items)
        for k, m in level["pattern"]:
            left[k] -= m * level["times"]
        used += level["times"]
        waste += level["waste"] * level["times"]
    return best


class Packing(NamedTuple):
    """Patterns with how often each is used; sequences needed at least; whether no packing has fewer than this one."""

    patterns: list[tuple[Pattern, int]]
    bound: int
    proved: bool

    @property
    def size(self) -> int:
        return sum(n for _, n in self.patterns)


class _Spent(Exception):
    """The steps are used up."""


class _Search:
    """All packings that may beat the incumbent: sequences with the same largest item in the order of their fillings."""

    STEPS = 600  # lengths looked at, for each node

    def __init__(self, counts: dict[int, int], capacity: int, best: list[tuple[Pattern, int]], bound: int, nodes: int):
        self.capacity, self.best, self.bound, self.nodes, self.steps = capacity, best, bound, nodes, nodes * self.STEPS
        self.size, self.total = sum(n for _, n in best), sum(k * n for k, n in counts.items())
        self.left = dict(counts)
        self.used = self.waste = 0
        self.chosen: list[tuple[Pattern, int]] = []

    def budget(self) -> int:
        """Waste that a better packing may still have."""
        return (self.size - 1) * self.capacity - self.total - self.waste

    def _spend(self, steps: int) -> None:
        self.steps -= steps
        if self.steps <= 0:
            raise _Spent

    def fillings(self, room: int, least: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(waste, items descending) of every full, undominated filling, by waste from `least` on, then large items first."""
        lengths = sorted((k for k, n in self.left.items() if n and k <= room), reverse=True)
        self._spend(10 * len(self.left))  # what follows looks at each length several times
        left = {k: self.left[k] for k in lengths}
        reach, sums = 1, (1 << room + 1) - 1  # sums that the lengths can make at all
        for k in lengths:
            step = k
            while step <= room:
                reach |= reach << step & sums
                step *= 2
        seen: list[tuple[int, ...]] = []

        def exactly(want: int, at: int, items: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
            self._spend(len(lengths) - at + 1)
            if want == 0:
                yield items
                return
            for i in range(at, len(lengths)):
                k = lengths[i]
                if k <= want and left[k] and reach >> (want - k) & 1:
                    left[k] -= 1
                    yield from exactly(want - k, i, (*items, k))
                    left[k] += 1

        waste = least
        while waste <= min(room, self.budget()):
            if reach >> (room - waste) & 1:
                for items in exactly(room - waste, 0, ()):
                    self._spend(len(lengths) + DOMINANCE * len(seen))
                    if waste and any(left[k] and k <= waste for k in lengths):
                        continue  # not full
                    if len(items) <= 8 and any(len(o) <= 8 and dominated(items, o) for o in seen):  # of longer ones it isn't asked, which costs time only
                        continue
                    if len(seen) < AGAINST:
                        seen.append(items)
                    yield waste, items
            waste += 1

    def run(self) -> bool:
        """Whether the search came to its end, so that the best packing is proved to be one of the least."""
        stack: list[Iterator[bool]] = [self.level(None, None)]
        try:
            while stack and self.size > self.bound:
                if next(stack[-1], None) is None:
                    stack.pop()
                elif not any(self.left.values()):
                    if self.used < self.size:
                        self.best, self.size = list(self.chosen), self.used
                else:
                    top = max(k for k, n in self.left.items() if n)
                    last = self.last
                    stack.append(self.level(top, last if last and last[0] == top else None))
        except _Spent:
            return self.size == self.bound
        return True

    def level(self, top: int | None, after: tuple | None) -> Iterator[bool]:
        """Applies one choice after the other; between two, what hangs on the first is tried. after: the filling that the sequences with the same largest item have had."""
        if top is None:
            top, after = max(self.left), None
        self.left[top] -= 1
        choices = self.fillings(self.capacity - top, after[1] if after else 0)
        while True:
            found = next(choices, None)  # the largest item is out of the counts while the room beside it is filled
            self.left[top] += 1
            if found is None:
                return
            waste, items = found
            order = (top, waste, tuple(-x for x in items))
            if not after or order > after:
                names, many = np.unique([top, *items], return_counts=True)
                pattern = tuple(zip(names[::-1].tolist(), many[::-1].tolist(), strict=True))
                times = min(self.left[k] // m for k, m in pattern)
                if waste:
                    times = min(times, self.budget() // waste)
                while times > 0 and self.used + times < self.size and waste * times <= self.budget():
                    self.nodes -= 1
                    if self.nodes < 0:
                        raise _Spent
                    self._use(pattern, times, waste)
                    self.last = order
                    yield True
                    self._use(pattern, -times, waste)
                    times -= 1
            self.left[top] -= 1

    def _use(self, pattern: Pattern, times: int, waste: int) -> None:
        for k, m in pattern:
            self.left[k] -= m * times
        self.used += times
        self.waste += waste * times
        if times > 0:
            self.chosen.append((pattern, times))
        else:
            self.chosen.pop()


def search(counts: dict[int, int], capacity: int, nodes: int = 12_000) -> Packing:
    """The best packing found in `nodes` steps, and how good it is at least."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if not counts:
        return Packing([], 0, True)
    bound = lower_bound(counts, capacity)
    best = _dive(counts, capacity, nodes)
    if sum(n for _, n in best) == bound:
        return Packing(best, bound, True)
    whole = _Search(counts, capacity, best, bound, nodes)
    proved = whole.run()
    return Packing(whole.best, bound, proved)


def plan(counts: dict[int, int], capacity: int, nodes: int = 12_000) -> list[tuple[Pattern, int]]:
    """Patterns with how often each is used, covering exactly the counts."""
    return search(counts, capacity, nodes).patterns


class Layout:
    """The plan as arrays by length: ranks from `first` on go to a pattern's slots for that length, sequence after sequence."""

    def __init__(self, patterns: list[tuple[Pattern, int]], capacity: int):
        runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        taken, sequence = [0] * (capacity + 1), 0
        for pattern, times in patterns:
            at = 0
            for length, many in pattern:
                runs[length].append((taken[length], many, sequence, at))
                taken[length] += many * times
                at += many * length
            sequence += times
        order = [r for rs in runs for r in rs]
        self.starts = np.cumsum([0, *map(len, runs)])
        # one sorted key over all lengths: length and first rank
        self.key = np.array([length << 44 | r[0] for length, rs in enumerate(runs) for r in rs], np.int64)
        self.first, self.many, self.sequence, self.at = (np.array([r[i] for r in order], np.int64) for i in range(4))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks (from 0) within them."""
        run = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        copy, slot = np.divmod(rank - self.first[run], self.many[run])
        return self.sequence[run] + copy, self.at[run] + slot * length


def pack(pieces: DataFrame, capacity: int, keys: list[str], length: str = "length", nodes: int = 12_000) -> DataFrame:
    """pieces (lengths from 1 to capacity) with sequence_id and offset, and how good the packing is: sequences_least, the number of sequences needed at least, and proved, whether none has fewer than this one. `keys` tell pieces apart, for ranks that are the same when a task is run again.

    The driver gets one count for each length. Ranks within a length are counted in slices of it, so that a frequent
    length isn't in one task, and the slices' sums, as many as lengths times slices, are carried on.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "sequences_least", "proved")
    hist = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count("*")).collect()}  # at most `capacity` rows
    found = search(hist, capacity, nodes)
    layout = Layout(found.patterns, capacity)
    slices = max(8, partitions(spark))
    own = [*dict.fromkeys([length, *keys])]
    held = carried(pieces, *own).toDF(*(f"k{i}" for i in range(len(own))), "carried")  # no name of theirs can clash with ours
    size, order = "k0", [f"k{own.index(k)}" for k in keys]
    sliced = held.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sums = sliced.groupBy(size, "_slice").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy(size).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    ranked = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy(size, "_slice").orderBy(*order)))
    ranked = ranked.join(sums, [size, "_slice"]).withColumn("_rank", F.col("_rank") - 1 + F.coalesce("_before", F.lit(0)))
    kept = held.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = layout.place(b.column(size).to_numpy(zero_copy_only=False).astype(np.int64), b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    placed = ranked.select(*kept, "_rank").mapInArrow(tidy(place), ", ".join([*(f"`{c}` {t}" for c, t in held.dtypes), "sequence_id long", "offset long"]))
    own_columns = {c: F.col(f"k{i}") for i, c in enumerate(own)}
    others = {c: F.col("carried")[f"c{i}"] for i, c in enumerate(pieces.columns) if c not in own}
    return placed.select(*((own_columns.get(c, others.get(c))).alias(c) for c in pieces.columns), "sequence_id", "offset", F.lit(found.bound).alias("sequences_least"), F.lit(found.proved).alias("proved"))


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of documents(doc_id, text): doc_id, piece, start, length, ids_crc32 (and ids); only documents over the capacity are cut."""
    small_batches(docs.sparkSession)
    end = np.uint32(end_id).astype("<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = wordbpe.tokenizer(vocabulary)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), t.encode_all(b.column("text").to_pylist()), strict=True):
                ids += end
                for i, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, i, a // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, capacity: int, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, u32), of at most `capacity` ids each. doc_ids have to be unique here."""
    ids = cut(docs, vocabulary, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str, capacity: int = 4096) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity)


def packed_documents(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    import public_tokenizers

    pieces = Scratch(docs.sparkSession, "packing").table(cut(docs, public_tokenizers.path("word_bpe_49k.json"), capacity), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences_least", "proved")
