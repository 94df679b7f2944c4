"""N-gram Jaccard join with PartEnum signatures, and the classes of near copies.

A document's set holds the hashes of its five-word runs. Sets with equal contents are one node. For two sets
with |A and B| >= t |A or B| the symmetric difference is at most (1-t)/(1+t) (|A| + |B|) =: k.

Frequent hashes, which common lines and passages bring, are left out of the domain: a symmetric difference only
shrinks by that, so the bound holds, and sets don't sign for what half the corpus shares. Which hashes count as
frequent (a bounded list) bears on the cost only.

Signatures. Sizes are cut into bands; a set signs for its own band and for the next one if a partner may be
there, so any two similar sets sign for a common band with greatest size hi and k = (1-t)/(1+t) 2 hi. The
domain of hashes is dealt to n1 parts of 3 cells each. k differences leave at least n1 - k//2 parts with one
difference or none, and in such a part two of three cells agree. So each part gives three signatures, the
contents of two of its cells, and similar sets share n1 - k//2. Empty contents aren't signed: they would be
shared by all. A part is weak for a set if two of its cells are empty. A set with fewer than n1 - k//2 weak
parts shares a signed signature with every partner. Sets with more weak parts also sign the prefix of their
hashes, frequent ones last, |A| - ceil(t |A|) + 1 of them, of which two such sets share one if they are similar.
So no link is lost. Signatures travel as four bytes within the part of the shuffle that all eight chose, and a
band has parts of its own, so a pair meets in few of them. What meets by chance is pruned below.

Candidates. Sets that share a signature with few others are paired. A signature of more than FEW sets links these
to the least of them instead, first within a task, then among the tasks' least ones; it never gives all pairs.
Pairs and links travel packed by bucket, where repeated ones fall away. A distinct pair stays if its sizes and
its sketches allow it: a sketch has the parities of a set's hashes by bit, and two sketches differ in no more
bits than the sets do in hashes, so no similar pair is dropped. All similar pairs lie within the components of
the links and of the pairs that stay.

Verification. The sets of a component meet in blocks of bounded size, each pair of blocks in one task. There,
sets that one set is similar to are joined with it at once; pairs that are in one class already are passed
over; the rest is found by an index over prefixes, rarest hashes first, and counted exactly. Blocks return
classes as stars, not pairs. Before that, the sets of a component of several blocks are held against its least
set, block by block: those similar to it are one class, and only the rest meets everything. So a large group
around one text costs what it holds, not its square.

Null texts and those without words have no set and no link. Repeated rows are copies of one another. Rows
without doc_id take part and may bridge others, but give no class its id; a class of such rows only has none.
Ties don't arise: ids are compared as numbers. Very long texts are one set each; a block holds at least one. An
empty table gives an empty table. Extra columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, M2, U, Scratch, WordHashes, carried, may_occur, mix, partitions, restored, shingles, small_batches, tidy
from .components import components

WORDS, CELLS = 5, 3
#: Sets that a signature pairs one by one.
FEW = 24
#: A hash is frequent if tasks that see it twice or more among COUNTED hashes see it FREQUENT times in all; at most LISTED are taken.
COUNTED, FREQUENT, LISTED = 4_000_000, 48, 1_000_000
#: Similarity as a fraction, so that sizes are compared exactly.
NUM, DEN = 80, 100
#: Greatest size of a band over its least, signatures that a task gathers before it deals them out, and hashes in a block.
BAND, GATHERED, BLOCK = 1.35, 500_000, 1 << 21


def _bands(upto: int = 1 << 40) -> np.ndarray:
    """Greatest sizes of the bands."""
    out, lo = [], 1
    while lo < upto:
        out.append(max(lo, int(lo * BAND)))
        lo = out[-1] + 1
    return np.array(out)


BANDS = _bands()


def differences(hi: int) -> int:
    """Greatest symmetric difference of two similar sets of at most hi hashes: 2 hi (1-t)/(1+t)."""
    return 2 * hi * (DEN - NUM) // (DEN + NUM)


def parts_of(hi: int) -> tuple[int, int]:
    """n1, and the most weak parts that a safe set may have. Some parts more than k//2 + 1 allow for weak ones."""
    k = differences(hi)
    spare = 2 + k // 16
    return k // 2 + 1 + spare, spare


class Routes:
    """Which part of the shuffle a signature goes to. A band has parts of its own, as many as its share of all signatures asks for, so a set's
    signatures go to few parts. The last ones are for prefixes. sets: (band, sets in it, hashes of their prefixes).
    """

    def __init__(self, sets: list[tuple[int, int, int]], parts: int):
        weight, prefixes = np.zeros(len(BANDS) + 1), 0.0
        for band, n, prefix in sets:
            weight[band] += n * CELLS * parts_of(int(BANDS[band]))[0]
            weight[band + 1] += n * CELLS * parts_of(int(BANDS[band + 1]))[0] / 2  # about half of them sign there too
            prefixes += prefix
        weight[-1] = prefixes
        self.counts = np.maximum(1, np.round(parts * weight / max(1.0, weight.sum()))).astype(np.int64) * (weight > 0)
        self.starts = np.cumsum(self.counts) - self.counts
        self.parts = max(1, int(self.counts.sum()))

    def of(self, sigs: np.ndarray, bands: np.ndarray) -> np.ndarray:
        return self.starts[bands] + (mix(sigs ^ U(5)) % np.maximum(self.counts[bands], 1).astype(U)).astype(np.int64)


#: The band of prefixes.
PREFIXES = len(BANDS)


def prefix_length(n: np.ndarray | int):
    return n - -(-n * NUM // DEN) + 1


def shingle_set(hashes: WordHashes, text: str | None) -> np.ndarray:
    return np.unique(shingles(hashes.of(text.encode().lower().split()), WORDS)) if text else np.zeros(0, U)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def signatures(sets: list[np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, the index of the set each belongs to, and the band."""
    sizes = np.array([len(s) for s in sets])
    common = _among(np.concatenate(sets), frequent)
    ends = np.cumsum(sizes)
    rare = [s[~common[e - len(s) : e]] for s, e in zip(sets, ends.tolist(), strict=True)]
    left = np.array([len(r) for r in rare])
    own = np.searchsorted(BANDS, sizes)
    sigs, owners, bands = [], [], []
    safe = np.ones(len(sets), bool)
    # the band, and the next one for sets that may have a larger partner there
    jobs = [(i, int(b)) for i, b in enumerate(own)] + [(i, int(b) + 1) for i, b in enumerate(own) if sizes[i] * DEN // NUM > BANDS[b]]
    jobs.sort(key=lambda j: j[1])
    at = 0
    while at < len(jobs):
        band = jobs[at][1]
        end = at
        while end < len(jobs) and jobs[end][1] == band:
            end += 1
        members = np.array([j[0] for j in jobs[at:end]])
        at = end
        n1, weak_most = parts_of(int(BANDS[band]))
        seed = mix(np.array([band + 1], U) * M1)[0]
        flat = np.concatenate([rare[i] for i in members])
        row = np.repeat(np.arange(len(members)), left[members])
        held = np.zeros(len(members) * n1 * CELLS, U)
        if len(flat):
            z = mix(flat ^ seed)
            cell = row * (n1 * CELLS) + (z % U(n1 * CELLS)).astype(np.int64)
            # the cell's contents as the sum of its hashes, in any order
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.nonzero(np.diff(cell, prepend=-1))[0]
            held[cell[first]] = np.add.reduceat(mix(z[order] + U(band + 7)), first)
        held = held.reshape(-1, n1, CELLS)
        full = held != 0  # a sum of hashes that is 0 by chance counts as empty, for all sets alike
        safe[members[(full.sum(2) <= 1).sum(1) > weak_most]] = False
        tags = mix(np.arange(n1 * CELLS, dtype=np.uint64).reshape(n1, CELLS) ^ (seed + U(1)))
        for q, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            some = np.nonzero(full[:, :, a] | full[:, :, b])
            sigs.append(mix(mix(held[:, :, a][some] + tags[some[1], q]) * M1 + held[:, :, b][some]))
            owners.append(members[some[0]])
            bands.append(np.full(len(some[0]), band))
    for i in np.nonzero(~safe)[0].tolist():
        n = len(sets[i])
        last = common[ends[i] - n : ends[i]]
        prefix = np.concatenate([sets[i][~last], sets[i][last]])[: prefix_length(n)]  # sets are sorted
        sigs.append(mix(prefix ^ M1))
        owners.append(np.full(len(prefix), i))
        bands.append(np.full(len(prefix), PREFIXES))
    return (np.concatenate(sigs), np.concatenate(owners), np.concatenate(bands)) if sigs else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))


NONE = np.zeros((0, 2), np.int64)


def grouped(sigs: np.ndarray, nodes: np.ndarray, large: np.ndarray, last: bool, bands: np.ndarray | None = None) -> tuple:
    """(sigs, nodes, large) to hand on, links (node, least) of large groups, if this is the last step pairs (a, b) of the others, and the bands handed on.

    large: the node stands for more than FEW sets that a task has linked to it already.
    """
    bands = np.zeros(len(sigs), np.int8) if bands is None else bands
    order = np.lexsort((nodes, sigs))
    s, x, big, bands = sigs[order], nodes[order], large[order], bands[order]
    if not len(s):
        return s, x, big, NONE, NONE, bands
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])
    big = np.logical_or.reduceat(big, np.nonzero(new)[0])  # one set from several tasks
    s, x, bands = s[new], x[new], bands[new]
    cuts = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
    sizes = np.diff(np.append(cuts, len(s)))
    wide = (sizes > FEW) | np.logical_or.reduceat(big, cuts)
    in_wide, hub = np.repeat(wide, sizes), np.repeat(x[cuts], sizes)
    other = in_wide & (x != hub)
    links = distinct(np.stack([x[other], hub[other]], 1))
    if not last:
        return s[~other], x[~other], in_wide[~other], links, NONE, bands[~other]
    found = [NONE]
    for size in np.unique(sizes[~wide & (sizes > 1)]).tolist():
        at = cuts[~wide & (sizes == size)]
        found += [np.stack([x[at + i], x[at + j]], 1) for i in range(size) for j in range(i + 1, size)]
    return s, x, in_wide, links, distinct(np.concatenate(found)), bands


def distinct(pairs: np.ndarray) -> np.ndarray:
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of a set's hashes by bit, over the power of two bits from twice the set's size on."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((mix(hashes ^ M2) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_be_similar(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Whether sizes n, m and the sketches x, y leave room for similar sets. The longer sketch folds to the shorter."""
    if DEN * min(n, m) < NUM * max(n, m):
        return False
    a, b = sorted((np.frombuffer(x, U), np.frombuffer(y, U)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), 0)
    return int(np.bitwise_count(a ^ b).sum()) * (DEN + NUM) <= (DEN - NUM) * (n + m)


#: What travels: kind s(ignatures), m(embers), k (sketches), l(inks) or p(airs), and their arrays.
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.string()), *((f"c{i}", pa.binary()) for i in range(4))])
PACKED = "part int, kind string, c0 binary, c1 binary, c2 binary, c3 binary"
#: m: doc_id, node (null: no set), size, hash of the text; k: node, -, size, -, sketch; l and p: two nodes.
FOUND = "kind string, a long, b long, n long, text_hash long, sketch binary"
_FOUND = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("text_hash", pa.int64()), ("sketch", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema = _PACKED) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _found(kind: str, rows: int, **columns) -> pa.RecordBatch:
    given = {"kind": [kind] * rows} | columns
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in _FOUND], schema=_FOUND)


def _dealt(kind: str, pairs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Links or pairs on their way to a bucket, one row each."""
    if not len(pairs):
        return
    bucket = (mix(pairs[:, 0].view(U) ^ mix(pairs[:, 1].view(U))) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[order], bucket[order]
    cuts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    yield _rows([(int(bucket[a]), kind, pairs[a:b].tobytes(), b"", b"", b"") for a, b in zip(cuts, np.append(cuts, len(pairs))[1:], strict=True)])


def census(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Sorted hashes that many documents share, at most LISTED, and for each band its sets and the hashes of their prefixes. Tasks name what they see twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def out() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held if len(s)], np.int64)
            bands, at, sets = np.unique(np.searchsorted(BANDS, sizes), return_inverse=True, return_counts=True)
            prefixes = np.bincount(at, prefix_length(sizes), len(bands)).astype(np.int64)
            met = np.concatenate(held)
            held.clear()
            met.sort()  # in place
            values, counts = np.unique(met[1:][met[1:] == met[:-1]], return_counts=True)
            counts, n = counts + 1, len(values)
            columns = (np.full(n, -1), bands, bands), (values.view(np.int64), np.zeros(len(bands), np.int64), np.ones(len(bands), np.int64)), (counts, sets, prefixes)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["band", "h", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(shingle_set(hashes, t))
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    size = 0
        if held:
            yield out()

    counts = docs.select("text").mapInArrow(tidy(count), "band long, h long, n long")
    # of a band, h is 0 for the number of sets and 1 for that of hashes
    counts = scratch.table(counts.groupBy("band", "h").agg(F.sum("n").alias("n")).where((F.col("band") >= 0) | (F.col("n") >= FREQUENT)), "counts")
    bands = counts.where("band >= 0").groupBy("band").agg(F.sum(F.col("n") * (1 - F.col("h"))).alias("sets"), F.sum(F.col("n") * F.col("h")).alias("prefixes")).collect()  # at most len(BANDS) rows
    counts = counts.where("band < 0")
    # most frequent first, by powers of two: as far down as LISTED allows
    steps = counts.groupBy(F.floor(F.log2(F.col("n") / FREQUENT)).alias("step")).agg(F.count("*").alias("c")).orderBy(F.desc("step")).collect()  # at most 64 rows
    least, taken = None, 0
    for r in steps:
        taken += r.c
        if taken > LISTED:
            break
        least = r.step
    found = np.zeros(0, U)
    if least is not None:
        rows = counts.where(F.floor(F.log2(F.col("n") / FREQUENT)) >= least).select("h").toArrow()["h"].to_numpy()
        found = np.sort(rows.view(np.uint64))
    return found, [tuple(r) for r in bands]


def sign(docs: DataFrame, routes: Routes, frequent: np.ndarray) -> DataFrame:
    """One pass over documents(doc_id, text, text_hash), a shuffle by signature and one of what was found. Columns as in FOUND."""
    known, parts = docs.sparkSession.sparkContext.broadcast(frequent), routes.parts  # at most LISTED hashes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sets: dict[int, np.ndarray] = {}
        gathered = 0

        def out() -> Iterator[pa.RecordBatch]:
            names = np.array(list(sets), np.int64)
            for a in range(0, len(names), 1000):
                some, held = names[a : a + 1000], list(sets.values())[a : a + 1000]
                sizes = np.array([len(s) for s in held], np.int64)
                yield _rows([(int(some[0]) % parts, "k", some.tobytes(), sizes.tobytes(), b"".join(map(sketch, held)), b"")])
            sigs, owners, bands = signatures(list(sets.values()), known.value)
            sigs, nodes, large, links, _, bands = grouped(sigs, names[owners], np.zeros(len(sigs), bool), False, bands)
            yield from _dealt("l", links, parts)
            part = routes.of(sigs, bands)
            order = np.lexsort((nodes, part))
            sigs, nodes, large, part = sigs[order], nodes[order], large[order], part[order]
            cuts = np.nonzero(np.diff(part, prepend=-1))[0]
            rows, size = [], 0
            for a, b in zip(cuts, np.append(cuts, len(part))[1:], strict=True):
                new = np.nonzero(np.diff(nodes[a:b], prepend=~nodes[a : a + 1]))[0]
                counts = np.diff(np.append(new, b - a))
                rows.append((int(part[a]), "s", nodes[a:b][new].tobytes(), counts.astype("<u2" if counts.max() < 1 << 16 else "<u4").tobytes(), np.packbits(large[a:b]).tobytes(), (sigs[a:b] >> U(32)).astype("<u4").tobytes()))
                size += 8 * (b - a)
                if size > 1 << 21:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

        for b in batches:
            ids, sizes, nodes = b.column("doc_id"), [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(hashes, text)
                sizes.append(len(s))
                node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                nodes.append(node)
                if node is not None and node not in sets:
                    sets[node] = s
                    gathered += len(s)
                if gathered >= GATHERED:
                    yield from out()
                    sets.clear()
                    gathered = 0
            if sizes:
                # no set and no doc_id are flags
                flags = np.array([(x is not None) + 2 * (d is None) for d, x in zip(ids.to_pylist(), nodes, strict=True)], np.int64)
                doc = np.array([d or 0 for d in ids.to_pylist()], np.int64)
                yield _rows([(int(doc.sum() % parts), "m", np.stack([doc, flags]).tobytes(), np.array([x or 0 for x in nodes], np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), np.array(b.column("text_hash").to_pylist(), np.int64).tobytes())])
        if sets:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, large = [], [], []
        for b in batches:
            signed = pa.compute.equal(b.column("kind"), "s")
            rest = b.filter(pa.compute.invert(signed))
            if rest.num_rows:
                yield rest
            for x, counts, big, s in zip(*(b.filter(signed).column(f"c{i}").to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(x, np.int64)
                counts = np.frombuffer(counts, "<u2" if len(counts) == 2 * len(x) else "<u4")
                nodes.append(np.repeat(x, counts))
                sigs.append(np.frombuffer(s, "<u4"))
                large.append(np.unpackbits(np.frombuffer(big, np.uint8), count=len(sigs[-1])).astype(bool))
        if sigs:
            sigs, nodes, large = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(large)
            *_, links, pairs, _ = grouped(sigs, nodes, large, True)
            yield from _dealt("l", links, parts)
            yield from _dealt("p", pairs, parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, list[np.ndarray]] = {"l": [], "p": []}
        for b in batches:
            for kind, *c in zip(*(b.column(x).to_pylist() for x in _PACKED.names[1:]), strict=True):
                if kind in pairs:
                    pairs[kind].append(np.frombuffer(c[0], np.int64).reshape(-1, 2))
                elif kind == "m":
                    docs, flags = np.frombuffer(c[0], np.int64).reshape(2, -1)
                    node, size, text = (np.frombuffer(x, np.int64) for x in c[1:])
                    yield _found("m", len(docs), a=pa.array(docs, mask=(flags & 2) > 0), b=pa.array(node, mask=(flags & 1) == 0), n=size, text_hash=text)
                else:
                    node, size = np.frombuffer(c[0], np.int64), np.frombuffer(c[1], np.int64)
                    ends = np.cumsum([1 << max(3, (2 * n - 1).bit_length() - 3) for n in size.tolist()]).tolist()
                    yield _found("k", len(node), a=node, n=size, sketch=[c[2][i:j] for i, j in zip([0, *ends], ends, strict=False)])
        for kind, some in pairs.items():
            some = distinct(np.concatenate(some)) if some else NONE
            for a in range(0, len(some), 100_000):
                x, y = np.ascontiguousarray(some[a : a + 100_000].T)
                yield _found(kind, len(x), a=x, b=y)

    dealt = docs.mapInArrow(tidy(deal), PACKED).repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(tidy(meet), PACKED).repartitionById(parts, F.col("part")).mapInArrow(tidy(gather), FOUND)


def pruned(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    pairs = found.where("kind = 'p'").select("a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = found.where("kind = 'k'").select(F.col("a").alias("node"), "n", "sketch").join(ends, "node", "left_semi").dropDuplicates(["node"])
    known = scratch.table(known, "sketches")
    of = lambda end: known.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_be_similar(*x) for x in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(possible), "a long, b long")


class BlockJoin:
    """Classes of similar sets among those of one task."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        values, self.rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.count = count
        # hashes by how many sets hold them, rarest first; each set sorted that way
        place = np.empty(len(values), np.int64)
        place[np.lexsort((np.arange(len(values)), count))] = np.arange(len(values))
        self.rank = place[self.rank]
        row = np.repeat(np.arange(len(sets)), self.sizes)
        self.rank = self.rank[np.lexsort((self.rank, row))]
        self.row = row
        self.above = np.arange(len(sets))

    def classes(self, of: np.ndarray) -> np.ndarray:
        """The least set of each one's class."""
        found = self.above[of]
        while (higher := self.above[found]) is not None and (higher != found).any():
            found = higher
        return found

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that set i is similar to, by exact counts."""
        own = self.rank[self.starts[i] : self.ends[i]]
        lengths = self.sizes[others]
        at = np.repeat(self.starts[others] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        held = self.rank[at]
        pos = np.searchsorted(own, held)
        pos[pos == len(own)] = 0
        both = np.add.reduceat(own[pos] == held, np.cumsum(lengths) - lengths)
        return others[DEN * both >= NUM * (self.sizes[i] + lengths - both)]

    def fits(self, i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.sizes[i], self.sizes[others]), np.maximum(self.sizes[i], self.sizes[others])
        return others[DEN * small >= NUM * large]

    def join(self, i: int, found: np.ndarray) -> None:
        some = np.append(found, i)
        roots = self.classes(some)
        self.above[roots] = self.above[some] = roots.min()

    def run(self) -> np.ndarray:
        n = len(self.sizes)
        everyone = np.arange(n)
        # sets around which many lie: one look each at all others
        tried: set[int] = set()
        for _ in range(16 if n > 64 else 0):
            classes = self.classes(everyone)
            alone = everyone[np.bincount(classes, minlength=n)[classes] == 1]
            if len(alone) < 64:
                break
            weight = np.add.reduceat(self.count_of(), self.starts) / self.sizes
            hub = max((int(i) for i in alone if int(i) not in tried), key=lambda i: weight[i], default=None)
            if hub is None:
                break
            tried.add(hub)
            others = self.fits(hub, everyone[everyone != hub])
            found = self.similar(hub, others) if len(others) else others
            self.join(hub, found)
            if len(found) * 50 < len(alone):
                break
        # the rest by shared prefix hashes
        prefix = prefix_length(self.sizes)
        within = np.arange(len(self.rank)) - np.repeat(self.starts, self.sizes)
        some = within < np.repeat(prefix, self.sizes)
        rank, row = self.rank[some], self.row[some]
        order = np.lexsort((row, rank))
        rank, row = rank[order], row[order]
        cuts = np.nonzero(np.diff(rank, prepend=-1))[0]
        ends = np.append(cuts[1:], len(rank))
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))  # place in the index of each prefix hash, set after set
        run = np.repeat(np.arange(len(cuts)), ends - cuts)
        own_ends = np.cumsum(prefix)
        for i in range(n):
            runs = run[where[own_ends[i] - prefix[i] : own_ends[i]]]
            runs = runs[ends[runs] - cuts[runs] > 1]
            if not len(runs):
                continue
            others = np.unique(np.concatenate([row[cuts[r] : ends[r]] for r in runs]))
            others = others[others > i]
            others = others[self.classes(others) != self.classes(np.array([i]))]
            others = self.fits(i, others)
            if len(others):
                found = self.similar(i, others)
                if len(found):
                    self.join(i, found)
        return self.classes(everyone)

    def count_of(self) -> np.ndarray:
        if not hasattr(self, "_held"):
            self._held = np.bincount(self.rank)[self.rank].astype(np.float64)
        return self._held


def near_least(blocks: DataFrame) -> DataFrame:
    """(node, c): the sets similar to their component's least one. blocks: c, own, node, hashes; the least set is in each block."""

    def run(pdf):
        import pandas as pd

        nodes, c = pdf["node"].to_numpy(), int(pdf["c"].iloc[0])
        block = BlockJoin([np.frombuffer(h, U) for h in pdf["hashes"]])
        least, others = int(np.nonzero(nodes == c)[0][0]), np.nonzero(nodes != c)[0]
        others = block.fits(least, others)
        found = nodes[block.similar(least, others)] if len(others) else nodes[:0]
        return pd.DataFrame({"node": found, "c": np.full(len(found), c)})

    return blocks.groupBy("c", "own").applyInPandas(run, "node long, c long")


def verify(candidates: DataFrame) -> DataFrame:
    """Links (a, b) that span the classes of similar sets. candidates: block key columns c, i, j, then node, hashes, near (of one class already)."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        nodes, near = pdf["node"].to_numpy(), np.nonzero(pdf["near"].to_numpy())[0]
        block = BlockJoin([np.frombuffer(h, U) for h in pdf["hashes"]])
        if len(near):
            block.join(int(near[0]), near)
        classes = block.run() if len(nodes) > 1 else np.zeros(1, np.int64)
        other = np.nonzero(classes != np.arange(len(nodes)))[0]
        return pd.DataFrame({"a": nodes[other], "b": nodes[classes[other]]})

    return candidates.groupBy("c", "i", "j").applyInPandas(run, "a long, b long")


def similar_sets(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that span the classes of similar sets within components. sets: node, c (its component's least node), blocks, hashes."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    wide = sets.where("blocks > 1").withColumn("own", block)
    least = wide.where("node = c").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = scratch.table(near_least(wide.where("node <> c").unionByName(least).select("c", "own", "node", "hashes")), "near")
    flagged = sets.join(near.select("node", F.lit(True).alias("near")), "node", "left").withColumn("near", F.coalesce("near", (F.col("node") == F.col("c")) & (F.col("blocks") > 1)))
    # what is not near the least set meets everything, so a set goes to as many tasks as there are blocks of the rest
    rest = flagged.where("not near").groupBy("c").agg(F.ceil(F.sum(F.octet_length("hashes") / 8) / BLOCK).cast("int").alias("rests"))
    own = F.when(F.col("near"), F.col("rests") + block).otherwise(F.pmod(F.xxhash64("node"), F.col("rests")).cast("int"))
    ends = F.when(F.col("near") | (F.col("blocks") == 1), F.col("rests")).otherwise(F.col("rests") + F.col("blocks"))
    dealt = flagged.join(rest, "c").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), ends - 1)))
    dealt = dealt.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "hashes", "near")
    return scratch.table(verify(dealt), "links").unionByName(near.toDF("a", "b"))


def classes_of(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text): doc_id, text_hash, n_shingles, class (null: no set), component_id (the class's least doc_id, or the own one), one row for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-chars // 6_000_000))  # about 700,000 signatures each
    frequent, bands = census(docs, scratch)
    signed = scratch.table(sign(docs, Routes(bands, parts), frequent), "signed")
    members = signed.where("kind = 'm'").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("n").alias("n_shingles"), "text_hash")
    candidates = signed.where("kind = 'l'").select("a", "b").unionByName(pruned(signed, scratch))
    linked = components(candidates, scratch, "candidates")

    # one document of each node, whose text gives the set again: that of the least id, of those without if there is no other
    nodes = members.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n"))
    nodes = nodes.select("node", "first.doc_id", "first.text_hash", "n")
    held = scratch.table(linked.join(nodes, "node"), "held")
    sizes = held.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    held = held.join(sizes, "component").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "node", F.col("component").alias("c"), "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [shingle_set(hashes, t).tobytes() for t in b.column("text").to_pylist()]
            # texts of one doc_id and hash: the one whose set is meant
            meant = pa.array([xxhash.xxh3_64_intdigest(s) - (1 << 63) == x for s, x in zip(found, b.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "c", "blocks")), pa.array(found, pa.binary())], names=["node", "c", "blocks", "hashes"]).filter(meant)

    docs = may_occur(docs, F.col("text_hash"), held.select("_text")).where("_may")  # most texts needn't move
    texts = docs.join(held, (docs["text_hash"] == held["_text"]) & docs["doc_id"].eqNullSafe(held["_doc"]))
    texts = texts.select("text", "node", "c", "blocks").mapInArrow(tidy(sets), "node long, c long, blocks int, hashes binary").dropDuplicates(["node"])
    links = similar_sets(scratch.table(texts, "sets"), scratch)

    classes = components(links, scratch, "classes")
    least = classes.join(nodes.select("node", "doc_id"), "node")
    firsts = least.groupBy("component").agg(F.min("doc_id").alias("first"))
    of_node = nodes.join(least.join(firsts, "component").select("node", "component", "first"), "node", "left")
    of_node = of_node.select("node", F.coalesce("component", "node").alias("class"), F.least("doc_id", "first").alias("component_id"))
    return members.join(of_node, "node", "left").select("doc_id", "text_hash", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text): doc_id, n_shingles, component_id, one row for each row."""
    return classes_of(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each class: that of the least doc_id, rows without one last, then of the least hash of the text.

    Rows without words are in no class and all stay. Of rows equal in doc_id and text any one stays, whatever their
    other columns. Only rows that may go are shuffled. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    rows = scratch.table(classes_of(docs.select("doc_id", "text")).where("class is not null"), "classes")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")).select("class", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_text"))
    each = rows.groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(first, "class")
    each = each.withColumn("goes", ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_text"))))
    moved = scratch.table(each.where("goes or n > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"), "goes"), "moved")
    gone = moved.where("goes")

    held = carried(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    held = may_occur(held, F.xxhash64(F.col("doc_id").cast("long"), F.col("text_hash")), moved.select(F.xxhash64("gone_id", "gone_text").alias("key")))
    doubtful = held.where("_may")
    doubtful = doubtful.join(gone, (doubtful["text_hash"] == gone["gone_text"]) & doubtful["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    stay = held.where("not _may").unionByName(doubtful.where(~words)).unionByName(doubtful.where(words).dropDuplicates(["doc_id", "text_hash"]))
    return restored(stay, docs, "doc_id", "text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over every whole text of documents."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows from the pairs that share a run of words.
ORACLE = """
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
grams as (select doc_id, array_to_string(w[p:p + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) p from words where len(w) > 0)),
sets as (select distinct doc_id, g from grams),
sizes as (select doc_id, count(*) n from sets group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
two_way as (select a, b from links union all select b, a from links),
reach as (select doc_id d, doc_id r from words union select reach.d, two_way.b from reach join two_way on reach.r = two_way.a)
select w.doc_id, coalesce(s.n, 0) n_shingles, min(r.r) component_id from words w left join sizes s using (doc_id) join reach r on r.d = w.doc_id group by w.doc_id, s.n
"""
