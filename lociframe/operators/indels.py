"""Indel calling: reads around a place where some have a gap, aligned anew to what each kind of gap would make of the reference.

Places with gaps come from the CIGARs. A place meets the reads over it in a join on (sequence, bucket of positions) and
its stretch of the reference in another; places deeper than `deepest` reads a sample are left out, as the feature has
it, so what comes together for a place is bounded. There each read is scored against each kind of gap by the forward
rows of the profile model, all reads of like size of many places at once. What follows is as for letters: a read shows the kind of
gap that suits it best, with a quality, and kinds take the place of letters in likelihoods and records.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from . import calling as K
from . import pileup as P
from . import realign

#: Letters looked at on either side; qualities of opening and extending a gap and of tandem repeats; least share and number of reads with a gap; reads a sample at most; kinds of gaps; share of reads that must agree with the reference for it to stand; scores above which a second, stricter alignment is made, and lengths' share at which a score counts nothing.
AROUND, OPENED, EXTENDED, TANDEM, SHARE, READS, DEEPEST, KINDS, AGREE, STRICT, WORST = 50, 40, 20, 100, 0.002, 1, 250, 64, 0.7, 5, 111
#: Chances that a gap opens and goes on, of the two alignments.
LOOSE, TIGHT = (1e-4, 1e-2), (1e-6, 1e-3)
#: Letters beyond the place on either side that homopolymers are followed for.
FAR, BUCKET = 500, 4096
#: Reads whose places are scored in one go, and alignments that go through the model together, at most.
TOGETHER, JOBS = 1 << 15, 4096

Ops = list[tuple[str, int]]


def parsed(cigar: str) -> Ops:
    out, n = [], 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append((c, n))
            n = 0
    return out


def query_place(pos: int, ops: Ops, place: int, left: bool) -> tuple[int, int]:
    """The read's letter over a place of the reference (or the next one that there is), and the place that this letter stands for."""
    x, y, after = pos, 0, 0
    for op, n in ops:
        if op in "M=X":
            if pos > place:
                return y, pos
            if x + n > place:
                return y + place - x, place
            x, y = x + n, y + n
            after = y
        elif op in "IS":
            y += n
        elif op in "DN":
            if x + n > place:
                return y, x if left else x + n
            x += n
    return after, x


def gap_at(pos: int, ops: Ops, place: int) -> tuple[int, int]:
    """Length of the gap right after a place (above 0: letters put in) and the read's letter over it."""
    x, y = pos, 0
    for i, (op, n) in enumerate(ops):
        if op in "M=X":
            if x <= place < x + n:
                following = ops[i + 1] if place == x + n - 1 and i + 1 < len(ops) else ("", 0)
                return {"I": following[1], "D": -following[1]}.get(following[0], 0), y + place - x
            x, y = x + n, y + n
        elif op in "IS":
            y += n
        elif op in "DN":
            x += n
    return 0, -1


def sequence_quality(length: int, run: int) -> int:
    """How likely a gap of that length is a sequencing error next to a run of one letter."""
    return min(OPENED + EXTENDED * (abs(length) - 1), int(TANDEM * abs(length) / run + 0.499) if run >= 3 else 1000)


def homopolymer(ref: str, at: int) -> int:
    """Length of the run of the letter behind a place, through the place itself."""
    c = ref[at + 1 : at + 2]
    if not c or c == "N":
        return 1
    hi = at + 2
    while hi < len(ref) and ref[hi] == c:
        hi += 1
    lo = at
    while lo >= 0 and ref[lo] == c:
        lo -= 1
    return hi - lo - 1


def _masked(ref: str, lo: int, left: int, right: int, reads: list[dict]) -> str:
    """ref[left:right] with N at the two places where most of a sample's reads differ, unless AGREE of them don't. ref begins at place lo."""
    own, other = Counter(), Counter()
    for r in reads:
        x, y = r["pos"], 0
        for op, n in r["ops"]:
            if op in "M=X":
                for j in range(max(0, left - x), min(n, right - x)):
                    (own if r["seq"][y + j] == ref[x + j - lo] else other)[x + j - left] += 1
                x, y = x + n, y + n
            elif op in "IS":
                y += n
            elif op in "DN":
                x += n
    text = list(ref[left - lo : right - lo])
    for i in sorted(range(len(text)), key=lambda i: (other[i], i))[-2:]:
        if not own[i] + other[i] or own[i] / (own[i] + other[i]) < AGREE:
            text[i] = "N"
    return "".join(text)


def _scores(jobs: list[tuple[str, str, np.ndarray, int]], gaps: tuple[float, float]) -> list[int]:
    """Phred score of each (window, letters, qualities, band): those of like size go through the model together."""
    out, groups = [0] * len(jobs), defaultdict(list)
    for i, (window, query, _, band) in enumerate(jobs):
        if window and query:
            groups[len(window), len(query), band].append(i)
    for (places, n, band), some in ((size, of_size[a : a + JOBS]) for size, of_size in groups.items() for a in range(0, len(of_size), JOBS)):
        letters = lambda k: realign.codes("".join(jobs[i][k] for i in some)).reshape(len(some), -1)  # noqa: E731, B023
        wrong = 10.0 ** (-np.stack([jobs[i][2] for i in some]) / 10)
        for i, s in zip(some, realign.scores(letters(0), letters(1), wrong, band, *gaps).tolist(), strict=True):
            out[i] = int(s + 0.499)
    return out


def site_calls(place: int, ref: str, lo: int, reads: list[dict]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
    """Kinds of gaps at a place, the one without first, then by the qualities of their reads, at most four, each with the letters it puts in; and for each read the kind's number (4: another), the gap's and the sequence's quality. Nothing if no read has a gap of a kind."""
    return scored_together([_site_steps(place, ref, lo, reads)])[0]


def scored_together(sites: list[Generator]) -> list:
    """What sites' steps return. Each of their rounds of scores is made for all sites at once, as many reads of like size go through the model in one go."""
    done: list = [None] * len(sites)
    answers: list = [None] * len(sites)
    left = list(range(len(sites)))
    while left:
        asked = []
        for i in left:
            try:
                asked.append((i, sites[i].send(answers[i])))
            except StopIteration as e:
                done[i] = e.value
        for gaps in (LOOSE, TIGHT):
            some = [(i, jobs) for i, (jobs, g) in asked if g == gaps]
            scores = iter(_scores([j for _, jobs in some for j in jobs], gaps))
            for i, jobs in some:
                answers[i] = list(itertools.islice(scores, len(jobs)))
        left = [i for i, _ in asked]
    return done


def _site_steps(place: int, ref: str, lo: int, reads: list[dict]) -> Generator:
    """site_calls in steps: yields alignments to score with their gaps' chances, is sent the scores."""
    at = place - lo
    shown = [gap_at(r["pos"], r["ops"], place) for r in reads]
    longest = max(len(r["seq"]) for r in reads)
    ahead = ref[at : at + longest]
    put_in: dict[int, str] = {}
    for length in sorted({g for g, _ in shown if g > 0}):
        parts = [r["seq"][y + 1 : y + 1 + length] for r, (g, y) in zip(reads, shown, strict=True) if g == length]
        put_in[length] = "".join(min("ACGTN", key=lambda c: (-sum(p[k] == c for p in parts), "ACGTN".index(c))) for k in range(length))  # noqa: B023
    kinds = sorted({0} | {g for g, _ in shown if g < 0} | {n for n, text in put_in.items() if "N" not in text})
    if len(kinds) < 2 or len(kinds) >= KINDS or 2 * ahead.count("N") > len(ahead):
        return [], []
    left, right = max(place - AROUND, 0), min(place + AROUND - min(kinds[0], 0), lo + len(ref))
    run = homopolymer(ref, at)
    masked = {s: _masked(ref, lo, left, right, [r for r in reads if r["sample"] == s]) for s in {r["sample"] for r in reads}}
    longest_gap = max(max(kinds), -kinds[0])
    loose, spans = [], []
    for r in reads:
        a, ta = query_place(r["pos"], r["ops"], left, False)
        b, tb = query_place(r["pos"], r["ops"], right, True)
        quals = np.clip(r["quals"][a:b], 7, 30)
        for kind in kinds:
            text = masked[r["sample"]]
            text = text[: place - left + 1] + put_in.get(kind, "") + text[place - left + 1 - min(kind, 0) :]
            text = text.ljust(right - left + 2 + 2 * longest_gap, "N")
            start = max(ta + min(kind, 0), left) if kind < 0 else ta
            loose.append((text[start - left : tb - left + abs(kind)], r["seq"][a:b], quals, abs(kind) + 3))
        spans.append(max(1, b - a))
    first = yield loose, LOOSE
    doubtful = [i for i, s in enumerate(first) if s > STRICT]
    second = list(first)
    for i, s in zip(doubtful, (yield [loose[i] for i in doubtful], TIGHT), strict=True):
        second[i] = s
    none, calls, sums = kinds.index(0), [], Counter()
    for i, n in enumerate(spans):
        quality, best, own = [], 0, 0
        for scores in (first, second):
            some = sorted((s, min(255, int(100.0 * s / n + 0.499)), t) for t, s in enumerate(scores[i * len(kinds) : (i + 1) * len(kinds)]))
            best = some[0][2]
            rival = some[1] if best == none else next(x for x in some if x[2] == none)
            if not quality:
                own = min(255, sequence_quality(kinds[some[1][2] if best == none else best], run))
            quality.append(0 if some[0][1] > WORST else int((1 - some[0][1] / WORST) * (rival[0] - some[0][0]) + 0.499))
        calls.append((best, min(*quality, 255), own))
        sums[best] += min(*quality, own)
    order = [none] + [t for t in sorted(range(len(kinds)), key=lambda t: (-sums[t], -t)) if t != none][:3]
    number = {t: i for i, t in enumerate(order)}
    return [(kinds[t], put_in.get(kinds[t], "")) for t in order], [(number.get(t, 4), q if t in number else 0, own if t in number else 0) for t, q, own in calls]


def gap_places(records: DataFrame) -> DataFrame:
    """(rname, place): places right after which some read has a gap."""
    r = P.runs(records.where(F.col("pos").isNotNull() & (F.col("flag").bitwiseAND(0x704) == 0))).where(F.col("op").isin("I", "D") & (F.col("r0") > F.col("pos")))
    return r.select("rname", (F.col("r0") - 1).alias("place")).distinct()


def gap_letters(records: DataFrame, pieces: DataFrame, stride: int, deepest: int = DEEPEST, far: int = FAR) -> DataFrame:
    """A row for each read over a place with gaps: tid (its rname), place, ref 'A', sample, base (a letter for the kind of gap: A for none, N for one of no kind), rev, q, mapq, tail, kinds (text: lengths, with the letters put in).

    records: rname, pos, flag, mapq, cigar, seq, qual, sample. Reads without letters or qualities, or with introns,
    don't count; sites where a sample has more than `deepest` reads on average are left out, as are reads whose gap's
    quality is below the least. pieces: as realign.pieces_of gives them, reaching 2 * far + 1 letters at least.
    """
    use = records.where((F.col("flag").bitwiseAND(0x704) == 0) & F.col("pos").isNotNull() & F.col("seq").isNotNull() & F.col("qual").isNotNull() & ~F.coalesce(F.contains("cigar", F.lit("N")), F.lit(True)))
    ops = C.ops(F.col("cigar"))
    use = use.select("rname", "pos", F.col("flag").bitwiseAND(16).alias("rev"), "mapq", "cigar", F.upper("seq").alias("seq"), "qual", "sample", (F.col("pos") + C.reference_length(ops)).alias("end")).where("length(seq) = length(qual)")
    spread = use.withColumn("bucket", F.explode(F.sequence(F.expr(f"pos div {BUCKET}"), F.expr(f"(end - 1) div {BUCKET}"))))
    places = gap_places(records).withColumn("bucket", F.expr(f"place div {BUCKET}"))
    over = (F.col("r.rname") == F.col("p.rname")) & (F.col("r.bucket") == F.col("p.bucket")) & (F.col("p.place") >= F.col("r.pos")) & (F.col("p.place") < F.col("r.end"))
    pairs = spread.alias("r").join(places.alias("p"), over).select("r.*", "p.place").drop("bucket", "end")
    piled = spread.alias("r").join(places.alias("p"), over).groupBy("p.rname", "p.place").agg(F.count("*").alias("n"), F.countDistinct("r.sample").alias("samples"))
    sites = piled.where(F.col("n") <= deepest * F.col("samples")).select("rname", "place", F.greatest(F.col("place") - far, F.lit(0)).alias("lo"))
    at = pieces.select(F.col("name").alias("rname"), F.col("piece"), F.col("seq").alias("text"))
    sites = sites.withColumn("piece", F.expr(f"lo div {stride}")).join(at.hint("merge"), ["rname", "piece"]).select("rname", "place", "lo", F.upper(F.expr(f"substring(text, cast(lo - piece * {stride} + 1 as int), {2 * far + 1})")).alias("ref"))
    both = pairs.join(sites, ["rname", "place"])
    key = ["rname", "place"]
    sorted_ = both.select(*key, "lo", "ref", "pos", "rev", "mapq", "cigar", "seq", "qual", F.col("sample").cast("string").alias("sample")).repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "sample", "pos", "seq", "cigar", "qual")
    columns = ["rname", "place", "lo", "ref", "pos", "rev", "mapq", "cigar", "seq", "qual", "sample"]
    kind = dict(records.dtypes)["rname"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        whole: list[list[tuple]] = []  # places that are complete
        rows_in = 0
        for b in batches:
            last = b.schema.field("rname").type
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    whole.append(held)
                    rows_in += len(held)
                    held = []
                    if rows_in >= TOGETHER:
                        yield _letters(_called(whole), last)
                        whole, rows_in = [], 0
                held.append(row)
        if held:
            yield _letters(_called([*whole, held]), last)

    return sorted_.mapInArrow(run, f"tid {kind}, place long, ref string, sample string, base string, rev int, q int, mapq int, tail int, kinds string")


def _called(places: list[list[tuple]]) -> list[tuple]:
    used = []
    for rows in places:
        _, place, lo, ref = rows[0][:4]
        reads = [{"pos": r[4], "ops": parsed(r[7]), "seq": r[8], "quals": np.frombuffer(r[9].encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33, "sample": r[10]} for r in rows]
        with_gap = sum(gap_at(r["pos"], r["ops"], place)[0] != 0 for r in reads)
        if with_gap >= READS and with_gap / len(reads) >= SHARE:
            used.append((rows, reads))
    out = []
    for (rows, reads), (kinds, calls) in zip(used, scored_together([_site_steps(rows[0][1], rows[0][3], rows[0][2], reads) for rows, reads in used]), strict=True):
        if not any(0 < c[0] < 4 for c in calls):
            continue
        name, place = rows[0][:2]
        text = ",".join(f"{n:+d}{letters}" if n else "0" for n, letters in kinds)
        for row, r, (number, quality, own) in zip(rows, reads, calls, strict=True):
            if quality >= K.LEAST and number < 4:
                y = query_place(r["pos"], r["ops"], place, True)[0]
                out.append((name, place, "A", row[10], K.LETTERS[number], int(row[5] != 0), min(quality, own), row[6], min(y, len(r["seq"]) - 1 - y), text))
    return out


def _letters(rows: list[tuple], name: pa.DataType) -> pa.RecordBatch:
    types = [name, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["tid", "place", "ref", "sample", "base", "rev", "q", "mapq", "tail", "kinds"])


def indel_records(letters: DataFrame) -> DataFrame:
    """Records of gap_letters' rows, one a place: kinds of gaps by the qualities of their reads, after the one without; shares; samples with likelihoods."""
    # kinds go along with the site: a second look at the letters would score all reads again
    s = K.sites(K.site_samples(letters, least=0), unseen=False)
    named = F.transform("alleles", lambda i: F.get(F.split("kinds", ","), i))
    return s.where("size(alleles) > 1").select("tid", "place", F.array_join(F.slice(named, 2, 4), ",").alias("alts"), "qs", "samples", "depth")
