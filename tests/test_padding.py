"""Padded alignments: round trips of planted reads, hand-made cases, places by counting."""

import random

from lociframe.functions import cigar as C
from lociframe.operators import padding, realign

KIND = "qname string, flag int, rname string, pos long, cigar string, rnext string, pnext long, seq string"


def compact(kinds):
    out = []
    for k in kinds:
        if out and out[-1][1] == k:
            out[-1][0] += 1
        else:
            out.append([1, k])
    return "".join(f"{n}{k}" for n, k in out)


def test_cigars_by_hand():
    u = padding.unpadded_cigar
    assert u("5M2D10M", "ACGTA**CGTACGTACG", 0) == "15M"  # pads between matches
    assert u("9M", "ACG***ACG", 0) == "3M3I3M"
    assert u("4M2D3M", "ACG***ACG", 0) == "3M1I2P3M"
    assert u("3M1D2M", "ACGTAC", 0) == "3M1D2M" and u("2M4D2M", "AC*GT*AC", 0) == "2M2D2M"
    assert u("2S4M", "**AC", 3) == "2S3P2I2M" and u("5H3S4M2S1H", "ACGT", 0) == "5H3S4M2S1H"
    assert u("3M2N3M", "ACGACGAC", 0) is None and u("5M", "ACG", 0) is None


def test_round_trip(spark):
    """Reads that show all or none of the letters of each run of pads get back the CIGAR that they were made from."""
    rng = random.Random(14)
    rows, want, refs = [], {}, {}
    for t in range(3):
        padded = "".join(rng.choice("ACGT") if rng.random() < 0.7 else rng.choice("*-") * rng.randrange(1, 5) for _ in range(200))
        refs[f"r{t}"] = padded
        letters = [i for i, c in enumerate(padded) if c not in "*-"]
        for k in range(40):
            a, b = sorted(rng.sample(range(len(letters)), 2))
            lo, hi = letters[a], letters[b] + 1
            inside, old, new, seq = rng.random() < 0.5, [], [], ""
            i = lo
            while i < hi:
                if padded[i] in "*-":
                    j = i
                    while padded[j] in "*-":
                        j += 1
                    if inside:
                        old += ["M"] * (j - i)
                        new += ["I"] * (j - i)
                        seq += "G" * (j - i)
                    else:
                        old += ["D"] * (j - i)
                    i, inside = j, rng.random() < 0.5
                    continue
                gone = lo < i < hi - 1 and rng.random() < 0.1
                old.append("D" if gone else "M")
                new.append("D" if gone else "M")
                seq += "" if gone else "A"
                i += 1
            name = f"q{t}.{k}"
            mate = rng.choice([None, letters[a], rng.randrange(len(padded))])
            rows.append((name, 0, f"r{t}", lo, "2S" + compact(old) + "3H", None if mate is None else f"r{t}", mate, "TT" + seq))
            want[name] = (a, "2S" + compact(new) + "3H", None if mate is None else sum(c not in "*-" for c in padded[:mate]))
    seqs = spark.createDataFrame(list(refs.items()), "name string, seq string")
    for stride in (7, 64, 5000):
        got = padding.without_pads(spark.createDataFrame(rows, KIND), realign.pieces_of(seqs, stride, 1000), stride)
        found = {r.qname: (r.pos, r.cigar, r.pnext) for r in got.collect()}
        assert {n: (p, m) for n, (p, _, m) in found.items()} == {n: (p, m) for n, (p, _, m) in want.items()}
        assert {n: c for n, (_, c, _) in found.items()} == {n: c for n, (_, c, _) in want.items()}
        lengths = got.select("qname", C.query_length(C.ops(got["cigar"])).alias("n"), "seq").collect()
        assert all(r.n == len(r.seq) for r in lengths)
        assert {r.name: r.length for r in padding.unpadded_lengths(realign.pieces_of(seqs, stride, 1000), stride).collect()} == {n: sum(c not in "*-" for c in s) for n, s in refs.items()}


def test_odd_records(spark):
    seqs = spark.createDataFrame([("r", "AC**GT")], "name string, seq string")
    rows = [("r", 0, "r", 0, "2M2D2M", None, None, "ACGT"), ("a", 0, "r", 2, "2M", None, 4, "AA"), ("b", 4, None, None, None, "r", 5, "A"), ("c", 0, "x", 1, "1M", None, None, "A"), ("d", 0, "r", 4, "9M", None, None, "A" * 9), ("e", 0, "r", 3, "3M", "r", 3, "GGT")]
    got = {r.qname: (r.pos, r.cigar, r.rnext, r.pnext) for r in padding.without_pads(spark.createDataFrame(rows, KIND), realign.pieces_of(seqs, 4, 100), 4).collect()}
    assert got == {"r": (0, "4M", None, None), "a": (2, "2I", None, None), "b": (None, None, "r", 3), "c": (None, None, None, None), "d": (2, None, None, None), "e": (2, "1P1I2M", "r", 2)}
    assert padding.without_pads(spark.createDataFrame([], KIND), realign.pieces_of(seqs, 4, 100), 4).collect() == []


def test_no_reference_in_the_driver_and_no_crowd_without_mates(spark):
    """A few rows unfold to all pieces, so Spark takes them for small; rows without a mate's place don't meet in one task."""
    from pyspark.sql import functions as F

    from lociframe.plans import record_queries as Q

    df = Q.unpadded_records(spark, "/root/testdata/sf0.001")
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    crowd = spark.range(1000).select(padding.realign.piece_or_none(F.lit(None).cast("long"), "id").alias("j"))
    assert crowd.distinct().count() > 900 and crowd.where("j >= 0").count() == 0


def test_finer_pieces_say_the_same(spark):
    import random

    random.seed(3)
    stride, reach = 4 * padding.WIDTH, 300
    rows = []
    for name, n in (("long", 3 * stride + 40), ("edge", stride + 5), ("short", 700)):
        seq = "".join(random.choice("ACGT*-") for _ in range(n))
        rows += [(name, j, seq[j * stride : (j + 1) * stride + reach]) for j in range(-(-n // stride))]
    pieces = spark.createDataFrame(rows, "name string, piece long, seq string")
    coarse = padding.gap_map(pieces, stride)
    whole = {n: "".join(s[:stride] for m, _, s in rows if m == n) for n in ("long", "edge", "short")}
    for r in padding._finer(coarse, stride, padding.WIDTH).collect():
        text, at = whole[r.name], r.piece * padding.WIDTH
        head = text[:at]
        assert r.letters == sum(c not in "*-" for c in head)
        assert r["last"] == max((i for i, c in enumerate(head) if c not in "*-"), default=-1)
        assert text[at:].startswith(r.seq) and len(r.seq) >= min(padding.WIDTH + reach, len(text) - at)
