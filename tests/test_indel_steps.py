"""Indel calling at size: reads are scored once, and their letters, made a batch at a time, are those of the definition."""

from pyspark.sql import functions as F

from lociframe.operators import indels
from lociframe.plans import reads as R
from lociframe.plans import record_queries as Q

SF = "/root/testdata/sf0.001"


def test_reads_are_scored_once(spark):
    r = indels.indel_records(indels.gap_letters(Q.gapped(spark, SF), Q.pieces(spark, SF), Q.STRIDE))
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    scoring = [x for x in plan.splitlines() if "MapInArrow" in x and "lo#" in x]
    assert len(scoring) == 1, plan


def _base(tid, place):
    p = place % Q.PRIME
    return "ACGT"[((p * p % Q.PRIME) * 7919 + p * 31 + tid * 97) % Q.PRIME % 4]


def test_letters_by_definition(spark):
    """Reads with gaps of either kind, shown and not, letter by letter."""
    raw = R.reads(spark, SF).where("qname < 400").select("qname", "tid", F.expr("pos div 16").alias("pos"), "flag", "mapq", (F.col("sk") % 3).alias("sample"), (F.col("end_pos") - F.col("pos") + 1).alias("n")).collect()
    want, kinds = [], set()
    for r in raw:
        site = r.pos + (50 - r.pos % 97 + 97) % 97
        nth, o = site // 97, site - r.pos
        copies = (nth + r.sample) % 3
        gap = 0 if o >= r.n - 1 or not (copies == 2 or (copies == 1 and r.qname % 2 == 1)) else -2 if nth % 2 == 0 else 3
        shown = 5 <= o < r.n - 8
        text = ""
        for k in range(r.n):
            x = k + ((-2 if gap < 0 else 3 if gap > 0 else 0) if o < 5 else 0)
            at = r.pos + x + (2 if gap < 0 and x > o else -3 if gap > 0 and x > o else 0)
            text += "GAT"[x - o - 1] if gap > 0 and o < x <= o + 3 else "A" if (r.qname * 31 + k * 17) % 89 == 0 else _base(r.tid, at)
        cigar = f"{r.n}M" if not shown or not gap else f"{o + 1}M2D{r.n - o - 1}M" if gap < 0 else f"{o + 1}M3I{r.n - o - 4}M"
        want.append((f"s{r.tid}", r.pos, r.flag, r.mapq, cigar, text, "".join(chr(53 + (k + r.qname) % 20) for k in range(r.n)), r.sample))
        kinds.add((gap, shown, o < 5))
    assert {(-2, True, False), (3, True, False), (-2, False, True), (3, False, True)} <= kinds
    keep = {(w[0], w[1], w[6]) for w in want}
    got = [tuple(r) for r in Q.gapped(spark, SF).collect() if (r.rname, r.pos, r.qual) in keep]
    assert set(want) <= set(got)


def test_rows_without_a_place_have_no_text(spark):
    df = spark.createDataFrame([(3, 1), (None, 2), (0, 3), (-4, 4)], "n long, x long")
    rows = Q.with_texts(df, "n", {"t": lambda r, k: 65 + k + r["x"]}, ["n", "x"]).collect()
    assert [(r.x, r.t) for r in rows] == [(1, "BCD"), (2, None), (3, ""), (4, "")]


def test_letters_of_records_by_definition(spark):
    """Clipped reads, letters left out and put in, last letters one place off."""
    raw = R.reads(spark, SF).where("qname < 300").collect()
    want = set()
    for r in raw:
        n, clip = r.end_pos - r.pos + 1, 4 if r.qname % 7 == 0 else 0
        gap, half = 2 if r.qname % 5 == 0 else -3 if r.qname % 5 == 1 else 0, (n - clip) // 2
        text = ""
        for k in range(n):
            x = k - clip
            shift = 2 if gap > 0 and x >= half else -3 if gap < 0 and x >= half + 3 else 0
            own = _base(r.tid, r.pos + x + shift + (1 if k >= n - 4 and r.qname % 11 == 0 else 0))
            text += "A" if x < 0 else "T" if gap < 0 and half <= x < half + 3 else own
        want.add((r.qname, r.ord, text, "".join(chr(36 + (r.pos + k + r.qname) % 38) for k in range(n))))
    got = {(r.qname, r.ord, r.seq, r.qual) for r in Q.records(spark, SF).where("qname < 300").collect()}
    assert got == want and len(got) > 200
    plan = Q.records(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # no letter is an expression that Spark evaluates by itself
