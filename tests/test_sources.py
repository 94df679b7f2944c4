"""Text sources: small files written by hand, read, and written again."""

from pyspark.sql import functions as F

from lociframe.functions import cigar, sequence
from lociframe.sources import alignment, text

SAM = "\n".join([
    "@HD\tVN:1.4\tSO:coordinate", "@SQ\tSN:ref\tLN:45", "@SQ\tSN:ref2\tLN:40", "@CO\ta comment",
    "r001\t163\tref\t7\t30\t8M4I4M1D3M\t=\t37\t39\tTTAGATAAAGAGGATACTG\t*\tXX:Z:a:b\tNM:i:1",
    "r002\t0\tref\t9\t30\t1S2I6M1P1I1P1I4M2I\t*\t0\t0\tAAAAGATAAGGGATAAA\t*",
    "r004\t0\tref\t16\t30\t6M14N1I5M\t*\t0\t0\tATAGCTCTCAGC\t*",
    "r003\t16\tref\t29\t30\t6H5M\t*\t0\t0\tTAGGC\tABCDE",
    "r005\t0\tref\t5\t0\t*\t*\t0\t0\t*\t*",
])


def put(path, content):
    path.write_text(content)
    return str(path)


def test_alignment_records(spark, tmp_path):
    path = put(tmp_path / "a.sam", SAM + "\n")
    r = {x.qname: x for x in alignment.read_sam(spark, path).collect()}
    assert (r["r001"].pos, r["r001"].rnext, r["r001"].pnext, r["r001"].tags["XX"].value, r["r001"].tags["NM"].type) == (6, "ref", 36, "a:b", "i")
    assert r["r005"].flag == 4 and r["r005"].cigar is None and r["r002"].pnext is None
    assert [(x.name, x.length) for x in alignment.references(spark, path).collect()] == [("ref", 45), ("ref2", 40)]
    seg = alignment.segments(alignment.read_sam(spark, path)).where("qname = 'r004'").orderBy("i").collect()
    assert [(x.a, x.b) for x in seg] == [(15, 20), (35, 39)]
    out = str(tmp_path / "out")
    alignment.write_sam(alignment.read_sam(spark, path), out)
    assert sorted(map(str, alignment.read_sam(spark, out).collect())) == sorted(map(str, r.values()))
    fq = [x.value for x in alignment.to_fastq(alignment.read_sam(spark, path)).collect()]
    assert "@r003\nGCCTA\n+\nEDCBA" in fq and any(x.startswith("@r001/2\n") for x in fq)


def test_cigar_of_an_odd_read(spark):
    r = spark.createDataFrame([("3M2B4M5N2D1M",), ("*",), ("",)], "c string").select(cigar.reference_length(cigar.ops(F.col("c"))).alias("r"), cigar.query_length(cigar.ops(F.col("c"))).alias("q")).collect()
    assert [(x.r, x.q) for x in r] == [(13, 8), (0, 0), (0, 0)]


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">s1 first one\nACGTNNNAC\nGT\n>s2\nnnAC\n>s3\n")
    s = text.read_fasta(spark, path)
    assert {(x.name, x.description, x.seq) for x in s.collect()} == {("s1", "first one", "ACGTNNNACGT"), ("s2", "", "nnAC"), ("s3", "", "")}
    assert text.fetch(s, "s1", 3, 8).first().seq == "GTNNNA"
    assert {(x.name, x.contig, x.start, x.end) for x in text.contigs(s, 2).collect()} == {("s1", 0, 0, 3), ("s1", 1, 7, 10), ("s2", 0, 2, 3)}
    assert text.to_fasta(s.where("name = 's1'"), 4).first().value == ">s1\nACGT\nNNNA\nCGT"


def test_bed(spark, tmp_path):
    path = put(tmp_path / "a.bed", "chr1\t10\t20\tx\n# no\nchr2 7\n\n")
    assert {(x.chrom, x.beg, x.fin) for x in text.read_bed(spark, path).collect()} == {("chr1", 10, 20), ("chr2", 6, 7)}


def test_vcf(spark, tmp_path):
    path = put(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\nchr1\t5\t.\tA\tC,G\t.\tPASS\tDP=7;DB\tGT:PL\t0/1:1,2,3\t./.\n")
    v = text.read_vcf(spark, path)
    x = v.first()
    assert (x.pos, x.id, x.alt, x.qual, x.info) == (4, None, ["C", "G"], None, {"DP": "7", "DB": ""})
    assert [g["values"] for g in text.genotypes(v).orderBy("sample").collect()] == [{"GT": "0/1", "PL": "1,2,3"}, {"GT": "./.", "PL": None}]


def test_connections(spark, tmp_path):
    content = "Contigs\nx\ncommand line: run -b a\n2: (s15 963557 219 +) (s87 956 115731 -)\n\t23: (s15:332817-333132) (s87:76-854)\n1: (s9 10 3 +)\nWARNINGS:\n5: (a 1 2 +) (b 3 4 -)\n"
    c = text.read_connections(spark, put(tmp_path / "c.out", content)).orderBy("chain", "ord")
    got = [(x.chain, x.scaffold, x.length, x.contig, x.strand, x.support) for x in c.collect()]
    assert got == [(0, "s15", 963557, 219, "+", 23), (0, "s87", 956, 115731, "-", None), (1, "s9", 10, 3, "+", None)]
    assert text.to_connections(c).orderBy("chain").first().value.splitlines()[0] == "2: (s15 963557 219 +) (s87 956 115731 -)"
    seqs = spark.createDataFrame([("s15", "AAC"), ("s87", "GGT"), ("s9", "A")], "name string, seq string")
    assert text.scaffold_sequences(c, seqs, 2).orderBy("chain").first().seq == "AACNNACC"


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTNacgt",), ("A",), ("",)], "s string")
    got = df.select(sequence.reverse_complement(F.col("s")).alias("r"), F.size(sequence.kmers(F.col("s"), 3)).alias("k"), sequence.colours(F.col("s")).alias("c")).collect()
    assert [(x.r, x.k) for x in got] == [("acgtNACGT", 7), ("T", 0), ("", 0)] and got[0].c[:4] == "1314"


def test_sessions_stream_equals_batch(spark, tmp_path):
    from lociframe.streaming.sessions import sessions

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, late="1 second").writeStream.format("memory").queryName("closed_sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    whole = {(r.user_id, r.start, r.n) for r in sessions(e).collect()}
    closed = {(r.user_id, r.start, r.n) for r in spark.table("closed_sessions").collect()}
    assert closed and closed <= whole


def test_vcf_round_trip(spark, tmp_path):
    lines = ["c\t5\t.\tA\tC,G\t30.5\tPASS\tDB;DP=7\tGT:PL\t0/1:1,2,3\t./.", "c\t9\trs1\tT\t.\t999\t.\t.", "d\t1\t.\tG\tA\t.\tq10;s50\tAC=2"]
    head = text.vcf_header({"c": 100, "d": 50}, ["s1", "s2"])
    assert head[0].startswith("##fileformat") and head[-1].endswith("FORMAT\ts1\ts2") and "##contig=<ID=d,length=50>" in head
    (tmp_path / "b.vcf").write_text("\n".join([*head, *lines]) + "\n")
    assert sorted(r.value for r in text.to_vcf(text.read_vcf(spark, str(tmp_path / "b.vcf"))).collect()) == sorted(lines)
