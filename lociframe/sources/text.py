"""Sequence, region, variant and connection text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq) of the records. Spark cuts the files at '>', so records of any number are read in parallel."""
    r = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.substr("value", F.instr("value", F.lit("\n")) + 1)).otherwise("")
    return r.select(F.split(F.trim(head), r"\s+", 2)[0].alias("name"), F.trim(F.coalesce(F.get(F.split(F.trim(head), r"\s+", 2), F.lit(1)), F.lit(""))).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def to_fasta(seqs: DataFrame, width: int = 60) -> DataFrame:
    """Text entries (value) of seqs(name, seq), wrapped at `width` letters."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value"))


def fetch(seqs: DataFrame, name: str, beg: int, end: int) -> DataFrame:
    """Letters of 1-based inclusive positions of one sequence, cut to its length."""
    return seqs.where(F.col("name") == name).select("name", F.substring("seq", max(1, beg), max(0, end - max(1, beg) + 1)).alias("seq"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, fin), half-open. A line of one number is a 1-based position."""
    f = F.split(F.trim("value"), r"\s+")
    r = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)")).select(f.alias("f"))
    beg, fin = F.get("f", F.lit(1)).cast("long"), F.expr("try_cast(get(f, 2) as bigint)")
    return r.where(beg.isNotNull()).select(F.get("f", F.lit(0)).alias("chrom"), F.when(fin.isNull(), beg - 1).otherwise(beg).alias("beg"), F.coalesce(fin, beg).alias("fin"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos 0-based, id, ref, alt array, qual, filter, info map, format, samples array); flags of INFO have an empty value."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    part = lambda i: F.get("f", F.lit(i))
    info = F.transform(F.filter(F.split(part(7), ";"), lambda x: (x != ".") & (x != "")), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(F.instr(x, "=") > 0, F.substr(x, F.instr(x, F.lit("=")) + 1)).otherwise("")))
    given = lambda c: F.nullif(c, F.lit("."))
    return lines.select(part(0).alias("chrom"), (part(1).cast("long") - 1).alias("pos"), given(part(2)).alias("id"), part(3).alias("ref"), F.split(part(4), ",").alias("alt"), F.expr("try_cast(get(f, 5) as double)").alias("qual"), given(part(6)).alias("filter"), F.map_from_entries(info).alias("info"), F.split(F.coalesce(part(8), F.lit("")), ":").alias("format"), F.slice("f", 10, 100_000).alias("samples"))


def to_vcf(variants: DataFrame) -> DataFrame:
    """Lines (value) of variants as read_vcf gives them: INFO by key, a quality in as few digits as it takes, '.' for what isn't there."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    listed = lambda c, sep: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, sep))
    info = F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    qual = F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit("."))
    samples = F.when(F.coalesce(F.size("samples"), F.lit(0)) > 0, F.concat(F.array(F.array_join("format", ":")), F.col("samples"))).otherwise(F.array().cast("array<string>"))
    fields = F.array(F.col("chrom"), (F.col("pos") + 1).cast("string"), dot("id"), F.col("ref"), F.coalesce(listed("alt", ","), F.lit(".")), qual, dot("filter"), F.coalesce(listed(info, ";"), F.lit(".")))
    return variants.select(F.array_join(F.concat(fields, samples), "\t").alias("value"))


def vcf_header(lengths: dict[str, int], samples: list[str]) -> list[str]:
    """First lines of a file of these sequences and samples."""
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return ["##fileformat=VCFv4.1", *(f"##contig=<ID={n},length={k}>" for n, k in lengths.items()), "\t".join(columns)]


def genotypes(variants: DataFrame) -> DataFrame:
    """One row for each sample of a site: its values by format key."""
    v = variants.select("chrom", "pos", "format", F.posexplode("samples").alias("sample", "value"))
    return v.select("chrom", "pos", "sample", F.map_from_arrays("format", F.transform(F.sequence(F.lit(0), F.size("format") - 1), lambda i: F.get(F.split("value", ":"), i))).alias("values"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Chains of a connection file: (file, chain, ord, scaffold, length, contig, strand, support of the link to the next).

    A chain line is 'n: (scaffold length contig strand) ...', its links follow on lines that begin with a tab. What comes
    before 'command line:' and after 'WARNINGS:' isn't read. A file is one unit here: it is read whole by one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?command line:[^\n]*\n", ""), r"(?s)\nWARNINGS:.*$", "")
    blocks = whole.select("file", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?m)(^\d+: \([^\n]*(?:\n\t[^\n]*)*)"), 1)).alias("chain", "b"))  # a chain line and its links
    parts = F.regexp_extract_all(F.substring_index("b", "\n", 1), F.lit(r"(\([^)]*\))"), 1)
    links = F.transform(F.regexp_extract_all("b", F.lit(r"\n\t(\d+):"), 1), lambda x: x.cast("int"))
    rows = blocks.select("file", "chain", F.posexplode(parts).alias("ord", "p"), links.alias("links"))
    f = F.split(F.regexp_replace("p", "[()]", ""), " ")
    return rows.select("file", "chain", "ord", f[0].alias("scaffold"), f[1].cast("long").alias("length"), f[2].cast("int").alias("contig"), f[3].alias("strand"), F.get("links", F.col("ord")).alias("support"))


def to_connections(chains: DataFrame) -> DataFrame:
    """Text of chains(chain, ord, scaffold, length, contig, strand, support), one value a chain."""
    one = F.struct("ord", F.concat(F.lit("("), F.concat_ws(" ", "scaffold", "length", "contig", "strand"), F.lit(")")).alias("p"), "support")
    c = chains.groupBy("chain").agg(F.sort_array(F.collect_list(one)).alias("x"))
    first = F.concat(F.size("x"), F.lit(": "), F.array_join(F.transform("x", lambda x: x["p"]), " "))
    links = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.concat(F.lit("\t"), F.get("x", i - 1)["support"], F.lit(": "), F.get("x", i - 1)["p"], F.lit(" "), F.get("x", i)["p"]))
    return c.select("chain", F.when(F.size("x") > 1, F.concat(first, F.lit("\n"), F.array_join(links, "\n"))).otherwise(first).alias("value"))


def scaffold_sequences(chains: DataFrame, seqs: DataFrame, gap: int = 17) -> DataFrame:
    """(chain, seq): sequences of a chain's parts in order, turned where the strand is '-', with N between them; and the parts' names."""
    from ..functions.sequence import reverse_complement

    j = chains.join(seqs.select(F.col("name").alias("scaffold"), "seq"), "scaffold")
    part = F.struct("ord", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("s"), F.concat("scaffold", F.lit(" "), "strand").alias("n"))
    g = j.groupBy("chain").agg(F.sort_array(F.collect_list(part)).alias("x"))
    return g.select("chain", F.array_join(F.transform("x", lambda x: x["s"]), "N" * gap).alias("seq"), F.transform("x", lambda x: x["n"]).alias("parts"))


def contigs(seqs: DataFrame, gap: int = 1) -> DataFrame:
    """(name, contig, start, end): runs between `gap` or more N, 0-based inclusive, numbered along each sequence."""
    pieces = F.split("seq", f"[Nn]{{{gap},}}")
    e = seqs.select("name", F.posexplode(pieces).alias("i", "p"), F.regexp_extract_all("seq", F.lit(f"([Nn]{{{gap},}})"), 1).alias("g"))
    w = Window.partitionBy("name").orderBy("i")
    size = F.length("p") + F.coalesce(F.length(F.get("g", F.col("i"))), F.lit(0))
    e = e.withColumn("start", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("p <> ''")
    return e.select("name", (F.row_number().over(w) - 1).alias("contig"), "start", (F.col("start") + F.length("p") - 1).alias("end"))
