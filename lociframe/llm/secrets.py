"""Secret scans: sliding-window Shannon entropy over candidate strings, beside three plain patterns.

Candidates are maximal runs of one character class (hexadecimal, base64-like) of at least `window`
characters. A window slides over a run; the counts of its characters, and the sum of n*log2(n) over
them, are updated for the character that leaves and the one that enters, so a run of any length takes
time in proportion to its length. Windows above the threshold of their class are joined into spans.
Spans on the allow list, and spans that base spans together cover from end to end, are suppressed; a span that
reaches beyond them is reported whole.

Null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives an
empty table. Extra columns are kept, but for one named like the new column, which gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, tidy

# The three base patterns and the least length of what counts, as the contract has them.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run shorter than the least length never counts and overlaps no other match of its kind, so the bound can go into the pattern.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class EntropyRules:
    """window: characters; hexadecimal, base64: least bits a character, of a window in which both letters and digits occur.

    allow: patterns of whole candidates that are never secrets.
    """

    window: int = 20
    hexadecimal: float = 3.0
    base64: float = 3.9
    allow: tuple[str, ...] = (
        r"[A-Za-z]+",  # words
        r"[0-9+/_=-]+",  # numbers, rules, dates
        r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",  # UUIDs
        r"(?i)(sha(1|224|256|384|512)|md5)[-_=].*",  # named digests
        r"[A-Za-z]+([/_-][A-Za-z]+)+[0-9]{0,4}",  # paths and identifiers made of words
        r"(?i).*(example|placeholder|redacted|xxxx|changeme|your[-_]?(token|key|secret)).*",
    )


def _steps(n: int) -> list[float]:
    return [0.0] + [i * math.log2(i) for i in range(1, n + 1)]


def high_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of `run` whose entropy is at least `least` and which have a letter and a digit."""
    if len(run) < window:
        return []
    part, counts, spans = _steps(window), {}, []
    total, digits, letters = 0.0, 0, 0
    limit = math.log2(window) - least + 1e-9  # entropy = log2(w) - sum(n log2 n) / w
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += part[n + 1] - part[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += part[n - 1] - part[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= window - 1 and digits and letters and total / window <= limit:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover together."""
    starts, ends = [], []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


class Scanner:
    def __init__(self, rules: EntropyRules):
        self.rules = rules
        self.allow = re.compile("|".join(f"(?i:{a[4:]})" if a.startswith("(?i)") else f"(?:{a})" for a in rules.allow)) if rules.allow else None
        self.runs = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{rules.window},}}")
        self.hex = re.compile(r"[0-9a-f]+|[0-9A-F]+")

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """Spans of the three patterns: (start, end, kind), by start, then kind as listed."""
        found = []
        lowered = text.lower()
        if any(k in lowered for k in _KEYS):
            found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        if any(len(w) >= 20 for w in text.split()):  # the other two have no white space inside
            found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
            found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    def entropy(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        if not any(len(w) >= self.rules.window for w in text.split()):
            return []
        found = []
        starts, ends = joined(base)
        for m in self.runs.finditer(text):
            run = m.group()
            if self.allow is not None and self.allow.fullmatch(run):
                continue
            least = self.rules.hexadecimal if self.hex.fullmatch(run) else self.rules.base64
            for a, b in high_windows(run, self.rules.window, least):
                a, b = a + m.start(), b + m.start()
                i = bisect_right(starts, a) - 1
                if not (i >= 0 and b <= ends[i]) and not (self.allow is not None and self.allow.fullmatch(text[a:b])):
                    found.append((a, b, "entropy"))
        return found

    def scan(self, text: str | None) -> tuple[list, list]:
        if not text:
            return [], []
        base = self.base(text)
        return base, sorted(base + self.entropy(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, text: str = "text", rules: EntropyRules = EntropyRules(), out: str = "secret_spans") -> DataFrame:
    """docs with a column of spans (start and end in code points, end exclusive; kind), base ones and those of the method.

    Spark moves nothing: each row is scanned where it is read.
    """
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(scanning(text, rules, out)), ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` {SPANS}"]))


def scanning(text: str, rules: EntropyRules, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the column of spans to Arrow batches."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            spans = [[{"start": a, "end": e, "kind": k} for a, e, k in scanner.scan(t)[1]] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, out])

    return run


def redact(docs: DataFrame, text: str = "text", rules: EntropyRules = EntropyRules(), mask: str = "<secret>") -> DataFrame:
    """docs with each secret of the text (overlapping spans as one) replaced by the mask; other columns as they are."""
    small_batches(docs.sparkSession)

    def clean(t: str | None, scanner: Scanner) -> str | None:
        spans = scanner.scan(t)[1]
        if not spans:
            return t
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [t[at:a], mask]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t, scanner) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents: counts and digests of the spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small_batches(spark)
    scanned = scanning("text", EntropyRules(), "secret_spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scanned(batches):  # in one worker
            rows = []
            for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("secret_spans").to_pylist(), strict=True):
                spans = [(s["start"], s["end"], s["kind"]) for s in spans]
                base = [s for s in spans if s[2] != "entropy"]
                n = {k: sum(s[2] == k for s in base) for k in LEAST}
                rows.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),) * 2, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(),) * 4 + (pa.string(),) * 2], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.mapInArrow(tidy(digest), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
