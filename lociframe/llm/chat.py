"""Conversations as token ids: segments are encoded separately, reserved ids are spliced in between, a loss mask covers the answers.

A turn of a known role stands between the two marks of that role (TEMPLATE); any other role's name stands in front,
between marks of its own. Marks are reserved ids above the vocabulary, so no text can make one. In the text form of
the ids a mark is its string with a space beside it; where such a string occurs in a text (or a role's name), a
backslash is put before it, and reading takes that one backslash away again. So both forms are read back exactly.

The turns are sorted by (conv_id, turn, role, text) over ranges that may cut a conversation, so a long one, or one
row repeated very often, is spread over tasks. Places within a range are running sums of lengths; what the ranges
before hold of the same conversation is added from a table with at most two rows a range, which is broadcast.

Null texts and roles count as empty. Rows without conv_id are one conversation, those without turn come first in
theirs, turns of one number are ordered by role and text, repeated rows are turns of their own. Texts of any length
are one row each. An empty table gives no rows. Other columns aren't used, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec, codec
from .common import Scratch, partitions, small_batches, tidy

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]
#: Marks before and after the text of a role; all other roles: OTHER, with the role's name before the second mark.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
LEARNED = "assistant"

_ANY = "|".join(map(re.escape, MARKS))
_MARK, _ESCAPED, _BARE = re.compile(f"({_ANY})"), re.compile(f"\\\\({_ANY})"), re.compile(f"(?<!\\\\)(?:{_ANY})")
#: Role that a first mark stands for.
_ROLE = {marks[0]: role for role, marks in TEMPLATE.items()}


def escape(text: str) -> str:
    return _MARK.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _shown(mark: str) -> str:
    """A mark's text form: a space towards the text that it encloses."""
    return f" {mark} " if mark == OTHER[1] else f" {mark}" if "/" in mark else f"{mark} "


def parse_text(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn from the text form."""
    found = [(m.group(), m.start(), m.end()) for m in _BARE.finditer(formatted)]
    out, role = [], ""
    for (first, _, end), (last, start, _) in zip(found, found[1:], strict=False):
        inner = unescape(formatted[end + 1 : start - 1])
        if last == OTHER[1]:
            role = inner
        elif first == OTHER[1]:
            out.append((role, inner))
        elif first in _ROLE:
            out.append((_ROLE[first], inner))
    return out


class Formatter:
    """Turns to ids and back. Reserved ids follow the largest of the vocabulary."""

    def __init__(self, c: Codec):
        self.codec, self.first = c, len(c.bytes_of)
        self.raw = {m: np.array([self.first + i], "<u4").tobytes() for i, m in enumerate(MARKS)}

    def encode(self, roles: list[str], texts: list[str]) -> list[tuple[bytes, int, int]]:
        """ids of each turn, and the stretch of them that is its text."""
        other = [i for i, r in enumerate(roles) if r not in TEMPLATE]
        ids = self.codec.encode_all([*map(escape, texts), *(escape(roles[i]) for i in other)])
        names = dict(zip(other, ids[len(texts) :], strict=True))
        out = []
        for i, (role, text) in enumerate(zip(roles, ids, strict=False)):
            head = self.raw[OTHER[0]] + names[i] + self.raw[OTHER[1]] if i in names else self.raw[TEMPLATE[role][0]]
            tail = self.raw[OTHER[2] if i in names else TEMPLATE[role][1]]
            out.append((head + text + tail, len(head) // 4, (len(head) + len(text)) // 4))
        return out

    def decode(self, data: bytes, mask: np.ndarray) -> tuple[str, str, str, str]:
        """Role, text, text under the mask, and text form, from the ids of one turn alone."""
        ids = np.frombuffer(data, "<u4")
        marks = np.nonzero(ids >= self.first)[0].tolist()
        plain = lambda some: self.codec.decode(some.astype("<u4").tobytes()).decode()
        between = [plain(ids[a + 1 : b]) for a, b in zip(marks, marks[1:], strict=False)]
        names = [MARKS[i - self.first] for i in ids[marks].tolist()]
        role = unescape(between[0]) if names[0] == OTHER[0] else _ROLE[names[0]]
        form = "".join([_shown(names[0]), *(x for pair in zip(between, map(_shown, names[1:]), strict=True) for x in pair)])
        learned = ids[mask]
        return role, unescape(between[-1]), unescape(plain(learned[learned < self.first])), form


def format_conversations(conversations: DataFrame, path: str, pattern: str, scratch: Scratch | None = None) -> DataFrame:
    """conversations(conv_id, turn, role, text) as one row a turn: conv_id, start (ids of the conversation before it), ids (little-endian uint32), loss_from and loss_to (the learned stretch, in places of the conversation; equal: none). Written once to the shared folder."""
    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark, "chat")
    small_batches(spark)
    kind = conversations.select("conv_id").dtypes[0][1]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(codec(path, pattern))
        now, place = object(), 0
        for b in batches:
            roles, texts = ([x or "" for x in b.column(c).to_pylist()] for c in ("role", "text"))
            turns = f.encode(roles, texts)
            starts, learned = [], []
            for conv, role, (ids, lo, hi) in zip(b.column("conv_id").to_pylist(), roles, turns, strict=True):
                if conv != now:
                    now, place = conv, 0
                starts.append(place)
                learned.append((place + lo, place + hi if role == LEARNED else place + lo))
                place += len(ids) // 4
            lo, hi = (pa.array([x[i] for x in learned], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("conv_id"), pa.array(starts, pa.int64()), pa.array([x[0] for x in turns], pa.binary()), lo, hi], names=["part", "conv_id", "place", "ids", "lo", "hi"])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "nth")]
    dealt = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("nth")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")
    turns = scratch.table(dealt.mapInArrow(tidy(assemble), f"part int, conv_id {kind}, place long, ids binary, lo long, hi long"), "turns")
    ends = turns.groupBy("part", "conv_id").agg(F.max(F.col("place") + (F.octet_length("ids") / 4).cast("long")).alias("length"))
    spans = ends.groupBy("conv_id").agg(F.collect_list(F.struct("part", "length")).alias("spans")).where(F.size("spans") > 1)  # of a range the first or last only
    cut = spans.select("conv_id", F.explode("spans").alias("at"), "spans").select(
        F.col("conv_id").alias("_conv"), F.col("at.part").alias("_part"), F.aggregate(F.filter("spans", lambda s: s["part"] < F.col("at.part")), F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("_before")
    )
    both = turns.join(F.broadcast(cut), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    before = F.coalesce("_before", F.lit(0))
    return both.select("conv_id", (F.col("place") + before).alias("start"), "ids", (F.col("lo") + before).alias("loss_from"), (F.col("hi") + before).alias("loss_to"))


def read_conversations(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, start, n_ids, role, text, learned (text under the mask), form (text form) of each turn, from its ids and the mask; rows stay where they are read."""
    small_batches(formatted.sparkSession)
    kind = formatted.select("conv_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(codec(path, pattern))
        for b in batches:
            rows, counts = [], []
            for start, ids, lo, hi in zip(*(b.column(c).to_pylist() for c in ("start", "ids", "loss_from", "loss_to")), strict=True):
                steps = np.zeros(len(ids) // 4 + 1, np.int8)  # one up where the mask begins, one down where it ends
                steps[lo - start] += 1
                steps[hi - start] -= 1
                rows.append(f.decode(ids, np.cumsum(steps)[:-1] > 0))
                counts.append(len(ids) // 4)
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("start"), pa.array(counts, pa.int64()), *columns], names=["conv_id", "start", "n_ids", "role", "text", "learned", "form"])

    return formatted.mapInArrow(tidy(run), f"conv_id {kind}, start long, n_ids long, role string, text string, learned string, form string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of read_conversations' rows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Such a digest takes a conversation's turns one after the other; they pass through a task in order, none is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = turns.select("conv_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some = None, False
        for b in batches:
            out = []
            for conv, start, n, role, text, learned, form in zip(*(b.column(c).to_pylist() for c in ("conv_id", "start", "n_ids", "role", "text", "learned", "form")), strict=True):
                if not some or conv != now:
                    if some:
                        out.append((now, count, all_turns.hexdigest(), chars, all_learned.hexdigest(), length))
                    now, some, count, chars, length, place = conv, True, 0, 0, 0, 0
                    all_turns, all_learned = hashlib.sha256(), hashlib.sha256()
                if start != place:
                    raise ValueError(f"conversation {conv}: a turn at {start} follows one that ends at {place}")
                place += n
                count, chars, length = count + 1, chars + len(learned), length + len(form)
                all_turns.update(f"{role}\n{text}\n".encode())
                all_learned.update(learned.encode())
            yield _rows(out, b.schema.field("conv_id").type, names)
            last = b.schema.field("conv_id").type
        if some:
            yield _rows([(now, count, all_turns.hexdigest(), chars, all_learned.hexdigest(), length)], last, names)

    together = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "start")
    return together.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one, -7, whose texts are full of marks: formatted, written, read back."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(read_conversations(format_conversations(given.unionByName(odd), path, pattern), path, pattern))
