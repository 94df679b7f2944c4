"""Chat formatting: exact round trips by ids and by text, masks, odd rows, long conversations over several ranges."""

import hashlib
import random

import numpy as np
import public_tokenizers

from lociframe.llm import chat
from lociframe.llm.bpe import codec

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def expected(rows):
    """Digests of (conv_id, turn, role, text) by plain loops."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        n, turns, learned = out.setdefault(conv, (0, "", ""))
        out[conv] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", learned + ((text or "") if role == "assistant" else ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x)) for c, (n, t, x) in out.items()}


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def round_trip(spark, rows, more=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.read_conversations(chat.format_conversations(df, PATH, PATTERN), PATH, PATTERN))


def test_escapes_are_reversible_in_both_forms():
    f = chat.Formatter(codec(PATH, PATTERN))
    rng = random.Random(5)
    parts = [*chat.MARKS, "\\", "\\\\", " ", "a", "[", "/", "<", "<|endoftext|>", "é\n"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[/ROLE]", "\\[ROLE]"]), "".join(rng.choices(parts, k=rng.randrange(7)))) for _ in range(3)]
        ids = f.encode([r for r, _ in turns], [t for _, t in turns])
        read = [f.decode(x, np.zeros(len(x) // 4, bool)) for x, _, _ in ids]
        assert [(r, t) for r, t, _, _ in read] == turns
        assert chat.parse_text("".join(form for *_, form in read)) == turns
        assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_query_equals_plain_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    want = expected([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    df = chat.op11_chat_format(spark, SF)
    assert got(df) == want
    found = {r.conv_id: r.formatted_chars for r in df.collect()}
    assert found[-7] == len("[INST] \\</s>\\[INST] ok \\[/INST] [/INST]<s> \\</s>\\[INST] ok \\[/INST] </s>")


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", ""), (1, 2, "assistant", None), (None, 1, "assistant", "x"), (None, 0, "tool", "[/ROLE] y"), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (2, 5, "assistant", "Same"), (3, 0, "user", "long " * 40_000)]
    assert got(round_trip(spark, rows)) == expected(rows)
    assert round_trip(spark, []).collect() == []
    clash = spark.createDataFrame([(1, 0, "assistant", "a", 7, "z")], "conv_id long, turn long, role string, text string, ids long, start string")
    assert got(chat.digests(chat.read_conversations(chat.format_conversations(clash, PATH, PATTERN), PATH, PATTERN))) == expected([(1, 0, "assistant", "a")])


def test_a_conversation_over_several_ranges(spark):
    rows = [(9, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(900)] + [(9, 450, "user", "again")] * 500 + [(c, 0, "user", "short") for c in (1, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df, PATH, PATTERN)
    places = sorted((r.start, len(r.ids) // 4) for r in formatted.where("conv_id = 9").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert got(chat.digests(chat.read_conversations(formatted, PATH, PATTERN))) == expected(rows)
