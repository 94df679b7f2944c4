"""Ids of the public word BPE, as the tokenizers library gives them, with the work per distinct piece kept.

White space is dropped by this tokenizer and no piece spans it. Text of ASCII and Latin-1 letters is lower-cased
and cut into pieces as the tokenizer's own normaliser and pre-tokenizer would, and each piece's ids come from a
dictionary of bounded size; pieces not met before are encoded by the library's model. Chunks between white space
for which that isn't plainly the same (marks that may combine, special tokens) go to the library whole, and are
kept like pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Characters that Rust's \\s takes as white space and those only; str.split() also cuts at \\x1c-\\x1f.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CUT, _CONTROL = re.compile(f"[{_SPACE}]+"), re.compile("[\x1c-\x1f]")
#: Latin text whose normal form and lower case are letter by letter.
_PLAIN, _PLAIN_TEXT = re.compile("[\x21-\x7e\xa1-\xff]*"), re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa0-\xff]*")
#: Letters and numbers of plain text in lower case.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_L}{_N}]+")


class _Kept(dict):
    """Ids of pieces met of late; asks the generation before. What neither has is listed, and gets an array to be filled."""

    def __init__(self, before: dict[str, bytes]):
        self.before, self.missed = before, []

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.before.get(piece)
        if ids is None:
            self.missed.append(piece)
            ids = bytearray()
        self[piece] = ids
        return ids


class WordTokenizer:
    """KEPT: pieces kept, of two generations; LONGEST: characters of those; STEP: characters whose new pieces are encoded together."""

    KEPT, LONGEST, STEP = 400_000, 48, 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        plain = json.loads(self.lib.to_str()) | {"normalizer": None, "added_tokens": []}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, plain["pre_tokenizer"]["pretokenizers"][-1]]}
        self.pieces_only = Tokenizer.from_str(json.dumps(plain))  # the same model, for pieces that are cut already
        self.kept = _Kept({})

    def _meet(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of pieces and odd chunks, by the library."""
        plain = [p for p in pieces if _is_plain(p)]
        if len(plain) < len(pieces):
            for p in set(pieces).difference(plain):
                yield p, np.array(self.lib.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        enc = self.pieces_only.encode(" ".join(plain), add_special_tokens=False)
        data, words = np.array(enc.ids, "<u4").tobytes(), np.array(enc.word_ids, np.int64)
        ends = (4 * np.searchsorted(words, np.arange(len(plain)), "right")).tolist()
        yield from zip(plain, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of whole texts (null: none)."""
        out: list[bytes] = []
        for some in _by_size(texts, self.STEP):
            if len(self.kept) > self.KEPT // 2:  # what isn't met again for as long goes
                self.kept.before = {}
                self.kept = _Kept(dict(self.kept))
            kept = self.kept
            rows = [[*map(kept.__getitem__, _cut(t))] for t in some]
            for p, ids in self._meet(kept.missed):
                kept[p] += ids
            out += map(b"".join, rows)
            for p in kept.missed:
                if len(p) > self.LONGEST:
                    del kept[p]
                else:
                    kept[p] = bytes(kept[p])
            kept.missed.clear()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def _is_plain(chunk: str) -> bool:
    return _PLAIN.fullmatch(chunk) is not None and "<|" not in chunk


def _cut(text: str | None) -> list[str]:
    """Pieces of a text in lower case, and odd chunks as they are: the latter aren't plain, so the two can't be mistaken."""
    if not text:
        return []
    if _PLAIN_TEXT.fullmatch(text) is not None and "<|" not in text:
        return _PIECES.findall(text.lower())
    out: list[str] = []
    for c in text.split() if _CONTROL.search(text) is None else filter(None, _CUT.split(text)):
        out += _PIECES.findall(c.lower()) if _is_plain(c) else [c]
    return out


def _by_size(texts: list, step: int) -> Iterator[list]:
    """Runs of texts of about `step` characters; a longer one by itself."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= step:
            yield run
            run, size = [], 0
    if run:
        yield run


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
