"""Texts as runs of chunks between white space, for tokenizers that never look across it."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]")
#: str.split() also cuts at these four, which are no white space to the tokenizers.
_ODD = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"[^\S\x1c-\x1f]+")


def chunks(text: str) -> list[str]:
    if _ODD.search(text):
        return [c for c in _CUT.split(text) if c]
    return text.split()


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at white space only."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        to = m.start() if m else len(text)
        yield text[at:to]
        at = to
    if at < len(text) or not text:
        yield text[at:]


def load(path: str):
    """The library's tokenizer, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ignores_space(tok) -> bool:
    """Whether the tokenizer drops white space and never looks across it.

    Found by trying every character that Python takes for white space between, before and
    after probes that other tokenizers join with or mark at white space.
    """

    def ids(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and not _ODD.match(c)]
    probes = ["the", "The", "1", "é", "'s", ".", "́x"]
    if any(ids(c) for c in spaces):
        return False
    return all(ids(c + a + c + b + c) == ids(a) + ids(b) for c in spaces for a in probes for b in probes[:3])


_PLAIN = re.compile("[!-~À-įĲ-ňŊ-ſ]*")
_WORDS_AND_MARKS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def folds(path: str) -> bool:
    """Whether the file lower-cases and cuts words from marks, so that ``Word,`` has the ids of ``word`` and then those of ``,``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(p["type"] == "Lowercase" for p in parts) and bool(cuts) and cuts[0].get("pattern") == {"Regex": _WORDS_AND_MARKS} and cuts[0].get("invert") is True


def added_tokens(path: str) -> tuple[str, ...]:
    """What the file's added tokens stand for, in lower case. The library looks for them before it lower-cases."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"].lower() for t in json.load(f).get("added_tokens") or [])


def fold(chunk: str, added: tuple[str, ...] = ()) -> tuple[str, str]:
    """A chunk of plain letters as its lower case and the one mark that follows a word in it, if any.

    Plain are printable ASCII and the precomposed Latin letters whose lower case is one letter.
    A chunk whose lower case has one of ``added`` in it stays as it is.
    """
    if not _PLAIN.fullmatch(chunk) or (added and any(t in chunk.lower() for t in added)):
        return chunk, ""
    if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isalpha():
        return chunk[:-1].lower(), chunk[-1]
    return chunk.lower(), ""


_kept: dict = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing at a time.

    Workers outlive the operators that use them, so what an earlier one has kept makes room
    before the next fills its own.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _kept[key] = make()
    return _kept[key]


def plain_word(chunk: str) -> bool:
    """Whether a chunk is one word of plain lower-case letters, which normalisation and the cut leave as it is."""
    return chunk.isalpha() and chunk.islower() and _PLAIN.fullmatch(chunk) is not None


def byte_symbols() -> dict[str, int]:
    """The symbols that byte-level tokenizers write for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in out.values())}


_SYMBOL = {b: c for c, b in byte_symbols().items()}
#: Plain letters that aren't ASCII as the symbols of their bytes, for str.translate().
LETTERS = {k: "".join(_SYMBOL[b] for b in chr(k).encode()) for k in range(0xC0, 0x180)}


def encoder(path: str, tok) -> Callable[[str], list[int]]:
    """The library's ids of a chunk; where :func:`folds` holds, plain words go straight to the library's model."""
    if not folds(path):
        return lambda chunk: tok.encode(chunk, add_special_tokens=False).ids
    model = tok.model

    def ids(chunk: str) -> list[int]:
        if plain_word(chunk) and len(chunk) <= 48:
            return [t.id for t in model.tokenize(chunk.translate(LETTERS))]
        return tok.encode(chunk, add_special_tokens=False).ids

    return ids


class Memo(dict):
    """What a worker process keeps for chunks: a fixed part, and a rest that is dropped when it is full.

    ``compute`` gives the value of a chunk. With ``join``, the value of a chunk that folds into
    a word and a mark is joined from theirs, but for chunks with a token of ``added`` in any case.
    Chunks of over ``longest`` characters are computed each time, so memory stays bounded.
    """

    def __init__(self, compute: Callable[[str], Any], fixed: dict | None = None, limit: int = 1_000_000, longest: int = 48, join: Callable[[Any, Any], Any] | None = None, added: tuple[str, ...] = ()):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.limit, self.longest, self.join, self.added = compute, fixed or {}, limit, longest, join, added

    def __missing__(self, chunk: str):
        if len(chunk) > self.longest:
            return self.compute(chunk)
        if self.join is None:
            value = self.compute(chunk)
        else:
            word, mark = fold(chunk, self.added)
            if word != chunk:
                value = self[word]
                if mark:
                    value = self.join(value, self[mark])
            else:
                value = self.compute(chunk)
        if len(self) >= self.limit:
            self.clear()
            self.update(self.fixed)
        self[chunk] = value
        return value
