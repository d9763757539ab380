"""BPE as a streaming transducer with bounded lookahead, and decoding as a state machine.

Whether a token at the front of a text stands depends on a bounded number of symbols after it,
however the text goes on. That number follows from the merge list. The transducer holds a
window of symbols, merges it, emits the tokens that have that many symbols behind them, and
goes on from the last border emitted: what follows a border of the encoding is the encoding of
what follows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import LETTERS, Memo, added_tokens, byte_symbols, chunks, folds, ignores_space, kept, load, plain_word, segments
from .common import column, ship

_NEVER = 1 << 60
#: Windows of up to so many symbols are merged by scanning, longer ones with a heap.
_SCAN = 64


class MergeList:
    """Vocabulary and merges of a tokenizers ``.json`` file whose model is BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        for k, (a, b) in enumerate(merges):
            if a + b in self.parts:
                raise ValueError("two merges make one token: the last token of a prefix isn't unique")
            if max(self.born.get(a, -1), self.born.get(b, -1)) >= k:
                raise ValueError("a merge comes before its parts")
            self.parts[a + b], self.born[a + b] = (a, b), k
        self.longest = max((self.width(t) for t in self.vocab), default=1)
        self.lookahead = self._lookahead(merges)

    def width(self, token: str) -> int:
        """Symbols in a token; the suffix belongs to its last one."""
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0) or 1

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a token's end beyond which nothing can change it.

        Whether merge (a, b) takes place depends on what stands right of a: b, which may lose
        its last symbols only to an earlier merge (s, w) with s on the right edge of b, which
        depends on w in the same way. Following such chains of ever earlier merges gives the
        furthest symbol that matters; one pass in order of the merges finds the longest.
        """
        reach: dict[str, int] = {}
        far = 1
        for a, b in merges:
            edge, most = b, 0
            while edge:
                most = max(most, reach.get(edge, 0))
                edge = self.parts[edge][1] if edge in self.parts else ""
            n = self.width(b) + most
            reach[a] = max(reach.get(a, 0), n)
            far = max(far, n)
        return far

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges in order of rank, the leftmost first among equals."""
        rank = self.rank.get
        if len(symbols) > _SCAN:
            return self._merge_long(symbols)
        ranks = [rank(p, _NEVER) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), _NEVER)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has gone into another token meanwhile
            symbols[i], symbols[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return [x for x in symbols if x]


class Encoder:
    """The transducer for one pre-token: feed() takes symbols and gives stable tokens, end() the rest.

    Kept are at most ``window`` symbols, a fixed multiple of the lookahead.
    """

    def __init__(self, merges: MergeList, window: int | None = None):
        self.m, self.held = merges, ""
        self.window = max(window or 0, 4 * merges.lookahead)

    def feed(self, symbols: str) -> Iterator[str]:
        at = 0
        while len(self.held) + len(symbols) - at > self.window:
            take = self.window - len(self.held)
            self.held += symbols[at : at + take]
            at += take
            tokens, end = self.m.merge(list(self.held)), 0
            for t in tokens:
                if end + len(t) > len(self.held) - self.m.lookahead:
                    break
                end += len(t)
                yield t
            self.held = self.held[end:]
        self.held += symbols[at:]

    def end(self) -> list[str]:
        """The last tokens; the last symbol of all carries the end-of-word suffix."""
        symbols, self.held = list(self.held), ""
        if symbols:
            symbols[-1] += self.m.suffix
        return self.m.merge(symbols)


class Utf8Machine:
    """Bytes to text, step by step: bytes of an unfinished character wait for the next call.

    A byte that can't continue a character makes the bytes before it one replacement character.
    """

    def __init__(self):
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode()
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if left else ""


class Codec:
    """Encoding and decoding with one tokenizer file.

    Normalisation and the cut into pre-tokens are the file's own; merging is the transducer.
    """

    def __init__(self, path: str, cached: int = 400_000):
        self.tok, self.m = load(path), MergeList(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("single_word") or t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("only added tokens that are matched as they stand are supported")
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} isn't supported")
        self.byte_level = kind == "ByteLevel"
        self.bytes_of = byte_symbols()
        self.texts = {i: t for t, i in (self.m.vocab | self.added).items()}
        self.spaceless = ignores_space(self.tok)
        self.folds = folds(path)
        self.words: dict[str, list[int]] = {}
        self.data: dict[int, bytes] = {}  # of byte-level tokens, as many as the vocabulary has at most
        self.cached = cached

    def _word(self, symbols: str) -> list[int]:
        ids = self.words.get(symbols)
        if ids is None:
            vocab, run = self.m.vocab, Encoder(self.m)
            ids = [vocab[t] for t in run.feed(symbols)] + [vocab[t] for t in run.end()]
            if len(symbols) <= 48:
                if len(self.words) >= self.cached:
                    self.words.clear()
                self.words[symbols] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of added tokens in it become their ids, as by default."""
        if self.folds and plain_word(text):
            return self._word(text.translate(LETTERS))
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if self.tok.normalizer is not None:
                    part = self.tok.normalizer.normalize_str(part)
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(part) if part else []:
                    out += self._word(piece)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, in parts: one blank between tokens without a decoder, else through the byte machine.

        Ids outside the vocabulary are passed over, as the library does.
        """
        if not self.byte_level:
            known = (self.texts[i] for i in ids if i in self.texts)
            yield next(known, "")
            for t in known:
                yield " " + t
            return
        machine = Utf8Machine()
        for i in ids:
            data = self.data.get(i)
            if data is None:
                t = self.texts.get(i, "")
                data = self.data[i] = bytes(self.bytes_of[c] for c in t) if all(c in self.bytes_of for c in t) else t.encode()
            yield machine.feed(data)
        yield machine.end()


def _codec(path: str) -> tuple[Codec, Memo]:
    def make() -> tuple[Codec, Memo]:
        codec = Codec(path, cached=400_000)

        def both(chunk: str) -> tuple[str, str]:
            ids = codec.encode(chunk)
            return " ".join(map(str, ids)), "".join(codec.decode(ids))

        def join(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
            return f"{a[0]} {b[0]}", f"{a[1]} {b[1]}"

        return codec, Memo(both, limit=600_000, join=join if folds(path) else None, added=added_tokens(path))

    return kept(("bpe", path), make)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, as the tokenizers library gives them without added special tokens.

    Null texts count as empty and have no ids. Null ids and repeated rows stay; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(path)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    ship(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of an array of ids; null arrays count as empty, null or unknown ids are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(path)
        for b in batches:
            texts = ["".join(codec.decode(x or [])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    ship(rows.sparkSession)
    own = rows.select(column(id_col).cast("long").alias("id"), column(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256.

    Every text is encoded and its ids are decoded; both run chunk by chunk where the tokenizer
    drops white space, with a bounded cache of chunks in each worker, and the digests take the
    parts in as they come. Null texts count as empty: 0 tokens, digests of the empty string.
    Null ids and repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(path)
        chunked = codec.spaceless and not codec.byte_level
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [0] * len(texts)
            digests = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            if chunked:
                for row, text in enumerate(texts):
                    for part in segments(text or ""):
                        found = [p for p in map(memo.__getitem__, chunks(part)) if p[0]]
                        if found:
                            ids, own = " ".join([p[0] for p in found]), " ".join([p[1] for p in found])
                            lead = " " if n[row] else ""
                            n[row] += ids.count(" ") + 1
                            digests[row][0].update((lead + ids).encode())
                            digests[row][1].update((lead + own).encode())
            else:
                for row, t in enumerate(texts):
                    ids = codec.encode(t or "")
                    n[row] = len(ids)
                    digests[row][0].update(" ".join(map(str, ids)).encode())
                    for p in codec.decode(ids):
                        digests[row][1].update(p.encode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([a.hexdigest() for a, _ in digests], pa.string()), pa.array([d.hexdigest() for _, d in digests], pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
