"""Token counts by a map-side lookup in two tiers; pre-tokens are never shuffled."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, added_tokens, chunks, encoder, folds, ignores_space, kept, load, segments
from .common import column, ship

#: Entries of the broadcast table; each is a chunk of at most 48 characters and a length.
FREQUENT = 32_768
_FAN_IN = 16


def _top(counts: dict[str, int], size: int) -> tuple[list[str], list[int]]:
    words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    if len(words) > size:
        best = np.argpartition(-n, size - 1)[:size]
        words, n = [words[i] for i in best], n[best]
    return words, n.tolist()


def frequent_chunks(docs: DataFrame, text_col: str, size: int = FREQUENT) -> list[str]:
    """About the ``size`` most frequent chunks of all texts.

    Every task reads all its texts and hands on one summary of its own ``size`` most frequent
    chunks; the summaries, not the chunks, are merged in a tree. A chunk that is frequent
    overall is frequent in some task, so it comes through; the counts of rare ones are
    approximate. The result only decides what the first tier holds, never a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for part in segments(text or ""):
                    seen.update(chunks(part))
            if len(seen) > 24 * size:
                seen = Counter(dict(zip(*_top(seen, 8 * size))))
        words, n = _top({w: k for w, k in seen.items() if k > 1 and len(w) <= 48}, size)
        if words:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "words": pa.array([words]), "n": pa.array([n], pa.list_(pa.int64()))})

    schema = "part long, words array<string>, n array<long>"

    def merge(group: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for words, n in zip(group.column("words").to_pylist(), group.column("n").to_pylist()):
            for w, k in zip(words, n):
                total[w] += k
        words, n = _top(total, size)
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // _FAN_IN], pa.int64()), "words": pa.array([words], pa.list_(pa.string())), "n": pa.array([n], pa.list_(pa.int64()))})

    rows = docs.select(column(text_col).alias("text"))
    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(summarise, schema)
    while True:
        found = found.groupBy(F.floor(F.col("part") / _FAN_IN)).applyInArrow(merge, schema)
        parts = -(-parts // _FAN_IN)
        if parts <= 1:
            break
    return [w for r in found.select("words").collect() for w in r.words]


class _Lengths:
    """The broadcast table: chunks joined by blanks, and their lengths as 16-bit numbers."""

    def __init__(self, path: str, words: list[str], n: list[int]):
        self.path, self.words, self.n = path, " ".join(words).encode(), np.array(n, np.uint16).tobytes()

    def memo(self) -> Memo:
        def make() -> Memo:
            ids = encoder(self.path, load(self.path))
            fixed = dict(zip(self.words.decode().split(" ") if self.words else [], np.frombuffer(self.n, np.uint16).tolist()))
            return Memo(lambda c: len(ids(c)), fixed, join=operator.add if folds(self.path) else None, added=added_tokens(self.path))

        return kept(("tokens", self.path, self.words), make)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.

    ``path`` names a ``.json`` file of the tokenizers library or a ``.model`` file of
    sentencepiece; counts are the library's without begin, end or added special tokens.
    Tokenizers that drop white space go through the two tiers: lengths of frequent chunks are
    broadcast as one compact table (at most ``frequent`` entries of at most 48 characters, so
    about 2 MB), and a worker computes what misses with the library, once for each chunk that
    it meets, in a cache of bounded size. For others the library reads each whole text.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay as they are;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    pieces = path.endswith(".model")
    shared = None
    if not pieces:
        tok = load(path)
        if ignores_space(tok):
            words = frequent_chunks(docs, text_col, frequent)
            n = [len(e) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
            shared = spark.sparkContext.broadcast(_Lengths(path, words, n))

    def whole(texts: list[str]) -> list[int]:
        def make():
            if pieces:
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=path)
                return lambda x: list(map(len, model.encode(x, num_threads=1)))
            tok = load(path)
            return lambda x: [len(e) for e in tok.encode_batch_fast(x, add_special_tokens=False)]

        lengths = kept(("whole", path), make)
        return [n for k in range(0, len(texts), 64) for n in lengths(texts[k : k + 64])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            if shared is None:
                n = np.array(whole(texts.to_pylist()), np.int64)
            else:
                n, memo = np.zeros(len(texts), np.int64), shared.value.memo()
                for row, text in enumerate(texts.to_pylist()):
                    n[row] = sum(sum(map(memo.__getitem__, chunks(part))) for part in segments(text))
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
