"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, a bag of words the
mean of its words, and a softmax layer maps that to two classes. Misspellings that were never
seen share n-gram vectors with the words they come from. The model is fitted to whole texts. A
text gives two scores: the softmax of its whole bag, and that of the bag of its most toxic
passage, calibrated, in which long texts hide nothing.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, chunks, kept, segments
from .common import column, cut, ship
from .labelled import held_out, labelled_sample, platt

#: Labelled rows of class 0 and of class 1 that a model is fitted on, at most (in expectation).
PER_CLASS = (4096, 2048)
#: Words of a passage.
PASSAGE = 2
BUCKETS, DIM = 1 << 17, 6
#: Texts of the sample that have a word, at least, for it to be trained on; its n-grams are scored all the same.
FEW = 2
#: Characters of an n-gram.
_SIZES = (3, 4, 5)
_WORD = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams with marked ends."""
    w = f"<{word}>"
    try:
        codes = w.encode("latin-1")  # a byte for each character, which is all that cutting needs
    except UnicodeEncodeError:
        grams = {w[i : i + n] for n in _SIZES for i in range(len(w) - n + 1)} | {w}
        return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]
    grams = {codes[i : i + n] for n in _SIZES for i in range(len(codes) - n + 1)}
    grams.add(codes)
    return [h % BUCKETS for h in map(zlib.crc32, grams)]


class SubwordSoftmax:
    """Embeddings and output layer; ``weight``, ``base``, ``slope`` and ``bias`` hold what scoring needs once fitted.

    Mean and output layer are linear, so a bucket's share of the margin between the classes is
    its vector times the difference of the output columns: one number for each bucket. ``base``
    is the difference of the layer's own biases.
    """

    def __init__(self, seed: int = 0):
        self.seed, self.weight, self.base, self.slope, self.bias = seed, np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0
        self._list: list[float] | None = None

    def train(self, bags: list[dict[str, int]], labels: list[int], steps: int = 192, rate: float = 0.2, rows: int = 96, least: int = 5) -> bool:
        """Trains vectors and softmax jointly on labelled bags of words (RMSprop and Adagrad, classes weighted evenly).

        Training takes ``steps`` steps of about ``rows`` bags, so as many passes as that needs.
        Words that fewer than ``FEW`` bags have aren't trained on, and buckets that fewer than
        ``least`` bags have stay at zero. With one class or none the scores are that class's
        smoothed share, and the answer is False.
        """
        y = np.asarray(labels, np.int64)
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 0.5) / (len(y) + 2)
            self.base = self.bias = float(np.log(p / (1 - p)))
            return False
        batches = max(1, len(y) // rows)
        self._train(bags, y, -(-steps // batches), rate, batches, least, np.random.default_rng(self.seed))
        return True

    def calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Fits the passage scores to texts that the model wasn't trained on."""
        self.slope, self.bias = platt(margins, labels)

    def _train(self, bags, y, epochs, rate, batches, least, rng) -> None:
        df = Counter()
        for bag in bags:
            df.update(bag.keys())
        number: dict[str, int] = {}
        words, counts, docs = array("i"), array("f"), array("i")
        total = np.array([max(1, sum(bag.values())) for bag in bags])
        for d, bag in enumerate(bags):
            # words of one text alone say nothing about others, but they count for the mean
            own = {number.setdefault(w, len(number)): n for w, n in bag.items() if df[w] >= FEW}
            words.extend(own.keys())
            counts.extend(own.values())
            docs.extend([d] * len(own))
        flat, size = array("i"), array("i")
        for w in number:
            own = subwords(w)
            flat.extend(own)
            size.append(len(own))
        words, docs = np.array(words, np.int32), np.array(docs, np.int32)
        counts, flat, size = np.array(counts, np.float32), np.array(flat, np.int32), np.array(size, np.int64)
        share_of = (counts / total[docs]).astype(np.float32)
        seen = np.bincount(flat, np.repeat([df[w] for w in number], size), BUCKETS)
        learnt = seen[flat] >= least
        inverse = (1 / size)[:, None].astype(np.float32)
        size = np.bincount(np.repeat(np.arange(len(size)), size)[learnt], minlength=len(size))
        del number, df, counts, total
        own, flat = np.unique(flat[learnt], return_inverse=True)
        flat = flat.astype(np.int32)
        first = np.cumsum(size) - size
        vec = rng.normal(0, 0.05, (len(own), DIM)).astype(np.float32)
        out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        g_vec, g_out, g_bias = np.zeros((len(own), 1), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        even = np.array([len(y) / 2 / max(1, (y == k).sum()) for k in (0, 1)], np.float32)
        starts = np.searchsorted(docs, np.arange(len(y) + 1))

        def spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
            """The numbers of all spans of n from begin on, one span after the other."""
            return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())

        def by(rows: np.ndarray, x: np.ndarray, at: np.ndarray, n: int, times=1) -> np.ndarray:
            """Sums of x[at] * times by row, a column at a time to save memory."""
            return np.stack([np.bincount(rows, x[at, j] * times, n).astype(np.float32) for j in range(x.shape[1])], 1)

        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), batches):
                n = starts[rows + 1] - starts[rows]
                at = spans(starts[rows], n)
                # only the words of the batch, and only their buckets, take part in a step
                kinds, w = np.unique(words[at], return_inverse=True)
                row_of, share = np.repeat(np.arange(len(rows)), n), share_of[at]
                bucket, word_of = flat[spans(first[kinds], size[kinds])], np.repeat(np.arange(len(kinds)), size[kinds])
                of_word = by(word_of, vec, bucket, len(kinds)) * inverse[kinds]
                hidden = by(row_of, of_word, w, len(rows), share)
                z = hidden @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p *= even[y[rows]][:, None] / max(1, len(rows))
                d_word = by(w, p @ out.T, row_of, len(kinds), share) * inverse[kinds]
                d_vec = by(bucket, d_word, word_of, len(own))
                d_out, d_bias = hidden.T @ p, p.sum(0)
                g_vec = 0.9 * g_vec + (d_vec**2).mean(1, keepdims=True)
                vec -= rate * d_vec / np.sqrt(g_vec + 1e-10)
                g_out += d_out**2
                out -= rate * d_out / np.sqrt(g_out + 1e-10)
                g_bias += d_bias**2
                bias -= rate * d_bias / np.sqrt(g_bias + 1e-10)
        self.base = float(bias[1] - bias[0])
        self.weight[own] = vec @ (out[:, 1] - out[:, 0])
        self._list = None

    def words(self, chunk: str) -> bytes:
        """Weights of the words in a chunk, as 32-bit floats."""
        if self._list is None:
            self._list = self.weight.tolist()
        of, out = self._list.__getitem__, []
        for w in _WORD.findall(chunk.lower()):
            own = subwords(w)
            out.append(struct.pack("f", sum(map(of, own)) / len(own)))
        return b"".join(out)

    def margins(self, text: str | None, of=None) -> tuple[float, float]:
        """The largest mean weight of a passage's words (a shorter text is one passage, padded with zeros), and the margin of the whole bag."""
        of, best, last, total, n = of or self.words, -np.inf, np.zeros(0, np.float32), 0.0, 0
        for part in segments(text or ""):
            own = np.frombuffer(b"".join(map(of, chunks(part))), np.float32)
            total, n = total + float(own.sum(dtype=np.float64)), n + len(own)
            x = np.concatenate([last, own])
            if len(x) >= PASSAGE:
                sums = np.convolve(x, np.ones(PASSAGE, np.float32), "valid") if PASSAGE > 2 else x[1:] + x[:-1]
                best = max(best, float(sums.max()) / PASSAGE)
                last = x[-(PASSAGE - 1) :]
            else:
                last = x
        return best if best > -np.inf else float(last.sum()) / PASSAGE, total / max(1, n) + self.base

    def margin(self, text: str | None, of=None) -> float:
        return self.margins(text, of)[0]

    def score(self, margins: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * margins + self.bias)


def _bag(text: str | None) -> Counter:
    out: Counter = Counter()
    for part in segments(text or ""):
        out.update(_WORD.findall(part.lower()))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = PER_CLASS) -> SubwordSoftmax:
    """A model of ``labels.toxic``, fitted to a bounded sample (see :func:`labelled_sample`).

    Tasks turn whole texts into bags of words, of which four fifths train the model on the
    driver; the others' margins, computed in tasks, calibrate it. Null labels and ids, repeated
    rows and empty tables are as in :func:`labelled_sample`; without labels every text scores 0.2.
    """
    spark = docs.sparkSession
    ship(spark)
    sample, _ = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)
    aside = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) == 0
    sample = cut(sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_bag(t) for t in b.column(2).to_pylist()]
            words, counts = pa.array([list(x) for x in own], pa.list_(pa.string())), pa.array([list(x.values()) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words, counts], ["id", "label", "words", "counts"])

    seen = sample.where(~aside).mapInArrow(bags, "id long, label int, words array<string>, counts array<long>").toArrow().sort_by("id")
    model = SubwordSoftmax()
    own = [dict(zip(w.as_py(), n.as_py())) for w, n in zip(seen.column("words"), seen.column("counts"))]
    marks = seen.column("label").to_pylist()
    del seen
    if model.train(own, marks):
        shared = spark.sparkContext.broadcast(model)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _margins(shared.value, b.column(2).to_pylist())[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["id", "label", "margin"])

        rest = sample.where(aside).mapInArrow(margins, "id long, label int, margin double").toArrow().sort_by("id")
        model.calibrate(rest.column("margin").to_numpy(), rest.column("label").to_numpy().astype(np.int64))
    return model


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more), bag_score.

    ``score`` is that of the most toxic passage's bag, ``bag_score`` the softmax of the whole
    text's. The model is broadcast (half a megabyte whatever the corpus). Texts are scored
    whole; null texts count as empty and score what no evidence scores. Null ids count as held
    out; they and repeated rows stay. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _margins(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(found[:, 0])), pa.array(_logistic(found[:, 1]))], ["id", "score", "bag_score"])

    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, score double, bag_score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "bag_score")


def drop_toxic(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with all their columns, in one pass without a shuffle.

    A null text counts as empty. Null ids and repeated rows are judged by their text like any
    other; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(_margins(shared.value, b.column(at).to_pylist())[:, 0]) < limit))

    # a column's name may hold what the call can't take, so columns go through it under plain names
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _margins(model: SubwordSoftmax, texts: list[str | None]) -> np.ndarray:
    """Rows of :meth:`SubwordSoftmax.margins`, through the worker's memo of chunks."""
    key = ("toxicity", model.weight.tobytes())
    of = kept(key, lambda: Memo(model.words, limit=700_000, join=lambda a, b: a + b)).__getitem__
    return np.array([model.margins(t, of) for t in texts], np.float64).reshape(-1, 2)
