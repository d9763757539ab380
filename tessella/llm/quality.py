"""Quality: histogram gradient-boosted trees over document statistics.

Trees are trained in numpy on binned statistics and kept as complete binary trees in flat
arrays, so that scoring is a few gathers for all rows and trees at once.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import segments
from .common import column, ship
from .labelled import held_out, labelled_sample

#: Labelled rows of class 0 and of class 1 that a model is fitted on, at most (in expectation).
PER_CLASS = (4096, 4096)
#: Lines of over so many characters are told apart by their digest, so that a line of any length is one line in bounded memory.
LINE = 4096
#: A text is kept (predicted 1) from this score on.
THRESHOLD = 0.3

_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "bracket", "bar", "symbol", "exclaim", "high", "control")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
for _name, _bytes in (
    ("lower", range(97, 123)),
    ("upper", range(65, 91)),
    ("digit", range(48, 58)),
    ("space", (9, 32)),
    ("newline", (10, 13)),
    ("stop", b".,;:"),
    ("quote", b"'\"-"),
    ("bracket", b"()[]{}<>"),
    ("bar", b"|"),
    ("exclaim", b"!?"),
    ("high", range(128, 256)),
    ("control", [*range(9), 11, 12, *range(14, 32), 127]),
):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

STATISTICS = (
    "log_bytes", "log_words", *_CLASSES[:4], *_CLASSES[5:], "word_mean", "word_deviation", "word_longest", "distinct_words", "distinct_pairs",
    "repeats", "caps_words", "log_lines", "distinct_lines", "line_words", "stops_a_word",
)


class _Lines:
    """Lines that aren't empty, counted as they come in parts: a line that goes on in the next part stays open."""

    def __init__(self):
        self.count, self.seen = 0, set()
        self.head, self.size, self.digest = "", 0, None

    def feed(self, text: str) -> None:
        first, *rest = text.split("\n")
        self._open(first)
        for line in rest:
            self.close()
            self._open(line)

    def _open(self, part: str) -> None:
        self.size += len(part)
        if self.size <= LINE:
            self.head += part
        else:
            if self.digest is None:
                self.digest = hashlib.blake2b(self.head.encode("utf-8", "surrogatepass"), digest_size=16)
                self.head = ""
            self.digest.update(part.encode("utf-8", "surrogatepass"))

    def close(self) -> None:
        if self.size:
            self.count += 1
            self.seen.add(self.head if self.digest is None else (self.size, self.digest.digest()))
        self.head, self.size, self.digest = "", 0, None


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text; null counts as empty. Texts are read in segments, which no statistic depends on."""
    kinds = np.zeros(len(_CLASSES), np.int64)
    size = n = repeats = caps = longest = 0
    total = squares = 0.0
    words_seen: set = set()
    pairs_seen: set = set()
    own_lines = _Lines()
    last = None
    for part in segments(text or ""):
        data = np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)
        size += len(data)
        kinds += np.bincount(_CLASS[data], minlength=len(_CLASSES))
        words = part.split()
        own_lines.feed(part)
        if not words:
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n += len(words)
        total += float(lengths.sum())
        squares += float((lengths * lengths).sum())
        longest = max(longest, int(lengths.max()))
        caps += sum(map(str.isupper, words))
        words_seen.update(words)
        chain = words if last is None else [last, *words]
        repeats += sum(map(operator.eq, chain, chain[1:]))
        codes = np.fromiter(map(hash, chain), np.int64, len(chain))
        pairs_seen.update((codes[1:] * 31 + codes[:-1]).tolist())
        last = words[-1]
    own_lines.close()
    lines, lines_seen = own_lines.count, own_lines.seen
    b, w, ln = max(1, size), max(1, n), max(1, lines)
    mean = total / w
    shares = (kinds / b).tolist()
    return [
        float(np.log1p(size)), float(np.log1p(n)), *shares[:4], *shares[5:], mean, max(0.0, squares / w - mean * mean) ** 0.5, float(longest),
        len(words_seen) / w, len(pairs_seen) / w, repeats / w, caps / w, float(np.log1p(lines)), len(lines_seen) / ln, n / ln, float(kinds[_CLASSES.index("stop")]) / w,
    ]


class BoostedTrees:
    """Gradient boosting for two classes on binned columns; ``score`` gives the probability of class 1.

    Tree t is a complete tree of ``depth`` levels: node i has its children at 2i+1 and 2i+2,
    ``feature`` and ``cut`` are (trees, inner nodes) arrays and ``leaf`` a (trees, leaves)
    array. A row goes right where its value exceeds the cut; a node that isn't split sends all
    rows left.
    """

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.cut = np.zeros((0, 2**depth - 1))
        self.leaf = np.zeros((0, 2**depth))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "BoostedTrees":
        """Fits to rows of statistics; without rows of both classes the score is the smoothed share of class 1."""
        y = np.asarray(y, np.float64)
        w = np.ones(len(y)) if weight is None else weight
        p = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1) if len(y) else 0.5
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        margin = np.full(len(y), self.base)
        features, cuts, leaves = [], [], []
        cells = np.arange(x.shape[1]) * self.bins
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = w * (q - y), np.maximum(w * q * (1 - q), 1e-9)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                at = ((node - first)[:, None] * x.shape[1] * self.bins + cells + binned).ravel()
                shape = (width, x.shape[1], self.bins)
                size = width * x.shape[1] * self.bins
                sums = [np.bincount(at, np.repeat(v, x.shape[1]), size).reshape(shape).cumsum(2) for v in (g, h, np.ones(len(y)))]
                gl, hl, nl = sums
                gt, ht, nt = (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(nl < self.least) | (nt - nl < self.least)] = -np.inf
                flat = gain.reshape(width, -1)
                best = flat.argmax(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if flat[k, best[k]] > 1e-6 and b < len(edges[j]):
                        feature[first + k], cut[first + k] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            slot = node - (2**self.depth - 1)
            leaf = -self.rate * np.bincount(slot, g, 2**self.depth) / (np.bincount(slot, h, 2**self.depth) + self.l2)
            margin += leaf[slot]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.leaf):
            tree = np.arange(len(self.leaf))
            for k in range(0, len(x), 2048):
                rows = np.arange(len(x[k : k + 2048]))[:, None]
                own, node = x[k : k + 2048], np.zeros((len(rows), len(tree)), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (own[rows, self.feature[tree, node]] > self.cut[tree, node])
                out[k : k + 2048] += self.leaf[tree, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = PER_CLASS) -> BoostedTrees:
    """A model of ``labels.quality``, fitted on the driver to a bounded sample weighted back to the classes' shares.

    Tasks compute the statistics of the sample's whole texts; only those reach the driver. Null
    labels and ids, repeated rows and empty tables are as in :func:`labelled_sample`.
    """
    ship(docs.sparkSession)
    sample, share = labelled_sample(docs, labels, "quality", per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["id", "label", "x"])

    seen = sample.mapInArrow(run, "id long, label int, x array<double>").toArrow().sort_by("id")
    y = seen.column("label").to_numpy().astype(np.int64)
    x = np.array(seen.column("x").to_pylist(), np.float64).reshape(len(y), len(STATISTICS))
    ones = y.sum()
    weight = np.where(y == 1, share / max(1, ones), (1 - share) / max(1, len(y) - ones)) * len(y) if len(y) else None
    return BoostedTrees().fit(x, y, weight)


def score_quality(docs: DataFrame, model: BoostedTrees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if the score reaches ``threshold``).

    The model is broadcast (some 50 kB whatever the corpus). Texts are read whole; null texts
    count as empty. Null ids count as held out; they and repeated rows stay. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
