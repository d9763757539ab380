"""Best-fit packing of token sequences, online and in bounded space."""

from __future__ import annotations

import operator
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, added_tokens, chunks, encoder, folds, ignores_space, kept, load, segments
from .common import column, cut, ship

#: Open bins of a task.
OPEN = 4096
#: Bins left open by tasks that one task of the second round packs.
ROUND = 16_384
assert sys.byteorder == "little" and array("I").itemsize == 4


class BestFit:
    """Online best fit with at most ``limit`` open bins of ``size`` each.

    One bit for each free space tells whether an open bin has it. An item goes to the open bin
    with the least free space that suffices: the lowest set bit from its length on. Without
    one, a bin is opened; if that would be one too many, the fullest open bin closes first.
    Full bins close at once.
    """

    def __init__(self, size: int, limit: int, first: int = 0):
        self.size, self.limit, self.next, self.bits, self.count = size, limit, first, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        at = self.bins[free]
        bin_id = at.pop()
        if not at:
            del self.bins[free]
            self.bits ^= 1 << free
        self.count -= 1
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of ``length`` between 1 and ``size``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, free, self.next = self.next, self.size, self.next + 1
        left = free - length
        if left:
            self.bits |= 1 << left
            self.bins.setdefault(left, []).append(bin_id)
            self.count += 1
        return bin_id, self.size - free

    def open(self) -> set[int]:
        return {b for at in self.bins.values() for b in at}


def _encoder(path: str):
    """The tokenizer, and its memo of chunks' ids as bytes (None if it looks across white space)."""

    def make():
        tok = load(path)
        ids = encoder(path, tok)
        memo = Memo(lambda c: array("I", ids(c)).tobytes(), join=operator.add if folds(path) else None, added=added_tokens(path))
        return tok, memo if ignores_space(tok) else None

    return kept(("packing", path), make)


def encoded(text: str | None, path: str) -> bytes:
    """Ids of a text, unsigned in 32 bits each."""
    tok, memo = _encoder(path)
    if memo is None:
        return array("I", tok.encode(text or "", add_special_tokens=False).ids).tobytes()
    return b"".join([b"".join(map(memo.__getitem__, chunks(part))) for part in segments(text or "")])


_PIECES = "id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long, is_open boolean"


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 1,
    with_ids: bool = True,
    open_bins: int = OPEN,
    round_bins: int = ROUND,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    A document is its token ids and then ``end_id``; only documents over ``size`` are cut, into
    pieces of ``size`` and a rest. Every task encodes its documents and packs their pieces in
    the same pass (:class:`BestFit`, the pieces of one Arrow batch longest first), without a
    shuffle. The bins that a task leaves open at its end are packed again as items by the same
    rule, ``round_bins`` of them in a task, and their pieces move along as a whole.
    ``ids`` (little-endian, 32 bits each) is null unless ``with_ids``.

    Null and empty texts are a piece that holds ``end_id`` alone. Null ids and repeated rows
    are packed like any other; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit = BestFit(size, open_bins, first=TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []  # rows of bins that may still be open

        def rows(part: list[tuple], is_open: bool) -> pa.RecordBatch:
            cols = list(zip(*part)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array([is_open] * len(part), pa.bool_())], [x.split()[0] for x in _PIECES.split(", ")])

        for b in batches:
            pieces = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = encoded(text, path) + end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    own = data[at : at + 4 * size]
                    pieces.append((len(own) // 4, doc, k, at // 4, zlib.crc32(own), own if with_ids else None))
            pieces.sort(key=lambda p: -p[0])
            for n, doc, k, start, crc, own in pieces:
                held.append((doc, k, start, n, crc, own, *fit.put(n)))
            still = fit.open()
            yield rows([r for r in held if r[6] not in still], False)
            held = [r for r in held if r[6] in still]
        yield rows(held, True)

    ship(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    placed = cut(rows.mapInArrow(run, _PIECES))
    return _again(placed, size, open_bins, round_bins).withColumnRenamed("id", id_col)


def _again(placed: DataFrame, size: int, open_bins: int, round_bins: int) -> DataFrame:
    bins = placed.where("is_open").groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("used"))
    groups = max(1, -(-bins.count() // round_bins))

    def merge(group: pa.Table) -> pa.Table:
        used, ids = group.column("used").to_numpy(), group.column("sequence_id").to_numpy()
        order = np.lexsort((ids, -used))
        fit, heads, out = BestFit(size, open_bins), {}, []
        for bin_id, n in zip(ids[order].tolist(), used[order].tolist()):
            at, shift = fit.put(n)
            out.append((bin_id, heads.setdefault(at, bin_id), shift))
        old, new, shift = zip(*out)
        return pa.table({"old": pa.array(old, pa.int64()), "new": pa.array(new, pa.int64()), "shift": pa.array(shift, pa.int64())})

    moved = bins.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")).applyInArrow(merge, "old long, new long, shift long")
    kept = placed.where("not is_open").drop("is_open")
    late = placed.where("is_open").drop("is_open").join(moved, F.col("sequence_id") == F.col("old"))
    late = late.withColumn("sequence_id", F.col("new")).withColumn("offset", F.col("offset") + F.col("shift")).select(kept.columns)
    return kept.unionByName(late)
