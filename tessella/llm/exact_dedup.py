"""Exact deduplication that stays even when one text makes up a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import column, fresh, lower_az, narrow

#: A group's salts travel as bit masks, one long for each 64 salts.
MASK = 64
#: Salts at least and at most; between them there is one for each BYTES_PER_SALT of input.
LEAST_SALTS, MOST_SALTS, BYTES_PER_SALT = 64, 1024, 16 << 30


def salts_for(docs: DataFrame) -> int:
    """Salts by the planner's estimate of the input's bytes, which runs nothing; their number changes no result."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(LEAST_SALTS, min(MOST_SALTS, -(-size // BYTES_PER_SALT)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, block: int = 1024) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays.

    1. Each task combines the equal texts that it holds (partial aggregation on digest, salt
       and the whole text).
    2. Salted digest groups are merged. The salt depends on the block of neighbouring ids, so
       most copies inside a task share a salt and step 1 still collapses them, while the
       copies of a very common text spread over ``salts`` tasks (by default as many as
       :func:`salts_for` says).
    3. Salt winners are combined globally by digest and whole text. Different texts under one
       digest stop the query with an error instead of being taken for copies.
    4. Every document looks its winner up by (digest, salt), so that a hot group is split by
       salt here as well. Only ids and digests move in this step.

    Null texts count as empty. Rows with a null id take part; a non-null id beats them, and a
    group of null ids only has a null keep_id (null ids share a block, hence a salt). Of repeated rows with the same id and text
    exactly one is kept. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    salts = salts or salts_for(docs)
    if not 1 <= salts <= MOST_SALTS:
        raise ValueError(f"salts must lie between 1 and {MOST_SALTS}")
    masks = [f"mask{k}" for k in range(-(-salts // MASK))]
    rows = docs.select(column(id_col).alias("id"), lower_az(column(text_col)).alias("content"))
    rows = rows.select(
        "id",
        "content",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.pmod(F.xxhash64(F.floor(F.coalesce("id", F.lit(0)) / block)), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    # one bit for each salt seen
    seen = [F.bit_or(F.expr(f"if(salt div {MASK} = {k}, shiftleft(1L, salt % {MASK}), 0L)")).alias(m) for k, m in enumerate(masks)]
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("top").alias("top"), F.sum("n").alias("n"), *seen)
        .groupBy("digest")
        .agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), *(F.bit_or(m).alias(m) for m in masks), F.count(F.lit(1)).alias("texts"))
        .where(F.expr("assert_true(texts = 1, 'different texts share a digest') is null"))
    )
    by_salt = winners.select(
        "digest",
        "keep_id",
        "group_size",
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(array({', '.join(masks)})[s div {MASK}], s % {MASK}) & 1L) = 1L)")).alias("salt"),
    )
    found = rows.select("id", "digest", "salt").join(by_salt, ["digest", "salt"])
    again = F.row_number().over(Window.partitionBy("digest", "salt", "id").orderBy(F.lit(1)))
    found = found.withColumn("again", again)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The stay-or-go decision is per row: groups are found by :func:`exact_groups` and joined
    back by id. Rows whose id is null or repeated are told apart by their text's digest; of
    fully repeated rows (same id and text) one stays.
    """
    def key(sha):
        return F.concat(F.coalesce(column(id_col).cast("string"), F.lit("-")), F.lit(":"), sha)

    mark, once = fresh(docs, "row_key", "row_once")
    kept = exact_groups(docs, id_col, text_col, **options).where("kept").select(key(F.col("text_sha256")).alias(mark))
    rows = docs.withColumn(mark, key(F.sha2(lower_az(column(text_col)), 256))).join(kept, mark, "left_semi")
    # an id and text may stand in several rows that differ elsewhere: the first by the other columns stays
    others = F.to_json(F.struct(*[column(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(0)]))
    rows = rows.withColumn(once, F.row_number().over(Window.partitionBy(mark).orderBy(others, column(text_col))))
    return narrow(rows.where(F.col(once) == 1), docs.columns)
