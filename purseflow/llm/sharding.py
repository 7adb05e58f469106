"""Sharding by proportional stratified interleaving of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.llm.positions import in_order, task_offsets
from purseflow.session import staged

SHARDS = 24
SEED = 20_231
# What a document's record takes besides its text.
RECORD_BYTES = 8
_OFFSET_STEPS = 1 << 30


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shuffled_ranks(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (row, source, key) with ``rank`` (from 0, by seeded hash of ``key``) and ``n`` of its
    source; a null source is a source of its own.

    One range sort by (source, hash, row) spreads a source of any size over many tasks. A row's
    rank is its place after its source's first row in the task, plus the source's rows in earlier
    tasks; those counts are one row per task and source.
    """
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "key"))
    placed = in_order(hashed, [F.col(c) for c in ("source", "hash", "row")], "by_source")
    source = Window.partitionBy("source")
    runs = (
        placed.groupBy("task", "source")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
        .select(
            F.col("task").alias("run_task"),
            F.col("source").alias("run_source"),
            (
                F.coalesce(
                    F.sum("rows").over(
                        source.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
                    ),
                    F.lit(0),
                )
                - F.col("first")
            ).alias("shift"),
            F.sum("rows").over(source).alias("n"),
        )
    )
    same = (F.col("task") == F.col("run_task")) & F.col("source").eqNullSafe(F.col("run_source"))
    return placed.join(runs, same).select(
        "row", "source", "n", (F.col("place") + F.col("shift")).alias("rank")
    )


def interleaved(ranked: DataFrame, shards: int, seed: int) -> DataFrame:
    """(row, shard, slot) from (row, source, rank, n): rows sorted by fractional rank and cut.

    The fractional rank is (rank + u) / n with a seeded u of the source in [0, 1), so that sources
    smaller than the number of shards don't all meet in the middle.
    """
    steps = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(_OFFSET_STEPS))
    fraction = (F.col("rank") + steps / _OFFSET_STEPS) / F.col("n")
    rows = ranked.select("row", "source", "rank", fraction.alias("fraction"))
    placed = in_order(rows, [F.col(c) for c in ("fraction", "source", "rank")], "interleaved")
    # One row per task of the sort: a proven bound for broadcast.
    found = placed.join(F.broadcast(task_offsets(placed)), "task").withColumn(
        "position", F.col("offset") + F.col("place")
    )
    found = found.withColumn("shard", F.expr(f"position * {shards} div total"))
    begin = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return found.select(
        "row", F.col("shard").cast("int").alias("shard"), (F.col("position") - begin).alias("slot")
    )


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = _quoted(text_col).cast("binary")
    filled = F.coalesce(text, F.lit(b""))
    return docs.select(
        F.struct(_quoted(id_col).alias("id")).alias("doc"),
        _quoted(source_col).alias("source"),
        (F.octet_length(filled).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(filled).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: its id, size, text_crc32, law, shard, slot, grown_shard,
    source.

    Law ``rows``: the shards' row counts are at most one apart, and each holds every source in
    proportion. Rows are ranked within their source by a seeded hash of id, size and text checksum,
    sorted by fractional rank, and cut into ``shards`` runs; ``slot`` counts from 0 in a shard.
    Other shard counts move rows freely, so ``grown_shard`` is null. Equal texts are not kept
    together: a group of them may be larger than a shard of equal row count.

    Null and empty texts have size 8 and checksum 0; a null source is a source of its own; null ids
    are hashed like others. Repeated rows are rows of their own, told apart by their place in the
    input. An empty table gives no rows. Other columns are not looked at.

    Texts are read once, and only checksums are sorted.
    """
    rows = staged(_measured(docs, id_col, text_col, source_col), "measured")
    keyed = rows.select("row", "source", F.struct("doc.id", "size", "crc").alias("key"))
    cut = interleaved(shuffled_ranks(keyed, seed), shards, seed)
    return rows.join(cut, "row").select(
        F.col("doc.id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> None:
    """Write whole documents under ``path``/shard=N, in slot order, with ``slot`` added.

    Same rules as ``shard_documents``. A shard is as many files as its share of the tasks; each
    file holds a run of slots in order. The documents' columns lie in a struct ``doc``, so that
    their names cannot clash with the shard's.
    """
    whole = docs.select(
        F.struct(F.col("*")).alias("doc"),
        *[_quoted(c).alias(a) for c, a in ((id_col, "id"), (text_col, "text"), (source_col, "source"))],
        F.monotonically_increasing_id().alias("row"),
    )
    whole = staged(whole.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b""))), "whole")
    size = F.octet_length("text").cast("long") + RECORD_BYTES
    key = F.struct("id", size.alias("size"), F.crc32("text").alias("crc")).alias("key")
    cut = interleaved(shuffled_ranks(whole.select("row", "source", key), seed), shards, seed)
    order = ("shard", "slot")
    (
        whole.select("row", "doc")
        .join(cut, "row")
        .drop("row")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("shard")
        .parquet(path)
    )
