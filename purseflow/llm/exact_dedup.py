"""Exact dedup by a heavy-hitter split of text digests, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.operators.skew import MAX_BROADCAST_KEYS
from purseflow.session import staged

# The summary has at least so many entries; more if there are more shuffle partitions.
LEAST_ENTRIES = 256

_DIGEST, _ROW = "digest", "row"


def quoted(name: str) -> Column:
    """The column of a name as it stands, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_digest(text: str) -> Column:
    """SHA-256 of the unchanged text in UTF-8, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(quoted(text), F.lit("")).cast("binary"), 256))


def usual_support(rows: DataFrame) -> float:
    """A digest on less than this share of the rows is less than a shuffle partition's share."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 / max(LEAST_ENTRIES, parts)


def heavy_candidates(digests: DataFrame, support: float) -> DataFrame:
    """Digests that may be frequent, from one Misra-Gries summary of all rows.

    ``freqItems`` keeps at most 1 / support counters per task and merges them, so the result has
    at most 1 / support rows of 32 bytes however large the input is: a proven bound for broadcast.
    """
    # As text: the summary compares byte arrays by identity.
    summary = digests.select(F.hex(_DIGEST).alias("d")).stat.freqItems(["d"], support)
    return summary.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias(_DIGEST))


def with_group(rows: DataFrame, best: Column, support: float) -> DataFrame:
    """``rows`` (digest, ..) with ``group_size`` and ``best``, the largest of a column, of their digest.

    Frequent digests' exact counts and winners are broadcast and decide their rows where they
    lie. The others are counted by partial aggregates and joined back by an ordinary shuffle.
    """
    summed = (F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best"))
    candidates = F.broadcast(heavy_candidates(rows, support))
    winners = rows.join(candidates, _DIGEST).groupBy(_DIGEST).agg(*summed)
    winners = F.broadcast(staged(winners, "winners"))
    light = rows.join(winners, _DIGEST, "left_anti")
    return rows.join(winners, _DIGEST).unionByName(
        light.join(light.groupBy(_DIGEST).agg(*summed), _DIGEST)
    )


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: float | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest id stays. If
    that row occurs repeatedly (same id, same text), exactly one of the repeats stays; null ids
    rank below all others. An empty table gives no rows. Other columns are not looked at.

    Only ids and digests are shuffled, never texts.
    """
    rows = staged(
        docs.select(
            quoted(id_col).alias("id"),
            text_digest(text_col).alias(_DIGEST),
            F.monotonically_increasing_id().alias(_ROW),
        ),
        "digests",
    )
    marked = with_group(rows, F.struct(F.col("id"), F.col(_ROW)), support or usual_support(rows))
    return marked.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col(_ROW) == F.col(f"best.{_ROW}")).alias("kept"),
        F.lower(F.hex(_DIGEST)).alias("text_sha256"),
    )


def _document_key(key: Column, digest: Column) -> Column:
    """16 bytes that tell ids and texts apart; a null id differs from all others."""
    named = F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit("-"))
    return F.unhex(F.substring(F.sha2(F.concat(digest, named.cast("binary")), 256), 1, 32))


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: float | None = None,
) -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id stays, whole.

    Same rules as ``mark_copies``. The documents' columns travel in a struct, so that none of their
    names can clash. What goes is found on (text digest, id) pairs; the pairs that go are anti-joined
    to the documents. Up to a measured number they are broadcast and no text is shuffled. Only rows
    whose winner occurs repeatedly are ranked, and a limit inside each map task drops the surplus.
    """
    whole = docs.select(
        F.struct(F.col("*")).alias("doc"),
        quoted(id_col).alias("id"),
        text_digest(text_col).alias(_DIGEST),
    )
    pairs = staged(whole.groupBy(_DIGEST, "id").agg(F.count(F.lit(1)).alias("n")), "pairs")
    # In a struct, as a null id would not count as a largest value.
    marked = with_group(pairs, F.struct(F.col("id")), support or usual_support(pairs))
    stays = F.col("id").eqNullSafe(F.col("best.id"))
    key = _document_key(F.col("id"), F.col(_DIGEST)).alias("key")
    ends = staged(
        marked.filter(~stays | (F.col("n") > 1)).select(key, stays.alias("stays")), "not_single"
    )
    few = ends.count() <= MAX_BROADCAST_KEYS
    keyed = whole.select("doc", key)
    some = F.broadcast(ends) if few else ends
    single = keyed.join(some, "key", "left_anti").select("doc")
    first = Window.partitionBy("key").orderBy(F.lit(0))
    repeats = (
        keyed.join(some.filter("stays"), "key", "left_semi")
        .withColumn("rank", F.row_number().over(first))
        .filter("rank = 1")
        .select("doc")
    )
    kept = single.unionByName(repeats)
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
