"""Which parts of a table may hold an id: least and largest id, and a Bloom filter of bitmaps.

One row per (part, bucket): a bitmap of 32,768 bits, 4 KB. An id sets one bit for each of a few
hashes of it. Everything is built from Spark's bitmap functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA = "part string, low long, high long, slots long, bucket long, bits binary"
BITS_PER_ID = 16
HASHES = 6
BITMAP_BITS = 32_768
# Batches up to this size are looked up in the filters.
MOST_IDS = 100_000


def _positions(key: str) -> Column:
    """One hash per filter bit of an id."""
    return F.array(*[F.xxhash64(F.lit(k), F.col(key)) for k in range(HASHES)])


def build(ids: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The index of (part, id); ``sizes`` is the number of rows of each part.

    Null ids are not indexed. A part's filter is as large as its rows need, so that a look-up is
    wrong for about one id and part in a thousand.
    """
    bits = {p: -(-max(n, 1) * BITS_PER_ID // BITMAP_BITS) * BITMAP_BITS for p, n in sizes.items()}
    if not bits:
        return ids.sparkSession.createDataFrame([], SCHEMA)
    slots = F.create_map(*[x for p, n in bits.items() for x in (F.lit(p), F.lit(n).cast("long"))])
    known = ids.filter(F.col("id").isNotNull()).withColumn("slots", F.element_at(slots, F.col("part")))
    spans = known.groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    bit = F.pmod(F.col("hash"), F.col("slots"))
    bitmaps = (
        known.select("part", "slots", F.explode(_positions("id")).alias("hash"))
        .select("part", "slots", bit.alias("bit"))
        .groupBy("part", "slots", F.expr("bit div 32768").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits"))
    )
    return bitmaps.join(F.broadcast(spans), "part").select("part", "low", "high", "slots", "bucket", "bits")


def parts_that_may_hold(index: DataFrame, ids: DataFrame, most_ids: int = MOST_IDS) -> list[str]:
    """Parts in whose range of ids, and in whose filter, some of the ``ids`` (id) lie.

    Every part that holds one is listed. A list has at most one name per part. For more than
    ``most_ids`` the ranges alone decide: so many would hit nearly every filter.
    """
    bounds = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not bounds[2]:
        return []
    near = index.filter((F.col("low") <= bounds[1]) & (F.col("high") >= bounds[0]))
    named = [tuple(r) for r in near.select("part", "low", "high", "slots").distinct().collect()]
    if not named or bounds[2] > most_ids:
        return sorted(r[0] for r in named)
    entry = [F.struct(F.lit(p).alias("part"), F.lit(a).cast("long").alias("low"),
                      F.lit(b).cast("long").alias("high"), F.lit(s).cast("long").alias("slots"))
             for p, a, b, s in named]
    # Each id next to the parts in whose range it lies, then one row per bit that must be set.
    asked = ids.select("id", F.inline(F.array(*entry))).filter("id between low and high")
    bit = F.pmod(F.col("hash"), F.col("slots"))
    wanted = (
        asked.select("id", "part", "slots", F.explode(_positions("id")).alias("hash"))
        .withColumn("bit", bit)
        .select("id", "part", F.expr("bit div 32768").alias("bucket"), (F.col("bit") % BITMAP_BITS).alias("at"))
    )
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, cast(at % 8 as int)) & 1 = 1")
    found = (
        wanted.join(index.select("part", "bucket", "bits"), ["part", "bucket"])
        .withColumn("byte", byte)
        .filter(is_set)
        .groupBy("id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == HASHES)
        .select("part")
        .distinct()
    )
    return sorted(r["part"] for r in found.collect())
