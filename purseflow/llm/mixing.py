"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from purseflow.llm.arrow import grouped, numbers
from purseflow.session import staged

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
# Documents that one leaf of the reduction tree rounds, and residuals that meet in a node.
LEAF_DOCUMENTS = 512
FAN_IN = 32
_SEED = 7_177


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """(source, source_size, sid, target) from one row (source, source_size) per source.

    Sources in code-point order, null last, take the weights in turn and share the total size by
    them; a target stops at ``max_copies`` times its source, and the excess is shared anew by
    weight until none is above. That level is found directly: by falling need for a cap, a source
    is capped if sharing what earlier caps leave would exceed its own. One row per source passes
    one task here.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.col("sid") - 1) % len(weights)
    ranked = (
        sizes.withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
        .withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    by_room = Window.orderBy("room", "sid")
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total") - before) / onward
    fits = F.when(F.col("share") <= F.col("room"), F.struct(F.col("room"), F.col("sid"), F.col("share")))
    return (
        ranked.withColumn("share", level)
        .withColumn("level", F.coalesce(F.min(fits).over(everything)["share"], F.max("room").over(everything)))
        .select(
            "source",
            "source_size",
            "sid",
            F.least("cap", F.col("weight") * F.col("level")).alias("target"),
        )
    )


def round_pairs(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> int:
    """Make all but at most one of ``chances`` 0 or 1, in place; the position of that one, or -1.

    Two open ones at a time, mass (chance times size) moves from one to the other, in a random
    direction that keeps every expectation, until one of them is integral. The total mass stays
    the same throughout.
    """
    held = -1
    for i in np.flatnonzero((chances > 0) & (chances < 1) & (sizes > 0)).tolist():
        if held < 0:
            held = i
            continue
        p, q, s, t = float(chances[held]), float(chances[i]), float(sizes[held]), float(sizes[i])
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if draws[i] * (up + down) < down:
            p, q = (1.0, q - up / t) if (1 - p) * s <= q * t else (p + up / s, 0.0)
        else:
            p, q = (0.0, q + down / t) if p * s <= (1 - q) * t else (p - down / s, 1.0)
        p, q = min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
        chances[held], chances[i] = p, q
        if p in (0.0, 1.0):
            held = i if 0.0 < q < 1.0 else -1
    return held


def _round_level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """Round the open chances of every (node, sid); ``open`` marks the one row left open in each.

    At the last level, where each source is one node, a draw decides that row too.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, sid), table in grouped(batches, ["node", "sid"]):
            chances = numbers(table.column("chance")).copy()
            draws = np.random.default_rng([seed, level, node, sid]).random(len(chances) + 1)
            held = round_pairs(numbers(table.column("size")), chances, draws)
            open_ = np.zeros(len(chances), dtype=bool)
            if held >= 0 and last:
                chances[held] = float(draws[-1] < chances[held])
            elif held >= 0:
                open_[held] = True
            table = table.set_column(names.index("chance"), "chance", pa.array(chances))
            table = table.set_column(names.index("open"), "open", pa.array(open_))
            yield from table.to_batches()

    order = [n for n in ("node", "sid", "size", "order") if n in names]
    return (
        rows.repartition("node", "sid").sortWithinPartitions(*order).mapInArrow(run, rows.schema)
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = _SEED,
) -> DataFrame:
    """Per row: its id, size, source_size, target, copies, taken, and the ``carry`` columns.

    Size is the number of words (runs without ASCII white space; null text 0). A source's target
    (see ``source_targets``) divided by its size is the expected number of copies of each of its
    documents; its fraction is rounded so that the source's taken words stay within one document
    of the target and no document is taken more than ``max_copies`` times. Documents of size 0
    are rounded like nothing: they keep the whole part. Null is a source of its own. Ids may be
    null or repeat; rows alike in id and size are interchangeable. An empty table gives no rows.

    Documents are dealt by a hash of id and text into leaves of about LEAF_DOCUMENTS, so that rows
    with a null or repeated id spread as well; only whole copies of one row share a leaf. Each leaf rounds its documents
    of a source but one, and those residuals meet up a tree, FAN_IN nodes at a time. Draws depend
    on the seed and the place in the tree, so reruns agree however the input is partitioned.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            words.cast("long").alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("deal"),
            *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
        ),
        "sized",
    )
    totals = staged(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")),
        "source_sizes",
    )
    count = totals.agg(F.sum("n")).first()[0] or 0
    targets = staged(source_targets(totals.drop("n"), weights, max_copies), "source_targets")
    leaves = -(-count // LEAF_DOCUMENTS) or 1
    expected = F.col("target") / F.greatest("source_size", F.lit(1))
    whole = F.floor(expected)
    order = F.xxhash64("id", "size")
    named = targets.withColumnRenamed("source", "target_source")
    rows = (
        sized.join(named, F.col("source").eqNullSafe(F.col("target_source")))
        .drop("source", "target_source")
        .withColumn("whole", whole.cast("long"))
        .withColumn("chance", expected - whole)
        .withColumn("node", F.pmod("deal", F.lit(leaves)).cast("long"))
        .drop("deal")
        .withColumn("order", order)
        .withColumn("open", F.lit(False))
    )
    done, level = None, 0
    while True:
        rounded = staged(_round_level(rows, level, leaves == 1, seed), "rounded")
        closed = rounded.filter(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if leaves == 1:
            break
        leaves, level = -(-leaves // FAN_IN), level + 1
        rows = rounded.filter("open").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
    # Open rows of size 0 never arise, so a chance is 0 or 1 unless the size is 0.
    copies = (F.col("whole") + F.when(F.col("size") > 0, F.col("chance")).otherwise(0)).cast("int")
    return done.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)),
    )


def repeat_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is copied, whole, or not at all.

    The mix works on ids, sizes and a 128-bit hash of the whole row; texts are shuffled once, to
    meet their numbers of copies. Rows alike in all columns are one there, with copies added up.
    """
    columns = docs.columns
    key = ["__row", "__row_again"]
    every = [F.col(f"`{c}`") for c in columns]
    whole = docs.withColumns({key[0]: F.xxhash64(*every), key[1]: F.xxhash64(F.lit(1), *every)})
    sized = whole.select(id_col, text_col, source_col, *key)
    mixed = mix_sources(sized, id_col, text_col, source_col, carry=tuple(key))
    copies = mixed.groupBy(*key).agg(F.sum("copies").cast("int").alias("__copies"))
    copies = staged(copies.filter("__copies > 0"), "copies")
    first = Window.partitionBy(*key).orderBy(F.lit(0))
    once = whole.join(copies, key).withColumn("__rank", F.row_number().over(first))
    times = once.filter("__rank = 1").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))
    )
    return times.select(*every)
