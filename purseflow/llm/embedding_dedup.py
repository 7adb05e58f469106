"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from purseflow.llm.arrow import grouped, numbers, unite
from purseflow.llm.components import connected_components
from purseflow.session import staged

THRESHOLD = 0.93
# Wanted probability that a pair just at the threshold shares a bucket of some table.
RECALL = 0.995
# Vectors of a bucket aimed at, and the most that meet in one task from either side.
BUCKET_ROWS = 64
TILE_ROWS = 2048
_BLOCK = 512
_SEED = 20_011


def table_layout(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """(tables, bits per table): buckets of about BUCKET_ROWS vectors, and enough tables.

    The more vectors, the longer the keys; the number of tables follows from the chance that all
    hyperplanes of a table leave a pair at the threshold on one side.
    """
    bits = min(24, max(4, ceil(log2(max(count, 1) / BUCKET_ROWS)))) if count > BUCKET_ROWS else 4
    same = (1 - acos(threshold) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - same))), bits


def _vectors(table: pa.Table | pa.RecordBatch, kind: str) -> np.ndarray:
    """Rows of float64; all vectors of the input have the same packed length."""
    values = table.column("packed").to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64)


def packed_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str
) -> DataFrame:
    """(id, label, packed) of every row; packed is null for vectors that cannot be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec in batch.column("vec").to_pylist():
                if not vec or any(x is None for x in vec):
                    rows.append(None)
                    continue
                v = np.asarray(vec, dtype=kind) + 0.0  # negative zero becomes zero
                rows.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())],
                names=["id", "label", "packed"],
            )

    source = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    return source.mapInArrow(run, "id long, label string, packed binary")


def _first_shared(keys_a: np.ndarray, keys_b: np.ndarray, place: int) -> np.ndarray:
    """Whether ``place`` is the first table in which the two rows of keys agree."""
    return ~(keys_a[:, :place] == keys_b[:, :place]).any(axis=1)


def _link_group(table: pa.Table, kind: str, place: int, cross: bool, threshold: float):
    """Links of one group: parent positions, and per row the copies it is newly linked with."""
    raw = _vectors(table, kind)
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow in the squares
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    copies = numbers(table.column("copies"))
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype="<i4").reshape(len(raw), -1)
    side = numbers(table.column("side"))
    parent, links = np.arange(len(raw)), np.zeros(len(raw), dtype=np.int64)
    left = np.flatnonzero(side == 0) if cross else np.arange(len(raw))
    right = np.flatnonzero(side == 1) if cross else left
    for i in range(0, len(left), _BLOCK):
        a = left[i : i + _BLOCK]
        for j in range(0 if cross else i, len(right), _BLOCK):
            b = right[j : j + _BLOCK]
            near = unit[a] @ unit[b].T >= threshold
            if not cross and i == j:
                near &= np.tri(len(a), len(b), -1, dtype=bool).T
            x, y = np.nonzero(near)
            for s in range(0, len(x), 1 << 18):
                p, q = a[x[s : s + (1 << 18)]], b[y[s : s + (1 << 18)]]
                new = _first_shared(keys[p], keys[q], place)
                p, q = p[new], q[new]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                unite(parent, p, q)
    return parent, links


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows with equal non-null labels are linked when a hash table proposes the pair and its cosine
    in double precision reaches the threshold; every vector is indexed, in several tables of
    random-hyperplane signs. Equal vectors are one point with a number of copies, which count as
    links but are never expanded. A pair proposed by several tables counts in the first only, so
    no pairs are written. Vectors that are null, empty or zero, or hold null or non-finite
    components, and vectors of another length, link with nothing; so do rows without a label.
    n_links counts the other rows linked directly, component_id is the smallest id reachable (the
    own one included), kept marks the row whose id it is. Repeated ids each get their row.

    A bucket of more than ``tile_rows`` vectors is cut into tiles, pairs of which meet in a task.
    """
    # Vectors travel in the precision that they are stored in; cosines are of doubles.
    single = vectors.schema[vector_col].dataType == ArrayType(FloatType())
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    rows = staged(packed_vectors(vectors, id_col, vector_col, label_col, kind), "vectors")
    usable = rows.filter("label is not null and packed is not null")
    points = usable.groupBy("label", "packed").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")
    )
    # Number the points: a row number is exact where a hash could collide.
    points = staged(points.withColumn("vid", F.monotonically_increasing_id()), "points")
    tables, bits = table_layout(points.count(), threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(x) // width for x in batch.column("packed").to_pylist()], dtype=np.int64)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(_SEED).standard_normal((int(dim), tables * bits))
                signs = (_vectors(part, kind) @ planes[dim] > 0).reshape(-1, tables, bits)
                keys = (signs * (1 << np.arange(bits))).sum(axis=2).astype("<i4")
                n = part.num_rows
                packed_keys = [k.tobytes() for k in keys]
                column = {name: part.column(name) for name in ("vid", "label", "copies", "packed")}
                for place in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            column["vid"],
                            column["label"],
                            pa.array(np.full(n, dim, dtype=np.int32)),
                            pa.array(np.full(n, place, dtype=np.int32)),
                            pa.array(keys[:, place]),
                            column["copies"],
                            column["packed"],
                            pa.array(packed_keys, pa.binary()),
                        ],
                        names=["vid", "label", "dim", "place", "key", "copies", "packed", "keys"],
                    )

    hashed = points.mapInArrow(
        sign,
        "vid long, label string, dim int, place int, key int, copies long, packed binary, keys binary",
    )
    bucket = ["label", "dim", "place", "key"]
    hashed = hashed.withColumn("bucket", F.xxhash64(*bucket))
    sizes = hashed.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("n"))
    big = staged(
        sizes.filter(F.col("n") > tile_rows).select(
            "place", "bucket", F.ceil(F.col("n") / tile_rows).cast("int").alias("cuts")
        ),
        "big_buckets",
    )
    met = (
        hashed.join(big, ["place", "bucket"], "left")
        .withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        .withColumn("own", F.pmod("vid", F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .select("place", "bucket", "low", "high", "side", "vid", "copies", "packed", "keys")
    )
    keys = ["place", "bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place, _, low, high), table in grouped(batches, keys):
            if table.num_rows < 2:
                continue
            parent, links = _link_group(table, kind, place, low != high, threshold)
            linked = np.flatnonzero(links)
            if len(linked):
                vid = numbers(table.column("vid"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vid[linked]), pa.array(vid[parent[linked]]), pa.array(links[linked])],
                    names=["a", "b", "n"],
                )

    edges = staged(
        met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long"),
        "links",
    )
    linked = edges.groupBy(F.col("a").alias("vid")).agg(F.sum("n").alias("n"))
    roots = connected_components(edges.select("a", "b")).withColumnRenamed("node", "vid")
    rooted = staged(
        points.join(linked, "vid", "left")
        .join(roots, "vid", "left")
        .select(
            "label",
            "packed",
            "least",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "vid").alias("root"),
        ),
        "rooted",
    )
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    known = staged(
        rooted.join(least, "root").select("label", "packed", "n_links", "component_id"), "known"
    )
    return rows.join(known, ["label", "packed"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"),
    )
