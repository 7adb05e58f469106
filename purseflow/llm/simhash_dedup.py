"""SimHash near-dedup: fingerprints compared exactly, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from purseflow.llm.arrow import chunks, grouped, numbers, texts, unite
from purseflow.llm.components import connected_components
from purseflow.session import staged

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4
# Fingerprints that one task compares with one another at once.
TILE_ROWS = 4096
_BLOCK = 1024


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bitwise majority over the XXH64 (seed 42) of all word shingles, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space; a text with fewer words than a
    shingle is one shingle of all its words, one without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(shingle_words, len(words)) - 1
    spans = zip(starts[: len(starts) - reach].tolist(), ends[reach:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, fp): 64 bits as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [fingerprint(t, shingle_words) for t in texts(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(found, pa.int64())], names=["id", "fp"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def block_layout(count: int, radius: int, tile_rows: int) -> tuple[int, int]:
    """(blocks, agreeing): how fingerprints are cut into blocks for the tiles.

    Two fingerprints at most ``radius`` bits apart agree on at least ``agreeing`` of
    radius + agreeing blocks, so keying by every choice of ``agreeing`` blocks loses no pair. More
    agreeing blocks make longer keys; the fewest that fill a bucket with about a tile are taken.
    """
    agreeing = 1
    while agreeing < 4 and count / 2 ** (BITS * agreeing / (radius + agreeing)) > tile_rows:
        agreeing += 1
    return radius + agreeing, agreeing


def block_keys(fp: Column, blocks: int, agreeing: int) -> Column:
    """Array of (place, key) of one fingerprint: the bits of every choice of agreeing blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    entries = []
    for place, chosen in enumerate(combinations(range(blocks), agreeing)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        entries.append(F.struct(F.lit(place).alias("place"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    assert len(entries) == comb(blocks, agreeing)
    return F.array(*entries)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def link_group(fps: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Root position of each fingerprint after linking all pairs within ``radius``.

    Side 0 holds the rows of one tile, side 1 those of another one that it is compared with; with
    one side only, the tile is compared with itself. Rows are ordered by their number of set bits,
    and pairs of blocks whose numbers differ by more than the radius are skipped.
    """
    parent = np.arange(len(fps))
    weight = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(weight, kind="stable")
    two = bool(side.any()) and not bool(side.all())
    left = order[side[order] == 0] if two else order
    right = order[side[order] == 1] if two else order
    for i in range(0, len(left), _BLOCK):
        a = left[i : i + _BLOCK]
        for j in range(0 if two else i, len(right), _BLOCK):
            b = right[j : j + _BLOCK]
            if weight[b[0]] - weight[a[-1]] > radius:
                break
            if weight[a[0]] - weight[b[-1]] > radius:
                continue
            x, y = _close(fps[a], fps[b], radius)
            if len(x):
                unite(parent, a[x], b[y])
    return parent


def link_edges(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (fp) linked directly or by others.

    Instead of all pairs, each group emits one edge per fingerprint that is not its tree's root.
    A bucket of more than ``tile_rows`` fingerprints is cut into tiles by number of set bits (and
    hash, where one number has too many); only tile pairs within the radius meet in a task.
    """
    blocks, agreeing = block_layout(distinct.count(), radius, tile_rows)
    rows = distinct.select(
        "fp",
        F.bit_count("fp").alias("weight"),
        F.explode(block_keys(F.col("fp"), blocks, agreeing)).alias("at"),
    ).select("fp", "weight", "at.place", "at.key")
    counts = rows.groupBy("place", "key", "weight").agg(F.count(F.lit(1)).alias("n"))
    big = staged(
        counts.groupBy("place", "key")
        .agg(
            F.sum("n").alias("total"),
            F.map_from_entries(
                F.collect_list(F.struct("weight", F.ceil(F.col("n") / tile_rows).cast("int")))
            ).alias("cuts"),
        )
        .filter(F.col("total") > tile_rows)
        .select("place", "key", "cuts"),
        "big_buckets",
    )
    here = F.pmod(F.xxhash64("fp"), F.element_at("cuts", F.col("weight"))).cast("int")
    tile = lambda weight, cut: weight.cast("long") * F.lit(1 << 32) + cut
    partners = F.expr(
        f"""flatten(transform(
              filter(map_keys(cuts), w -> abs(w - weight) <= {radius}),
              w -> transform(sequence(0, cuts[w] - 1),
                             c -> cast(w as bigint) * {1 << 32} + c)))"""
    )
    met = (
        rows.join(big, ["place", "key"], "left")
        .withColumn("own", F.coalesce(tile(F.col("weight"), here), F.lit(0)))
        .withColumn("other", F.explode(F.coalesce(partners, F.array(F.lit(0).cast("long")))))
        .select(
            "place",
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )
    keys = ["place", "key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, keys):
            if table.num_rows < 2:
                continue
            fps = numbers(table.column("fp"))
            root = link_group(fps.view(np.uint64), numbers(table.column("side")), radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[moved]), pa.array(fps[root[moved]])], names=["a", "b"]
                )

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle_words: int = SHINGLE_WORDS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the smallest
    id reachable over links, the row's own included. Documents with equal fingerprints are one
    point: copies are neither compared nor expanded. Null and wordless texts have fingerprint 0
    and are linked like any other. Null ids never are a component_id unless no other id is there.
    Repeated rows each get their row. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    smallest = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(link_edges(smallest.select("fp"), radius, tile_rows))
    known = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    known = staged(known, "rooted")
    ids = staged(known.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    classes = staged(known.join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    Rows that share an id cannot be told apart and stay together if one of them represents its
    group. A row without id stays only if its whole group has none.
    """
    found = near_duplicates(docs, id_col, text_col)
    mine = F.col(id_col).eqNullSafe(F.col("component_id"))
    by_id = found.groupBy(F.col(id_col).alias("__id")).agg(F.bool_or(mine).alias("__stays"))
    # Those that go are fewer than those that stay, so that the join may need no shuffle of texts.
    gone = staged(by_id.filter(~F.col("__stays")).select("__id"), "gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left_anti")
