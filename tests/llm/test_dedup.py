"""Exact, substring, SimHash and embedding dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from corpora import DOCS, corpus, empty, messy, sorted_rows  # noqa: F401
from pyspark.sql import functions as F

from purseflow.llm import exact_dedup
from purseflow.llm.components import connected_components
from purseflow.llm.embedding_dedup import near_duplicate_vectors, table_layout
from purseflow.llm.exact_dedup import drop_copies, heavy_candidates, mark_copies, text_digest
from purseflow.llm.hashing import Windows, keyed_word_hashes, sliding, word_hashes
from purseflow.llm.simhash_dedup import block_layout, fingerprint, keep_one, near_duplicates
from purseflow.llm.substring_dedup import levels, remove_repeated_windows



def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- connected components


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1), (2, 2)],
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 50)] + [(100, 101)],
        [(random.Random(k).randrange(80), random.Random(k + 999).randrange(80)) for k in range(60)],
    ],
    ids=["none", "loops", "path", "star", "random"],
)
def test_components(spark, edges):
    rows = spark.createDataFrame(edges + [(None, 1)] * bool(edges), "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(rows).collect()}
    proper = [(a, b) for a, b in edges if a != b]
    expected = roots({n for e in proper for n in e}, proper)
    assert set(found) == set(expected)
    pairs = {(found[n], expected[n]) for n in expected}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# --- exact dedup


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"text {rng.randrange(60)}") for i in range(400)]
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    expected = sorted(
        (i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for i, t in rows
    )
    for support in (0.5, 0.02, 0.001):
        found = mark_copies(corpus(spark, rows), support=support)
        assert sorted(map(tuple, found.collect())) == expected
        kept = drop_copies(corpus(spark, rows), support=support)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
        assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_frequent_digests_are_candidates(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    digests = corpus(spark, rows).select(text_digest("text").alias("digest"))
    found = {bytes(r[0]) for r in heavy_candidates(digests, 0.1).collect()}
    assert hashlib.sha256(b"hot").digest() in found and len(found) <= 10


def test_exact_edge_cases(messy, empty):
    assert mark_copies(empty).count() == drop_copies(empty).count() == 0
    found = mark_copies(messy)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alpha = found.filter(F.col("text_sha256") == hashlib.sha256(b"alpha beta").hexdigest()).collect()
    # Repeated rows of the winner: exactly one stays; a null id ranks below.
    assert len(alpha) == 3 and all(r["keep_id"] == 1 and r["group_size"] == 3 for r in alpha)
    assert sum(r["kept"] for r in alpha) == 1
    nothing = found.filter(F.col("text_sha256") == hashlib.sha256(b"").hexdigest()).collect()
    assert len(nothing) == 3 and {r["keep_id"] for r in nothing} == {3}
    kept = drop_copies(messy)
    assert kept.columns == messy.columns
    assert kept.count() == messy.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_exact_keeps_columns_of_any_name(spark, messy):
    """Names that look like the operator's own, or hold a dot, come back with their values."""
    odd = messy
    for k, name in enumerate(("__digest", "__rank", "__best", "digest", "row", "best", "doc", "stays", "n", "a.b")):
        odd = odd.withColumn(name, F.lit(k))
    kept = drop_copies(odd.withColumnRenamed("text", "x.y"), text_col="x.y")
    plain = sorted_rows(drop_copies(messy), "doc_id", "text")
    rows = kept.collect()
    assert sorted(((r["doc_id"], r["x.y"]) for r in rows), key=repr) == plain
    assert {tuple(r)[-10:] for r in rows} == {tuple(range(10))}
    assert mark_copies(odd.withColumnRenamed("doc_id", "i.d"), id_col="i.d").count() == messy.count()


def test_exact_of_one_repeated_row(spark, monkeypatch):
    """A third of all rows are one row; also with more rows to drop than are broadcast."""
    rows = [(7, "same")] * 200 + [(i, f"t{i}") for i in range(400)] + [(900, "t5"), (None, "t6"), (None, "u")] * 2
    for most in (200_000, 0):
        monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_KEYS", most)
        kept = Counter((r["doc_id"], r["text"]) for r in drop_copies(corpus(spark, rows)).collect())
        gone = {(5, "t5")}
        expected = {(i, f"t{i}") for i in range(400)} - gone | {(7, "same"), (900, "t5"), (None, "u")}
        assert kept == Counter(expected)


def test_exact_plan_is_native(spark, messy):
    plan = mark_copies(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- substring dedup


def removed_by_brute_force(texts, window):
    words = [(t or "").split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 7, 12, 35])
def test_substring_against_brute_force(spark, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(window + 6)]
    rows = []
    for i in range(120):
        words = [f"v{rng.randrange(9 if i % 3 else 4000)}" for _ in range(rng.randrange(0, 3 * window + 20))]
        if rng.random() < 0.4:  # a third of all documents share a passage, or a part of it
            a, b = sorted((rng.randrange(window + 7), rng.randrange(window + 7)))
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[a:b] if rng.random() < 0.5 else passage
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(300, "same " * 80)]
    found = remove_repeated_windows(corpus(spark, rows), window=window)
    expected = removed_by_brute_force([t for _, t in rows], window)
    assert sorted_rows(found, *found.columns) == sorted(
        ((i, *e) for (i, _), e in zip(rows, expected)), key=repr
    )


def test_substring_edge_cases(messy, empty):
    assert remove_repeated_windows(empty).count() == 0
    found = remove_repeated_windows(messy).collect()
    assert len(found) == messy.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[5]["n_removed"] == by_id[6]["n_removed"] == 60_000
    assert by_id[7]["n_words"] == 1 and by_id[2]["n_words"] == 0


def thue_morse(length, a, b):
    """A word that polynomial hashes modulo 2^64 cannot tell from the one with a and b swapped."""
    return "".join(b if k.bit_count() % 2 else a for k in range(length))


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_substring_tells_long_words_apart(spark, length):
    shared = [f"s{k}" for k in range(34)]
    one, two = thue_morse(length, "a", "b"), thue_morse(length, "b", "a")
    assert len(set(np.concatenate([word_hashes(w.encode())[0] for w in (one, two)]).tolist())) == 1
    rows = [(1, " ".join([*shared, one])), (2, " ".join([*shared, two]))]
    # In one chunk, and in chunks of their own.
    for parts in (1, 2):
        found = remove_repeated_windows(spark.createDataFrame(
            [(*r, "en", "web", 0) for r in rows], DOCS).repartition(parts, "doc_id"))
        assert [r["n_removed"] for r in found.collect()] == [0, 0]


def test_substring_of_many_equal_rows(spark):
    """Equal rows are one document that occurs often: 600 of them take no longer than others."""
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(3000))
    rows = [(1, text)] * 600 + [(2, "a " + text[:4000]), (3, None)]
    found = remove_repeated_windows(corpus(spark, rows)).collect()
    assert len(found) == 602
    assert all(r["n_removed"] == 3000 for r in found if r["doc_id"] == 1)
    expected = removed_by_brute_force([t for _, t in rows[-3:]], 35)
    two = next(r for r in found if r["doc_id"] == 2)
    assert (two["n_words"], two["n_removed"], two["kept_sha256"]) == expected[1]


def test_levels_double():
    assert levels(35) == [9, 18, 35] and levels(1) == [1] and levels(2) == [1, 2]


def test_hashes_follow_content():
    text = ("ab c\t" * 700_000 + "end").encode()
    words, starts, ends = word_hashes(text)
    assert len(words) == 1_400_001 and len(set(words.tolist())) == 3
    assert text[starts[-1] : ends[-1]] == b"end"
    keyed = keyed_word_hashes(text, 5)
    assert len(keyed) == len(words) and len(set(keyed.tolist())) == 3
    assert keyed_word_hashes(b" \t", 5).tolist() == [] and keyed[0] != keyed_word_hashes(b"ab", 6)[0]
    flat = Windows(words[:1000])
    at = np.arange(0, 900)
    assert len(set(flat.at(at, 10).tolist())) == 2
    values = np.array([5, 3, 8, 1, 9, 2, 7], dtype=np.uint64)
    assert sliding(values, 3).tolist() == [3, 1, 1, 1, 2]


# --- SimHash


def simhash_by_definition(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(count, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(count // 8)]
    rows = []
    for i in range(count):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("tile_rows", [4096, 3])
def test_simhash_against_brute_force(spark, tile_rows):
    rows = near_texts(160, tile_rows) + [(500, ""), (501, None), (502, "One TWO"), (503, "one two")]
    prints = {i: simhash_by_definition(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = roots(list(prints), links)
    assert len(set(expected.values())) < len(rows) - 20
    found = near_duplicates(corpus(spark, rows), tile_rows=tile_rows).collect()
    assert sorted(map(tuple, found)) == sorted((i, f"{prints[i]:016x}", expected[i]) for i in prints)


def test_simhash_blocks_lose_no_pair():
    for count in (10, 10**7, 10**9, 10**12):
        blocks, agreeing = block_layout(count, 4, 4096)
        assert blocks - 4 == agreeing >= 1


def test_simhash_matches_xxhash64_of_spark(spark):
    rows = [("one two three four",), ("été à la plage",)]
    for text, h in spark.createDataFrame(rows, "t string").select("t", F.xxhash64("t")).collect():
        assert fingerprint(text.encode()) == h


def test_simhash_edge_cases(messy, empty):
    assert near_duplicates(empty).count() == keep_one(empty).count() == 0
    found = near_duplicates(messy).collect()
    assert len(found) == messy.count()
    wordless = [r for r in found if r["fingerprint"] == "0" * 16]
    assert len(wordless) == 4 and {r["component_id"] for r in wordless} == {2}
    kept = keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] not in (1, None)) == [2, 5, 7, 8]


# --- embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, count=300, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dim))
    rows = []
    for i in range(count):
        v = base[rng.integers(12)] + rng.choice([0.0, 0.15, 0.25, 0.4]) * rng.standard_normal(dim)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows + [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]


@pytest.mark.parametrize("tile_rows", [2048, 7])
def test_embeddings_against_brute_force(spark, tile_rows):
    rows = vectors(tile_rows)
    matrix = np.array([r[1] for r in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    expected = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = {r["vec_id"]: r for r in near_duplicate_vectors(frame, tile_rows=tile_rows).collect()}
    links = sum(r["n_links"] for r in found.values())
    assert 0.9 * near.sum() <= links <= near.sum()
    assert all(found[i]["n_links"] <= n for i, n in zip(ids, near.sum(axis=1)))
    if links == near.sum():
        assert {i: r["component_id"] for i, r in found.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_embedding_edge_cases(spark):
    good, nan = [1.0, 2.0], float("nan")
    rows = [
        (1, good, 1), (2, good, 1), (2, good, 1), (3, good, None), (4, None, 1), (5, [], 1),
        (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [1e30, 2e30], 1),
        (10, [1.0, 2.0, 0.0], 1), (None, good, 2),
    ]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    found = sorted_rows(near_duplicate_vectors(frame), "vec_id", "n_links", "component_id", "kept")
    expected = [
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True),
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 1, False),
        (10, 0, 10, True), (None, 0, None, True),
    ]
    assert found == sorted(expected, key=repr)
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_table_layout_reaches_recall():
    for count in (100, 10_000, 10**8):
        tables, bits = table_layout(count, 0.93, 0.995)
        same = (1 - np.arccos(0.93) / np.pi) ** bits
        assert 1 - (1 - same) ** tables >= 0.995
