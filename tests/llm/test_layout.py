"""Sharding, conversation tries and whitening against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from corpora import DOCS, SF, corpus, empty, messy  # noqa: F401
from pyspark.sql import functions as F

from purseflow.llm.conversation_trie import (
    Skeleton,
    common_turns,
    conversation_trie,
    own_paths,
    path_trie,
)
from purseflow.llm.embedding_whitening import (
    Scatter,
    bit_planes,
    distinct_vectors,
    fit_whitening,
    limbs,
    scaled_vectors,
    whiten_embeddings,
)
from purseflow.llm.sharding import SEED, shard_documents, write_shards

needs_data = pytest.mark.skipif(not SF.is_dir(), reason="no test data")

# --- sharding


def check_shards(rows, shards):
    """Counts at most one apart, gapless slots; returns the rows in their global order."""
    sizes = Counter(r["shard"] for r in rows)
    every = [sizes[s] for s in range(shards)]
    assert sum(every) == len(rows) and max(every) - min(every) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    return sorted(rows, key=lambda r: (r["shard"], r["slot"]))


def check_mixture(rows, shards):
    """Every shard holds each source in proportion, up to what whole rows allow."""
    totals = Counter(r["source"] for r in rows)
    found = Counter((r["shard"], r["source"]) for r in rows)
    slack = 2 + len(totals) * max(totals.values()) / len(rows)
    for source, n in totals.items():
        for shard in range(shards):
            assert abs(found[shard, source] - n / shards) <= slack


def test_sharding_by_definition(spark):
    rng = random.Random(3)
    rows = [
        (i, " ".join(rng.choices("abcdefg", k=rng.randrange(9))), "en", rng.choice("xxxxyyz") if i % 9 else None)
        for i in range(900)
    ]
    docs = corpus(spark, rows)
    placed = check_shards(shard_documents(docs, 7).collect(), 7)
    check_mixture(placed, 7)

    # By definition: sort each source by hash, then all rows by fractional rank.
    hashed = docs.select(
        "doc_id",
        "source",
        F.xxhash64(
            F.lit(SEED),
            F.struct(
                "doc_id",
                (F.octet_length("text").cast("long") + 8),
                F.crc32(F.col("text").cast("binary")),
            ),
        ).alias("hash"),
        (F.pmod(F.xxhash64(F.lit(SEED), F.lit("offset"), "source"), F.lit(1 << 30)) / (1 << 30)).alias("u"),
    ).collect()
    by_source = defaultdict(list)
    for r in sorted(hashed, key=lambda r: r["hash"]):
        by_source[r["source"]].append(r)
    keyed = [
        ((k + r["u"]) / len(mine), source is not None, source, k, r["doc_id"])
        for source, mine in by_source.items()
        for k, r in enumerate(mine)
    ]
    order = [r[-1] for r in sorted(keyed, key=lambda r: (r[0], r[1], r[2] or "", r[3]))]
    assert [r["doc_id"] for r in placed] == order
    texts = {r[0]: r[1].encode() for r in rows}
    for r in placed:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_sharding_hot_and_single_sources(spark):
    """Many sources of one row spread over all shards; repeated rows each get a place."""
    rows = [(i, f"t{i}", "en", "hot") for i in range(300)] + [(7, "same", "en", "hot")] * 200
    rows += [(1000 + i, "s", "en", f"single{i}") for i in range(240)]
    placed = check_shards(shard_documents(corpus(spark, rows), 24).collect(), 24)
    singles = Counter(r["shard"] for r in placed if r["source"] != "hot")
    assert max(singles.values()) <= 22 and len(singles) == 24
    assert sum(r["doc_id"] == 7 for r in placed) == 201


def test_sharding_messy(spark, empty, messy):  # noqa: F811
    placed = check_shards(shard_documents(messy, 5).collect(), 5)
    given = messy.select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(r["doc_id"] for r in given)
    sizes = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8) for r in given)
    assert Counter((r["doc_id"], r["size"]) for r in placed) == sizes
    assert shard_documents(empty).collect() == []
    few = check_shards(shard_documents(messy.limit(2), 24).collect(), 24)
    assert len(few) == 2
    odd = messy.withColumnsRenamed({"source": "a.b", "doc_id": "shard", "text": "slot"})
    named = shard_documents(odd, 5, id_col="shard", text_col="slot", source_col="a.b")
    assert named.count() == len(placed)


def test_write_shards(spark, messy, tmp_path):  # noqa: F811
    path = str(tmp_path / "shards")
    write_shards(messy.withColumn("a.b", F.lit(1)), path, 4)
    back = spark.read.parquet(path)
    assert back.select("doc.*").columns == [*messy.columns, "a.b"]
    rows = back.select("shard", "slot", F.col("doc.doc_id").alias("doc_id"), "doc.text").collect()
    check_shards(rows, 4)
    expected = {(r["shard"], r["slot"], r["doc_id"]) for r in shard_documents(messy, 4).collect()}
    assert {(r["shard"], r["slot"], r["doc_id"]) for r in rows} == expected
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in messy.select("text").collect())


# --- conversation trie

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_definition(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []

    def below(path):
        size = len(path[-1][1].encode()) if path else 0
        saved, leaves = (len(members[path]) - 1) * size, 0 if children[path] else 1
        for child in children[path]:
            more, n = below(child)
            saved, leaves = saved + more, leaves + n
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        up = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), up, len(members[path]), len(children[path]),
                    leaves, saved, digest))
        return saved, leaves

    if members:
        below(())
    return Counter(out)


def random_turns(seed, convs, same):
    """Conversations over few texts, a share ``same`` of them copies of one."""
    rng = random.Random(seed)
    hot = [(rng.choice("ua"), rng.choice(["hi", "ho", "é", ""])) for _ in range(12)]
    rows = []
    for c in range(convs):
        mine = [(rng.choice("ua"), rng.choice(["hi", "ho"])) for _ in range(rng.randrange(1, 7))]
        for turn, (role, text) in enumerate(hot if rng.random() < same else mine):
            rows.append((c, turn, role, text))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 16])
@pytest.mark.parametrize("same", [0.0, 0.5, 1.0])
def test_trie_by_definition(spark, shards, same):
    rows = random_turns(7, 120, same)
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    found = Counter(tuple(r) for r in conversation_trie(turns, shards=shards).collect())
    assert found == trie_by_definition(rows)


def test_trie_messy(spark):
    long = "x" * 300_000
    rows = [
        (0, 2, "u", "b"), (0, None, "u", "first"), (0, 1, None, None), (0, 1, "a", "tie"),
        (1, 1, "u", "b"), (1, 1, "u", "b"), (3, 0, "u", long), (3, 1, "u", "é漢🙂"),
        (None, 1, "u", "nobody"), (None, None, None, None), (-7, 0, "u", "n"), (-5, 0, "u", "n"),
        (5, None, None, None), (8, 0, "", ""), (9, 0, None, ""), (12, 0, "u", "turnless?"),
        (2**60, 3, "u", "far"),
    ]
    rows += [(c, 0, "u", f"{c}") for c in range(100, 130)]
    rows += [(40, t, "u", "a") for t in range(400)] + [(41, t, "u", "a") for t in range(399)]
    turns = spark.createDataFrame(rows, TURNS)
    for name in ("path", "step", "shard", "kind", "skeleton", "first_id", "taken", "head", "a.b"):
        turns = turns.withColumn(name, F.lit(1))
    renamed = turns.withColumnRenamed("text", "x.y")
    for shards in (1, 4):
        found = conversation_trie(turns, shards=shards)
        assert Counter(tuple(r) for r in found.collect()) == trie_by_definition(rows)
    assert conversation_trie(renamed, text_col="x.y").count() == found.count()
    assert conversation_trie(turns.limit(0)).collect() == []
    assert conversation_trie(turns.filter("conv_id is null")).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    # crc32 of 3 and 4 modulo 9 exceeds one turn, and conversation 0 is absent.
    lone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    rows = [(c, 0, "u", "gone") for c in lone]
    found = conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert len(found) == 1 and found[0]["depth"] == 0 and found[0]["n_convs"] == len(lone)
    text = ",".join(map(str, lone)).encode()
    assert found[0]["ends_sha256"] == hashlib.sha256(text).hexdigest()


def test_equal_paths_spread_over_shards(spark):
    """Copies of one conversation are cut by conv_id, and their ends hash is still in order."""
    paths = spark.range(30_000).select(F.col("id").alias("conv_id"), F.lit(bytes(40)).alias("path"))
    found = {r["depth"]: r for r in path_trie(paths, 9).collect()}
    text = ",".join(map(str, range(30_000))).encode()
    assert found[2]["n_convs"] == 30_000 and found[2]["ends_sha256"] == hashlib.sha256(text).hexdigest()
    assert set(found) == {0, 1, 2} and found[0]["n_leaves"] == 1


def test_common_turns_and_skeleton(spark):
    a, b, c = (bytes([k]) * 20 for k in (1, 2, 3))
    assert common_turns(a + b, a + c) == 1 and common_turns(a, a + c) == 1
    assert common_turns(b"", a) == 0 and common_turns(a + b, a + b) == 2
    trie = Skeleton([(a + b, 5), (a + c, 1)])
    assert trie.parent == [-1, 0, 1, 1] and trie.depth == [0, 1, 2, 2]
    assert [trie.shard_of(*x) for x in ((a, 9), (a + b, 4), (a + b, 5), (a + c, 0), (b, 0))] == [0, 0, 1, 1, 2]
    rows = spark.createDataFrame([(1, 0, "u", "é")], TURNS)
    assert bytes(own_paths(rows).first()["path"])[16:] == (2).to_bytes(4, "big")


# --- embedding whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def whitening_by_definition(vectors):
    """Exact fractions up to the eigenvectors."""
    x = {k: [int(np.floor(256 * float(np.float32(c)))) for c in v] for k, v in vectors}
    fit = sorted(set(map(tuple, x.values())))
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    cov = [
        [float(Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in fit), n**3)) for b in range(dims)]
        for a in range(dims)
    ]
    values, axes = np.linalg.eigh(np.array(cov))
    deviation = {k: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for k, v in x.items()}
    centred = {k: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) for k, v in x.items()}
    return n, values[::-1], axes[:, ::-1], deviation, centred


def check_whitening(rows, vectors, components):
    n, values, axes, deviation, centred = whitening_by_definition(vectors)
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(found) == len(rows) == len(vectors) * components
    for c in range(1, components + 1):
        ids = [k for k, _ in vectors]
        got = np.array([found[k, c]["whitened"] for k in ids])
        want = np.array([centred[k] @ axes[:, c - 1] for k in ids]) / np.sqrt(values[c - 1])
        sign = np.sign(got @ want) or 1
        np.testing.assert_allclose(sign * got, want, atol=1e-8)
        for k in ids:
            r = found[k, c]
            assert (r["n"], r["deviation"]) == (n, deviation[k])
            assert abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
            assert r["identity_error"] < 1e-6


def test_whitening_by_definition(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + [0, -9, 40, 0, 1, 0]).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(data)]
    vectors += [(1000 + i, data[0].tolist()) for i in range(200)]
    frame = spark.createDataFrame([(k, v, 1) for k, v in vectors], VECTORS).repartition(5)
    check_whitening(whiten_embeddings(frame).collect(), vectors, 4)


@needs_data
def test_whitening_of_the_test_table(spark):
    frame = spark.read.parquet(f"{SF}/sf0.001/embeddings.parquet").limit(120)
    vectors = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    frame = spark.createDataFrame([(k, v, 1) for k, v in vectors], VECTORS)
    check_whitening(whiten_embeddings(frame).collect(), vectors, 4)


def test_whitening_messy(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11)]) for i in range(40)]
    odd = [(50, None), (51, [1.0, None]), (52, [nan, 1.0]), (53, [1.0, -inf]), (54, []), (55, [1.0])]
    rows = [(k, v, 1) for k, v in good + odd] + [(None, [1.0, 2.0], None), (3, [3.0, 9.0], 2)]
    frame = spark.createDataFrame(rows, VECTORS)
    for name in ("x", "n", "component", "whitened", "longest", "a.b"):
        frame = frame.withColumn(name, F.lit(1))
    found = whiten_embeddings(frame).collect()
    # Two dimensions give two components; the null id and the repeated id keep their rows.
    assert len(found) == 2 * 42 and sum(r["vec_id"] is None for r in found) == 2
    renamed = frame.withColumnRenamed("embedding", "e.f")
    assert whiten_embeddings(renamed, vector_col="e.f").count() == len(found)
    for few in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0], 1)] * 3):
        assert whiten_embeddings(spark.createDataFrame(few, VECTORS)).collect() == []
    # A constant dimension has no variance and so no component.
    flat = spark.createDataFrame([(i, [float(i), 5.0], 1) for i in range(9)], VECTORS)
    assert {r["component"] for r in whiten_embeddings(flat).collect()} == {1}


def test_whitening_of_huge_entries(spark):
    """Entries beyond a long become the nearest one; deviations that no long holds are null."""
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whiten_embeddings(frame).collect()
    assert {r["component"] for r in found} == {1} and all(np.isfinite(r["whitened"]) for r in found)
    far = {r["vec_id"]: r["deviation"] for r in found}
    assert far[1] is None and far[2] is None


@pytest.mark.parametrize("width", [1, 9, 30, 63])
def test_scatter_equals_integer_products(width):
    rng = random.Random(width)
    x = np.array([[rng.randrange(1 << rng.choice((1, width))) for _ in range(5)] for _ in range(150)], dtype=np.uint64)
    widths = [int(c.max()).bit_length() for c in x.T]
    bits = [np.array([d for d in range(5) if widths[d] > k]) for k in range(max(widths))]
    assert bit_planes(x, bits).shape == (sum(map(len, bits)), 3)
    scatter = Scatter(bits, 5)
    scatter.add(x[:100])
    scatter.add(x[100:])
    scatter.flush()
    exact = x.astype(object)
    assert (scatter.cross == exact.T @ exact).all() and (scatter.sums == exact.sum(axis=0)).all()


def test_limbs():
    for value in (0, 1, 1 << 40, (1 << 200) + 12345):
        assert sum(p << (40 * k) for k, p in enumerate(limbs(value))) == value


def test_distinct_vectors_and_scaling(spark):
    rows = [(i, [0.5, -0.001], 1) for i in range(10)] + [(11, [-0.0, 1.0], 1)]
    scaled = scaled_vectors(spark.createDataFrame(rows, VECTORS))
    assert {tuple(r["x"]) for r in scaled.collect()} == {(128, -1), (0, 256)}
    model = fit_whitening(distinct_vectors(scaled))
    assert model.n == 2 and list(model.sums) == [128, 255]
