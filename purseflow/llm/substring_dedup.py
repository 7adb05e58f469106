"""Substring dedup: repeated word windows found level by level, doubling their length."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.llm.arrow import chunks, packed, texts
from purseflow.llm.hashing import Windows, keyed_word_hashes, sliding, word_hashes
from purseflow.session import staged

WINDOW_WORDS = 35
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def levels(window: int) -> list[int]:
    """Lengths of the levels: a quarter of the window, doubled until the window is reached."""
    length = max(1, -(-window // 4))
    found = [length]
    while length < window:
        length = min(2 * length, window)
        found.append(length)
    return found


def anchor_positions(base: np.ndarray, ends: np.ndarray, window: int, length: int) -> np.ndarray:
    """Whether each word is an anchor: the start of the smallest ``length``-word hash of a window.

    ``base`` holds those hashes (all ones where no such window starts), ``ends`` the position after
    each word's document. Which words of a window are anchors depends on its words alone, and
    every window of ``window`` words has one, so equal windows have equal anchors.
    """
    span = window - length + 1
    smallest = sliding(base, span)
    at = np.arange(len(smallest))
    inside = at + window <= ends[: len(smallest)]
    smallest = np.where(inside, smallest, np.uint64(0))
    padded = np.concatenate((np.zeros(span - 1, np.uint64), smallest, np.zeros(span - 1, np.uint64)))
    # The largest of the minima of all windows that reach over a word equals its hash if it is one.
    return (sliding(padded, span, np.maximum)[: len(base)] == base) & (base != _FAR)


def thin_ties(at: np.ndarray, key: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Which of the anchors to keep so that every window keeps one with its smallest hash.

    Of equal hashes close together, as in text that repeats itself, an anchor is left out if the
    next one still lies within ``span`` of the last one kept.
    """
    order = np.lexsort((at, key, doc))
    p, k, d = at[order], key[order], doc[order]
    chained = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (p[1:] - p[:-1] <= span)
    dropped, last, before, place = [], 0, -2, p.tolist()
    for i in (np.flatnonzero(chained[1:] & chained[:-1]) + 1).tolist():  # inside a chain
        if i != before + 1:
            last = i - 1
        if place[i + 1] - place[last] <= span:
            dropped.append(i)
        else:
            last = i
        before = i
    keep = np.ones(len(at), dtype=bool)
    keep[order[dropped]] = False
    return keep


def _documents(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a chunk, the position of each document's first word, and the end per word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.concatenate(words), ends - sizes, np.repeat(ends, sizes)


def _level_hashes(flat: Windows, ends: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window at each position, all ones where it would leave its document."""
    inside = at + length <= ends[at]
    return np.where(inside, flat.at(np.where(inside, at, 0), min(length, flat.count)), _FAR)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two hashes as one 16-byte value each."""
    return np.stack([a, b], axis=1).copy().view("V16").ravel()


def find_anchors(docs: DataFrame, window: int, key: int) -> DataFrame:
    """(kind, h0, h1, .., v, uid, uid2, pos, n, local): windows of all levels at every anchor.

    kind -1 is an anchor; pos its first word, n its document's words; v is a second hash of the
    full window, of keyed word hashes. Bit k of ``local`` tells that
    its level-k window occurs twice within one chunk of documents. For each such repeated window
    one more row of kind k stands for all of them, so that a window which a third of all
    documents hold reaches the shuffle once per chunk.
    """
    lengths = levels(window)
    hashes = [f"h{k}" for k in range(len(lengths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 8 << 20):
            words = [word_hashes(t)[0] for t in texts(part, "text")]
            flat, firsts, ends = _documents(words)
            if len(flat) < window:
                continue
            second = Windows(np.concatenate([keyed_word_hashes(t, key) for t in texts(part, "text")]))
            rolled, every = Windows(flat), np.arange(len(flat))
            base = _level_hashes(rolled, ends, every, lengths[0])
            at = np.flatnonzero(anchor_positions(base, ends, window, lengths[0]))
            if not len(at):
                continue
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            at = at[thin_ties(at, base[at], owner[at], window - lengths[0] + 1)]
            keys = [base[at]] + [_level_hashes(rolled, ends, at, n) for n in lengths[1:]]
            verify = _level_hashes(second, ends, at, window)
            doc = owner[at]
            uid, uid2 = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("uid", "uid2"))
            local = np.zeros(len(at), dtype=np.int32)
            kind, extra = [np.full(len(at), -1, dtype=np.int32)], []
            for k, hashes_at in enumerate(keys):
                # Earlier levels choose candidates; the last one decides, by both hashes.
                same = _pairs(hashes_at, verify) if k == len(keys) - 1 else hashes_at
                _, first, inverse, count = np.unique(
                    same, return_index=True, return_inverse=True, return_counts=True
                )
                twice = (count > 1) & (hashes_at[first] != _FAR)
                local |= twice[inverse].astype(np.int32) << k
                extra.append(first[twice])
                kind.append(np.full(len(extra[-1]), k, dtype=np.int32))
            rows = np.concatenate([np.arange(len(at)), *extra])
            n = (ends[at] - firsts[doc]).astype(np.int32)
            columns = [np.concatenate(kind), *(k[rows].view(np.int64) for k in keys)]
            columns += [verify[rows].view(np.int64), uid[rows], uid2[rows], (at - firsts[doc]).astype(np.int32)[rows], n[rows], local[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["kind", *hashes, "v", "uid", "uid2", "pos", "n", "local"]
    schema = "kind int, " + "".join(f"{h} long, " for h in hashes)
    schema += "v long, uid long, uid2 int, pos int, n int, local int"
    return docs.select("uid", "uid2", "text").mapInArrow(run, schema)


def _spread() -> Column:
    return F.xxhash64("uid", "pos", "kind")


def mark_level(rows: DataFrame, level: int, check: str | None, repeated: str) -> DataFrame:
    """Add ``repeated``: whether the anchor's window of this level occurs anywhere else.

    One shuffle by the window's hash; column ``check`` tells equal hashes apart. Rows whose answer is
    known (repeated within their chunk, or no candidates) are dealt out evenly instead.
    """
    known = (F.col("kind") > level) | (
        (F.col("kind") == -1) & (F.col("local").bitwiseAND(1 << level) != 0)
    )
    candidate = F.col("candidate") & (F.col(f"h{level}") != -1)
    decided = known | ((F.col("kind") == -1) & ~candidate)
    key = F.when(decided, _spread()).otherwise(F.col(f"h{level}"))
    second = F.lit(0).cast("long") if check is None else F.col(check)
    extra = F.when(decided, F.lit(None)).otherwise(second)
    weight = F.when(F.col("kind") == level, 2).otherwise(1)
    same = Window.partitionBy("key", "extra")
    return (
        rows.withColumn("key", key)
        .withColumn("extra", extra)
        .withColumn("decided", decided)
        .withColumn("known", known)
        # What later levels don't need stays behind.
        .drop(*([f"h{level}"] if level else []), *([check] if check else []))
        .withColumn("seen", F.sum(weight).over(same))
        .filter(F.col("kind") != level)
        .withColumn(repeated, F.when(F.col("decided"), F.col("known")).otherwise(F.col("seen") > 1))
        .drop("key", "extra", "seen", "decided", "known")
    )


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Per word whether one of the windows beginning at ``starts`` holds it."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps)[:n] > 0


def undecided_anchors(found: DataFrame, window: int, last: int) -> DataFrame:
    """(h0): hashes of anchors that lie within reach of a word no repeated anchor window covers."""
    base = levels(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, rows in zip(batch.column("n").to_pylist(), batch.column("rows")):
                values = rows.values
                pos = values.field("pos").to_numpy().astype(np.int64)
                done = values.field("done").to_numpy(zero_copy_only=False)
                key = values.field("h0").to_numpy()
                bare = np.concatenate(([0], np.cumsum(~_covered(pos[done], window, n))))
                reach = bare[np.minimum(pos + window, n)] - bare[np.maximum(pos - window + base, 0)]
                out.append(np.unique(key[reach > 0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["h0"])

    # As a set: of equal rows all have the same anchors.
    per_doc = found.groupBy("uid", "uid2").agg(
        F.first("n").alias("n"),
        F.collect_set(F.struct("pos", "h0", F.col(f"r{last}").alias("done"))).alias("rows"),
    )
    return per_doc.select("n", "rows").mapInArrow(run, "h0 long").distinct()


def _kept(text: bytes, covered: np.ndarray) -> tuple[int, str]:
    """Number of removed words, and the SHA-256 of the kept ones joined by a space."""
    words = text.split()
    kept = b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone])
    return int(covered.sum()), hashlib.sha256(kept).hexdigest()


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


_FIRST = (
    "uid long, uid2 int, doc_id long, n_words long, n_removed long, kept_sha256 string, text binary, "
    "starts binary, open array<struct<at: int, a: bigint, b: bigint>>"
)


def _first_pass(window: int, key: int):
    """Decide the documents without open windows; list the open windows of the others.

    Windows that repeat within one chunk of documents are decided here. One more row per chunk,
    without document, lists each of them once, at position -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 8 << 20):
            bodies = texts(part, "text")
            sizes, starts, at, a, b, doc = [], [], [], [], [], []
            for k, (text, anchors) in enumerate(zip(bodies, part.column("rows").to_pylist())):
                sizes.append(len(text.split()))
                if not anchors:
                    starts.append(None)
                    continue
                pos = np.array([x["pos"] for x in anchors], dtype=np.int64)
                done, open_, next_ = (
                    np.array([x[name] for x in anchors], dtype=bool) for name in ("done", "open", "next")
                )
                starts.append(np.unique(pos[done]))
                near, rolled = _open_windows(text, pos, open_, next_, window)
                if len(near):
                    at.append(near)
                    a.append(rolled.at(near, window))
                    b.append(Windows(keyed_word_hashes(text, key)).at(near, window))
                    doc.append(np.full(len(near), k))
            at, a, b, doc = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in
                             ((at, np.int64), (a, np.uint64), (b, np.uint64), (doc, np.int64)))
            _, first, inverse, count = np.unique(
                _pairs(a, b), return_index=True, return_inverse=True, return_counts=True
            )
            twice = count[inverse] > 1
            witness = first[count > 1]
            for k in np.unique(doc[twice]).tolist():
                starts[k] = np.union1d(starts[k], at[twice & (doc == k)])
            left = np.flatnonzero(~twice)
            per_doc = np.bincount(doc[left], minlength=len(bodies))
            removed, digest, text_out = [], [], []
            for k, text in enumerate(bodies):
                if per_doc[k]:
                    removed.append(None)
                    digest.append(None)
                    text_out.append(text)
                    continue
                empty = np.zeros(0, np.int64)
                begun = empty if starts[k] is None else starts[k]
                gone, sha = _kept(text, _covered(begun, window, sizes[k]))
                removed.append(gone)
                digest.append(sha)
                text_out.append(None)
            rows = np.concatenate([left, witness])
            place = at[rows].astype(np.int32)
            place[len(left):] = -1
            values = pa.StructArray.from_arrays(
                [pa.array(place), pa.array(a[rows].view(np.int64)), pa.array(b[rows].view(np.int64))],
                names=["at", "a", "b"],
            )
            offsets = np.concatenate(([0], np.cumsum(per_doc), [len(rows)])).astype(np.int32)
            none = [None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.column("uid").to_pylist() + none, pa.int64()),
                    pa.array(part.column("uid2").to_pylist() + none, pa.int32()),
                    pa.array(part.column("doc_id").to_pylist() + none, pa.int64()),
                    pa.array(sizes + none, pa.int64()),
                    pa.array(removed + none, pa.int64()),
                    pa.array(digest + none, pa.string()),
                    pa.array(text_out + none, pa.binary()),
                    pa.array([None if s is None else packed(s, "<i4") for s in starts] + none, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ],
                names=["uid", "uid2", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "starts", "open"],
            )

    return run


def _open_windows(
    text: bytes, pos: np.ndarray, open_: np.ndarray, goes_on: np.ndarray, window: int
) -> tuple[np.ndarray, Windows | None]:
    """Starts of the windows to be compared one by one: those whose smallest hash is at an open
    anchor, unless they would hold the anchor's next level and that is known not to repeat."""
    if not open_.any():
        return np.zeros(0, np.int64), None
    lengths = levels(window)
    words = word_hashes(text)[0]
    n, base = len(words), lengths[0]
    rolled = Windows(words)
    hashes = rolled.at(np.arange(n - base + 1), base)
    smallest = sliding(hashes, window - base + 1)
    longer = lengths[min(1, len(lengths) - 1)]
    steps = np.arange(window - base + 1)
    starts = pos[open_][:, None] - steps[None, :]
    fine = (starts >= 0) & (starts < len(smallest))
    # Where the smallest hash occurs again nearby, its copies elsewhere may have other anchors.
    near = pos[open_][:, None] + np.arange(1 - len(steps), len(steps))[None, :]
    inside = (near >= 0) & (near < len(hashes))
    alike = inside & (hashes[np.where(inside, near, 0)] == hashes[pos[open_]][:, None])
    sure = goes_on[open_] | (alike.sum(axis=1) > 1)
    fine &= sure[:, None] | (steps[None, :] + longer > window)
    fine &= smallest[np.where(fine, starts, 0)] == hashes[pos[open_]][:, None]
    return np.unique(starts[fine]), rolled


def _last_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = []
            starts, more = part.column("starts").to_pylist(), part.column("more").to_pylist()
            sizes = part.column("n_words").to_pylist()
            for text, first, second, n in zip(texts(part, "text"), starts, more, sizes):
                begun = np.concatenate((np.frombuffer(first, "<i4"), second or [])).astype(np.int64)
                rows.append(_kept(text, _covered(begun, window, n)))
            removed, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("n_words"),
                    pa.array(removed, pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row: what is left without repeated windows.

    A word goes if a window of ``window`` consecutive words of one document that holds it also
    starts anywhere else, in the same document or another. Words are runs without ASCII white
    space, unchanged; windows are those of the input. Null and empty texts have no words (their
    kept text is empty); texts shorter than a window stay whole; repeated rows repeat each other's
    windows and so lose them; an empty table gives no rows.

    1. Levels. Every window has an anchor, the word where its smallest quarter-length hash
       starts. The quarter-length windows at anchors are counted; those that repeat, and no
       others, are extended to twice the length and counted again, until the full length is
       reached. Full windows at anchors that repeat cover most of what goes.
    2. Edges. Where an anchor is within reach of a word not covered so, all anchors with its hash
       name the windows they are the anchor of, and these are counted like a level.

    A document is identified by 96 bits of hashes of its id and text, so equal rows are one document
    whose windows occur as often as the row. Windows are equal if two hashes are, one of them of
    word hashes under a key drawn for the run (128 bits).
    """
    lengths = levels(window)
    last = len(lengths) - 1
    key = secrets.randbits(63)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"),
        F.hash(F.col(id_col), F.col(text_col)).alias("uid2"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    rows = find_anchors(source, window, key).withColumn("candidate", F.lit(True))
    for level in range(last + 1):
        # The last level is decided by two hashes, earlier ones only choose candidates.
        rows = mark_level(rows, level, "v" if level == last else None, f"r{level}")
        rows = rows.filter(F.col(f"r{level}")) if level == 0 else rows
        rows = rows.withColumn("candidate", F.col(f"r{level}"))
    document = ["uid", "uid2"]
    found = staged(
        rows.select(*document, "pos", "n", "h0", F.col(f"r{min(1, last)}").alias("next"), f"r{last}"),
        "repeated_anchors",
    )
    undecided = staged(undecided_anchors(found, window, last), "undecided")
    marked = found.join(undecided.withColumn("open", F.lit(True)), "h0", "left")
    per_doc = marked.groupBy(*document).agg(
        F.collect_set(
            F.struct("pos", F.col(f"r{last}").alias("done"), F.coalesce("open", F.lit(False)).alias("open"), "next")
        ).alias("rows")
    )
    first = staged(
        source.join(per_doc, document, "left")
        .select(*document, "doc_id", "text", "rows")
        .mapInArrow(_first_pass(window, key), _FIRST),
        "first_pass",
    )
    fine = first.select(*document, F.explode("open").alias("w")).select(*document, "w.at", "w.a", "w.b")
    weight = F.when(F.col("at") < 0, 2).otherwise(1)
    again = fine.withColumn("seen", F.sum(weight).over(Window.partitionBy("a", "b")))
    more = again.filter("seen > 1 and at >= 0").groupBy(*document).agg(F.collect_set("at").alias("more"))
    waiting = first.filter("text is not null")
    rest = (
        waiting.select(*document, "doc_id", "n_words", "text", "starts")
        .join(more, document, "left")
        .select("doc_id", "n_words", "text", "starts", "more")
        .mapInArrow(_last_pass(window), _RESULT)
    )
    result = first.filter("text is null and n_words is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return result.unionByName(rest).withColumnRenamed("doc_id", id_col)
