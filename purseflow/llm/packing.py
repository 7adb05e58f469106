"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from purseflow.llm.arrow import chunks, numbers, texts
from purseflow.session import staged

SEQUENCE_TOKENS = 2048
# Words and cores that a worker remembers; beyond, it starts anew.
CACHE_WORDS = 1 << 18
# Pieces up to this part of a sequence are left to best fit.
KEPT_BACK = 8
# Blocks of lengths whose complements are taken or put back as a whole.
BLOCKS = 6
# Parts that the pieces of one length are ranked in; one more for every PART_PIECES pieces.
PARTS, PART_PIECES = 64, 1_000_000


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Cores(dict):
    """Ids (little-endian uint32) of letter runs and punctuation runs."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # Byte-level vocabularies write a byte as itself where it is printable, else as 256 + n.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in printable]
        self.symbols = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        # A run of Latin letters is one pre-token that normalises letter by letter.
        if run.isalpha() and max(run) < "ƀ" and "İ" not in run:
            symbols = self.symbols
            mapped = "".join([symbols[b] for b in run.lower().encode()])
            ids = [token.id for token in self.model.tokenize(mapped)]
        else:
            ids = self.tokenizer.encode(run, add_special_tokens=False).ids
        self[run] = found = np.array(ids, dtype="<u4").tobytes()
        return found


class WordEncoder(dict):
    """Ids of words between ASCII white space, by the tokenizer; cached, for it cuts at white space.

    Punctuation around a word of letters is a pre-token of its own, so that the letters alone are
    looked up, in lower case where they are ASCII. Apostrophes, and words with the marks of a
    special token, go to the tokenizer as they are.
    """

    _AROUND = string.punctuation.replace("'", "")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.cores = _Cores(Tokenizer.from_file(path))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(self._AROUND)
        if core.isalpha() and "<|" not in text:
            at = text.index(core)
            lead, trail = text[:at], text[at + len(core) :]
            found = self.cores[core.lower() if core.isascii() else core]
            if lead:
                found = self.cores[lead] + found
            if trail:
                found += self.cores[trail]
        else:
            ids = self.cores.tokenizer.encode(text, add_special_tokens=False).ids
            found = np.array(ids, dtype="<u4").tobytes()
        self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and a closing 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        width = 4 * capacity
        for part in chunks(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                ids = words.ids(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), width)):
                    body = ids[at : at + width]
                    rows.append((doc_id, piece, at // 4, len(body) // 4, zlib.crc32(body)))
            columns = zip(*rows)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )
    return source.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class SumIndex:
    """Single, pair and triple sums of available lengths, looked up by the gap they fill.

    A sum's pairs are listed once, the largest length first, and kept under the sum; lengths that
    have run out are passed over when a list is read.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.lengths = np.flatnonzero(left)
        self._pairs: dict[int, list[tuple[int, int]]] = {}

    def singles(self, gap: int) -> Iterator[tuple[int, ...]]:
        if self.left[gap]:
            yield (gap,)

    def pairs(self, gap: int) -> Iterator[tuple[int, ...]]:
        known = self._pairs.get(gap)
        if known is None:
            a = self.lengths[(self.lengths < gap) & (2 * self.lengths >= gap)]
            a = a[self.left[gap - a] > 0][::-1]
            known = self._pairs[gap] = list(zip(a.tolist(), (gap - a).tolist()))
        for a, b in known:
            if self.left[a] and self.left[b]:
                yield a, b

    def triples(self, gap: int) -> Iterator[tuple[int, ...]]:
        if not len(self.lengths):
            return
        # The largest of three is a third of the gap at least, and leaves room for two more.
        room = (3 * self.lengths >= gap) & (self.lengths <= gap - 2 * self.lengths[0])
        for a in self.lengths[room][::-1].tolist():
            for b, c in self.pairs(gap - a) if self.left[a] else ():
                if not self.left[a]:
                    break
                if b <= a:
                    yield a, b, c


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Longest first, each piece where the least room is left; open sequences that are alike are
    handled together."""
    left, plan = counts, []
    gaps: list[int] = []
    alike: dict[int, list[tuple[list[int], int]]] = {}

    def put(lengths: list[int], times: int) -> None:
        gap = capacity - sum(lengths)
        if times and not gap:
            plan.append((lengths, times))
        elif times:
            if gap not in alike:
                alike[gap] = []
                insort(gaps, gap)
            alike[gap].append((lengths, times))

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(count, each)
                put([length] * each, full)
                if rest:
                    put([length] * rest, 1)
                break
            gap = gaps[at]
            lengths, times = alike[gap].pop()
            if not alike[gap]:
                del alike[gap], gaps[at]
            each = min(gap // length, count)
            used = min(times, count // each)
            put(lengths, times - used)
            put(lengths + [length] * each, used)
            count -= used * each
    plan += [entry for entries in alike.values() for entry in entries]
    return plan


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, times): how often to fill a sequence with which lengths, for ``counts`` pieces.

    ``counts[n]`` is the number of pieces of n tokens. From the longest length down, its gap is
    filled exactly by single lengths, then pairs, then triples out of an index of their sums, each
    combination as often at once as the counts allow; what is left is packed best-fit. Residuals need
    short pieces to fill up with, so pieces up to a KEPT_BACK-th of a sequence are kept out of the
    complements, and a block of lengths whose complements would make complements and residual
    together need more sequences is put back. The plan is thus never longer than best fit alone.
    The work depends on the capacity, not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    short = capacity // KEPT_BACK + 1
    kept = np.where(np.arange(capacity + 1) < short, left, 0)
    left -= kept
    plan: list[tuple[list[int], int]] = []

    def take(lengths: list[int]) -> None:
        kinds, uses = np.unique(lengths, return_counts=True)
        times = int((left[kinds] // uses).min())
        if times:
            left[kinds] -= times * uses
            plan.append((lengths, times))

    def made() -> int:
        residual = best_fit(left + kept, capacity)
        return sum(times for _, times in plan) + sum(times for _, times in residual)

    if left[capacity]:
        take([capacity])
    needed = made()
    sums = SumIndex(left)
    for fill in (sums.singles, sums.pairs, sums.triples):
        lengths_left = np.flatnonzero(left)[::-1]
        for block in np.array_split(lengths_left, BLOCKS):
            before, planned = left.copy(), len(plan)
            for longest in block.tolist():
                for lengths in fill(capacity - longest) if left[longest] else ():
                    take([longest, *lengths])
                    if not left[longest]:
                        break
            total = made() if len(plan) > planned else needed
            if total > needed:
                left[:] = before
                del plan[planned:]
            else:
                needed = total
    return plan + best_fit(left + kept, capacity)


def slot_table(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Per slot of the plan, ordered by (length, first rank): key, first rank, sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            used[n] = first + times
            rows.append(((n << 44) + first, first, sequence, offset))
            offset += n
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(4))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = SEQUENCE_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids (null text: none) and a closing id 0 are one piece, or pieces of ``capacity``
    ids if they are more. Pieces are packed into as few sequences of at most ``capacity`` ids as
    the plan finds. Repeated rows are packed as often as they occur; an empty table gives no rows.

    The plan is made on the driver from the number of pieces of each length, at most ``capacity``
    numbers. A piece's place follows from its rank among the pieces of its length: its rank in a
    part of them plus the sizes of the parts before.
    """
    path = tokenizer_path or tokenizer_file()
    pieces = staged(cut_pieces(docs, id_col, text_col, path, capacity), "pieces")
    parts = PARTS + pieces.count() // PART_PIECES
    pieces = pieces.withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    )
    sizes = staged(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    keys, firsts, sequences, offsets = slot_table(plan_sequences(counts, capacity))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = numbers(batch.column("rank"))
            at = np.searchsorted(keys, (numbers(batch.column("length")) << 44) + rank, "right") - 1
            found = [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *found], names=[*names, "sequence_id", "offset"]
            )

    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("own", F.row_number().over(order) - 1)
        .join(sizes.select("length", "part", "before"), ["length", "part"])
        .withColumn("rank", F.col("own") + F.col("before"))
        .select(*names, "rank")
    )
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    ).withColumnRenamed("doc_id", id_col)
