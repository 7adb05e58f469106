"""Language ID as multilingual mixture inference: each document's language proportions by EM."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.llm.arrow import chunks, texts

UNDETERMINED = "und"
# Bound on the training sample: labelled documents per language, the first by hash of their id.
SAMPLE_PER_LANGUAGE = 1500
# Hashed byte trigrams of lower-cased words.
GRAM_BITS = 15
SMOOTHING = 0.5
EM_STEPS = 12
# What each further language of a document's set costs (times log words / 2).
PENALTY = 2.0
# Bytes of text that are scored at once; longer texts are worked off in parts of that size.
PART_BYTES = 1 << 20

# Every byte that is part of a word: ASCII letters in lower case, and all bytes of other letters.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class LanguageModel:
    """Log-likelihood of every hashed trigram in every language, float32 (grams, languages)."""

    languages: list[str]
    table: np.ndarray


def word_grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram around each letter of all texts; first gram of each word; document per word."""
    folded = [b" " + body.translate(_FOLD) + b" " for body in bodies]
    data = np.frombuffer(b"".join(folded), dtype=np.uint8)
    letter = data != 32
    at = np.flatnonzero(letter)
    wide = data.astype(np.uint32)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    code = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
    grams = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(f) for f in folded])
    return grams, first, np.searchsorted(ends, at[first], side="right")


def _has_letter(body: bytes) -> bool:
    return any(c.isalpha() for c in body.decode("utf-8", "replace"))


def first_by_hash(rows: DataFrame, kind: str, bound: Callable[[object], int]) -> DataFrame:
    """At most ``bound`` (id, kind) rows of each kind, those that come first by hash of their id.

    A first look at the number of rows per kind gives a limit for the hash that leaves a little
    more than the bound, so that the ranking sees no more rows of a frequent kind than of a rare
    one. There are as few kinds as a model can tell apart.
    """
    scale = 1 << 30
    counts = {r[kind]: r["count"] for r in rows.groupBy(kind).count().collect()}
    limits = {
        k: scale if n <= bound(k) else int(scale * (1.2 * bound(k) + 50) / n) for k, n in counts.items()
    }
    if not limits:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(kind)]
    most = F.create_map(*[F.lit(x) for k in counts for x in (k, bound(k))])[F.col(kind)]
    first = Window.partitionBy(kind).orderBy(F.xxhash64("id"), "id")
    return (
        rows.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < limit)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= most)
        .drop("rank")
    )


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model from (id, text, lang) rows without nulls in text and lang.

    The sample is the ``per_language`` rows of each language that come first by hash of their id;
    it is chosen by ids alone. Its trigrams are counted in Spark; the driver gets one number per
    language and trigram.
    """
    chosen = first_by_hash(labelled.select("id", "lang"), "lang", lambda lang: per_language).distinct()
    # At most per_language rows for each language.
    sample = labelled.join(F.broadcast(chosen), ["id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text"):
            langs = part.column("lang").to_pylist()
            grams, first_gram, doc = word_grams(texts(part, "text"))
            if not len(grams):
                continue
            owner = np.repeat(doc, np.diff(np.append(first_gram, len(grams))))
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[owner]
            flat = np.bincount((code << GRAM_BITS) + grams, minlength=len(names) << GRAM_BITS)
            for name, row in zip(names, flat.reshape(len(names), -1)):
                totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(seen), pa.string()),
                    pa.array(seen.astype(np.int32)),
                    pa.array(row[seen].astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )

    counted = (
        sample.select("lang", F.col("text").cast("binary").alias("text"))
        .mapInArrow(count, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(set(counted.column("lang").to_pylist()))
    totals = np.zeros((1 << GRAM_BITS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    columns = np.array([place[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)
    totals[counted.column("gram").to_numpy(), columns] = counted.column("n").to_numpy()
    share = (totals + SMOOTHING) / (totals.sum(axis=0) + SMOOTHING * (1 << GRAM_BITS))
    return LanguageModel(names, np.log(share).astype(np.float32))


def word_scores(model: LanguageModel, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood (words, languages) of every word of the texts, and each word's document."""
    grams, first, doc = word_grams(bodies)
    if not len(grams):
        return np.zeros((0, len(model.languages)), np.float32), doc
    # Words are added up by differences of running sums: one pass in double precision.
    running = np.zeros((len(grams) + 1, len(model.languages)))
    np.cumsum(model.table[grams], axis=0, dtype=np.float64, out=running[1:])
    edges = np.append(first, len(grams))
    return running[edges[1:]] - running[edges[:-1]], doc


def _mixture(
    like: np.ndarray, starts: np.ndarray, doc: np.ndarray, shares: np.ndarray, steps: int
) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions, and the log of the mixture per word summed."""
    sizes = np.diff(np.append(starts, len(like)))[:, None]
    for _ in range(steps):
        part = like * shares[doc]
        part /= part.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(part, starts, axis=0) / sizes
    total = np.log((like * shares[doc]).sum(axis=1))
    return shares, np.add.reduceat(total, starts)


def _shares_of_many(model: LanguageModel, bodies: list[bytes], proportions: np.ndarray) -> None:
    """Fill in the proportions of texts that are short enough to be scored at once."""
    count = len(model.languages)
    scores, doc = word_scores(model, bodies)
    if not len(scores):
        return
    present, starts = np.unique(doc, return_index=True)
    local = np.searchsorted(present, doc)
    best = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - best, -80.0)).astype(np.float64)
    words = np.diff(np.append(starts, len(like)))

    def fitted(start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        return _mixture(like, starts, local, start, steps)

    proportions[present] = _best_sets(fitted, len(present), count, words)


def _best_sets(fitted: Callable, documents: int, count: int, words: np.ndarray) -> np.ndarray:
    """Proportions (documents, languages) under each document's best language set.

    The nested sets of the 1, 2, .. heaviest languages compete, each fitted again; a document's
    sets grow until its log-likelihood less a penalty per further language falls.
    """
    full, _ = fitted(np.full((documents, count), 1.0 / count), EM_STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    winner, value = np.zeros((documents, count)), np.full(documents, -np.inf)
    growing = np.ones(documents, dtype=bool)
    for size in range(1, count + 1):
        start = np.where(place < size, full + 1e-9, 0.0)
        start /= start.sum(axis=1, keepdims=True)
        shares, fit_value = fitted(start, 4 if size > 1 else 0)
        fit_value = fit_value - PENALTY * (size - 1) * 0.5 * np.log(words + 1.0)
        growing &= fit_value > value
        winner = np.where(growing[:, None], shares, winner)
        value = np.where(growing, fit_value, value)
        if not growing.any():
            break
    return winner


def _parts(body: bytes) -> Iterator[bytes]:
    """Parts of a long text of about PART_BYTES, cut between words; a word that long is cut too."""
    at = 0
    while at < len(body):
        stop = min(at + PART_BYTES, len(body))
        ahead = body[stop : stop + PART_BYTES].translate(_FOLD)
        space = ahead.find(b" ")
        stop += space if space >= 0 else len(ahead)
        yield body[at:stop]
        at = stop


def _shares_of_long(model: LanguageModel, body: bytes) -> np.ndarray | None:
    """Proportions of one long text; its parts are scored anew in every step, and their sums added.

    Memory follows the size of a part. None for a text without a word.
    """
    count = len(model.languages)
    words = sum(len(word_grams([part])[1]) for part in _parts(body))
    if not words:
        return None

    def fitted(start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        shares = start
        for step in range(steps + 1):
            added, total = np.zeros((1, count)), 0.0
            for part in _parts(body):
                scores, _ = word_scores(model, [part])
                if not len(scores):
                    continue
                like = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -80.0))
                mixed = like * shares
                sums = mixed.sum(axis=1, keepdims=True)
                added += (mixed / sums).sum(axis=0)
                total += np.log(sums).sum()
            if step < steps:
                shares = added / words
        return shares, np.array([total])

    return _best_sets(fitted, 1, count, np.array([words]))[0]


def infer(model: LanguageModel, bodies: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: language, its proportion, and the proportions of all languages.

    EM over words runs with all languages first, then with nested sets (``_best_sets``).
    """
    count = len(model.languages)
    proportions = np.zeros((len(bodies), max(count, 1)))
    if count:
        long = [i for i, body in enumerate(bodies) if len(body) > PART_BYTES]
        for i in long:
            shares = _shares_of_long(model, bodies[i])
            if shares is not None:
                proportions[i] = shares
        rest = [b"" if len(body) > PART_BYTES else body for body in bodies]
        some = np.zeros_like(proportions)
        _shares_of_many(model, rest, some)
        proportions += some
    top = proportions.argmax(axis=1)
    chosen, score = [], proportions[np.arange(len(bodies)), top]
    known = proportions.sum(axis=1) > 0
    for i, body in enumerate(bodies):
        # ASCII letters are letters; for texts without one, look at the characters.
        sure = known[i] and (body.isascii() or bool(body.translate(None, _NO_ASCII_LETTER)))
        if count and known[i] and (sure or _has_letter(body)):
            chosen.append(model.languages[top[i]])
        else:
            chosen.append(UNDETERMINED)
            score[i] = 0.0
    return chosen, np.clip(score, 0.0, 1.0), proportions


_NO_ASCII_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """The model of a bounded sample of the rows that are not held out."""
    out = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    usable = F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
    labelled = docs.filter(usable & ~out).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    return fit(labelled, per_language)


def _slices(bodies: list[bytes], most: int = 100) -> Iterator[list[bytes]]:
    """Runs of texts with at most ``most`` of them and about PART_BYTES together."""
    held, size = [], 0
    for body in bodies:
        if held and (len(held) == most or size + len(body) > PART_BYTES):
            yield held
            held, size = [], 0
        held.append(body)
        size += len(body)
    if held:
        yield held


def mixture_udf(model: LanguageModel):
    """Column function of a binary text: struct of lang_pred, score and mixture."""

    @F.pandas_udf("lang_pred string, score double, mixture string")
    def mixture(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in series:
            found = []
            for bodies in _slices([b or b"" for b in part]):
                chosen, score, shares = infer(model, bodies)
                listed = [
                    ",".join(f"{model.languages[k]}:{row[k]:.4f}" for k in np.flatnonzero(row > 0.0001))
                    for row in shares
                ]
                found += zip(chosen, score.tolist(), listed)
            yield pd.DataFrame(found, columns=["lang_pred", "score", "mixture"])

    return mixture


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """Per row: id, held_out, lang_pred, score (proportion of that language), mixture.

    Rows whose crc32(id as text) mod 4 is 2 are held out; the model is fitted on a bounded sample
    of the others that have a language and a text, and predicts from the text alone. ``mixture``
    lists the selected languages with proportions. Null texts and texts without a letter are
    ``und`` with score 0, as are all if nothing can be learned. Null ids are never learned from
    and not held out. Repeated rows each get their row; an empty table gives no rows.
    """
    mixture = mixture_udf(learn(docs, id_col, text_col, lang_col, per_language))
    held_out = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    found = docs.select(
        F.col(id_col), held_out.alias("held_out"), mixture(F.col(text_col).cast("binary")).alias("m")
    )
    return found.select(id_col, "held_out", "m.lang_pred", "m.score", "m.mixture")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` without the rows that have no identifiable language (``und``), whole.

    The same rules as ``identify``; each row is judged by itself, without a shuffle.
    """
    mixture = mixture_udf(learn(docs, id_col, text_col, lang_col))
    found = mixture(F.col(text_col).cast("binary"))["lang_pred"]
    return docs.filter(found != UNDETERMINED)
