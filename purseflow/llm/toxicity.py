"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from purseflow.llm.arrow import chunks, packed, texts
from purseflow.llm.hashing import word_hashes
from purseflow.llm.language_id import (
    _FOLD,
    PART_BYTES,
    LanguageModel,
    _parts,
    first_by_hash,
    fit as fit_languages,
    remainder,
    word_scores,
)

# Bound on the training sample: labelled documents of each class, the first by hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
# A word's embedding is the sum of a row for each of two hashes of the whole word, which words
# rarely share both of, and of a row for each of its beginnings, which its inflections share.
HEADS = (4, 6)
TABLES = 2 + len(HEADS)
HASH_BITS = 16
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 6
BATCH = 32
RATE = 0.02
# Rows of the sample kept out of training to choose thresholds, and how many toxic ones of a
# language must be among them for a threshold of its own.
CALIBRATION_SHARE = 5
CALIBRATION_TOXIC = 10
# Words of a text that are convolved at once.
PART_WORDS = 1 << 16
_SEED = 40_009


def hashed_words(text: bytes) -> np.ndarray:
    """A row of 16-bit hashes per word: two of the word, one of each of its beginnings.

    Words are lower-cased runs of letters; a beginning is a number of bytes. Long texts are hashed
    in parts that are cut between words.
    """
    if len(text) > PART_BYTES:
        return np.concatenate([_hashed_part(part) for part in _parts(text)])
    return _hashed_part(text)


def _hashed_part(text: bytes) -> np.ndarray:
    whole, _, _, *heads = word_hashes(text.translate(_FOLD), HEADS)
    high = [h >> np.uint64(64 - HASH_BITS) for h in (whole, *heads)]
    second = (whole >> np.uint64(64 - 2 * HASH_BITS)) & np.uint64((1 << HASH_BITS) - 1)
    return np.stack([high[0], second, *high[1:]], axis=1).astype(np.uint16)


@dataclass
class Network:
    rows: np.ndarray  # embeddings: (tables, hashes, dimensions)
    kernels: list[np.ndarray]  # per width: (width, dimensions, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            draw(0.1, TABLES, 1 << HASH_BITS, DIMENSIONS),
            [draw(0.3, w, DIMENSIONS, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            draw(0.1, FILTERS * len(WIDTHS)),
            0.0,
        )

    def embed(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of all words, each document followed by zero rows; its first row; each row's
        word; and the rows at which a window would reach into the next document."""
        pad = max(WIDTHS) - 1
        sizes = np.array([len(d) for d in docs]) + pad + 1
        starts = np.cumsum(sizes) - sizes
        rows = np.concatenate([np.arange(len(d)) + s for d, s in zip(docs, starts)])
        words = np.concatenate(docs)
        values = np.zeros((int(sizes.sum()) + pad, DIMENSIONS), np.float32)
        total = self.rows[0][words[:, 0]]
        for k in range(1, TABLES):
            total += self.rows[k][words[:, k]]
        values[rows] = total
        word = np.full(len(values), -1, dtype=np.int64)
        word[rows] = np.arange(len(words))
        ends = starts + sizes
        return values, starts, word, (ends[:, None] - np.arange(1, pad + 1)).ravel()

    def convolve(self, values: np.ndarray, at: int, over: np.ndarray | None = None) -> np.ndarray:
        """Filter outputs of one width at every row; 0, as of zero rows, at the rows ``over``.

        Scores leave out windows that reach into the next document. Training takes them along: its
        batches are shuffled, so they are noise.
        """
        width, n = WIDTHS[at], len(values) - max(WIDTHS) + 1
        out = values[:n] @ self.kernels[at][0]
        for step in range(1, width):
            out += values[step : step + n] @ self.kernels[at][step]
        if over is not None:
            out[over] = 0
        return out

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """The largest output of every filter over each document."""
        values, starts, _, over = self.embed(docs)
        found = [
            np.maximum.reduceat(self.convolve(values, k, over), starts, axis=0)
            for k in range(len(WIDTHS))
        ]
        return np.concatenate(found, axis=1)

    def pooled_long(self, words: np.ndarray) -> np.ndarray:
        """The same for one long document: parts that overlap by the widest window, merged by
        maximum, which pooling allows."""
        pad, best = max(WIDTHS) - 1, None
        for at in range(0, len(words), PART_WORDS):
            last = at + PART_WORDS >= len(words)
            values, _, _, over = self.embed([words[at : at + PART_WORDS + pad]])
            # Windows that begin in the part; those over its end belong to the last part alone.
            rows = slice(None) if last else slice(PART_WORDS)
            found = np.concatenate(
                [self.convolve(values, k, over)[rows].max(axis=0) for k in range(len(WIDTHS))]
            )
            best = found if best is None else np.maximum(best, found)
        return best

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        long = {i for i, d in enumerate(docs) if len(d) > PART_WORDS}
        pooled = self.pooled([d[:0] if i in long else d for i, d in enumerate(docs)])
        for i in long:
            pooled[i] = self.pooled_long(docs[i])
        features = np.maximum(pooled + np.concatenate(self.biases), 0)
        return features.astype(np.float64) @ self.weights + self.bias


class _Adam:
    def __init__(self, value: np.ndarray):
        self.value, self.m, self.v, self.t = value, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        self.value -= (RATE / 4) * m / (np.sqrt(v) + 1e-8)


def train(docs: list[np.ndarray], toxic: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Balanced logistic loss; gradients flow through the maxima only, so embeddings get few."""
    rng = np.random.default_rng(_SEED)
    net = Network.start(rng)
    seen = np.zeros((TABLES, 1 << HASH_BITS), np.float32)
    bias = np.zeros(1, np.float32)
    dense = [_Adam(x) for x in (*net.kernels, *net.biases, net.weights, bias)]
    positive = max(1, int(toxic.sum()))
    balance = np.where(toxic == 1, len(toxic) / (2 * positive), len(toxic) / (2 * max(1, len(toxic) - positive)))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), BATCH):
            chosen = order[s : s + BATCH]
            values, starts, word, _ = net.embed([docs[i] for i in chosen])
            ends = np.append(starts[1:], len(values) - max(WIDTHS) + 1)
            features, peaks = [], []
            for k in range(len(WIDTHS)):
                out = net.convolve(values, k)
                peak = np.stack([a + out[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                peaks.append(peak)
                features.append(np.maximum(out[peak, np.arange(FILTERS)] + net.biases[k], 0))
            joint = np.concatenate(features, axis=1)
            logit = joint @ net.weights + bias[0]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[chosen]) * balance[chosen] / len(chosen)
            error = error.astype(np.float32)
            back = error[:, None] * net.weights * (joint > 0)
            kernel_steps, bias_steps, rows, steps = [], [], [], []
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                bias_steps.append(g.sum(axis=0))
                step = np.empty_like(net.kernels[k])
                for j in range(width):
                    near = values[peaks[k] + j]
                    step[j] = np.einsum("bfd,bf->df", near, g)
                    rows.append((peaks[k] + j).ravel())
                    steps.append((net.kernels[k][j].T[None] * g[:, :, None]).reshape(-1, DIMENSIONS))
                kernel_steps.append(step)
            words, moves = word[np.concatenate(rows)], np.concatenate(steps)
            live = (words >= 0) & (moves != 0).any(axis=1)
            words, moves = words[live], moves[live]
            flat = np.concatenate([docs[i] for i in chosen])[words]
            for table, past, index in zip(net.rows, seen, flat.T):
                unique, inverse = np.unique(index, return_inverse=True)
                total = np.zeros((len(unique), DIMENSIONS), np.float32)
                np.add.at(total, inverse, moves)
                past[unique] += (total * total).mean(axis=1)
                table[unique] -= RATE * 2 * total / (np.sqrt(past[unique]) + 1e-6)[:, None]
            joint_step = joint.T @ error
            for part, gradient in zip(dense, (*kernel_steps, *bias_steps, joint_step, error.sum(keepdims=True))):
                part.step(gradient)
    net.bias = float(bias[0])
    return net


def best_threshold(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest cut among those with the best balanced accuracy."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], toxic[order]
    misses = np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())
    alarms = (len(y) - y.sum() - np.concatenate(([0], np.cumsum(1 - y)))) / max(1, len(y) - y.sum())
    cost = misses + alarms
    edges = np.concatenate(([x[0] - 2], x, [x[-1] + 2]))
    width = np.where(cost <= cost.min() + 1e-12, np.diff(edges), -1)
    at = int(width.argmax())
    return float((edges[at] + edges[at + 1]) / 2)


@dataclass
class ToxicityModel:
    network: Network | None
    languages: LanguageModel
    thresholds: dict[str, float]
    default: float

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        """Probability-like scores, 0.5 at the threshold of the language a text looks like."""
        if self.network is None:
            return np.zeros(len(bodies))
        logits = self.network.logits([hashed_words(b) for b in bodies])
        looks = guess_languages(self.languages, bodies)
        level = np.array([self.thresholds.get(x, self.default) for x in looks])
        return 1 / (1 + np.exp(-np.clip(logits - level, -500, 500)))


def guess_languages(model: LanguageModel, bodies: list[bytes]) -> list[str]:
    """The likeliest single language of each text, "" if there is nothing to tell."""
    found = [""] * len(bodies)
    if not model.languages:
        return found
    scores, doc = word_scores(model, [b"" if len(b) > PART_BYTES else b for b in bodies])
    if len(scores):
        present, starts = np.unique(doc, return_index=True)
        best = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
        for i, k in zip(present.tolist(), best.tolist()):
            found[i] = model.languages[k]
    for i, body in enumerate(bodies):
        if len(body) > PART_BYTES:
            totals = [word_scores(model, [part])[0].sum(axis=0) for part in _parts(body)]
            total = np.sum(totals, axis=0)
            found[i] = model.languages[int(total.argmax())] if total.any() else ""
    return found


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    toxic_col: str = "toxic",
    sample: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC),
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows whose crc32(id as text) mod 5 is not 0.

    The sample is the ``sample`` (clean, toxic) documents that come first by hash of their id. The
    driver gets their hashed words. A fifth of them choose the thresholds: one overall, and one
    for each language with enough toxic rows; languages are guessed from the text.
    """
    seen = F.coalesce(remainder(id_col, 5) != 0, F.lit(False))
    marked = (
        labels.filter(seen & F.col(toxic_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(toxic_col).alias("toxic"))
    )
    chosen = first_by_hash(marked, "toxic", lambda toxic: sample[toxic])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            bodies = texts(part, "text")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("toxic"),
                    pa.array([packed(hashed_words(b), "<u2") for b in bodies], pa.binary()),
                    pa.array(guess_languages(languages, bodies), pa.string()),
                ],
                names=["id", "toxic", "words", "looks"],
            )

    usable = docs.filter(seen & F.col(text_col).isNotNull())
    languages = fit_languages(
        usable.filter(F.col(lang_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
        ),
        500,
    )
    rows = (
        usable.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("id", F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(hashes, "id long, toxic int, words binary, looks string")
        # Of several texts of an id the least by its hashes, whatever the order of rows.
        .groupBy("id")
        .agg(F.min(F.struct("toxic", "words", "looks")).alias("row"))
        .select("id", "row.*")
        .toArrow()
        .sort_by("id")
    )
    toxic = rows.column("toxic").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(None, languages, {}, 0.0)
    words = [np.frombuffer(w, "<u2").reshape(-1, TABLES) for w in rows.column("words").to_pylist()]
    looks = np.array(rows.column("looks").to_pylist())
    fold = np.arange(len(words)) % CALIBRATION_SHARE == 0
    if len(set(toxic[fold].tolist())) < 2 or len(set(toxic[~fold].tolist())) < 2:
        fold = np.zeros(len(words), dtype=bool)
    network = train([w for w, out in zip(words, fold) if not out], toxic[~fold])
    judged = fold if fold.any() else ~fold
    logits = np.concatenate(
        [network.logits(words[i : i + BATCH]) for i in range(0, len(words), BATCH)]
    )
    default = best_threshold(logits[judged], toxic[judged])
    thresholds = {}
    for name in np.unique(looks):
        mine = judged & (looks == name)
        if CALIBRATION_TOXIC <= toxic[mine].sum() < mine.sum():
            thresholds[str(name)] = best_threshold(logits[mine], toxic[mine])
    return ToxicityModel(network, languages, thresholds, default)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    toxic_col: str = "toxic",
) -> DataFrame:
    """Per row: id, held_out (crc32(id as text) mod 5 is 0), score (0 to 1), predicted (0 or 1).

    Scores depend on the text alone. Null and empty texts are scored like texts without words; if
    the labels hold one class only or none, every score is 0. Labels that are not 0 or 1 are
    ignored; of several labels of an id the higher counts; null ids are never learned from and
    not held out. Repeated rows each get their row; an empty table gives no rows.
    """
    model = learn(docs, labels, id_col, text_col, lang_col, toxic_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 18):
            scores = model.scores(texts(part, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                names=["id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(remainder(id_col, 5) == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    return rows.mapInArrow(
        run, "id long, held_out boolean, score double, predicted int"
    ).withColumnRenamed("id", id_col)
