"""Language identification by a convolutional network on bytes.

Whole texts are cut into windows of a fixed number of bytes. Each byte is embedded; filters of several
widths run over the window, the maximum of each over all positions is kept, and a softmax layer tells the
language. The network is trained in numpy on a bounded sample of labelled documents; a text's
probabilities are the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import raw_texts, table
from pitchlens.staging import stage

#: Labelled documents that a model is fitted on, at most, dealt out evenly to the languages.
FIT_ROWS = 4000
#: Windows of a document that the fit uses, at most, spread over the whole text. All windows are scored.
FIT_WINDOWS = 8
#: Bytes of a window, and the symbol that fills it up.
WINDOW, PAD = 256, 256
#: Numbers that a byte is embedded in, filter widths, filters of each width.
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 4, 5), 12
#: Windows that are computed at once.
WINDOWS_AT_ONCE = 64
UNKNOWN = "und"


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text as rows of symbols, and how many bytes of the text each holds."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(text) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


@dataclass
class ByteNetwork:
    """Embedding, filters (rows: width x embedding, zero beyond their own width), biases, softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @staticmethod
    def new(languages: list[str], seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        count = FILTERS * len(WIDTHS)
        return ByteNetwork(
            languages,
            rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
            (rng.normal(0, 0.3, (max(WIDTHS) * EMBEDDING, count)) * filter_shape()).astype(np.float32),
            np.zeros(count, np.float32),
            rng.normal(0, 0.1, (count, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def inputs(self, windows: np.ndarray) -> np.ndarray:
        """Per window and position the embedded bytes under the widest filter."""
        widest = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, widest - 1)), constant_values=PAD)
        flat = self.embedding[padded].reshape(len(windows), -1)
        step = flat.strides[1]
        shape = (len(windows), WINDOW, widest * EMBEDDING)
        return np.lib.stride_tricks.as_strided(flat, shape, (flat.strides[0], EMBEDDING * step, step))

    def pooled(self, inputs: np.ndarray) -> np.ndarray:
        """Filter outputs of every position before pooling, positions in the second axis."""
        rows = np.ascontiguousarray(inputs).reshape(-1, inputs.shape[2])
        return (rows @ self.filters).reshape(len(inputs), WINDOW, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """A row of probabilities for each window."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for start in range(0, len(windows), WINDOWS_AT_ONCE):
            part = slice(start, start + WINDOWS_AT_ONCE)
            best = self.pooled(self.inputs(windows[part])).max(axis=1)
            out[part] = _softmax(np.maximum(best + self.bias, 0) @ self.weights + self.offset)
        return out


def filter_shape() -> np.ndarray:
    """1 where a filter has a weight: narrower ones end before the widest."""
    shape = np.zeros((max(WIDTHS) * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
    for i, width in enumerate(WIDTHS):
        shape[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    return shape


def gradients(net: ByteNetwork, windows: np.ndarray, answers: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of some windows, and its gradient for each parameter.

    Through the pooling only the position with the maximum counts, so the way back is short.
    """
    n = len(windows)
    inputs = net.inputs(windows)
    scores = net.pooled(inputs)
    at = scores.argmax(axis=1)
    best = np.take_along_axis(scores, at[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(best, 0)
    chance = _softmax(hidden @ net.weights + net.offset)
    loss = -float(np.log(np.maximum(chance[np.arange(n), answers], 1e-12)).mean())
    d_scores = chance
    d_scores[np.arange(n), answers] -= 1
    d_scores /= n
    d_best = (d_scores @ net.weights.T) * (best > 0)
    seen = inputs[np.arange(n)[:, None], at]  # window, filter, width x embedding
    shape = filter_shape()
    d_filters = np.einsum("nf,nfk->kf", d_best, seen) * shape
    d_seen = (d_best[:, :, None] * net.filters.T).reshape(n, len(net.bias), max(WIDTHS), EMBEDDING)
    padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)), constant_values=PAD)
    symbols = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, symbols.ravel(), d_seen.reshape(-1, EMBEDDING))
    return loss, [d_embedding, d_filters, d_best.sum(axis=0), hidden.T @ d_scores, d_scores.sum(axis=0)]


def train(
    windows: np.ndarray, sizes: np.ndarray, answers: np.ndarray, languages: list[str],
    epochs: int = 3, batch: int = 64, rate: float = 0.005, seed: int = 11,
) -> ByteNetwork:
    """A network fitted by Adam. Every fourth window is cut short, so that short texts are known, too."""
    rng = np.random.default_rng(seed)
    net = ByteNetwork.new(languages, seed)
    shape = filter_shape()
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            part = windows[rows].copy()
            for i in range(0, len(rows), 4):
                part[i, rng.integers(4, max(5, sizes[rows[i]] + 1)) :] = PAD
            step += 1
            _, slopes = gradients(net, part, answers[rows])
            speed = rate * 0.3**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, slope, (mean, square) in zip(net.parameters(), slopes, state):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                p -= speed * mean / (np.sqrt(square) + 1e-8)
            net.filters *= shape
    return net


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``FIT_WINDOWS`` windows of each text, those with the smallest checksums of text and place."""
    for batch in batches:
        names, held, sizes, keys = [], [], [], []
        for text, name in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
            first = zlib.crc32(text)
            order = sorted(range(max(1, -(-len(text) // WINDOW))), key=lambda i: (zlib.crc32(b"%d" % i, first), i))
            for i in sorted(order[:FIT_WINDOWS]):
                held.append(text[i * WINDOW : (i + 1) * WINDOW])
                names.append(name)
                sizes.append(len(held[-1]))
                keys.append(zlib.crc32(b"%d" % i, first))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(held, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())],
            ["lang", "bytes", "size", "key"],
        )


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS
) -> ByteNetwork:
    """Fit a network on at most ``rows`` labelled documents that are not held out.

    Every language gets the same share of them, those with the smallest hashes of id and text; with more
    languages than ``rows`` the most frequent are learned. Rows without text, letters, language or id
    are no examples. Ids and sources are never inputs. Without examples no language is known.
    """
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    told = told.filter(~is_held_out(F.col("id"))).dropna().filter(F.col("text").rlike(r"\p{L}"))
    counts = told.groupBy("lang").agg(F.count(F.lit(1)).alias("rows_of"))
    counts = stage(counts.orderBy(F.desc("rows_of"), "lang").limit(rows), "languages")
    share = rows // max(1, counts.count())
    place = F.xxhash64("id", "text") / 2.0**64 + 0.5
    told = told.join(F.broadcast(counts), "lang")  # as many rows as languages, ``rows`` at most
    told = told.filter(place * F.col("rows_of") < 1.2 * share)
    told = told.orderBy(F.xxhash64("id", "text"), "lang").limit(rows).select("text", "lang")
    chosen = told.mapInArrow(_chosen, "lang string, bytes binary, size int, key long").toArrow()
    chosen = chosen.sort_by([("key", "ascending"), ("lang", "ascending"), ("bytes", "ascending")])
    names = np.array(chosen["lang"].to_pylist(), object)
    languages = sorted(set(names))
    if not languages:
        return ByteNetwork.new([])
    windows = np.concatenate([windows_of(b)[0][:1] for b in chosen["bytes"].to_pylist()])
    return train(windows, chosen["size"].to_numpy(), np.searchsorted(languages, names.astype(str)), languages)


def _texts_scored(net: ByteNetwork, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and probability of each text. Windows of several texts are computed together."""
    totals = np.zeros((len(texts), len(net.languages)))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        owners = np.concatenate([h[2] for h in held])
        chance = net.probabilities(np.concatenate([h[0] for h in held])) * np.concatenate([h[1] for h in held])[:, None]
        np.add.at(totals, owners, chance)
        held.clear()

    count = 0
    for i, text in enumerate(texts):
        span = WINDOW * WINDOWS_AT_ONCE
        for start in range(0, max(1, len(text)), span):  # a long text in parts
            windows, sizes = windows_of(text[start : start + span])
            held.append((windows, sizes, np.full(len(windows), i)))
            count += len(windows)
            if count >= WINDOWS_AT_ONCE:
                flush()
                count = 0
    if held:
        flush()
    totals /= np.maximum(1, [[len(t)] for t in texts])
    best = totals.argmax(axis=1)
    return [(net.languages[b], float(row[b])) for b, row in zip(best, totals)]


def identify(
    docs: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row, from the whole text alone.

    ``score`` is the probability of the predicted language, rounded to six places. A text that is null
    or has no letter is ``und`` with score 0, as is every text if the network knows no language. Rows
    without id are not held out; repeated rows get equal results; an empty table gives no rows. Other
    columns, the language among them, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(2))
            known = [i for i, ok in enumerate(batch.column(3).to_pylist()) if ok and net.languages]
            answers = [(UNKNOWN, 0.0)] * len(texts)
            for i, answer in zip(known, _texts_scored(net, [texts[i] for i in known]) if known else []):
                answers[i] = answer
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in answers], pa.string()),
                 pa.array([min(1.0, round(s, 6)) for _, s in answers], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = picked.select(
        F.col("id").cast("long").alias("doc_id"),
        is_held_out(F.col("id")).alias("held_out"),
        "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_query(spark, folder: str) -> DataFrame:
    """op11: all ``documents``; the network learns from those that are not held out."""
    docs = table(spark, folder, "documents")
    return identify(docs, fit(docs))
