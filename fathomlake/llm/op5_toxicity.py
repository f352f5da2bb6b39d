"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window by window.

Training takes a bounded sample of the labelled training rows, PER_CLASS of each label in an order by hash. Where their
texts have more than MAX_CHARS characters, all stay and the longest are cut to one bound for each text, the largest that
fits: PIECES pieces of equal length, spread evenly over the text. So no text ends or empties the sample.
Three of four sampled documents train the dictionaries, with zstandard's own trainer; every fourth is kept for the
calibration. The ordinary dictionary is trained on windows of ordinary text, BASE_WINDOWS of them at most (every n-th,
over all sampled texts): all of them for the base that both dictionaries share, and every ORDINARY-th for its own part.
The toxic one is trained on stretches of toxic text: those covered by strings of six bytes that are ODDS times as common
in the toxic documents, and in a hundredth of them or more. Trained on whole windows instead it holds the syllables that
all text has, and tells the labels apart far worse (figures in the README).
A window of 64 bytes is compressed with each; the bytes saved by the toxic one, over a document's windows, are
calibrated to a probability by a logistic fit on the documents kept for that.

Cases: null and empty texts have no windows and get the score of zero savings; a text shorter than a window is one; rows
with a null label or without a label are scored, not learned from; where a label has fewer than LEAST sampled texts every
score is 0 and nothing is predicted toxic, with a warning if the label has rows in the table of labels; a null doc_id is
not held out and has no label; repeated rows get the same score; ties in the order by hash are broken by the text; all windows
of a very long text are scored; an empty table gives an empty one; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, release, written

#: The bounds of the sample: rows of each label, and characters of text over all rows of a label.
PER_CLASS, MAX_CHARS = 2000, 12_000_000
#: Pieces that are taken of a text longer than the bound for each text.
PIECES = 16
#: Sampled texts of each label that a model needs, and windows of ordinary text that dictionaries are trained on.
LEAST, BASE_WINDOWS, ORDINARY = 8, 20_000, 3
#: Every so many-th sampled text is kept for the calibration.
KEPT = 4
FOLDS, HELD = 4, 2
GRAM, SUPPORT, ODDS = 6, 0.01, 100
DICT_BYTES, BASE_BYTES, LEVEL, WINDOW, STEP, CUT = 1024, 8192, 5, 64, 32, 0.3
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _windows(b: bytes) -> list[bytes]:
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - STEP), STEP)] if b else []


def _grams(b: bytes) -> set[bytes]:
    return {b[i : i + GRAM] for i in range(len(b) - GRAM + 1)}


def _stretches(b: bytes, marked: set[bytes]) -> list[bytes]:
    """Maximal stretches of a text that marked strings cover."""
    out, start, end = [], -1, -1
    for i in range(len(b) - GRAM + 1):
        if b[i : i + GRAM] in marked:
            if i > end:
                if start >= 0:
                    out.append(b[start:end])
                start = i
            end = i + GRAM
    return [*out, b[start:end]] if start >= 0 else out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(toxic: list[str], ordinary: list[str]) -> dict | None:
    """The two dictionaries and the calibration, or None if a label has too few texts."""
    if min(len(toxic), len(ordinary)) < LEAST:
        return None
    every = [[x.encode().translate(_LOWER) for x in texts] for texts in (toxic, ordinary)]
    toxic_b, ordinary_b = ([x for i, x in enumerate(texts) if i % KEPT] for texts in every)
    kept = [x[::KEPT] for x in every]
    held: list[Counter] = []
    for texts in (toxic_b, ordinary_b):
        held.append(Counter())
        for b in texts:
            held[-1].update(_grams(b))
    n, m = len(toxic_b), len(ordinary_b)
    marked = {g for g, c in held[0].items() if c >= max(3, SUPPORT * n) and (c + 0.5) / (n + 1) > ODDS * (held[1].get(g, 0) + 0.5) / (m + 1)}
    common = [w for b in ordinary_b for w in _windows(b)]
    common = common[:: max(1, len(common) // BASE_WINDOWS)]
    base = _dictionary(common, BASE_BYTES)
    model = {"toxic": base + _dictionary([x for b in toxic_b for x in _stretches(b, marked)], DICT_BYTES), "ordinary": base + _dictionary(common[::ORDINARY], DICT_BYTES)}
    measure = _measure(model)
    x = np.array([measure(b) for b in kept[0] + kept[1]])
    return model | {"weights": _logistic(x, np.repeat([1.0, 0.0], [len(kept[0]), len(kept[1])]))}


def _measure(model: dict) -> Callable[[bytes], list[float]]:
    """A document's features: of the bytes that the toxic dictionary saves in a window, the most, the mean of the four
    largest, and the share of windows with savings of four or more."""
    packers = [
        zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress
        for k in ("toxic", "ordinary")
    ]

    def measure(b: bytes) -> list[float]:
        saved = np.sort(np.fromiter((len(packers[1](w)) - len(packers[0](w)) for w in _windows(b)), np.float64))[::-1]
        if not len(saved):
            return [0.0] * 4
        return [min(saved[0], 15) / 4, np.minimum(saved[:4], 15).mean() / 4, 10 * float((saved >= 4).mean()), float((saved >= 4).sum()) ** 0.5]

    return measure


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's steps; the labels' shares are those of the sample."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scorer(model: dict | None) -> Callable[[pa.Array], np.ndarray]:
    measure = _measure(model) if model else None

    def score(texts: pa.Array) -> np.ndarray:
        if not measure:
            return np.zeros(len(texts))
        x = np.array([[*measure((t or b"").translate(_LOWER)), 1.0] for t in texts.cast(pa.large_binary()).to_pylist()]).reshape(-1, len(model["weights"]))
        return 1 / (1 + np.exp(-np.clip(x @ model["weights"], -30, 30)))

    return score


def _score(model: dict | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            s = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def bound_each(lengths: list[int], max_chars: int) -> int:
    """The largest bound for each text, 1 at least, with which texts of these lengths have max_chars characters or fewer."""
    left = max_chars
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return max(1, left // (len(lengths) - k))
        left -= n
    return max(lengths, default=1)


def pieces(text: Column, bound: int) -> Column:
    """A text of up to bound characters as it is, a longer one as pieces of bound characters together, in its order."""
    k = min(PIECES, bound)
    size = bound // k
    starts = [F.floor((F.length(text) - size) * i / max(1, k - 1)) + 1 for i in range(k)]
    return F.when(F.length(text) <= bound, text).otherwise(F.concat(*[F.substring(text, s.cast("int"), F.lit(size)) for s in starts]))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Texts of up to per_class training rows of each label, and how many training rows each label has."""
    training = labels.where((fold(F.col("doc_id")) != HELD) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = {}
    for toxic in counts:
        # The ids with the least hashes, at most per_class rows; their texts come to the driver, max_chars at most together.
        chosen = training.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(per_class)
        rows = written(rows, "sample").orderBy(F.xxhash64("doc_id"), "text")
        bound = bound_each([r["n"] for r in rows.select(F.length("text").alias("n")).collect()], max_chars)
        texts[toxic] = [r["text"] for r in rows.select(pieces(F.col("text"), bound).alias("text")).toLocalIterator()]
        if len(texts[toxic]) < LEAST:
            warnings.warn(f"toxicity: label {toxic} has {counts[toxic]} training rows and {len(texts[toxic])} documents with a text, under {LEAST}, so every score is 0", stacklevel=2)
    return texts, counts


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """The model of a sample, with the constant moved from the sample's shares of the labels to all training rows'."""
    texts, counts = sample(docs, labels, per_class)
    model = train(texts.get(1, []), texts.get(0, []))
    if model:
        shift = np.log(counts[1] / counts[0]) - np.log(len(texts[1]) / len(texts[0]))
        model["weights"] = model["weights"] + np.append(np.zeros(len(model["weights"]) - 1), shift)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.3)."""
    model = fitted(docs, labels, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(model), RESULT)


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns; each text is scored where it is read. Only
    texts go to the scoring and only decisions come back, so that a task never holds the rows twice."""
    model = fitted(docs, labels, per_class)

    def keep(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _scorer(model)
        for some in texts:
            yield pa.array(score(some) < CUT)
            release()

    return docs.where(F.arrow_udf(keep, "boolean")(F.col("text")))
