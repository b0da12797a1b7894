"""A quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

Words are runs of letters, of digits or of other signs; single words and pairs of neighbours are
hashed to a fixed number of features. A word that repeats the one some places before it counts as a
ditto mark of that distance, whatever word it is. A feature weighs by the logarithm of its count and the features
of a text have length one, so that long and short texts are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import as_bytes, forget_tables, prepared, row_hash, slices
from medialog.llm.hashing import PIECE, mixed, pieces, tokens

FEATURE_BITS = 18
# Distances at which a repeated word is marked.
DITTO = (1, 2, 3)
# Labelled rows that the model is fitted to, about; chosen by hash of the id.
TRAINING_ROWS = 16_000
# Learners over parts of these rows; their weights are averaged.
LEARNERS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.05

_KINDS = np.array([0 if chr(b).isspace() and b < 128 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_VALUES = np.arange(1, 257, dtype=np.uint64)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the features that occur and their weights."""
    parts, owner = pieces(texts)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[int] = []
    size = 0
    for k in range(len(parts) + 1):
        if k == len(parts) or group and size + len(parts[k]) > PIECE:
            _add([parts[g] for g in group], owner[group], found)
            group, size = [], 0
        if k < len(parts):
            group.append(k)
            size += len(parts[k]) + 1
    out = []
    for grams in found:
        index, count = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.empty(0, np.int32), np.empty(0, int))
        weight = np.log1p(count)
        out.append((index, (weight / max(1e-12, float(np.sqrt((weight**2).sum())))).astype(np.float32)))
    return out


def _add(texts: list[bytes], owner: np.ndarray, found: list[list[np.ndarray]]) -> None:
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    begins, hashes = tokens(data, _KINDS, _VALUES)
    cut = np.searchsorted(begins, bounds)
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) else hashes
    shift = np.uint64(64 - FEATURE_BITS)
    one, two = (hashes >> shift).astype(np.int32), (pairs >> shift).astype(np.int32)
    place = np.flatnonzero(_KINDS[data[begins]] == 1)
    words = hashes[place]
    for k, text in enumerate(owner.tolist()):
        a, b = int(cut[k]), int(cut[k + 1])
        if b > a:
            found[text] += [one[a:b], two[a : b - 1]]
            c, d = np.searchsorted(place, (a, b))
            for back in DITTO:
                again = int((words[c + back : d] == words[c : d - back]).sum()) if d - c > back else 0
                found[text].append(np.full(again, -back, np.int32) & ((1 << FEATURE_BITS) - 1))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after the per-coordinate updates over the rows in their order."""
    z, n = np.zeros(1 << FEATURE_BITS), np.zeros(1 << FEATURE_BITS)
    bias, bias_n = 0.0, 0.0

    def weights(index: np.ndarray) -> np.ndarray:
        at = z[index]
        return np.where(np.abs(at) <= L1, 0.0, -(at - np.sign(at) * L1) / ((BETA + np.sqrt(n[index])) / ALPHA + L2))

    # Both labels count alike in sum, whatever their shares.
    share = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    for _ in range(epochs):
        for (index, x), y in zip(rows, labels.tolist(), strict=True):
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            error = (p - y) * len(rows) / (2 * share[y])
            g = error * x
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - step * w
            n[index] += g * g
            bias_n += error * error
            bias -= error * 0.1 / np.sqrt(1 + bias_n)
    return weights(np.arange(1 << FEATURE_BITS)), bias


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(self.weights[i] @ x + self.bias, -30, 30)))) for i, x in features(texts)]


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS
) -> Model:
    """Learn from the texts of labelled documents.

    About ``rows`` labels are used, chosen by hash of the id; they are few enough to be sent to all
    tasks, so no text moves but those. Labels other than 0 and 1 and null ids are left out; a
    document labelled twice counts twice. Without labels every text scores 0.5.
    """
    prepared(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    span = 1 << 30
    limit = int(min(1.0, rows / max(1, known.count())) * span)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(span)) <= limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = features(as_bytes(batch.column("text")))
            index = pa.array([i.tolist() for i, _ in found], pa.list_(pa.int32()))
            weight = pa.array([x.tolist() for _, x in found], pa.list_(pa.float32()))
            yield pa.record_batch([batch.column("part"), batch.column("place"), batch.column("label"), index, weight], ["part", "place", "label", "features", "x"])

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "label"])
        weights, bias = follow_the_leader(list(zip(frame["features"], frame["x"], strict=True)), frame["label"].to_numpy())
        used = np.flatnonzero(weights)
        return pd.DataFrame({"part": [key[0]], "bias": [bias], "feature": [used.astype(np.int32)], "weight": [weights[used]]})

    place = F.xxhash64("id", F.lit("place"))
    training = texts.join(F.broadcast(chosen), "id").select(F.pmod(place, F.lit(LEARNERS)).cast("int").alias("part"), place.alias("place"), "label", "text")
    parts = (
        training.mapInArrow(extract, "part int, place long, label int, features array<int>, x array<float>")
        .groupBy("part")
        .applyInPandas(learn, "part int, bias double, feature array<int>, weight array<double>")
        .orderBy("part")
        .collect()
    )
    weights, bias = np.zeros(1 << FEATURE_BITS), 0.0
    for p in parts:
        weights[p["feature"]] += np.array(p["weight"]) / len(parts)
        bias += p["bias"] / len(parts)
    return Model(weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row`` (hash of the text), ``score`` from 0 to 1.

    The whole text alone decides. Null and empty texts have no features and get the score of the
    bias. Repeated rows and null ids are rows like others; an empty table gives none.
    """
    prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in slices(batches, "text"):
            scores = pa.array(shared.value.score(as_bytes(batch.column("text"))), pa.float64())
            yield pa.record_batch([batch.column("id"), batch.column("row"), scores], ["id", "row", "score"])

    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, row long, score double")
