"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text is a sparse vector: its words, word pairs and shapes of words, hashed to ``2**BITS`` places, each with weight
``sqrt(count)`` over the vector's length. The learner keeps FTRL-proximal sums per place; several learners, each on a
hashed share of the sample, run as Spark tasks, and their weights are averaged. Scores are sparse dot products.

The sample that it is fitted on has at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hashes of their
identifiers; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import words
from oddsloom.llm.tables import in_batches

BITS = 18
SAMPLE_ROWS = 16_000
#: A learner for each so many rows; passes over its rows, and updates that it makes at least.
ROWS_PER_LEARNER = 4_000
EPOCHS, UPDATES = 10, 20_000
ALPHA, BETA, L1, L2 = 2.0, 0.1, 1e-4, 1e-4
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _shapes(w: words.Words) -> np.ndarray:
    """What a word looks like: length class, case of its ends, digits and signs in it; with it, whether it repeats its forerunner."""
    d = w.data
    kind = np.zeros(256, np.int64)
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 3
    n = np.minimum(np.log2(np.maximum(w.ends - w.starts, 1)).astype(np.int64), 7)
    signs = np.add.reduceat((kind[d] == 0).astype(np.int64), w.starts) if len(w.starts) else np.zeros(0, np.int64)
    inside = signs - np.where(np.append(w.starts[1:], len(d)) > w.ends, _white_between(w), 0)
    return (((n * 4 + kind[d[w.starts]]) * 4 + kind[d[w.ends - 1]]) * 8 + np.clip(inside, 0, 7)).astype(np.uint64)


def _white_between(w: words.Words) -> np.ndarray:
    """White bytes from each word's end to the next word's start."""
    return np.append(w.starts[1:], len(w.data)) - w.ends


def features(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, place, value`` of all texts of a slice, sorted by row and place, one entry for each."""
    h, owner = w.hashes(), w.owner()
    same = owner[1:] == owner[:-1]
    pairs = words.mix(h[:-1] * np.uint64(3) + h[1:])[same] if len(h) else h
    shape = words.mix(_shapes(w) + np.uint64(0x5151))
    repeat = words.mix((h[1:] == h[:-1])[same].astype(np.uint64) + np.uint64(0x7272)) if len(h) else h
    row = np.concatenate([owner, owner[1:][same], owner, owner[1:][same]])
    place = (np.concatenate([h, pairs, shape, repeat]) >> np.uint64(64 - BITS)).astype(np.int64)
    keys = np.sort(row << BITS | place)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(first, append=len(keys))
    keys = keys[first]
    row, value = keys >> BITS, np.sqrt(counts)
    norm = np.sqrt(np.bincount(row, value * value, w.last - w.first))
    return row, keys & (1 << BITS) - 1, value / norm[row]


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the identifier's text is a multiple of 5. A null identifier has none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _learn(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the vectors in shuffled order; place ``2**BITS`` is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        s = z[at]
        return np.where(np.abs(s) <= L1, 0.0, -(s - np.sign(s) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(max(EPOCHS, -(-UPDATES // len(labels)))):
        for k in rng.permutation(len(labels)).tolist():
            at, x = vectors[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[k]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    every = weights(np.arange((1 << BITS) + 1))
    return every[:-1], float(every[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns ``labels.quality`` from the texts of ``docs``, of rows that are not ``held_out``.

    Null labels, and labels without a document, are left out; without any label all scores are 1/2. Rows that repeat a
    label count as often as they are there.
    """
    order = F.xxhash64("doc_id")
    sample = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").orderBy(order, "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, y = [], []
        for batch in batches:
            quality = batch.column(1).to_pylist()
            for w in words.scan(batch.column(0)):
                row, place, value = features(w)
                cut = np.searchsorted(row, np.arange(w.last - w.first + 1))
                for i in range(w.last - w.first):
                    a, b = cut[i], cut[i + 1]
                    vectors.append((np.append(place[a:b], 1 << BITS), np.append(value[a:b], 1.0)))
                    y.append(int(quality[w.first + i]))
        if y:
            w, bias = _learn(vectors, y, 1)
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"place": pa.array([used.astype("<i4").tobytes()], pa.binary()), "weight": pa.array([w[used].astype("<f4").tobytes()], pa.binary()), "bias": [bias], "rows": [len(y)]})

    learners = max(1, sample.count() // ROWS_PER_LEARNER)
    shares = chosen.repartition(learners, F.xxhash64(F.lit(5), "doc_id")).sortWithinPartitions(order, "doc_id", "text", "quality")
    fitted = in_batches(shares.select("text", F.col("quality").cast("int")), learn, "place binary, weight binary, bias double, rows long").collect()
    weights, bias, rows = np.zeros(1 << BITS), 0.0, sum(r["rows"] for r in fitted)
    for r in sorted(fitted, key=lambda r: (r["rows"], r["bias"])):
        weights[np.frombuffer(r["place"], "<i4")] += np.frombuffer(r["weight"], "<f4") * (r["rows"] / rows)
        bias += r["bias"] * r["rows"] / rows
    return Model(weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds ``name``, the chance of label 1, to ``docs``.

    Null and empty texts score by the bias alone. Repeated rows are scored each; other columns stay, one of this name
    is replaced. An empty table gives no rows.
    """
    # 2**BITS weights of four bytes: 1 MB, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != name]
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for w in words.scan(batch.column(at)):
                row, place, value = features(w)
                out[w.first : w.last] = m.bias + np.bincount(row, value * m.weights[place], w.last - w.first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=[*rest, name])

    return in_batches(docs.select(*rest), run, docs.select(*rest).schema.add(name, "double"))
