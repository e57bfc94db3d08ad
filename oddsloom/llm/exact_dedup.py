"""Exact dedup by merging sorted runs of digests in rounds.

A partition's digests, sorted and each once with its smallest identifier, are a run. Runs have numbers of ``FAN``-ary
digits, and the rounds are those of a binomial exchange: in round r the ``FAN`` runs whose numbers differ in digit r
alone cut themselves at that digit of their digests and send each piece to the one whose number has it. What a run gets
is sorted, so it merges ``FAN`` sorted runs, and again only the smallest identifier and the number of rows of a digest
go on. After the last round a run holds all there is of its range of digests, and no run ever holds more than its
share: there are as many digits as keep a share at about ``SHARE`` rows. A text that a third of all rows share is one
entry a run in every round.

Runs move as packed arrays, never texts. Equality is verified at each merge by three values together: SHA-256, length
and an unrelated 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.tables import hot_join, in_batches, written

#: Runs that are merged at once, the bits of a digit, digits at least, and rows of a run after the last round.
FAN, BITS, LEAST_ROUNDS, SHARE = 16, 4, 2, 1 << 19
KEY = ["text_sha256", "n", "h"]
#: One entry of a run: digest, length and hash; the smallest identifier (none is the largest) with its row; rows.
ENTRY = np.dtype([("sha", ">u8", 4), ("n", "<i8"), ("h", "<i8"), ("none", "<i8"), ("id", "<i8"), ("rid", "<i8"), ("rows", "<i8")])


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digests(text: Column) -> dict[str, Column]:
    t = normalised(text)
    return {"text_sha256": F.sha2(t, 256), "n": F.length(t), "h": F.xxhash64(t)}


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs as one, each digest once with its smallest identifier and all its rows."""
    every = np.concatenate(runs).astype(ENTRY, copy=False)
    if not len(every):
        return every
    sha = every["sha"].astype(np.uint64)
    # The sort finds the runs that are there and merges them. Digests that differ after eight bytes are sorted by all.
    order = np.argsort(sha[:, 0], kind="stable")
    keys = np.column_stack([sha, every["n"].view(np.uint64), every["h"].view(np.uint64)])
    same = lambda order: (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    equal = same(order)
    if (~equal & (sha[order[1:], 0] == sha[order[:-1], 0])).any():
        order = np.lexsort(keys.T[::-1])
        equal = same(order)
    group = np.append(0, np.cumsum(~equal))
    every = every[order]
    best = every[np.lexsort((every["rid"], every["id"], every["none"], group))]
    first = np.flatnonzero(np.append(True, ~equal))
    out = best[first]
    out["rows"] = np.add.reduceat(every["rows"], first)
    return out


def _pieces(run: np.ndarray, number: int, place: int, rounds: int) -> Iterator[tuple[int, np.ndarray]]:
    """A run cut at digit ``place`` of its digests, each piece with the number of the run it goes to."""
    digit = (run["sha"][:, 0].astype(np.uint64) >> np.uint64(64 - BITS * (place + 1))) & np.uint64(FAN - 1)
    weight = FAN ** (rounds - 1 - place)
    rest = number - number // weight % FAN * weight
    cuts = np.searchsorted(digit, np.arange(FAN + 1))
    for d in range(FAN):
        if cuts[d] < cuts[d + 1]:
            yield rest + d * weight, run[cuts[d] : cuts[d + 1]]


def _sent(pieces: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    to, parts = [], []
    for number, part in pieces:
        to.append(number)
        parts.append(part.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(parts, pa.binary())], ["run", "part"])


def _first_runs(rows: DataFrame, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def out() -> pa.RecordBatch:
            return _sent(_pieces(merged(held), number % FAN**rounds, 0, rounds))

        for batch in batches:
            e = np.zeros(batch.num_rows, ENTRY)
            e["sha"] = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), ">u8").reshape(-1, 4)
            ids, whole = batch.column(3), lambda c: c.to_numpy(zero_copy_only=False)
            e["n"], e["h"], e["none"], e["id"], e["rid"], e["rows"] = whole(batch.column(1)), whole(batch.column(2)), whole(ids.is_null()), whole(ids.fill_null(0)), whole(batch.column(4)), 1
            number = batch.column(5)[0].as_py() if batch.num_rows else number
            held.append(e)
            size += len(e)
            if size >= SHARE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return in_batches(rows.select(*KEY, "doc_id", "rid", "part"), run, "run long, part binary")


def _round(runs: DataFrame, place: int, rounds: int) -> DataFrame:
    """Merges what each run has got, and cuts it for round ``place``."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), ENTRY) for b in table.column("part")]
        return pa.Table.from_batches([_sent(_pieces(merged(parts), table.column("run")[0].as_py(), place, rounds))])

    return runs.groupBy("run").applyInArrow(run, "run long, part binary")


def _answers(runs: DataFrame) -> DataFrame:
    """Merges what each run has got in the last round: a row for each digest."""

    def run(table: pa.Table) -> pa.Table:
        e = merged([np.frombuffer(b.as_py(), ENTRY) for b in table.column("part")])
        sha = np.ascontiguousarray(e["sha"]).tobytes().hex()
        ids = pa.array(e["id"], pa.int64(), mask=e["none"] > 0)
        return pa.table({"text_sha256": [sha[k : k + 64] for k in range(0, len(sha), 64)], "n": e["n"].astype(np.int32), "h": e["h"].astype(np.int64), "keep_id": ids, "keep_rid": e["rid"].astype(np.int64), "group_size": e["rows"].astype(np.int64)})

    return runs.groupBy("run").applyInArrow(run, "text_sha256 string, n int, h long, keep_id long, keep_rid long, group_size long")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null and empty texts are equal to each other. Of rows that repeat an identifier and its text one is kept. A null
    identifier counts as larger than any other; identifiers are whole numbers. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).select("doc_id", F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("part"), *[c.alias(k) for k, c in _digests(F.col("t")).items()])
    rows = written(rows, "digests")
    rounds, total = LEAST_ROUNDS, rows.count()
    while FAN**rounds * SHARE < total:
        rounds += 1
    runs = _first_runs(rows, rounds)
    for place in range(1, rounds):
        runs = _round(runs, place, rounds)
    answers = written(_answers(runs), "digest-answers")
    return hot_join(rows, answers, KEY, "group_size").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (names that begin with ``__dedup`` are taken)."""
    rows = docs.withColumn("__dedup_sha", F.sha2(normalised(F.col("text")), 256))
    kept = assign(docs).filter("kept").select(F.col("doc_id").alias("__dedup_id"), F.col("text_sha256").alias("__dedup_kept"))
    rows = rows.join(kept, (F.col("__dedup_sha") == F.col("__dedup_kept")) & F.col("doc_id").eqNullSafe(F.col("__dedup_id")), "left_semi")
    same = Window.partitionBy("__dedup_sha", "doc_id").orderBy("__dedup_sha")
    return rows.withColumn("__dedup_n", F.row_number().over(same)).filter("__dedup_n = 1").select(*docs.columns)
