"""Cosine similarity of vectors: joins over a threshold, best pairs, counts of all.

The join is a metric one. The angle between vectors obeys the triangle inequality, so what lies far from what is known
from angles to a few pivots: vectors go to the cell of their nearest pivot, and a vector visits another cell only if

* its angle to that cell's pivot is within the threshold's angle of the range of angles in the cell, and
* the plane halfway between the two pivots is not farther than the threshold's angle.

In a cell, vectors are sorted by their angle to the pivot, and visitors meet only those in reach. What is skipped
cannot be a pair, so results are whole; how much is skipped depends on the data: much where vectors form clusters,
nothing where all are nearly orthogonal and the threshold is low. Cells are dealt into tiles of a bounded number of
values, and a tile's visitors into slices, so no category or cell is ever held by one task. Small cells share a tile,
and a vector is sent once to a tile, however many of its cells it visits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a tile of vectors; a slice has as many visitors as ``VISITORS`` tiles. Products that are held at once.
VALUES, VISITORS, PRODUCTS = 1 << 20, 8, 1 << 22
#: Steps of a similarity of six digits from 0 to 1; products that are counted, and pairs that leave a task, at once.
DIGITS, COUNTED, SENT = 10**6, 1 << 20, 1 << 17
#: Vectors for one pivot; pivots of a category, and of all: the largest categories have theirs first.
CELL, PIVOTS, ALL_PIVOTS = 256, 512, 8192
#: Vectors of the join that finds a threshold for the best pairs.
PROBED = 20_000
#: Angles from rounded cosines are taken as this much wider.
SLACK = 1e-6


@dataclass
class Cells:
    """What every task knows: of each category with several cells its pivots, and of each cell its size and range of angles to its pivot."""

    pivots: dict
    sizes: dict
    low: dict
    high: dict


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    vec = flat.reshape(rows, -1).astype(np.float64)
    size = np.linalg.norm(vec, axis=1)
    return vec / np.where(size > 0, size, 1.0)[:, None]


def _vectors(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False), len(column))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _by_category(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy()
    for k, name in enumerate(coded.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == k)


def _homes(vec: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector and its angle to the cell's pivot; 0 and 0 in a category of one cell."""
    if pivots is None:
        return np.zeros(len(vec), np.int64), np.zeros(len(vec))
    cosine = vec @ pivots.T
    cell = cosine.argmax(axis=1)
    return cell, _angle(cosine[np.arange(len(vec)), cell])


def choose_pivots(vectors: DataFrame) -> dict:
    """Pivots of the largest categories with more than one cell: vectors with the smallest hashes of their identifiers; at most ``ALL_PIVOTS``."""
    counts = vectors.groupBy("category").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
    counts = counts.withColumn("k", F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS))).orderBy(F.desc("n"), "category").limit(ALL_PIVOTS // 2)
    taken, asked = 0, []
    for r in counts.collect():
        if taken + r.k > ALL_PIVOTS:
            break
        taken += r.k
        # About four times as many as are wanted have hashes of this remainder: a task sends few, whatever it holds.
        asked.append((r.category, r.k, max(1, r.n // (4 * r.k))))
    if not asked:
        return {}
    wanted = vectors.sparkSession.createDataFrame(asked, f"category {vectors.schema['category'].dataType.simpleString()}, k long, every long")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.xxhash64("id"), "id"))
    picked = vectors.join(F.broadcast(wanted), "category").filter(F.pmod(F.xxhash64("id"), F.col("every")) == 0)
    picked = picked.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).filter("rank <= k")
    found: dict = {}
    for r in picked.select("category", "vec").collect():
        found.setdefault(r.category, []).append(r.vec)
    return {c: np.unique(_unit(np.array(v, np.float64).ravel(), len(v)), axis=0) for c, v in found.items()}


def measured_cells(vectors: DataFrame, pivots: dict) -> Cells:
    """One pass that finds how many vectors each cell has, and between which angles."""
    if not pivots:
        return Cells({}, {}, {}, {})
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, high = ({c: np.full(len(p), v) for c, p in shared.value.items()} for v in (0, np.inf, -np.inf))
        for batch in batches:
            vec = _vectors(batch.column(1))
            for name, rows in _by_category(batch.column(0)):
                if name in shared.value:
                    cell, angle = _homes(vec[rows], shared.value[name])
                    size[name] += np.bincount(cell, minlength=len(size[name]))
                    np.minimum.at(low[name], cell, angle)
                    np.maximum.at(high[name], cell, angle)
        for name, n in size.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), kind), pa.array(at), pa.array(n[at]), pa.array(low[name][at]), pa.array(high[name][at])], ["category", "cell", "n", "low", "high"])

    kind = pa.string() if vectors.schema["category"].dataType.simpleString() == "string" else pa.int64()
    category = "string" if kind == pa.string() else "long"
    sent = vectors.select(F.col("category").cast(category).alias("category"), "vec").mapInArrow(run, f"category {category}, cell long, n long, low double, high double")
    cells = Cells(pivots, *({c: np.full(len(p), v) for c, p in pivots.items()} for v in (0, np.inf, -np.inf)))
    for r in sent.groupBy("category", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        cells.sizes[r.category][r.cell], cells.low[r.category][r.cell], cells.high[r.category][r.cell] = r.n, r.low, r.high
    return cells


def _bundles(size: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each cell and the tiles of each bundle: cells of at most ``tile`` vectors together, or one larger cell."""
    bundle, tiles, held = np.zeros(len(size), np.int64), [], 0
    for k, n in enumerate(size.tolist()):
        if not tiles or held + n > tile:
            tiles.append(max(1, -(-n // tile)))
            held = 0
        bundle[k] = len(tiles) - 1
        held += n
    return bundle, np.array(tiles)


def _visits(vec: np.ndarray, cell: np.ndarray, pivots: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell, angle`` of the visits that vectors pay to those of the cells ``to`` that are not theirs; of two cells the smaller one's vectors visit."""
    cosine = vec @ pivots[to].T
    angle = _angle(cosine)
    order = np.lexsort((np.arange(len(size)), size))
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    goes = (rank[to][None, :] > rank[cell][:, None]) & (size[to] > 0) & (angle >= low[to] - reach) & (angle <= high[to] + reach)
    if reach < np.pi / 2:
        own = (vec * pivots[cell]).sum(axis=1)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots[to].T))[cell]
        close = apart < 1e-3  # too close for their difference to have a direction
        goes &= close | ((own[:, None] - cosine) / np.where(close, 1.0, apart) <= np.sin(reach) + SLACK)
    row, at = np.nonzero(goes)
    return row, to[at], angle[row, at]


def _dealt(vectors: DataFrame, shared: Broadcast, reach: float, tile: int) -> DataFrame:
    """Rows for each tile: its own vectors, once for each slice of visitors, and visitors: ``category, bundle, tile, slice, own, cell`` (theirs) and the columns of ``vectors``."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    counts = vectors.groupBy("category").agg(F.count("*").alias("n"))
    kept = [c for c in vectors.columns if c != "category"]
    rows = vectors.join(counts, "category").select(F.col("category").cast("string").alias("name"), "category", "n", F.xxhash64("id", F.lit(1)).alias("h"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, named = shared.value
        for batch in batches:
            vec, hashes, n = _vectors(batch.column(4 + kept.index("vec"))), batch.column(3).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            for name, at in ((name, rows[k : k + 2048]) for name, rows in _by_category(batch.column(0)) for k in range(0, len(rows), 2048)):
                known = named.get(name)
                pivots = cells.pivots.get(known) if known is not None else None
                own, _ = _homes(vec[at], pivots)
                size = cells.sizes[known].astype(np.int64) if pivots is not None else n[at][:1]
                bundle, tiles = _bundles(size, tile)
                home = bundle[own]
                slices = np.uint64(max(1, -(-int(n[at][0]) // (VISITORS * tile))))
                mine = (hashes[at] % tiles[home].astype(np.uint64)).astype(np.int64)
                my_slice = (hashes[at] // np.uint64(1 << 20) % slices).astype(np.int64)
                # Residents in each slice, visitors of the tiles after theirs in their own cell, and of the tiles with cells that they visit.
                parts = [(np.repeat(np.arange(len(at)), int(slices)), np.repeat(home, int(slices)), np.repeat(mine, int(slices)), np.tile(np.arange(int(slices)), len(at)), True)]
                after = tiles[home] - 1 - mine
                row = np.repeat(np.arange(len(at)), after)
                later = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + 1 + mine[row]
                parts.append((row, home[row], later, my_slice[row], False))
                if pivots is not None:
                    row, to, _ = _visits(vec[at], own, pivots, size, cells.low[known], cells.high[known], reach, np.arange(len(size)))
                    row, to = np.divmod(np.unique(row * len(tiles) + bundle[to]), len(tiles))
                    many = tiles[to]
                    of = np.repeat(np.arange(len(row)), many)
                    parts.append((row[of], to[of], np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), my_slice[row[of]], False))
                for row, to, place, part, resident in parts:
                    for k in range(0, len(row), 2000):
                        cut = slice(k, k + 2000)
                        rows = pa.array(at[row[cut]])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(1).take(rows), pa.array(to[cut].astype(np.int64)), pa.array(place[cut].astype(np.int64)), pa.array(part[cut].astype(np.int64)), pa.array(np.full(len(rows), resident)), pa.array(own[row[cut]].astype(np.int64)), *(batch.column(4 + c).take(rows) for c in range(len(kept)))],
                            ["category", "bundle", "tile", "slice", "own", "cell", *kept],
                        )

    schema = f"category {kind['category']}, bundle long, tile long, slice long, own boolean, cell long, " + ", ".join(f"{c} {kind[c]}" for c in kept)
    return rows.mapInArrow(run, schema)


def _met(table: pa.Table, cells: Cells, named: dict, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the pairs of a tile that are in reach: rows, other rows, and the cosines of all of them; each pair once."""
    column = lambda c: table.column(c).combine_chunks()
    own, cell = column("own").to_numpy(zero_copy_only=False), column("cell").to_numpy()
    home, away = (np.flatnonzero(x) for x in (own, ~own))
    known = named.get(str(table.column("category")[0].as_py()))
    pivots = cells.pivots.get(known) if known is not None else None
    # Visitors are many, so only those of a step are held as unit vectors.
    raw = column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
    width = max(1, raw.shape[1])
    residents = []
    for c in np.unique(cell[home]):
        rows = home[cell[home] == c]
        vec = _unit(raw[rows], len(rows))
        angle = _angle(vec @ pivots[c]) if pivots is not None else np.zeros(len(rows))
        order = np.argsort(angle, kind="stable")
        residents.append((c, rows[order], vec[order], angle[order]))
    if not table.column("slice")[0].as_py():
        for _, rows, vec, angle in residents:
            step = max(1, PRODUCTS // len(rows))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                hi = np.searchsorted(angle, angle[k : k + step][-1] + reach, side="right")
                others = rows[k + 1 : hi]
                if len(others):
                    products = vec[k : k + step] @ vec[k + 1 : hi].T
                    # each row with those after it
                    products[np.arange(len(others))[None, :] < np.arange(len(some))[:, None]] = np.nan
                    yield some, others, products
    in_tile = np.array([c for c, *_ in residents])
    held = max(1, VALUES // width)
    for start in range(0, len(away) if residents else 0, held):
        rows = away[start : start + held]
        unit = _unit(raw[rows], len(rows))
        # Visitors of a cell's own vectors are of its tiles before this one; a tile of several cells has none.
        row, to, angle = [np.flatnonzero(cell[rows] == in_tile[0])] if len(in_tile) == 1 else [np.zeros(0, np.int64)], [], []
        to.append(np.full(len(row[0]), in_tile[0]))
        angle.append(_angle(unit[row[0]] @ pivots[in_tile[0]]) if pivots is not None else np.zeros(len(row[0])))
        if pivots is not None:
            visits = _visits(unit, cell[rows], pivots, cells.sizes[known].astype(np.int64), cells.low[known], cells.high[known], reach, in_tile)
            row, to, angle = ([x, y] for (x,), y in zip((row, to, angle), visits))
        row, to, angle = map(np.concatenate, (row, to, angle))
        for c, others, vec, theirs in residents:
            at = np.flatnonzero(to == c)
            at = at[np.argsort(angle[at], kind="stable")]
            step = max(1, PRODUCTS // len(others))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                lo, hi = np.searchsorted(theirs, angle[part[0]] - reach), np.searchsorted(theirs, angle[part[-1]] + reach, side="right")
                if lo < hi:
                    yield rows[row[part]], others[lo:hi], unit[row[part]] @ vec[lo:hi].T


def _angle_of(least: float) -> float:
    """Pairs of a cosine of ``least`` or more are at most this far apart; vectors of length zero are none of a threshold of 0 or more."""
    return float(np.pi if least < 0 else _angle(np.array([least]))[0] + SLACK)


def _tile_of(vectors: DataFrame) -> int:
    width = vectors.agg(F.max(F.size("vec")).alias("d")).first().d or 1
    return max(64, VALUES // width)


def _joined(vectors: DataFrame, least: float, keep: Callable, schema: str) -> DataFrame:
    """The tables ``keep(table, blocks)`` of every tile with its visitors; ``blocks`` as ``_met`` gives them."""
    rows = vectors.filter("category IS NOT NULL AND platform IS NOT NULL")
    if least >= 0:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    reach = _angle_of(least)
    cells = measured_cells(rows, choose_pivots(rows) if reach < np.pi else {})
    shared = vectors.sparkSession.sparkContext.broadcast((cells, {str(c): c for c in cells.pivots}))
    dealt = _dealt(rows, shared, reach, _tile_of(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for found in keep(table, _met(table, *shared.value, reach)):
            yield from found.combine_chunks().to_batches()

    return dealt.groupBy("category", "bundle", "tile", "slice").applyInArrow(run, schema)


def _pair_schema(vectors: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    more = "".join(f", {p}more {kind['more']}" for p in ("", "b_")) if "more" in kind else ""
    return f"id {kind['id']}, b_id {kind['id']}, category {kind['category']}, similarity double{more}"


def _pairs(table: pa.Table, i: np.ndarray, j: np.ndarray, similarity: np.ndarray) -> pa.Table:
    ids = table.column("id").combine_chunks()
    first = pa.compute.less(ids.take(pa.array(i)), ids.take(pa.array(j))).to_numpy(zero_copy_only=False)
    a, b = pa.array(np.where(first, i, j)), pa.array(np.where(first, j, i))
    more = table.column("more").combine_chunks() if "more" in table.column_names else None
    return pa.table({
        "id": ids.take(a),
        "b_id": ids.take(b),
        "category": table.column("category").combine_chunks().take(pa.array(np.zeros(len(i), np.int64))),
        "similarity": pa.array(similarity, pa.float64()),
        **({} if more is None else {"more": more.take(a), "b_more": more.take(b)}),
    })


def _platforms(table: pa.Table) -> np.ndarray:
    return table.column("platform").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """Pairs of one category and different platforms by cosine similarity over ``least``: ``id, b_id, category, similarity``, ``id < b_id``.

    ``vectors``: ``id, category, platform, vec``; vectors are of one length and complete. A vector of length zero has the
    similarity 0 to all. Rows without a category or platform meet nobody. Only pairs over ``least`` leave a task, a block
    at a time. What is needed of both to go on with a pair may be in a column ``more`` of ``vectors``, a struct; pairs have
    it as ``more`` and ``b_more``, so that they need not be joined with anything.
    """

    def keep(table: pa.Table, blocks: Iterator) -> Iterator[pa.Table]:
        platform = _platforms(table)
        for some, others, products in blocks:
            i, j = np.nonzero((products > least) & (platform[some][:, None] != platform[others][None, :]))
            for k in range(0, len(i), SENT):
                x, y = i[k : k + SENT], j[k : k + SENT]
                yield _pairs(table, some[x], others[y], products[x, y])

    return _joined(vectors.select("id", "category", "platform", "vec", *(c for c in vectors.columns if c == "more")), least, keep, _pair_schema(vectors))


def cosine_top(vectors: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar pairs, similarities of six digits, ties by identifiers.

    A first join over about ``PROBED`` vectors finds ``n`` pairs, whose least similarity is the threshold of the join over
    all; where it finds fewer, all pairs are compared. A tile sends its own best.
    """
    every = max(1, vectors.count() // PROBED)
    probe = _best(vectors.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(every)) == 0), n, -2.0).collect()
    least = min(r.similarity for r in probe) - 1e-5 if len(probe) == n else -2.0
    return _best(vectors, n, least)


def _best(vectors: DataFrame, n: int, least: float) -> DataFrame:
    vectors = vectors.select("id", "category", "platform", "vec")

    def keep(table: pa.Table, blocks: Iterator) -> Iterator[pa.Table]:
        platform = _platforms(table)
        best = _pairs(table, *(np.zeros(0, np.int64),) * 2, np.zeros(0))
        for some, others, products in blocks:
            i, j = np.nonzero((products > least) & (platform[some][:, None] != platform[others][None, :]))
            both = pa.concat_tables([best, _pairs(table, some[i], others[j], np.round(products[i, j], 6))]).combine_chunks()
            order = pa.compute.sort_indices(both, sort_keys=[("similarity", "descending"), ("id", "ascending"), ("b_id", "ascending")])
            best = both.take(order[:n])
        yield best

    return _joined(vectors, least, keep, _pair_schema(vectors)).orderBy(F.desc("similarity"), "id", "b_id").limit(n)


def cosine_counts(vectors: DataFrame) -> DataFrame:
    """``similarity`` of six digits and ``n`` pairs that have it: at most two million rows, whatever the number of pairs."""

    def keep(table: pa.Table, blocks: Iterator) -> Iterator[pa.Table]:
        platform = _platforms(table)
        counts = np.zeros(2 * DIGITS + 3, np.int64)
        for some, others, products in blocks:
            step = max(1, COUNTED // len(others))
            for k in range(0, len(some), step):
                part = products[k : k + step]
                met = part[(platform[some[k : k + step]][:, None] != platform[others][None, :]) & ~np.isnan(part)]
                counts += np.bincount(np.rint(met * DIGITS).astype(np.int64) + DIGITS + 1, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.table({"similarity": pa.array((at - DIGITS - 1) / DIGITS, pa.float64()), "n": pa.array(counts[at], pa.int64())})

    return _joined(vectors.select("id", "category", "platform", "vec"), -2.0, keep, "similarity double, n long").groupBy("similarity").agg(F.sum("n").alias("n"))


def compared(vectors: DataFrame, least: float) -> DataFrame:
    """What a join over ``least`` does, one row a category: ``vectors, pairs, compared, copies`` (rows dealt for each vector)."""

    def keep(table: pa.Table, blocks: Iterator) -> Iterator[pa.Table]:
        met = sum(int((~np.isnan(products)).sum()) for _, _, products in blocks)
        yield pa.table({"category": table.column("category").slice(0, 1).combine_chunks(), "n": pa.array([met], pa.int64()), "dealt": pa.array([table.num_rows], pa.int64())})

    kind = vectors.schema["category"].dataType.simpleString()
    met = _joined(vectors.select("id", "category", "platform", "vec"), least, keep, f"category {kind}, n long, dealt long").groupBy("category").agg(F.sum("n").alias("compared"), F.sum("dealt").alias("dealt"))
    n = vectors.filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("vectors"))
    pairs = (F.col("vectors") * (F.col("vectors") - 1) / 2).cast("long")
    return n.join(met, "category", "left").select("category", "vectors", pairs.alias("pairs"), F.coalesce("compared", F.lit(0)).alias("compared"), (F.coalesce("dealt", F.lit(0)) / F.col("vectors")).alias("copies"))


def similarity_stats(counts: DataFrame) -> DataFrame:
    """Smallest, mean, largest and upper median similarity of counted pairs (``similarity, n``).

    The upper median is the smallest value that half of all, rounded down, and one more reach.
    """
    line = Window.orderBy("similarity").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(line)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
        F.min("similarity").alias("lo"),
        F.round(F.sum(F.col("similarity") * F.col("n")) / F.sum("n"), 4).alias("mean"),
        F.max("similarity").alias("hi"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("similarity"))).alias("median"),
    )


def similarity_histogram(counts: DataFrame) -> DataFrame:
    """Five bands of similarity in percent, the first open below, with their share of counted pairs (``similarity, n``)."""
    bands = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
    at = F.least(F.greatest(F.floor(F.col("similarity") * 5), F.lit(0)), F.lit(4)).cast("int")
    sums = counts.groupBy(F.element_at(F.array(*map(F.lit, bands)), at + 1).alias("band")).agg(F.sum("n").alias("n"))
    return sums.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 6))
