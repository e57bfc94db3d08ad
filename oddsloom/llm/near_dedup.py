"""Near-duplicate classes by BagMinHash over weighted word shingles.

A text is a multiset of shingles of ``SHINGLE`` words. Every shingle has a Poisson process over (time, weight): weights
are cut into rings [0, 1), [1, 2), [2, 4), [4, 8) ..., each ring has points of its own at a rate in proportion to its
width, and a point counts for a shingle of weight w if it lies below w. Each point falls to one of ``M`` signature
components, which keep the earliest: two texts agree in a component with exactly their weighted Jaccard similarity as
the chance. Points are drawn only up to the time by which all components of a text are expected to be filled (and
further where some are not), so a text costs about ``M log M`` points whatever its length.

Signatures are cut into ``BANDS`` bands, and texts with the same band share a bucket. In each bucket members are held
against a leader; buckets whose members are not yet one class try another leader. What is apart after that meets in blocks,
first signatures of a bucket, then the texts of families, which are texts that buckets connect and signatures do not
keep apart. Two texts are candidates if their signatures agree in ``AGREE`` components or more; of texts of similarity
0.8, all bands miss fewer than 0.0004 and this rule fewer than 0.000002. Candidates are verified on whole texts: the
overlap of their multisets must reach ``SIMILARITY``. Classes are the connected components of verified links.

Multisets are compared by hashes of ``HASH_BITS`` bits. Two texts of n and m different shingles have a pair that only
seems equal with a chance below ``n * m / 2**HASH_BITS``: one in ten million for texts of a thousand words, and such a
pair moves a similarity by less than 0.001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm import words
from oddsloom.llm.tables import hot_join, in_batches, release, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
M = BANDS * ROWS
#: Components that candidates agree in.
AGREE = 60
#: Rounds with one leader a bucket before the rest is compared in blocks; in the first one, buckets agree on leaders.
ROUNDS = 2
#: Texts of a block of signatures, and bytes of a block of texts.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Keys up to which a set of wanted texts is broadcast (16 bytes each) so that only those texts are shuffled.
BROADCAST_KEYS = 2_000_000
#: Bits of a shingle's hash; the others number the texts of a slice.
HASH_BITS = 44
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(w: words.Words) -> np.ndarray:
    """``row << HASH_BITS | shingle``, sorted, one entry for each occurrence. Texts of fewer words than a shingle have one: all their words."""
    h, n = w.hashes(), np.diff(w.bounds)
    roll = h.copy()
    for k in range(1, SHINGLE):
        m = max(len(h) - k, 0)
        roll[:m] = words.mix(roll[:m] * GOLDEN + h[k:])
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, 0)
    row = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + w.bounds[:-1][row]
    keys = [row.astype(np.uint64) << np.uint64(HASH_BITS) | words.mix(roll[at]) >> np.uint64(64 - HASH_BITS)]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        x = np.full(len(short), k, np.uint64)
        for i in range(k):
            x = words.mix(x * GOLDEN + h[w.bounds[short] + i])
        keys.append(short.astype(np.uint64) << np.uint64(HASH_BITS) | x >> np.uint64(64 - HASH_BITS))
    return np.sort(np.concatenate(keys))


def weighted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight of each distinct entry."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(first, append=len(keys))
    keys = keys[first]
    return (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1), weight


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """``rows x M`` identities of the earliest points; 0 where a text has no shingle."""
    out = np.zeros((rows, M), np.uint64)
    total = np.bincount(row, weight, rows)
    todo, reach = total > 0, np.log(M) + 4.0
    while todo.any():
        mine = np.flatnonzero(todo[row])
        # Elements: each shingle with each of its rings.
        rings = np.ceil(np.log2(weight[mine])).astype(np.int64) + 1
        e = np.repeat(mine, rings)
        ring = np.arange(len(e)) - np.repeat(np.cumsum(rings) - rings, rings)
        width = np.where(ring == 0, 1.0, 2.0 ** (ring - 1))
        low = np.where(ring == 0, 0.0, width)
        doc, limit = row[e], (reach / total[np.newaxis, row[e]])[0]
        state = words.mix(shingle[e] * GOLDEN + ring.astype(np.uint64))
        rate, heavy, time = width * M, weight[e].astype(float), np.zeros(len(e))
        best, who = np.full(rows * M, np.inf), np.zeros(rows * M, np.uint64)
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(doc):
            state = state + GOLDEN
            x = words.mix(state)
            time = time - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            on = time < limit
            if not on.all():
                doc, limit, state, rate, heavy, time, width, low, x = (v[on] for v in (doc, limit, state, rate, heavy, time, width, low, x))
            y = words.mix(x ^ GOLDEN)
            inside = low + (y & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width < heavy
            slot = doc * M + ((y >> np.uint64(32)) * np.uint64(M) >> np.uint64(32)).astype(np.int64)
            if not inside.all():
                seen.append((slot[inside], time[inside], y[inside]))
            else:
                seen.append((slot, time, y))
        slot, time, y = (np.concatenate(v) for v in zip(*seen, strict=True))
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        who[slot[first]] = y[first]
        full = np.isfinite(best.reshape(rows, M)).all(1) & todo
        out[full] = who.reshape(rows, M)[full]
        todo &= ~full
        reach *= 2
    return out


SKETCH = "doc_id long, t0 long, t1 long, d0 long, d1 long, bands array<long>, signature binary"
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row: ``__near_own``, its identifier or ``NO_ID``, and ``__near_t0, __near_t1``, a digest of its text. Rows of one key are copies."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.withColumns({"__near_own": own, "__near_t0": F.xxhash64("text"), "__near_t1": F.xxhash64(F.lit(1), "text")})


def fixed(values: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unfixed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, M)


def sketch(docs: DataFrame) -> DataFrame:
    """Per row of ``doc_id, t0, t1, text``: its key, a digest of the bag of shingles in two numbers, the hash of each band, and a byte of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words.scan(batch.column(3)):
                rows = w.last - w.first
                keys = bags(w)
                at = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
                digest = []
                for salt in (np.uint64(0xA5A5), np.uint64(0x5A5A)):
                    sums = np.append(np.uint64(0), np.cumsum(words.mix((keys & np.uint64((1 << HASH_BITS) - 1)) * GOLDEN + salt)))
                    digest.append(words.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
                parts = signatures(*weighted(keys), rows)
                bands = np.tile(np.arange(BANDS, dtype=np.uint64), (rows, 1))
                for k in range(ROWS):
                    bands = words.mix(bands * GOLDEN + parts.reshape(rows, BANDS, ROWS)[:, :, k])
                lists = pa.ListArray.from_arrays(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32), bands.ravel().view(np.int64))
                columns = [*(batch.column(k).slice(w.first, rows) for k in range(3)), *(pa.array(d.view(np.int64)) for d in digest), lists, fixed((parts & np.uint64(255)).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t0", "t1", "d0", "d1", "bands", "signature"])

    return in_batches(docs.select("doc_id", "t0", "t1", "text"), run, SKETCH)


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of two columns of texts, row by row."""

    def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys = [bags(w) + (np.uint64(w.first) << np.uint64(HASH_BITS)) for w in words.scan(column)]
        return np.unique(np.concatenate(keys), return_counts=True)

    (ka, na), (kb, nb) = entries(a), entries(b)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    row = lambda k: (k >> np.uint64(HASH_BITS)).astype(np.int64)
    both = np.bincount(row(ka[ia]), np.minimum(na[ia], nb[ib]), len(a))
    either = np.bincount(row(ka), na, len(a)) + np.bincount(row(kb), nb, len(a)) - both
    return np.divide(both, either, out=np.zeros(len(a)), where=either > 0)


def alike(pairs: DataFrame, signatures_of: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose signatures (``id, signature``) agree in ``AGREE`` components or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array((unfixed(batch.column(2)) == unfixed(batch.column(3))).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    side = lambda c: signatures_of.select(F.col("id").alias(c), F.col("signature").alias(f"signature_{c}"))
    return in_batches(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "signature_a", "signature_b"), run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose texts' overlap reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                good = overlap(part.column(2), part.column(3)) >= least - 1e-12
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], names=["a", "b"])

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return in_batches(rows, run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, comp``: the smallest identifier that links lead to, for each end of a link.

    Each end points to a smaller one or to itself. In a round, pointers go on to where their ends point, links go along
    their ends' pointers, and an end that points to itself takes the smallest end that it is linked to. Links whose ends
    have become one are dropped and others that have become equal are one, so rounds have fewer and fewer; when none is
    left and no pointer moves, all point to the smallest. Each round is written and read again.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    left = written(ends.filter("a <> b").distinct(), "links")
    labels = written(ends.unionByName(ends.select("b", F.col("b").alias("a"))).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")), "labels")
    while True:
        of = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
        moved = left.join(of("a"), "a").join(of("b"), "b").filter("comp_a <> comp_b")
        fewer = written(moved.select(F.greatest("comp_a", "comp_b").alias("a"), F.least("comp_a", "comp_b").alias("b")).distinct(), "links")
        nearest = fewer.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        jump = labels.select(F.col("id").alias("was"), F.col("comp").alias("far"))
        step = labels.withColumnRenamed("comp", "was").join(jump, "was").join(nearest, "id", "left")
        new = written(step.select("id", "was", F.when(F.col("id") == F.col("far"), F.coalesce("near", "far")).otherwise(F.col("far")).alias("comp")), "labels")
        release(left, labels)
        left, labels = fewer, new.select("id", "comp")
        if left.isEmpty() and new.filter("comp <> was").isEmpty():
            release(left)
            return labels


def relabelled(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` with the classes that ``links`` join become one."""
    if comps is None:
        return components(links)
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    new = components(joined).select(F.col("id").alias("old"), F.col("comp").alias("new"))
    ids = comps.select("id", "comp").unionByName(new.join(comps, new["old"] == comps["id"], "left_anti").select(F.col("old").alias("id"), F.col("old").alias("comp")))
    out = written(ids.join(new, ids["comp"] == new["old"], "left").select("id", F.coalesce("new", "comp").alias("comp")), "classes")
    release(comps, new)
    return out


def agreeing(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``i, j`` of signatures in ``x`` and ``y`` that agree in ``AGREE`` components, some rows of ``x`` at a time."""
    step = max(1, (1 << 22) // max(1, len(y)))
    across = np.ascontiguousarray(y.T)
    for at in range(0, len(x), step):
        agree = np.zeros((len(x[at : at + step]), len(y)), np.uint8)
        for k in range(M):
            agree += x[at : at + step, k][:, None] == across[k]
        i, j = np.nonzero(agree >= AGREE)
        yield i + at, j


def dealt(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``rows`` with ``lo, hi, block``, once for each block of its key that a row's own block meets. ``blocks`` has their number per key, and ``n`` rows."""
    own = hot_join(rows, blocks, [key], "n").drop("n").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def open_texts(rest: DataFrame) -> DataFrame:
    """``a, b``: each text of ``rest`` (``h, id, comp, signature``) that is like one of another class in its bucket, with a first such text of the bucket.

    A bucket is dealt into blocks of about ``BLOCK`` texts, and a task holds two blocks of one bucket at a time.
    """

    def found(block: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, comp: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(block == lo[0])
        right = left if lo[0] == hi[0] else np.flatnonzero(block == hi[0])
        some = np.zeros(len(ids), bool)
        for i, j in agreeing(sign[left], sign[right]):
            apart = comp[left[i]] != comp[right[j]]
            some[left[i[apart]]] = some[right[j[apart]]] = True
        mine = ids[some]
        return mine, np.full(len(mine), mine.min(initial=np.iinfo(np.int64).max))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = [*(batch.column(k).to_numpy() for k in range(6)), unfixed(batch.column(6))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[2][1:] != held[2][:-1]) | (held[3][1:] != held[3][:-1])) + 1
            if len(change):
                cuts = [0, *change.tolist()]
                each = [found(*(x[p:q] for x in held[1:])) for p, q in zip(cuts, cuts[1:], strict=False)]
                held = [x[cuts[-1] :] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*each, strict=True)], names=["a", "b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(*held[1:])], names=["a", "b"])

    blocks = written(rest.groupBy("h").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = dealt(rest, "h", blocks).select("h", "block", "lo", "hi", "id", "comp", "signature")
    return in_batches(rows.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi"), run, "a long, b long").distinct()


def compared(rest: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` between texts of different classes in ``rest`` (``id, comp, signature, family``), of one family each.

    A family is dealt into blocks of about ``BLOCK_BYTES`` of text, and a task holds two blocks: it compares the bags of
    those texts whose signatures agree. Only links leave a task, one for each two classes that it finds linked.
    """

    def run(table: pa.Table) -> pa.Table:
        block, lo, hi, ids, comp = (table.column(k).to_numpy() for k in range(1, 6))
        sign, text = unfixed(table.column(6)), table.column(7).combine_chunks()
        keys = np.concatenate([bags(w) + (np.uint64(w.first) << np.uint64(HASH_BITS)) for w in words.scan(text)])
        row = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        again = np.arange(len(keys)) - np.repeat(first, np.diff(first, append=len(keys)))
        distinct, token = np.unique(words.mix((keys & np.uint64((1 << HASH_BITS) - 1)) * GOLDEN + again.astype(np.uint64)), return_inverse=True)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        n = np.diff(at)
        mine = np.zeros(len(distinct), np.int64)
        left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
        links: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in agreeing(sign[left], sign[right]):
            a, b = left[i], right[j]
            apart = comp[a] != comp[b]
            if lo[0] == hi[0]:
                apart &= a < b
            a, b = a[apart], b[apart]
            for x, y in zip(cuts := np.flatnonzero(np.diff(a, prepend=-1)), np.append(cuts[1:], len(a)), strict=True):
                here, others = a[x], b[x:y]
                mine[token[at[here] : at[here + 1]]] = 1
                size = n[others]
                place = np.arange(size.sum()) + np.repeat(at[others] - np.cumsum(size) + size, size)
                both = np.add.reduceat(mine[token[place]], np.cumsum(size) - size)
                for k in others[both >= least * (n[here] + size - both) - 1e-9].tolist():
                    links.setdefault((min(comp[here], comp[k]), max(comp[here], comp[k])), (ids[here], ids[k]))
                mine[token[at[here] : at[here + 1]]] = 0
        return pa.table([pa.array([x[k] for x in links.values()], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = written(rest.join(texts, "id"), "open")
    size = F.sum(F.octet_length("text"))
    blocks = written(rows.groupBy("family").agg(F.count("*").alias("n"), F.ceil(size / BLOCK_BYTES).cast("int").alias("blocks")), "blocks")
    out = dealt(rows, "family", blocks).select("family", "block", "lo", "hi", "id", "comp", "signature", "text")
    return out.groupBy("family", "lo", "hi").applyInArrow(run, "a long, b long")


def wordings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, text`` of the rows ``doc_id, t0, t1`` in ``wanted`` (written, with their ``id``)."""
    key = F.xxhash64("doc_id", "t0", "t1").alias("key")
    if wanted.count() <= BROADCAST_KEYS:
        texts = texts.withColumn("key", key).join(F.broadcast(wanted.select(key)), "key", "left_semi").drop("key")
    return texts.join(wanted, ["doc_id", "t0", "t1"]).select("id", "text").dropDuplicates(["id"])


def assigned(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` with its key ``doc_id, t0, t1`` (see ``keyed``) and ``d0, d1``, and one per ``d0, d1``: ``comp``, the name of its class, its first key and number of rows.

    Texts with equal bags of shingles are one text from the start, so copies are never compared with each other; such a
    text goes by the first number of its bag's digest, never by identifiers, which rows may lack or share. Its wording is that of one row.
    """
    texts = keyed(docs).select(F.col("__near_own").alias("doc_id"), F.col("__near_t0").alias("t0"), F.col("__near_t1").alias("t1"), "text")
    rows = written(sketch(texts), "sketches")
    first = F.min(F.struct("doc_id", "t0", "t1")).alias("row")
    nodes = written(rows.groupBy("d0", "d1").agg(first, F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")).select(F.col("d0").alias("id"), "d0", "d1", "row.*", "n", "bands", "signature"), "nodes")
    members = nodes.select("id", F.explode("bands").alias("h"))
    # In the first round a bucket's leader is its smallest identifier, which is a hash.
    buckets = written(members.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1"), "buckets")
    multi = written(hot_join(members, buckets, ["h"], "n").select("h", "id", "leader"), "members")
    some = nodes.join(multi.select("id").distinct(), "id", "left_semi")
    signs = written(some.select("id", "doc_id", "t0", "t1", "signature"), "signatures")
    candidates = written(wordings(texts, signs.drop("signature")), "candidates")

    comps: DataFrame | None = None
    tested: DataFrame | None = None
    for k in range(ROUNDS + 1):
        if k == 0:
            pairs = multi.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        else:
            at = multi.select("h", "id") if comps is None else multi.select("h", "id").join(comps, "id", "left")
            at = written(at.select("h", "id", F.coalesce("comp", "id").alias("comp") if comps is not None else F.col("id").alias("comp")), "apart")
            turn = F.xxhash64(F.lit(k), "h")
            apart = at.groupBy("h").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(turn)).alias("o"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
            apart = written(apart.select("h", "n", F.col("o").bitwiseXOR(turn).alias("leader")), "buckets")
            rest = hot_join(at, apart, ["h"], "n")
            if k < ROUNDS:
                leads = at.select(F.col("id").alias("leader"), F.col("comp").alias("leads")).distinct()
                pairs = rest.filter("id <> leader").select("id", "leader", "comp").distinct().join(leads, "leader").filter("comp <> leads")
                pairs = pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        if k < ROUNDS:
            pairs = written(alike(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), signs), "pairs")
            links = written(verified(pairs, candidates, least), "verified")
            tested = pairs if tested is None else tested.unionByName(pairs)
        else:
            rest = written(rest.select("h", "id", "comp").join(signs.select("id", "signature"), "id"), "rest")
            family = components(open_texts(rest)).withColumnRenamed("comp", "family")
            links = written(compared(rest.select("id", "comp", "signature").dropDuplicates(["id"]).join(family, "id"), candidates, least), "verified")
            release(rest)
        if not links.isEmpty():
            comps = relabelled(comps, links)
    release(candidates, signs, multi, buckets)
    named = nodes.select("d0", "d1", "id", "doc_id", "t0", "t1", "n")
    if comps is not None:
        named = named.join(comps, "id", "left").withColumn("id", F.coalesce("comp", "id"))
    return rows.select("doc_id", "t0", "t1", "d0", "d1"), written(named.select("d0", "d1", F.col("id").alias("comp"), F.struct("doc_id", "t0", "t1").alias("row"), "n"), "classes")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id`` (smallest identifier of its class) and ``class_size``.

    Null and empty texts have no shingle and form one class. Null identifiers count as the smallest 64-bit number.
    Rows with null or repeated identifiers are in one class only if their texts are; classes whose smallest identifier
    is the same are told apart by nothing else here, but each has its own size. An empty table gives no rows.
    """
    rows, nodes = assigned(docs, least)
    sizes = nodes.groupBy("comp").agg(F.min("row.doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    return hot_join(rows, nodes.join(sizes, "comp"), ["d0", "d1"], "n").select("doc_id", "class_id", "class_size")


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, one with the smallest identifier, with all columns (names that begin with ``__near`` are taken).

    Of several rows with that identifier the one with the smallest digest of its text stays, and of its copies one.
    """
    key = ["__near_own", "__near_t0", "__near_t1"]
    first = assigned(docs, least)[1].groupBy("comp").agg(F.min("row").alias("row"))
    first = first.select(*(F.col(f"row.{c}").alias(k) for c, k in zip(("doc_id", "t0", "t1"), key, strict=True)))
    rows = keyed(docs).join(first, key, "left_semi")
    same = Window.partitionBy(*key).orderBy("text")
    return rows.withColumn("__near_n", F.row_number().over(same)).filter("__near_n = 1").select(*docs.columns)
