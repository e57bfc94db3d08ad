"""How sources differ in their words: sorted word-start pointers, counted by language and source.

A slice of texts is a shard. Its words stay where they are, in the bytes of Arrow's buffer; what is sorted are pointers
to their first bytes, by a multikey quicksort whose characters are eight bytes: all pointers by their first eight, then
those of an equal run that has more bytes by the next eight, and so on. Equal runs are terms. In a run the pointers
are in document order, so a run gives the documents and occurrences of its term for every (language, source).

What shards send is summed by (language, source, term), then by (language, term). Distances between all sources of a
language are summed in blocks of terms and of sources, so a task holds a matrix of bounded size and sends one row a pair.
Counts are long, and products that may be longer are decimals: all numbers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm import words
from oddsloom.llm.tables import in_batches, written

#: Bytes of text in a shard, at least if the partition has them; a longer text is a shard of its own.
SHARD = 12 << 20
LEAST_DOCS, SMOOTH, PARTS, TOP = 30, 5, 1_000_000_000, 50
#: About as many terms, and as many sources with as many others, are compared by one task.
TERMS, SOURCES = 1024, 256
COUNTS = "lang string, source string, term string, docs long, n long"


def _chunk(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one number that sorts as they do; bytes from ``left`` on are 0."""
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[np.minimum(at, len(padded) - 8)].view(">u8")[:, 0].astype(np.uint64)
    cut = np.uint64(8) * (8 - np.clip(left, 1, 8)).astype(np.uint64)
    return np.where(left > 0, eight >> cut << cut, np.uint64(0))


def sorted_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in the order of their words, and where each run of equal words begins (one more at the end)."""
    n = len(starts)
    padded, size = np.append(data, np.zeros(8, np.uint8)), ends - starts
    key = _chunk(padded, starts, size)
    order = np.argsort(key)
    new = np.ones(n + 1, bool)
    new[1:n] = np.diff(key[order]) != 0
    depth, at = 8, np.arange(n)
    while len(at):
        # Words that have ended are told apart by their chunks: no word has a byte 0. Runs with longer words go on.
        run = np.cumsum(new[at])
        heads = np.flatnonzero(np.diff(run, prepend=0))
        longer = np.logical_or.reduceat(size[order[at]] > depth, heads) & (np.diff(np.append(heads, len(at))) > 1)
        at = at[longer[run - 1]]
        mine, run = order[at], np.cumsum(new[at])
        key = _chunk(padded, starts[mine] + depth, size[mine] - depth)
        again = np.lexsort((key, run))
        order[at], key = mine[again], key[again]
        new[at[1:]] |= np.diff(key) != 0
        depth += 8
    return order, np.flatnonzero(new)


def _counted(w: words.Words, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``terms, group, docs, n`` for each term and group of documents (``group``: of each row of the slice) that has it."""
    order, at = sorted_pointers(w.data, w.starts, w.ends)
    runs, rows = len(at) - 1, max(1, len(group))
    owner = w.owner()
    place = np.sort(np.repeat(np.arange(runs), np.diff(at)) * rows + owner[order])
    first = np.flatnonzero(np.diff(place, prepend=-1))
    occurs = np.diff(np.append(first, len(place)))
    run, row = np.divmod(place[first], rows)
    groups = int(group.max(initial=0)) + 1
    cell = run * groups + group[row]
    by = np.argsort(cell, kind="stable")
    head = np.flatnonzero(np.diff(cell[by], prepend=-1))
    docs, n = np.diff(np.append(head, len(by))), np.add.reduceat(occurs[by], head) if len(head) else occurs[:0]
    run, of = np.divmod(cell[by][head], groups)
    word = order[at[:-1]]
    size = w.ends[word] - w.starts[word]
    offsets = np.append(0, np.cumsum(size))
    raw = w.data[np.arange(offsets[-1]) + np.repeat(w.starts[word] - offsets[:-1], size)]
    terms = pa.Array.from_buffers(pa.large_string(), runs, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    return terms.take(pa.array(run)), of, docs, n


def shard_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, docs, n`` of every shard, in several rows; the term of a row that counts a group's documents is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            text = table.column(0).combine_chunks().cast(pa.large_string())
            pair = pa.StructArray.from_arrays([table.column(k).combine_chunks().cast(pa.string()) for k in (1, 2)], ["lang", "source"])
            codes: dict = {}
            group = np.array([codes.setdefault((p["lang"], p["source"]), len(codes)) for p in pair.to_pylist()], np.int64)
            lang, source = (pa.array([c[k] for c in codes], pa.string()) for k in (0, 1))

            def rows(terms: pa.Array, of: np.ndarray, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), terms.cast(pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["lang", "source", "term", "docs", "n"])

            every = np.arange(len(codes))
            yield rows(pa.array([""] * len(codes), pa.string()), every, np.bincount(group, minlength=len(codes)), np.zeros(len(codes), np.int64))
            for w in words.scan(text, lower=True, of=words.TERM, size=SHARD):
                out = rows(*_counted(w, group[w.first : w.last]))
                for k in range(0, out.num_rows, 50_000):
                    yield out.slice(k, 50_000)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return in_batches(docs.select(empty("text"), empty("lang"), empty("source")), run, COUNTS)


def _parts(count: Column, total: Column, kept: Column) -> Column:
    """A smoothed share in parts of ``PARTS``, rounded down and raised by one; products are decimals, so no count is too large.

    Without kept terms there is nothing to share, and what this gives is not used.
    """
    wide = (count + SMOOTH).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", wide, F.greatest(total + kept * SMOOTH, F.lit(1)).cast("decimal(20,0)")) + F.lit(1).cast("long")


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, head``: occurrences of kept terms, one row of a term is its ``head``; one row with the term '' for each group."""
    cells = shard_counts(docs).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    same = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"lang_docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same), "head": F.min("source").over(same) == F.col("source")})
    kept = (F.col("term") == "") | (F.col("lang_docs") >= least)
    return cells.filter(kept).select("lang", "source", "term", "n", "lang_n", "head")


def group_totals(kept: DataFrame) -> DataFrame:
    """``lang, source, total, lang_total, terms, sources`` of every group that occurs."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("head") & (F.col("term") != "")).alias("heads"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"), F.count("*").alias("sources"))
    return groups.drop("heads").join(langs, "lang")


def over_used(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a group uses more than its language does: ``lang, source, item, value, rank``, at most ``top`` a group."""
    rows = kept.filter("term != ''").join(groups, ["lang", "source"])
    own, other = _parts(F.col("n"), F.col("total"), F.col("terms")), _parts(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = rows.filter("n > 0").select("lang", "source", F.col("term").alias("item"), (own - other).alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def _distances(table: pa.Table) -> pa.Table:
    """Sums over the terms of a block for each two of its sources; where a term has no row of a source, its row without a term says what it has."""
    pick = lambda rows, c: rows.column(c).combine_chunks()
    here = table.filter(pa.compute.is_null(table.column("term")))
    names = sorted(zip(pick(here, "block").to_pylist(), pick(here, "source").to_pylist(), pick(here, "p").to_pylist()))
    place = {s: k for k, (_, s, _) in enumerate(names)}
    rows = table.filter(pa.compute.is_valid(table.column("term")))
    coded = pick(rows, "term").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    at = np.array([place[s] for s in pick(rows, "source").to_pylist()], np.int64)
    shares = np.tile(np.array([p for _, _, p in names], np.int64)[:, None], len(coded.dictionary))
    shares[at, coded.indices.to_numpy()] = pick(rows, "p").to_numpy()
    block = np.array([b for b, _, _ in names])
    lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
    a, b, value = [], [], []
    for i in range(len(names)):
        if block[i] == lo:
            others = np.arange(i + 1, len(names)) if lo == hi else np.flatnonzero(block == hi)
            a += [names[i][1]] * len(others)
            b += [names[j][1] for j in others]
            value.append(np.abs(shares[others] - shares[i]).sum(axis=1))
    values = np.concatenate(value) if value else np.zeros(0, np.int64)
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(values, pa.int64()), "seen": pa.array(np.full(len(a), shares.shape[1]), pa.int64())})


def distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """How far each two sources of a language are apart: ``lang, source, item, value, rank``, both ways.

    A block of terms and two blocks of sources are one task. Terms that none of the two blocks of sources has add alike
    for a pair, so they are added by their number.
    """
    none = _parts(F.lit(0), F.col("total"), F.col("terms"))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    blocks, parts = F.ceil(F.col("terms") / TERMS).cast("int"), F.ceil(F.col("sources") / SOURCES).cast("int")
    known = groups.withColumns({"none": none, "blocks": F.greatest(blocks, F.lit(1)), "parts": parts, "block": place("source", parts)})
    every = known.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "parts", "block", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"))
    rows = kept.filter("term != ''").join(known, ["lang", "source"])
    rows = rows.select("lang", "source", place("term", F.col("blocks")).alias("at"), "parts", "block", "term", _parts(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    dealt = every.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("lang", "at", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "source", "term", "p")
    sums = dealt.groupBy("lang", "at", "lo", "hi").applyInArrow(_distances, "lang string, a string, b string, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = lambda c: known.select("lang", F.col("source").alias(c), F.col("none").alias(f"{c}_none"), "terms")
    sums = sums.join(side("a"), ["lang", "a"]).join(side("b").drop("terms"), ["lang", "b"])
    total = F.col("value") + (F.col("terms") - F.col("seen")) * F.abs(F.col("a_none") - F.col("b_none"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", total.alias("value"), both.alias("s")).select("lang", "s.source", "s.item", "value")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` are distances between sources, part ``term`` what a source over-uses.

    ``docs`` has ``text, lang, source``; null is '' in each, other columns are ignored. Repeated rows count as often as
    they are there. A language without a kept term has distances 0, one with a single source none. An empty table gives
    an empty result. Equal values rank by the bytes of their items.
    """
    kept = written(kept_counts(docs, least), "kept-terms")
    groups = written(group_totals(kept), "groups")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(distances(kept, groups), "pair").unionByName(part(over_used(kept, groups, top), "term"))
