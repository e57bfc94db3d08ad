"""The queries over the document tables, one for each operator, and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsloom.llm import binary_ids, chat, ctw, decontamination, divergence, exact_dedup, lexicon, media, mixing, near_dedup, quality, token_edits, whitening
from oddsloom.llm.tables import read


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and conversation -7, whose texts look like the template's own control strings.

    A row becomes the events that such a message leaves in a log: a first draft that the message before it drops by
    starting anew, its beginning, the same again by an edit or a regeneration, and two more deltas. Folding the log gives
    the rows' texts.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("\\### Assistant: </turn> ok")
    rows = rows.unionByName(
        spark.range(2).select(
            F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text")
        )
    )
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    third = F.floor(F.length("text") / 3).cast("int")
    event = lambda seq, kind, role, text: F.struct(seq.alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    part = lambda at, n: F.substring(F.col("text"), at, n)
    at, delta, role, none = F.col("msg") * 10, F.lit("delta"), F.col("role"), F.lit(None).cast("string")
    events = F.array(
        event(at - 9, delta, none, F.lit("lost ")),
        event(at, delta, role, part(F.lit(1), third)),
        event(at + 2, F.when(F.col("msg") % 2 == 0, "edit").otherwise("regenerate"), role, part(F.lit(1), third)),
        event(at + 3, delta, none, part(third + 1, third)),
        event(at + 4, delta, role, part(2 * third + 1, F.length("text"))),
    )
    log = rows.withColumn("msg", order).select("conv_id", "msg", F.explode(events).alias("e")).select("conv_id", "msg", "e.*")
    out = chat.render(chat.fold(log)).withColumn("turns", chat.parse(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS escaped,
    length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + escaped + length('### ') + length(': ') + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by context-tree weighting, learnt from those outside the held-out seventh."""
    return ctw.score(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits: a phrase in the middle, a heading, a new last character."""
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(at: Column, cut: int, put: str) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), F.lit(put).alias("put"))

    edits = F.array(edit(F.floor(n / 2), 8, " was re-written"), edit(F.lit(0), 0, "Draft: "), edit(n + 13, 1, "!"))
    return token_edits.count_edited(read(spark, sf_dir, "documents"), edits)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a motion-JPEG file, reads the files back, and sums up their clips."""
    out = media.read(media.store(read(spark, sf_dir, "documents")))
    ends = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f", c.end_s)), ",")
    feature = F.concat_ws(" ", F.concat(F.lit("clips="), F.size("clips")), F.concat(F.lit("ends="), ends), F.concat(F.lit("mean="), F.format_string("%.3f", F.get("clips", F.lit(0)).mean)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: bags of five-word shingles that overlap by 0.8 or more."""
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: sources weigh 5, 2, 1 in turn, share 150 % of all words, and stop at twice their size.

    The rows come in order of the training position of their first pass, those that the mix leaves out at the end;
    ``position`` and ``position_again`` are null where a pass is not taken.
    """
    p = mixing.plan(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    place = lambda k: F.round(F.get("positions", F.lit(k)), 9)
    rows = p.select("doc_id", "size", "source_size", "target", "taken", place(0).alias("position"), place(1).alias("position_again"))
    return rows.orderBy(F.asc_nulls_last("position"), "doc_id")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY no_source, source) AS rank
  FROM d GROUP BY no_source, source
), w AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS weight,
    [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][(rank - 1) % 3 + 1] AS ramp FROM s
), l AS (
  SELECT *, row_number() OVER line AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER past, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER past, 0)) AS level
  FROM w
  WINDOW line AS (ORDER BY cap / weight, rank), past AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN cap >= weight * level
    THEN min_by(level, place) FILTER (cap >= weight * level) OVER () * weight ELSE cap END AS target
  FROM l
), p AS (
  SELECT d.*, source_size, target, ramp,
    sum(size) OVER (PARTITION BY no_source, source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle
  FROM d JOIN t USING (no_source, source)
)
SELECT doc_id, size, source_size, target,
  CAST(size * ((middle < target)::INT + (source_size + middle < target)::INT) AS BIGINT) AS taken,
  CASE WHEN middle < target THEN round(due(middle / target, ramp), 9) END AS position,
  CASE WHEN source_size + middle < target THEN round(due((source_size + middle) / target, ramp), 9) END AS position_again
FROM p
"""
for _at in ("middle", "(source_size + middle)"):
    # Of a rate 1 + ramp * (2 t - 1), the time by which a share of the target is due.
    _share, _rest = f"({_at} / target)", "(1.0::DOUBLE - ramp)"
    OP6_SQL = OP6_SQL.replace(f"due({_at} / target, ramp)", f"(2 * {_share} / ({_rest} + sqrt({_rest} * {_rest} + 4 * ramp * {_share})))")


def op7_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents through a lexicon of their frequent words, and decodes the ids again."""
    docs = read(spark, sf_dir, "documents")
    return lexicon.digests(docs, lexicon.fit(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and whether it is the one that stays."""
    return exact_dedup.assign(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def op9_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as shards, and reads documents, offsets and checksums back from their bytes."""
    return binary_ids.read_shards(binary_ids.write_shards(read(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the quality of all documents with a model of the labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in the coordinates of their first eight components, each of variance one."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in passages of ten words of a benchmark item."""
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), s AS (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos FROM b WHERE len(words) > 0
), w AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS w FROM s
), p AS (SELECT rid, n, words, unnest(range(1, len(words) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n
), h AS (SELECT rid, pos, w.n, item_id FROM (SELECT rid, pos, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS w FROM p) x JOIN w ON x.n = w.n AND x.w = w.w
), c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY rid
), i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart in their terms, and the terms that each uses more than its language."""
    return divergence.audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d
), w AS (SELECT rid, lang, source, unnest(words) AS term FROM d
), k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), l AS (SELECT lang, coalesce(count(term), 0) AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang
), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.total + 5 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_media": op4_media,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_bpe_coding": op7_bpe_coding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_binary_ids": op9_binary_ids,
    "op10_quality": op10_quality,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op1_chat_formatting": OP1_SQL, "op6_mixing": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_decontamination": OP12_SQL, "op13_source_divergence": OP13_SQL}
