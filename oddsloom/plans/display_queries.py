"""Queries on what pages show, on reports about snapshots, and on structs out of free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import display
from oddsloom.operators import snapshots
from oddsloom.plans import relations as rel
from oddsloom.plans.queries import AS_OF
from oddsloom.plans.registry import query, r6, table

_NUMBER = "CASE l_linenumber % 5 WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice * 64 WHEN 2 THEN l_extendedprice * 65536 WHEN 3 THEN l_quantity * 1e9 ELSE l_quantity + 0.5 END"


def _tenth(x: str) -> str:
    """One decimal of the exact binary value, ties up."""
    return f"printf('%.1f', CASE WHEN ({x}) * 4 % 2 = 1 THEN ({x}) + 0.001 ELSE ({x}) END)"


@query(
    f"""SELECT k, CASE WHEN v >= 1e9 THEN {_tenth('v / 1e9')} || 'B' WHEN v >= 1e6 THEN {_tenth('v / 1e6')} || 'M' WHEN v >= 1e3 THEN {_tenth('v / 1e3')} || 'K'
      WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS label, count(*) AS n
    FROM (SELECT l_partkey AS k, {_NUMBER} AS v FROM lineitem) l GROUP BY ALL"""
)
def number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.expr(_NUMBER).cast("double").alias("v"))
    return rows.groupBy("k", display.number_label(F.col("v")).alias("label")).agg(F.count("*").alias("n"))


_CAPITALS = ", ".join(f"'{c}'" for c in display.CAPITALS)


@query(
    f"""SELECT id, array_to_string(list_transform(regexp_split_to_array(title, '\\s+'), lambda w: CASE
      WHEN upper(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')) IN ({_CAPITALS}) THEN upper(w) WHEN regexp_matches(w, '^[A-Z]{{2,}}$') THEN w
      ELSE upper(left(w, 1)) || lower(substring(w, 2)) END), ' ') AS shown FROM x""",
    rel.MARKET,
)
def title_cases(m: DataFrame) -> DataFrame:
    return m.select("id", display.title_case(F.col("title")).alias("shown"))


@query(
    r"""SELECT id, coalesce(trim(nullif(regexp_extract(title, '(?i)will (?:the )?(.+?) win', 1), '')), CASE WHEN length(title) > 38 THEN left(title, 35) || '…' ELSE title END) AS label FROM x""",
    rel.MARKET,
)
def short_labels(m: DataFrame) -> DataFrame:
    return m.select("id", display.short_label(F.col("title")).alias("label"))


_CITIES = ["Minnesota", "Utah", "New York", "Oakland", "Lakers", "los angeles"]
_TEAMS = "list_value('Wild', 'Heat')"


@query(
    f"""SELECT c_custkey AS id, city, CASE WHEN city = 'Minnesota' THEN CASE WHEN c_custkey % 2 = 0 THEN 'Wild' ELSE 'Timberwolves' END
      WHEN city = 'Utah' THEN NULL WHEN city = 'New York' THEN NULL WHEN city = 'Oakland' THEN NULL WHEN city IN ('Lakers', 'los angeles') THEN CASE WHEN c_custkey % 2 = 1 THEN 'LA Lakers' END END AS team,
      CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'Los Angeles Lakers' END AS shown
    FROM (SELECT c_custkey, CASE c_custkey % {len(_CITIES)} {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CITIES))} END AS city FROM customer) c"""
)
def teams_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities against two games: Wild with Heat, Timberwolves with the LA Lakers."""
    k = F.col("c_custkey")
    city = F.element_at(F.array(*map(F.lit, _CITIES)), (k % len(_CITIES) + 1).cast("int"))
    playing = F.when(k % 2 == 0, F.array(F.lit("Wild"), F.lit("Heat"))).otherwise(F.array(F.lit("Timberwolves"), F.lit("LA Lakers")))
    name = F.when(k % 3 > 0, "los ANGELES lakers")
    return table(spark, sf_dir, "customer").select(k.alias("id"), city.alias("city"), display.team_shown(city, playing).alias("team"), display.capitalised(name).alias("shown"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE 'win ' || c_custkey END AS event, CASE WHEN c_custkey % 3 = 2 THEN 'Predicted outcome' ELSE 'yes' END AS outcome,
      CASE WHEN c_custkey % 3 = 1 THEN '2026' END AS timeframe, CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END AS conditions FROM customer"""
)
def parsed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model: bare JSON, JSON in a fence with words around, and none."""
    k, name = F.col("c_custkey"), F.concat(F.lit("win "), F.col("c_custkey"))
    bare = F.format_string('{"event": "%s", "outcome": "yes", "timeframe": null, "conditions": []}', name)
    fenced = F.format_string('Here it is:\n```json\n{"event": "%s", "outcome": "yes",\n "timeframe": "2026", "conditions": ["a", "b"]}\n```\nDone.', name)
    answer = F.when(k % 3 == 0, bare).when(k % 3 == 1, fenced).otherwise("I can not say.")
    p = display.prediction(answer, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), p["event"].alias("event"), p["outcome"].alias("outcome"), p["timeframe"].alias("timeframe"), F.size(p["conditions"]).alias("conditions"))


# --- reports on snapshots ---------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(DISTINCT market_id) AS markets, count(outcome_index) AS outcome_rows FROM x", rel.SNAPSHOT)
def insert_metrics(s: DataFrame) -> DataFrame:
    return snapshots.insert_metrics(s)


@query(
    f"""SELECT '{{"success":true,"deleted":' || count(*) FILTER (recorded_at < c) || ',"remaining":' || count(*) FILTER (recorded_at >= c) || ',"cutoff":"' || max(c) || '","timestamp":"{AS_OF}"}}' AS report
    FROM (SELECT *, TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AS c FROM x) a""",
    rel.SNAPSHOT,
)
def retention_json(s: DataFrame) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    return snapshots.report_json(snapshots.retention_report(s, as_of, 20), as_of)


@query(
    """SELECT round(m, 6) AS mean_length, round(m * (SELECT count(*) FROM x) / 1048576, 6) AS megabytes
    FROM (SELECT avg(coalesce(length(data), 0)) AS m FROM (SELECT data FROM x ORDER BY event_id LIMIT 10) s) a""",
    rel.SNAPSHOT,
)
def payload_size(s: DataFrame) -> DataFrame:
    return snapshots.payload_size(s).select(r6("mean_length").alias("mean_length"), r6("megabytes").alias("megabytes"))
