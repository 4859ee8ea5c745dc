"""Snippet packs: what is read of documents for suppliers (targets) whose line items refer to them, and for suspected risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drilldown
from . import bindings as b
from . import event_queries as ev
from .registry import query

LIMITS = drilldown.Limits(context_lines=2, max_files=5, max_snippets=8, max_lines=6, max_chars=12_000)
_W = f"""w AS (SELECT target, path, greatest(1, s - {LIMITS.context_lines}) AS a, greatest(greatest(1, s - {LIMITS.context_lines}), t + {LIMITS.context_lines}) AS e, c FROM refs),
    m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY target, path ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {drilldown.NEAR} >= a THEN 0 ELSE 1 END AS new FROM w),
    i AS (SELECT *, sum(new) OVER (PARTITION BY target, path ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
    r AS (SELECT target, path, min(a) AS a, max(e) AS e, max(c) AS c, count(*) AS n FROM i GROUP BY target, path, island),
    f AS (SELECT target, path, count(*) AS k, sum(n) AS refs, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, path) AS fr FROM r GROUP BY target, path),
    p AS (SELECT r.*, row_number() OVER (PARTITION BY target ORDER BY path, a, e) AS place FROM r JOIN f USING (target, path) WHERE fr <= {LIMITS.max_files}),
    d AS (SELECT target, path, place, a, least(e, a + {LIMITS.max_lines - 1}) AS e, e > a + {LIMITS.max_lines - 1} AS clipped, c, n, string_split(text, chr(10)) AS lines FROM p LEFT JOIN documents ON path = concat('d/', doc_id) WHERE place <= {LIMITS.max_snippets}),
    s AS (SELECT * REPLACE (least(e, len(lines)) AS e), CASE WHEN lines IS NULL THEN 'missing' WHEN a > len(lines) THEN 'outside' ELSE 'loaded' END AS state, array_to_string(lines[a:least(e, len(lines))], chr(10)) AS snippet FROM d),
    q AS (SELECT *, sum(CASE WHEN state = 'loaded' THEN length(snippet) ELSE 0 END) OVER (PARTITION BY target ORDER BY place) AS total FROM s)"""
_REFS = "refs AS (SELECT l_suppkey AS target, concat('d/', l_partkey % 1009) AS path, l_linenumber AS s, l_linenumber + CAST(floor(l_quantity) AS BIGINT) % 7 AS t, l_discount AS c FROM lineitem)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber").cast("bigint")
    refs = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), F.concat(F.lit("d/"), (F.col("l_partkey") % 1009).cast("string")).alias("path"), start.alias("start_line"), (start + F.floor("l_quantity") % 7).alias("end_line"), F.col("l_discount").alias("confidence"))
    return drilldown.packs(refs, _files(spark, sf_dir), LIMITS)


@query(f"WITH {_REFS}, {_W} SELECT target, path, CAST(a AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, c AS confidence, CAST(n AS BIGINT) AS n_refs, sha1(snippet) AS snippet FROM q WHERE state = 'loaded' AND total <= {LIMITS.max_chars}")
def snippet_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read for each target."""
    rows = _packs(spark, sf_dir).select("target", F.explode("snippets").alias("s"))
    return rows.select("target", "s.path", "s.start_line", "s.end_line", "s.confidence", "s.n_refs", F.sha1(F.col("s.snippet").cast("binary")).alias("snippet"))


_COUNT = "CAST(count(*) FILTER ({0}) AS BIGINT)"
_FULL = f"total > {LIMITS.max_chars}"


@query(
    f"""WITH {_REFS}, {_W}, g AS (SELECT target, CAST(sum(refs) AS BIGINT) AS candidate_refs, CAST(sum(k) AS BIGINT) AS n_ranges, {_COUNT.format(f'fr <= {LIMITS.max_files}')} AS selected_files, {_COUNT.format(f'fr > {LIMITS.max_files}')} AS cut_files,
    CAST(greatest(0, sum(k) FILTER (fr <= {LIMITS.max_files}) - {LIMITS.max_snippets}) AS BIGINT) AS cut_snippets FROM f GROUP BY target)
    SELECT target, candidate_refs, n_ranges, selected_files, cut_files, cut_snippets, {_COUNT.format('clipped')} AS cut_lines, {_COUNT.format(_FULL)} AS cut_chars, {_COUNT.format(f"state = 'missing' AND NOT {_FULL}")} AS missing,
    {_COUNT.format(f"state = 'outside' AND NOT {_FULL}")} AS outside, {_COUNT.format(f"state = 'loaded' AND NOT {_FULL}")} AS loaded, CAST(coalesce(max(total) FILTER (NOT {_FULL}), 0) AS BIGINT) AS total_chars
    FROM q JOIN g USING (target) GROUP BY ALL"""
)
def selection_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references each target has, and what each of the five limits cut."""
    return _packs(spark, sf_dir).select("target", "trace.*")


_RISK = f"""it AS (SELECT DISTINCT pattern_id AS risk_id, severity, status, support FROM pt), nd AS (SELECT risk_id FROM it WHERE severity IN ('medium', 'high') AND status = 'suspected' GROUP BY risk_id ORDER BY risk_id LIMIT 40),
    refs AS (SELECT x.risk_id AS target, concat('d/', user_id) AS path, k % 5 + 1 AS s, k % 5 + 3 AS t, k / 100 AS c FROM (SELECT DISTINCT risk_id, unnest(string_split(support, ',')) AS id FROM it) x JOIN nd USING (risk_id) JOIN ev ON CAST(event_id AS VARCHAR) = id)"""


@query(
    f"""WITH {ev._EV}, {ev._FIND}, {ev._FLAGS}, {ev._ALL}, {_RISK}, {_W}, got AS (SELECT target AS risk_id, count(*) AS n_snippets, string_agg(concat(path, ':', a, '-', e), ' ' ORDER BY place) AS places FROM q WHERE state = 'loaded' AND total <= {LIMITS.max_chars} GROUP BY target)
    SELECT risk_id, severity, status, nd.risk_id IS NOT NULL AS drilled, coalesce(n_snippets, 0) AS n_snippets, coalesce(places, '') AS places FROM (SELECT DISTINCT risk_id, severity, status FROM it) it LEFT JOIN nd USING (risk_id) LEFT JOIN got USING (risk_id)"""
)
def risk_drilldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every risk, with what is read for the first forty that are suspected."""
    items = ev._patterns(spark, sf_dir).select(F.col("pattern_id").alias("risk_id"), "severity", "status", "support")
    places = ev._events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("d/"), F.col("user_id").cast("string")).alias("path"), (F.col("k") % 5 + 1).alias("start_line"), (F.col("k") % 5 + 3).alias("end_line"), (F.col("k") / 100).alias("confidence"))
    refs = items.select(F.col("risk_id").alias("target"), F.explode(F.split("support", ",")).alias("id")).distinct().join(places, "id").drop("id")
    rows = drilldown.with_packs(items.drop("support").distinct(), refs, _files(spark, sf_dir), LIMITS, always=True, most=40)
    place = F.transform("snippets", lambda s: F.format_string("%s:%d-%d", s["path"], s["start_line"], s["end_line"]))
    return rows.select("risk_id", "severity", "status", "drilled", F.coalesce("trace.loaded", F.lit(0)).cast("bigint").alias("n_snippets"), F.coalesce(F.array_join(place, " "), F.lit("")).alias("places"))
