"""Log search: predicates, ordering, grouping, relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.catalog import register
from sigloom.operators import search, winners
from sigloom.sources import relations as R

WITH = f"WITH {R.LOGS_SQL} "
TOKEN = r"[^0-9A-Za-z_\x{80}-\x{10FFFF}]+"
DOC_TOKENS = f"list_filter(regexp_split_to_array(text, '{TOKEN}'), lambda x: x <> '')"


def scan(name: str, pairs: str, sql: str, source=R.logs, keep: tuple[str, ...] = ("offset", "message")) -> None:
    """Register a request over the log relation; `keep` are its output columns unless it counts or groups."""
    parsed = [tuple(p.split("=", 1)) for p in pairs.split("&") if p]

    @register(name, sql)
    def run(spark, sf_dir):
        out = search.scan(source(spark, sf_dir), parsed)
        have = [c for c in keep if c in out.columns]
        return out.select(*have) if have else out


def on_logs(name: str, pairs: str, where: str) -> None:
    scan(name, pairs, f"{WITH} SELECT off AS offset, message FROM logs WHERE {where}")


def on_docs(name: str, pairs: str, where: str) -> None:
    scan(name, pairs, f"WITH d AS (SELECT doc_id, text, {DOC_TOKENS} AS toks FROM documents) SELECT doc_id AS offset FROM d WHERE {where}", R.document_logs, ("offset",))


FROM, TO = 1_704_412_800_000_000_000, 1_704_844_800_000_000_000

scan("flagship_errors_by_minute", "message_token_ci=ERROR&group_by=minute&group_order=count_desc", f"{WITH} SELECT CAST(ts_ns // 60000000000 AS VARCHAR) AS minute, count(*) AS count FROM logs WHERE event_type = 'error' GROUP BY 1")
scan("scan_project", "columns=timestamp,offset,message,severity_text", f"{WITH} SELECT ts_ns AS timestamp, off AS offset, message, sev_text AS severity_text FROM logs", keep=("timestamp", "offset", "message", "severity_text"))
on_logs("filter_ts_range", f"start_ns={FROM}&end_ns={TO}", f"ts_ns >= {FROM} AND ts_ns < {TO}")
on_logs("filter_offset_range", "offset_start=100&offset_end=900", "off >= 100 AND off < 900")
on_logs("filter_label_eq", "label.event_type=click", "event_type = 'click'")
on_logs("filter_resource_eq", "resource.service.name=svc-3", "usr = '3'")
on_logs("filter_trace_id", "trace_id=00000000000000000000000000000011", "user_id = 17")
on_logs("field_exists", "field_exists=attr.loki.metadata.k", "k IS NOT NULL")
on_logs("field_equals", "field_equals=resource.loki.label.user=4", "usr = '4'")
on_logs("field_in", "field_in=attr.loki.metadata.k=1|2|3", "k IN ('1', '2', '3')")
on_logs("field_prefix", "field_prefix=attr.loki.metadata.k=1", "starts_with(k, '1')")
on_logs("field_suffix", "field_suffix=attr.loki.metadata.k=7", "ends_with(k, '7')")
on_logs("field_contains", "field_contains=resource.loki.label.event_type=ic", "contains(event_type, 'ic')")
on_logs("field_regex", "field_regex=attr.loki.metadata.k=^[12][0-9]$", "regexp_matches(k, '^[12][0-9]$')")
on_logs("field_numeric_ge", "field_numeric=attr.loki.metadata.k:ge:90", "CAST(k AS HUGEINT) >= 90")
on_logs("field_numeric_ne", "field_numeric=otel.severity_number:ne:9", "sev <> 9")
on_logs("match_all", "", "true")
on_logs("match_none", "field_in=attr.loki.metadata.nothing=x", "false")
on_logs("msg_exact", "message_exact=type=click user=46 cents=1231", "message = 'type=click user=46 cents=1231'")
scan("group_null_key", "group_by=scope_name", f"{WITH} SELECT CAST(NULL AS VARCHAR) AS scope_name, count(*) AS count FROM logs")
on_logs("msg_contains_ci", "message_contains=CENTS=12", "contains(lower(message), 'cents=12')")
on_logs("msg_prefix", "message_prefix=TYPE=PUR", "starts_with(lower(message), 'type=pur')")
on_logs("msg_suffix", "message_suffix=5", "ends_with(message, '5')")
on_logs("msg_regex", "message_regex=user=1[0-9] cents=[1-4]", "regexp_matches(message, 'user=1[0-9] cents=[1-4]')")
on_logs("msg_regex_ci", "message_regex_ci=TYPE=(VIEW|CLICK) ", "regexp_matches(message, '(?i)TYPE=(VIEW|CLICK) ')")
on_logs("term_and", "term=Error&term=user", "event_type = 'error'")
on_logs("token_ci", "message_token_ci=SIGNUP", "event_type = 'signup'")
on_logs("token_not", "message_not=error", "event_type <> 'error'")
on_logs("predicate_or", "message_token=click&message_contains=cents=99&predicate_operator=or", "event_type = 'click' OR contains(message, 'cents=99')")
on_docs("token_cs", "message_token=The", "list_contains(toks, 'The')")
on_docs("token_prefix", "message_token_prefix=thin", "len(list_filter(toks, lambda x: starts_with(x, 'thin'))) > 0")
on_docs("token_prefix_ci", "message_token_prefix_ci=THIN", "len(list_filter(toks, lambda x: starts_with(lower(x), 'thin'))) > 0")
on_docs("token_regex", "message_token_regex=^in.*ly$", "len(list_filter(toks, lambda x: regexp_matches(x, '^in.*ly$'))) > 0")
on_docs("token_like", "message_like=th_r%ly", "len(list_filter(toks, lambda x: regexp_matches(x, '(?i)^th.r.*ly$'))) > 0")
on_docs("token_fuzzy1", "message_fuzzy=thereing:1", "len(list_filter(toks, lambda x: abs(length(x) - 8) <= 1 AND levenshtein(lower(x), 'thereing') <= 1)) > 0")
on_docs("phrase_exact", "message_phrase=of|the", "regexp_matches(lower(text), '(^|[^0-9a-z_\\x{80}-\\x{10FFFF}])of[^0-9a-z_\\x{80}-\\x{10FFFF}]+the($|[^0-9a-z_\\x{80}-\\x{10FFFF}])')")
on_docs("phrase_gap2", "message_proximity=this|from:2", "len(list_filter(range(1, len(toks) + 1), lambda i: lower(toks[i]) = 'this' AND list_contains(list_transform(toks[i + 1:i + 3], lambda x: lower(x)), 'from'))) > 0")
on_docs("any_tokens", "message_any=idiot&message_any=scum", "len(list_filter(toks, lambda x: lower(x) IN ('idiot', 'scum'))) > 0")
on_docs("min_match2", "message_any=idiot&message_any=scum&message_any=the&message_min_match=2", "(list_contains(list_transform(toks, lambda x: lower(x)), 'idiot'))::INT + (list_contains(list_transform(toks, lambda x: lower(x)), 'scum'))::INT + (list_contains(list_transform(toks, lambda x: lower(x)), 'the'))::INT >= 2")
scan("cardinality", "cardinality_only=1&label.event_type=view", f"{WITH} SELECT count(*) AS rows FROM logs WHERE event_type = 'view'")
scan("group_severity", "group_by=severity_text", f"{WITH} SELECT sev_text AS severity_text, count(*) AS count FROM logs GROUP BY 1")
scan("group_minute", "group_by=minute&group_order=count_desc&group_limit=20", f"{WITH} SELECT CAST(ts_ns // 60000000000 AS VARCHAR) AS minute, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
scan("group_two_keys", "group_by=severity_text,minute&message_contains=user=7", f"{WITH} SELECT sev_text AS severity_text, CAST(ts_ns // 60000000000 AS VARCHAR) AS minute, count(*) AS count FROM logs WHERE contains(message, 'user=7') GROUP BY 1, 2")
scan("topk_ts_desc", "order=timestamp_desc&limit=50&label.event_type=error", f"{WITH} SELECT off AS offset, message FROM logs WHERE event_type = 'error' ORDER BY ts_ns DESC, off DESC LIMIT 50")
scan("topk_ts_asc", "order=timestamp_asc&limit=50", f"{WITH} SELECT off AS offset, message FROM logs ORDER BY ts_ns, off LIMIT 50")
scan("cursor_page", f"order=timestamp_desc&limit=25&after={TO}:500", f"{WITH} SELECT off AS offset, message FROM logs WHERE (ts_ns, off) < ({TO}, 500) ORDER BY ts_ns DESC, off DESC LIMIT 25")
scan(
    "topk_relevance",
    "message_token_ci=the&message_any=from&order=relevance_desc&limit=40&columns=offset,score",
    f"""WITH d AS (SELECT doc_id, doc_id * 1000000000 AS ts, {DOC_TOKENS.replace('text', 'lower(text)')} AS toks FROM documents), m AS (SELECT *, greatest(len(toks), 1) AS dl,
    CAST(len(list_filter(toks, lambda x: x = 'the')) AS DOUBLE) AS a, CAST(len(list_filter(toks, lambda x: x = 'from')) AS DOUBLE) AS b FROM d),
    s AS (SELECT *, a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / 12.0)) + b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / 12.0)) AS score FROM m WHERE a > 0 AND b > 0)
    SELECT doc_id AS offset, score FROM s ORDER BY score DESC, ts DESC, doc_id DESC LIMIT 40""",
    R.document_logs,
    ("offset", "score"),
)
scan("distinct_trace", "distinct_trace_id=1&cardinality_only=1&label.event_type=error", f"{WITH} SELECT count(DISTINCT trace_id) AS rows FROM logs WHERE event_type = 'error'")
scan("trace_join_service", "label.event_type=error&trace_join_service=svc-3&distinct_trace_id=1&cardinality_only=1", f"{WITH} SELECT count(DISTINCT trace_id) AS rows FROM logs WHERE event_type = 'error' AND trace_id IN (SELECT trace_id FROM logs WHERE usr = '3')")
scan("trace_join_rows", "label.event_type=purchase&trace_join_service=svc-5", f"{WITH} SELECT off AS offset, message FROM logs WHERE event_type = 'purchase' AND trace_id IN (SELECT trace_id FROM logs WHERE usr = '5')")


@register("byte_page", f"{WITH} SELECT off AS offset FROM (SELECT off, sum(strlen(message)) OVER (ORDER BY ts_ns, off) AS b FROM logs) WHERE b <= 5000")
def byte_page(spark, sf_dir):
    return search.page_by_bytes(R.logs(spark, sf_dir), 5000).select("offset")


@register("winner_spans", f"WITH {R.SPANS_SQL} SELECT trace_id, span_id, name, ts AS timestamp, duration AS duration_nanos, status AS status_code FROM spans")
def winner_spans(spark, sf_dir):
    return R.spans(spark, sf_dir).select("trace_id", "span_id", "name", "timestamp", "duration_nanos", "status_code")


@register(
    "traces_view",
    f"""WITH {R.SPANS_SQL} SELECT trace_id, min(ts) AS start_timestamp, max(ts + duration) AS end_timestamp, count(*) AS span_count, CAST(count(*) FILTER (status = 2) AS BIGINT) AS error_count,
    arg_min(name, (ts, span_id)) FILTER (parent_span_id IS NULL) AS root_name, arg_min(service, (ts, span_id)) FILTER (parent_span_id IS NULL) AS root_service FROM spans GROUP BY 1""",
)
def traces_view(spark, sf_dir):
    return winners.traces(R.spans(spark, sf_dir)).drop("tenant")


def _versions(spark, sf_dir):
    """Gauge points, every seventh followed by a correction and every eleventh by a retry."""
    points = R.gauge_points(spark, sf_dir).select("tenant", "series_id", "timestamp", "offset", "value")
    fixed = points.filter("offset % 7 = 0").withColumn("value", F.col("value") + 1).withColumn("offset", F.col("offset") + 1_000_000)
    retried = points.filter("offset % 11 = 0").withColumn("offset", F.col("offset") + 2_000_000)
    return points.unionByName(fixed).unionByName(retried)


VERSIONS_SQL = """p AS (SELECT 'event_value/' || event_type || '/' || (user_id % 10) AS series_id, epoch_us(ts) * 1000 AS ts, event_id AS off, value FROM events),
 v AS (SELECT * FROM p UNION ALL SELECT series_id, ts, off + 1000000, value + 1 FROM p WHERE off % 7 = 0 UNION ALL SELECT series_id, ts, off + 2000000, value FROM p WHERE off % 11 = 0)"""


@register("winner_points", f"WITH {VERSIONS_SQL} SELECT series_id, ts AS timestamp, max(off) AS offset, round(arg_max(value, off), 6) AS value FROM v GROUP BY 1, 2")
def winner_points(spark, sf_dir):
    return winners.winning_points(_versions(spark, sf_dir)).select("series_id", "timestamp", "offset", F.round("value", 6).alias("value"))


@register("point_conflicts", f"WITH {VERSIONS_SQL} SELECT 'default' AS tenant, series_id, ts AS timestamp, count(DISTINCT value) AS values FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def point_conflicts(spark, sf_dir):
    return winners.conflicts(_versions(spark, sf_dir))


def _arrivals(spark, sf_dir):
    """Gauge points as they come in: corrections and retries soon after their points, some points late, and some too late to count."""
    p = R.gauge_points(spark, sf_dir).select("tenant", "series_id", "timestamp", "offset", "value")

    def again(every: int, kind: int, value, back: int):
        return p.filter(f"offset % {every} = 0").select("tenant", "series_id", (F.col("timestamp") - back).alias("timestamp"), (F.col("offset") * 10 + kind).alias("offset"), value.alias("value"))

    v = F.col("value")
    return again(1, 0, v, 0).unionByName(again(7, 1, v + 1, 0)).unionByName(again(11, 2, v, 0)).unionByName(again(5, 3, v, 300_000_000_000)).unionByName(again(9, 4, v, 900_000_000_000))


ARRIVALS_SQL = """p AS (SELECT 'event_value/' || event_type || '/' || (user_id % 10) AS series_id, epoch_us(ts) * 1000 AS ts, event_id AS off, value FROM events),
 w AS (SELECT series_id, ts, off, 0 AS kind, value FROM p UNION ALL SELECT series_id, ts, off, 1, value + 1 FROM p WHERE off % 7 = 0 UNION ALL SELECT series_id, ts, off, 2, value FROM p WHERE off % 11 = 0
  UNION ALL SELECT series_id, ts - 300000000000, off, 3, value FROM p WHERE off % 5 = 0 UNION ALL SELECT series_id, ts - 900000000000, off, 4, value FROM p WHERE off % 9 = 0)"""


@register(
    "point_outcomes",
    f"""WITH {ARRIVALS_SQL}, l AS (SELECT *, max(ts) OVER (PARTITION BY series_id ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (SELECT series_id, ts, off * 10 + kind AS arrived, value FROM w)),
    o AS (SELECT *, coalesce(latest - ts > 600000000000, false) AS late, lag(arrived) OVER (PARTITION BY series_id, ts, coalesce(latest - ts > 600000000000, false) ORDER BY arrived) AS po, lag(value) OVER (PARTITION BY series_id, ts, coalesce(latest - ts > 600000000000, false) ORDER BY arrived) AS pv FROM l)
    SELECT CASE WHEN late THEN 'rejected' WHEN po IS NOT NULL AND pv = value THEN 'duplicate' WHEN po IS NOT NULL THEN 'replaced' WHEN ts < latest THEN 'out_of_order' ELSE 'inserted' END AS outcome, count(*) AS n FROM o GROUP BY 1""",
)
def point_outcomes(spark, sf_dir):
    return winners.classify_points(_arrivals(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


@register("delta_accumulator", f"WITH {R.GAUGE_SQL} SELECT off AS offset, round(sum(value) OVER (PARTITION BY event_type, usr ORDER BY off), 4) AS cumulative FROM points")
def delta_accumulator(spark, sf_dir):
    return winners.accumulate_delta(R.gauge_points(spark, sf_dir)).select("offset", F.round("cumulative", 4).alias("cumulative"))


@register("retention_clamp", f"{WITH} SELECT off AS offset FROM logs WHERE ts_ns >= {TO}")
def retention_clamp(spark, sf_dir):
    return winners.within_retention(R.logs(spark, sf_dir), TO + 10, 10).select("offset")
