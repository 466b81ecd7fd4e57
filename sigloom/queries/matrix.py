"""The SQL surface: fixed relations as views, queried with plain Spark SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.catalog import register
from sigloom.sources import readers
from sigloom.sources import relations as R

L = f"WITH {R.LOGS_SQL} "
S = f"WITH {R.SPANS_SQL} "
G = f"WITH {R.GAUGE_SQL} "


def views(spark, sf_dir):
    """Temporary views of the six relations."""
    R.logs(spark, sf_dir).createOrReplaceTempView("v_logs")
    R.spans(spark, sf_dir).createOrReplaceTempView("v_spans")
    R.gauge_points(spark, sf_dir).createOrReplaceTempView("v_metric_points")
    nested = R.nested_spans(spark, sf_dir)
    readers.span_events(nested).createOrReplaceTempView("v_span_events")
    readers.span_links(nested).createOrReplaceTempView("v_span_links")
    R.exemplars(spark, sf_dir).createOrReplaceTempView("v_metric_exemplars")


def sql(name: str, text: str, oracle: str) -> None:
    @register(f"sql_{name}", oracle)
    def run(spark, sf_dir):
        views(spark, sf_dir)
        return spark.sql(text)


APP = "coalesce(try_element_at(labels, 'event_type'), '')"
K = "coalesce(try_element_at(metadata, 'k'), '')"
sql("row_count", "SELECT count(*) AS rows FROM v_logs", f"{L} SELECT count(*) AS rows FROM logs")
sql("group_map", f"SELECT {APP} AS kind, count(*) AS rows FROM v_logs GROUP BY 1", f"{L} SELECT event_type AS kind, count(*) AS rows FROM logs GROUP BY 1")
sql("aggregates", "SELECT count_if(locate('error', lower(message)) > 0) AS errors, count(DISTINCT partition) AS partitions, percentile_disc(0.5) WITHIN GROUP (ORDER BY char_length(message)) AS middle_length FROM v_logs", f"{L} SELECT count(*) FILTER (contains(lower(message), 'error')) AS errors, CAST(1 AS BIGINT) AS partitions, CAST(quantile_disc(length(message), 0.5) AS DOUBLE) AS middle_length FROM logs")
sql("window", f"SELECT timestamp, offset, row_number() OVER (PARTITION BY {APP} ORDER BY timestamp, partition, offset) AS row_number FROM v_logs", f"{L} SELECT ts_ns AS timestamp, off AS offset, row_number() OVER (PARTITION BY event_type ORDER BY ts_ns, off) AS row_number FROM logs")
sql("cte_array", f"WITH told AS (SELECT {APP} AS kind, {K} AS k FROM v_logs) SELECT kind, array_join(array_sort(collect_list(k)), ',') AS ks FROM told GROUP BY kind", f"{L} SELECT event_type AS kind, string_agg(k, ',' ORDER BY k) AS ks FROM logs GROUP BY 1")
sql("self_join", "SELECT count(*) AS pairs FROM v_logs a JOIN v_logs b ON a.partition = b.partition AND a.offset = b.offset", f"{L} SELECT count(*) AS pairs FROM logs")
sql("timestamp_map_filter", f"SELECT offset, message FROM v_logs WHERE timestamp >= 0 AND timestamp < 2000000000000000000 AND {APP} = 'view' AND {K} = '50'", f"{L} SELECT off AS offset, message FROM logs WHERE event_type = 'view' AND k = '50'")
sql("ordered_limit", "SELECT timestamp, offset, message FROM v_logs ORDER BY timestamp DESC, offset DESC LIMIT 1", f"{L} SELECT ts_ns AS timestamp, off AS offset, message FROM logs ORDER BY 1 DESC, 2 DESC LIMIT 1")
sql("ordered_map_limit", f"SELECT timestamp, offset, message FROM v_logs WHERE {K} = '50' ORDER BY timestamp DESC, offset DESC LIMIT 1", f"{L} SELECT ts_ns AS timestamp, off AS offset, message FROM logs WHERE k = '50' ORDER BY 1 DESC, 2 DESC LIMIT 1")
sql("ordered_residual_limit", "SELECT timestamp, offset, message FROM v_logs WHERE locate('error', lower(coalesce(message, ''))) > 0 ORDER BY timestamp DESC, offset DESC LIMIT 1", f"{L} SELECT ts_ns AS timestamp, off AS offset, message FROM logs WHERE contains(lower(message), 'error') ORDER BY 1 DESC, 2 DESC LIMIT 1")
sql("ordered_token_limit", "SELECT timestamp, offset, message FROM v_logs WHERE message rlike '(?<![0-9A-Za-z_])error(?![0-9A-Za-z_])' ORDER BY timestamp DESC, offset DESC LIMIT 1", f"{L} SELECT ts_ns AS timestamp, off AS offset, message FROM logs WHERE event_type = 'error' ORDER BY 1 DESC, 2 DESC LIMIT 1")
sql("ordered_token_ci_limit", "SELECT timestamp, offset, message FROM v_logs WHERE message rlike '(?i)(?<![0-9A-Za-z_])ERROR(?![0-9A-Za-z_])' ORDER BY timestamp DESC, offset DESC LIMIT 1", f"{L} SELECT ts_ns AS timestamp, off AS offset, message FROM logs WHERE event_type = 'error' ORDER BY 1 DESC, 2 DESC LIMIT 1")
sql("all_tokens", "SELECT offset FROM v_logs WHERE message rlike '(?<![0-9A-Za-z_])type(?![0-9A-Za-z_])' AND message rlike '(?<![0-9A-Za-z_])error(?![0-9A-Za-z_])' AND contains(message, 'type') AND contains(message, 'error')", f"{L} SELECT off AS offset FROM logs WHERE event_type = 'error'")
sql("mixed_residual", f"SELECT offset FROM v_logs WHERE {APP} = 'click' AND locate('user=1', lower(message)) > 0", f"{L} SELECT off AS offset FROM logs WHERE event_type = 'click' AND contains(message, 'user=1')")
sql("disjunction", f"SELECT offset FROM v_logs WHERE {APP} = 'click' OR {K} = '20'", f"{L} SELECT off AS offset FROM logs WHERE event_type = 'click' OR k = '20'")
sql("missing_map_key", "SELECT coalesce(try_element_at(labels, 'missing'), '') AS missing, count(*) AS rows FROM v_logs GROUP BY 1", f"{L} SELECT '' AS missing, count(*) AS rows FROM logs")
sql("missing_map_equality", "SELECT count(*) AS rows FROM v_logs WHERE coalesce(try_element_at(labels, 'missing'), '') = ''", f"{L} SELECT count(*) AS rows FROM logs")
sql("alias_subquery", f"SELECT kind, count(*) AS rows FROM (SELECT {APP} AS kind, offset FROM v_logs WHERE timestamp >= 0) GROUP BY kind", f"{L} SELECT event_type AS kind, count(*) AS rows FROM logs GROUP BY 1")
sql("aggregate_combinators", f"SELECT count_if({K} = '50') AS fifties, count(DISTINCT offset) FILTER (WHERE {APP} = 'view') AS view_offsets FROM v_logs", f"{L} SELECT count(*) FILTER (k = '50') AS fifties, count(DISTINCT off) FILTER (event_type = 'view') AS view_offsets FROM logs")
sql("span_aggregates", "SELECT count(*) AS n, count(DISTINCT trace_id) AS traces, sum(duration_nanos) AS total, count_if(status_code = 2) AS errors FROM v_spans", f"{S} SELECT count(*) AS n, count(DISTINCT trace_id) AS traces, CAST(sum(duration) AS BIGINT) AS total, CAST(count(*) FILTER (status = 2) AS BIGINT) AS errors FROM spans")
sql("span_window", "SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, offset) AS n FROM v_spans", f"{S} SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, off) AS n FROM spans")
sql("span_map_filter", "SELECT trace_id, span_id FROM v_spans WHERE coalesce(try_element_at(resource_attributes, 'service.name'), '') <> '' AND coalesce(try_element_at(attributes, 'flag'), '') <> ''", f"{S} SELECT trace_id, span_id FROM spans WHERE flag <> ''")
sql("event_group", "SELECT name, count(*) AS n, count(DISTINCT trace_id) AS traces FROM v_span_events GROUP BY name", "SELECT 'shipped-' || l_returnflag AS name, count(*) AS n, count(DISTINCT l_orderkey) AS traces FROM lineitem GROUP BY 1")
sql("link_topology", "SELECT trace_id, linked_trace_id, count(*) AS n FROM v_span_links GROUP BY 1, 2", "SELECT lpad(lower(to_hex(l_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(l_suppkey + 1)), 32, '0') AS linked_trace_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
sql("metric_aggregates", "SELECT name, metric_kind, count(*) AS n, count(DISTINCT series_id) AS series, count_if(value_type = 'integer') AS integers FROM v_metric_points GROUP BY 1, 2", f"{G} SELECT 'event_value' AS name, 'gauge' AS metric_kind, count(*) AS n, count(DISTINCT (event_type, usr)) AS series, CAST(0 AS BIGINT) AS integers FROM points")
sql("metric_window", "SELECT series_id, timestamp, row_number() OVER (PARTITION BY series_id ORDER BY timestamp, offset) AS n FROM v_metric_points", f"{G} SELECT 'event_value/' || event_type || '/' || usr AS series_id, ts_ns AS timestamp, row_number() OVER (PARTITION BY event_type, usr ORDER BY ts_ns, off) AS n FROM points")
sql("metric_map_filter", "SELECT series_id, timestamp FROM v_metric_points WHERE coalesce(try_element_at(labels, 'user'), '') = '3'", f"{G} SELECT 'event_value/' || event_type || '/' || usr AS series_id, ts_ns AS timestamp FROM points WHERE usr = '3'")
sql("exemplar_group", "SELECT trace_id, count(*) AS n, count(DISTINCT series_id) AS series FROM v_metric_exemplars GROUP BY 1", f"{L} SELECT trace_id, count(*) AS n, count(DISTINCT (event_type, usr)) AS series FROM logs GROUP BY 1")
sql("log_span_correlation", "SELECT s.name, count(*) AS n FROM v_logs l JOIN v_spans s ON l.tenant = s.tenant AND l.trace_id = s.trace_id AND l.span_id = s.span_id GROUP BY 1", f"WITH {R.LOGS_SQL}, {R.SPANS_SQL} SELECT s.name, count(*) AS n FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id GROUP BY 1")
sql("exemplar_span_correlation", "SELECT s.name, count(DISTINCT e.series_id) AS series, count(*) AS n FROM v_metric_exemplars e JOIN v_spans s ON e.tenant = s.tenant AND e.trace_id = s.trace_id GROUP BY 1", f"WITH {R.LOGS_SQL}, {R.SPANS_SQL} SELECT s.name, count(DISTINCT (event_type, usr)) AS series, count(*) AS n FROM logs l JOIN spans s ON l.trace_id = s.trace_id GROUP BY 1")
# A resource's rows of both sides are counted before they meet, so no pair of rows is made.
sql("resource_correlation", "SELECT l.resource_id, l.n * m.n AS n, m.series FROM (SELECT tenant, resource_id, count(*) AS n FROM v_logs GROUP BY 1, 2) l JOIN (SELECT tenant, resource_id, count(*) AS n, count(DISTINCT series_id) AS series FROM v_metric_points GROUP BY 1, 2) m ON l.tenant = m.tenant AND l.resource_id = m.resource_id", f"{L} SELECT 'r' || a.usr AS resource_id, count(*) AS n, count(DISTINCT (b.event_type, b.usr)) AS series FROM logs a JOIN logs b ON a.usr = b.usr GROUP BY 1")
sql("traces_errors", "SELECT trace_id, min(timestamp) AS start_timestamp, count_if(status_code = 2) AS error_count FROM v_spans GROUP BY trace_id HAVING count_if(status_code = 2) > 2", f"{S} SELECT trace_id, min(ts) AS start_timestamp, CAST(count(*) FILTER (status = 2) AS BIGINT) AS error_count FROM spans GROUP BY 1 HAVING count(*) FILTER (status = 2) > 2")
