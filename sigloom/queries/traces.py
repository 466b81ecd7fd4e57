"""TraceQL queries, correlation and trace discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.catalog import register
from sigloom.operators import correlation
from sigloom.plans import traceql
from sigloom.sources import relations as R

WITH = f"WITH {R.SPANS_SQL} "
CONV = f"WITH RECURSIVE {R.CONVERSATIONS_SQL} "
START, DAY = 757_382_400_000_000_000, 86_400_000_000_000
END = START + 4000 * DAY


def spans(name: str, text: str, sql: str, source=R.spans) -> None:
    @register(name, sql)
    def run(spark, sf_dir):
        return traceql.selected(source(spark, sf_dir), traceql.parse(text)).select("trace_id", "span_id")


def flat(name: str, text: str, where: str) -> None:
    spans(name, text, f"{WITH} SELECT trace_id, span_id FROM spans s WHERE {where}")


flat("traceql_filter", '{ name = "line" && span.quantity > 40 && status = 2 || duration > 99s && .priority = "1-URGENT" }', "name = 'line' AND CAST(quantity AS INT) > 40 AND status = 2 OR duration > 99000000000 AND priority = '1-URGENT'")
flat("traceql_regex", '{ resource.service.name =~ "wh-[12]" && span.flag != "N" && span.flag !~ "A" }', "regexp_full_match(service, 'wh-[12]') AND flag <> 'N' AND flag <> 'A'")
flat("traceql_nil", "{ span.flag = nil && kind = 2 }", "flag IS NULL AND kind = 2")
flat("traceql_not_nil", "{ span.priority != nil }", "priority IS NOT NULL")
flat("traceql_child", '{ span.status = "O" } > { span.flag = "R" }', "flag = 'R' AND EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND p.ostatus = 'O')")
flat("traceql_parent", '{ span.flag = "R" && span.quantity >= 48 } < { name = "order" }', "name = 'order' AND EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.span_id AND c.flag = 'R' AND CAST(c.quantity AS INT) >= 48)")
flat("traceql_sibling", '{ span.quantity = 50 } ~ { span.flag = "A" }', "flag = 'A' AND EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.parent_span_id AND c.span_id <> s.span_id AND c.quantity = '50')")
flat("traceql_not_child", '{ span.status = "F" } !> { span.flag = "R" }', "flag = 'R' AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND p.ostatus = 'F')")
flat("traceql_union_child", '{ span.status = "P" } &> { span.quantity > 48 }', "coalesce(CAST(quantity AS INT) > 48, false) AND EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND p.ostatus = 'P') OR coalesce(ostatus = 'P', false) AND EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.span_id AND CAST(c.quantity AS INT) > 48)")
flat("traceql_not_parent", '{ span.flag = "R" } !< { name = "order" }', "name = 'order' AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.span_id AND c.flag = 'R')")
flat("traceql_not_sibling", '{ span.quantity = 50 } !~ { span.flag = "A" }', "flag = 'A' AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.parent_span_id AND c.span_id <> s.span_id AND c.quantity = '50')")
flat("traceql_union_parent", '{ span.quantity > 48 } &< { span.status = "P" }', "coalesce(ostatus = 'P', false) AND EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.span_id AND CAST(c.quantity AS INT) > 48) OR coalesce(CAST(quantity AS INT) > 48, false) AND EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND p.ostatus = 'P')")
OTHER = "EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.parent_span_id AND c.span_id <> s.span_id AND {})"
flat("traceql_union_sibling", '{ span.quantity = 50 } &~ { span.flag = "A" }', f"coalesce(flag = 'A', false) AND {OTHER.format('c.quantity = 50')} OR coalesce(quantity = '50', false) AND {OTHER.format("c.flag = 'A'")}")
flat("traceql_precedence", '{ span.flag = "R" } || { span.flag = "A" } > { name = "nothing" }', "coalesce(flag = 'R', false)")
flat("traceql_sum_min_max", '{ name = "line" } | sum(span.quantity) > 100 | min(span.quantity) > 2 | max(span.quantity) <= 49', "name = 'line' AND trace_id IN (SELECT trace_id FROM spans WHERE name = 'line' GROUP BY 1 HAVING sum(CAST(quantity AS INT)) > 100 AND min(CAST(quantity AS INT)) > 2 AND max(CAST(quantity AS INT)) <= 49)")


@register("traceql_select", f"{WITH} SELECT trace_id, span_id, quantity, service FROM spans WHERE flag = 'R'")
def traceql_select(spark, sf_dir):
    out = traceql.selected(R.spans(spark, sf_dir), traceql.parse('{ span.flag = "R" } | select(span.quantity, resource.service.name)'))
    return out.select("trace_id", "span_id", F.col("`select:span.quantity`").alias("quantity"), F.col("`select:resource.service.name`").alias("service"))


flat("traceql_and", '{ span.flag = "R" } && { span.quantity > 47 }', "(coalesce(flag = 'R', false) OR coalesce(CAST(quantity AS INT) > 47, false)) AND trace_id IN (SELECT trace_id FROM spans WHERE flag = 'R') AND trace_id IN (SELECT trace_id FROM spans WHERE CAST(quantity AS INT) > 47)")
flat("traceql_or", '{ span.quantity = 1 } || { span.priority = "5-LOW" }', "coalesce(quantity = '1', false) OR coalesce(priority = '5-LOW', false)")
flat("traceql_trace_fields", '{ rootName = "order" && rootServiceName = "shop" && traceDuration > 100s && name = "line" }', "name = 'line' AND trace_id IN (SELECT trace_id FROM spans GROUP BY 1 HAVING max(ts + duration) - min(ts) > 100000000000 AND count(*) FILTER (parent_span_id IS NULL) > 0)")
flat("traceql_by_count", '{ name = "line" } | by(span.flag) | count() >= 3', "name = 'line' AND (trace_id, flag) IN (SELECT (trace_id, flag) FROM spans WHERE name = 'line' GROUP BY trace_id, flag HAVING count(*) >= 3)")
flat("traceql_avg", '{ name = "line" } | avg(span.quantity) > 45 | count() > 1', "name = 'line' AND trace_id IN (SELECT trace_id FROM spans WHERE name = 'line' GROUP BY 1 HAVING avg(CAST(quantity AS DOUBLE)) > 45 AND count(*) > 1)")
CLOSURE = "up AS (SELECT conv_id, turn, turn - 1 AS a FROM cspans WHERE turn > 0 UNION ALL SELECT up.conv_id, up.turn, up.a - 1 FROM up WHERE up.a > 0)"
IDS = "lpad(lower(to_hex(s.conv_id + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(s.turn + 1)), 16, '0') AS span_id"
RELATED = f"{CONV}, {CLOSURE} SELECT {IDS} FROM cspans s WHERE "
spans("traceql_descendant", '{ name = "assistant" } >> { duration > 500ms }', RELATED + "s.duration > 500000000 AND EXISTS (SELECT 1 FROM up JOIN cspans p ON p.conv_id = up.conv_id AND p.turn = up.a WHERE up.conv_id = s.conv_id AND up.turn = s.turn AND p.role = 'assistant')", R.conversation_spans)
spans("traceql_ancestor", '{ duration > 1s } << { name = "user" }', RELATED + "s.role = 'user' AND EXISTS (SELECT 1 FROM up JOIN cspans c ON c.conv_id = up.conv_id AND c.turn = up.turn WHERE up.conv_id = s.conv_id AND up.a = s.turn AND c.duration > 1000000000)", R.conversation_spans)
spans("traceql_not_descendant", '{ name = "system" } !>> { name = "user" }', RELATED + "s.role = 'user' AND NOT EXISTS (SELECT 1 FROM up JOIN cspans p ON p.conv_id = up.conv_id AND p.turn = up.a WHERE up.conv_id = s.conv_id AND up.turn = s.turn AND p.role = 'system')", R.conversation_spans)
spans("traceql_union", '{ name = "system" } &>> { duration > 1s }', RELATED + "s.duration > 1000000000 AND EXISTS (SELECT 1 FROM up JOIN cspans p ON p.conv_id = up.conv_id AND p.turn = up.a WHERE up.conv_id = s.conv_id AND up.turn = s.turn AND p.role = 'system') OR s.role = 'system' AND EXISTS (SELECT 1 FROM up JOIN cspans c ON c.conv_id = up.conv_id AND c.turn = up.turn WHERE up.conv_id = s.conv_id AND up.a = s.turn AND c.duration > 1000000000)", R.conversation_spans)


spans("traceql_not_ancestor", '{ duration > 1s } !<< { name = "user" }', RELATED + "s.role = 'user' AND NOT EXISTS (SELECT 1 FROM up JOIN cspans c ON c.conv_id = up.conv_id AND c.turn = up.turn WHERE up.conv_id = s.conv_id AND up.a = s.turn AND c.duration > 1000000000)", R.conversation_spans)
spans("traceql_union_ancestor", '{ duration > 1s } &<< { name = "system" }', RELATED + "s.role = 'system' AND EXISTS (SELECT 1 FROM up JOIN cspans c ON c.conv_id = up.conv_id AND c.turn = up.turn WHERE up.conv_id = s.conv_id AND up.a = s.turn AND c.duration > 1000000000) OR s.duration > 1000000000 AND EXISTS (SELECT 1 FROM up JOIN cspans p ON p.conv_id = up.conv_id AND p.turn = up.a WHERE up.conv_id = s.conv_id AND up.turn = s.turn AND p.role = 'system')", R.conversation_spans)


@register(
    "traceql_search",
    f"{WITH} SELECT trace_id, min(ts) AS start, max(ts + duration) AS \"end\", count(*) AS spans, CAST(count(*) FILTER (status = 2) AS BIGINT) AS errors, arg_min(name, (ts, span_id)) FILTER (parent_span_id IS NULL) AS root_name FROM spans WHERE flag = 'R' OR ostatus = 'F' GROUP BY 1 ORDER BY start DESC, trace_id LIMIT 30",
)
def traceql_search(spark, sf_dir):
    return traceql.search(R.spans(spark, sf_dir), '{ span.flag = "R" || span.status = "F" }', limit=30)


@register("trace_by_id", f"{WITH} SELECT trace_id, span_id FROM spans WHERE trace_id = '00000000000000000000000000000010'")
def trace_by_id(spark, sf_dir):
    return traceql.selected(R.spans(spark, sf_dir), traceql.parse('{ trace:id = "00000000000000000000000000000010" }')).select("trace_id", "span_id")


STEP = 400 * DAY
BUCKET = f"least({START} + (greatest(ts - {START}, 0) // {STEP} + 1) * {STEP}, {END})"
IN = f"ts + duration >= {START} AND ts < {END}"


def metric(name: str, text: str, sql: str) -> None:
    @register(name, f"{WITH} {sql}")
    def run(spark, sf_dir):
        out = traceql.metrics(R.spans(spark, sf_dir), text, START, END, STEP)
        return out.select("t", "labels", F.round("value", 8).alias("value"))


metric("traceql_rate", '{ name = "line" } | rate() by(span.flag)', f"SELECT {BUCKET} AS t, 'span.flag=' || flag AS labels, round(count(*) / {STEP / 1e9}, 8) AS value FROM spans WHERE name = 'line' AND {IN} GROUP BY 1, 2")
metric("traceql_count", '{ status = 2 } | count_over_time() by(resource.service.name) > 5', f"SELECT {BUCKET} AS t, 'resource.service.name=' || service AS labels, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE status = 2 AND {IN} GROUP BY 1, 2 HAVING count(*) > 5")
metric("traceql_avg_over_time", '{ name = "line" } | avg_over_time(span.quantity)', f"SELECT {BUCKET} AS t, '' AS labels, round(avg(CAST(quantity AS DOUBLE)), 8) AS value FROM spans WHERE name = 'line' AND {IN} GROUP BY 1")
metric("traceql_quantile", '{ name = "line" } | quantile_over_time(span.quantity, 0.5, 0.99) by(span.flag)', f"SELECT {BUCKET} AS t, 'p=' || q || ',span.flag=' || flag AS labels, round(CASE q WHEN '0.5' THEN quantile_cont(CAST(quantity AS DOUBLE), 0.5) ELSE quantile_cont(CAST(quantity AS DOUBLE), 0.99) END, 8) AS value FROM spans, (VALUES ('0.5'), ('0.99')) v(q) WHERE name = 'line' AND {IN} GROUP BY 1, flag, q")
metric(
    "traceql_topk",
    '{ name = "line" } | max_over_time(span.quantity) by(span.flag) | topk(2)',
    f"SELECT t, labels, value FROM (SELECT *, max(last) OVER (PARTITION BY labels) AS l FROM (SELECT *, arg_max(value, t) OVER (PARTITION BY labels) AS last FROM (SELECT {BUCKET} AS t, 'span.flag=' || flag AS labels, max(CAST(quantity AS DOUBLE)) AS value FROM spans WHERE name = 'line' AND {IN} GROUP BY 1, 2))) WHERE labels IN (SELECT labels FROM (SELECT labels, arg_max(value, t) AS last FROM (SELECT {BUCKET} AS t, 'span.flag=' || flag AS labels, max(CAST(quantity AS DOUBLE)) AS value FROM spans WHERE name = 'line' AND {IN} GROUP BY 1, 2) GROUP BY 1 ORDER BY last DESC, labels LIMIT 2))",
)


@register("traceql_exemplars", f"{WITH} SELECT {BUCKET} AS t, 'span.flag=' || flag AS labels, CAST(count(*) AS DOUBLE) AS value, arg_min(trace_id || '/' || span_id, (ts, trace_id, span_id)) AS exemplar FROM spans WHERE name = 'line' AND {IN} GROUP BY 1, 2")
def traceql_exemplars(spark, sf_dir):
    out = traceql.metrics(R.spans(spark, sf_dir), '{ name = "line" } | count_over_time() by(span.flag)', START, END, STEP, exemplars=True)
    return out.select("t", "labels", "value", F.concat_ws("/", "exemplar.trace_id", "exemplar.span_id").alias("exemplar"))


@register("tag_names", "SELECT * FROM (VALUES ('priority'), ('status'), ('flag'), ('quantity')) v(name)")
def tag_names(spark, sf_dir):
    return traceql.tag_names(R.spans(spark, sf_dir), "span")


@register("tag_values", "SELECT DISTINCT 'wh-' || (l_suppkey % 5) AS value FROM lineitem UNION SELECT 'shop'")
def tag_values(spark, sf_dir):
    return traceql.tag_values(R.spans(spark, sf_dir), "resource.service.name")


@register(
    "correlation_lookup",
    f"WITH {R.LOGS_SQL} SELECT 'logs' AS signal, off AS offset FROM logs WHERE usr = '3' AND user_id = 13 UNION ALL SELECT 'metrics', off FROM (SELECT off FROM logs WHERE false)",
)
def correlation_lookup(spark, sf_dir):
    postings = correlation.postings(logs=R.logs(spark, sf_dir), points=R.gauge_points(spark, sf_dir))
    return correlation.lookup(postings, [("resource", "r3"), ("trace", "0000000000000000000000000000000d")], limit=None).select("signal", "offset")


@register("correlation_by_resource", f"WITH {R.LOGS_SQL} SELECT signal, off AS offset FROM (SELECT 'logs' AS signal, off FROM logs WHERE usr = '4' UNION ALL SELECT 'metrics', off FROM logs WHERE usr = '4') ORDER BY signal, off LIMIT 1000")
def correlation_by_resource(spark, sf_dir):
    postings = correlation.postings(logs=R.logs(spark, sf_dir), points=R.gauge_points(spark, sf_dir))
    return correlation.lookup(postings, [("resource", "r4")]).select("signal", "offset")
