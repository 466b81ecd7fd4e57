"""LogQL queries and log discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.catalog import register
from sigloom.operators import discovery
from sigloom.plans import logql
from sigloom.sources import relations as R

WITH = f"WITH {R.LOGS_SQL} "
DAY, HOUR, MINUTE = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000
#: 2024-01-01 and ten days later.
T0 = 1_704_067_200_000_000_000
T1 = T0 + 10 * DAY


def stream(name: str, text: str, where: str, line: str = "message", limit: int = 200) -> None:
    @register(name, f"{WITH} SELECT off AS offset, {line} AS line FROM logs WHERE ts_ns BETWEEN {T0} AND {T1} AND {where} ORDER BY ts_ns DESC, off DESC LIMIT {limit}")
    def run(spark, sf_dir):
        return logql.stream_query(R.logs(spark, sf_dir), text, T0, T1, limit).select("offset", "line")


stream("logql_stream_eq", '{event_type="click"}', "event_type = 'click'")
stream("logql_stream_matchers", '{event_type=~"click|view", user!="3", missing=""}', "event_type IN ('click', 'view') AND usr <> '3'")
stream("logql_line_filter", '{} |= "user=1" != "cents=9" |~ "type=(view|error)"', "contains(message, 'user=1') AND NOT contains(message, 'cents=9') AND regexp_matches(message, 'type=(view|error)')")
stream("logql_logfmt_filter", '{} | logfmt | cents >= 4000 and type = "error"', "event_type = 'error' AND CAST(regexp_extract(message, 'cents=(-?[0-9]+)', 1) AS BIGINT) >= 4000")
stream("logql_regexp", '{} | regexp "user=(?P<who>[0-9]+) cents=(?P<amount>[0-9]+)" | who = "17"', "user_id = 17")
stream("logql_pattern", '{} | pattern "type=<kind> user=<_> cents=<c>" | kind =~ "sign.*" | c < 500', "event_type = 'signup' AND CAST(regexp_extract(message, 'cents=([0-9]+)', 1) AS BIGINT) < 500 AND regexp_matches(message, 'cents=[0-9]+$')")
stream("logql_line_format", '{event_type="view"} | logfmt | line_format "{{.type}}/{{.user_extracted}}:{{ __line__ }}"', "event_type = 'view'", "event_type || '/' || user_id || ':' || message")
stream("logql_label_format", '{event_type="view"} | label_format kind=event_type, both="{{.kind}}-{{.user}}" | line_format "{{.both}}"', "event_type = 'view'", "event_type || '-' || usr")
stream("logql_metadata_filter", '{} | k > 95', "CAST(k AS BIGINT) > 95")
stream("logql_drop_keep", '{event_type="error"} | drop user | line_format "{{.event_type}}{{.user}}"', "event_type = 'error'", "event_type")


@register("logql_json_path", f"SELECT event_id AS offset, json_extract_string(props, '$.k') AS line FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 98")
def logql_json_path(spark, sf_dir):
    logs = R.logs(spark, sf_dir, message=F.col("props"))
    return logql.pipeline(logql.entries(logs), logql.parse_selector('{} | json a="k" | a >= 98 | line_format "{{.a}}"')).select("offset", "line")


@register("logql_json_flatten", f"SELECT event_id AS offset, json_extract_string(props, '$.k') AS line FROM events WHERE event_type = 'view'")
def logql_json_flatten(spark, sf_dir):
    logs = R.logs(spark, sf_dir, message=F.col("props"))
    return logql.pipeline(logql.entries(logs), logql.parse_selector('{event_type="view"} | json | line_format "{{.k}}"')).select("offset", "line")


@register("logql_unpack", f"{WITH} SELECT off AS offset, 'user=' || user_id AS line FROM logs WHERE event_type = 'click'")
def logql_unpack(spark, sf_dir):
    packed = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","_entry":"user='), "user_id", F.lit('"}'))
    return logql.pipeline(logql.entries(R.logs(spark, sf_dir, message=packed)), logql.parse_selector('{} | unpack | kind = "click"')).select("offset", "line")


@register("logql_decolorize", f"{WITH} SELECT off AS offset, event_type || ' done' AS line FROM logs WHERE event_type = 'view'")
def logql_decolorize(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m do"), F.lit("\x1b[1;32mne"))
    return logql.pipeline(logql.entries(R.logs(spark, sf_dir, message=coloured)), logql.parse_selector('{event_type="view"} | decolorize')).select("offset", "line")


@register("logql_stream_labels", f"{WITH} SELECT off AS offset, event_type || '/' || usr || '/' || k || '/' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END AS labels FROM logs WHERE ts_ns BETWEEN {T0} AND {T1} AND event_type = 'error' ORDER BY ts_ns, off LIMIT 300")
def logql_stream_labels(spark, sf_dir):
    found = logql.stream_query(R.logs(spark, sf_dir), '{event_type="error"}', T0, T1, 300, forward=True)
    return found.select("offset", F.concat_ws("/", *[F.col("labels")[n] for n in ("event_type", "user", "k", "detected_level")]).alias("labels"))


@register("logql_delete_filter", f"{WITH} SELECT off AS offset FROM logs WHERE NOT (event_type = 'click' AND contains(message, 'user=1') AND ts_ns BETWEEN {T0} AND {T0 + 5 * DAY})")
def logql_delete_filter(spark, sf_dir):
    return logql.deleted(logql.entries(R.logs(spark, sf_dir)), [('{event_type="click"} |= "user=1"', T0, T0 + 5 * DAY)]).select("offset")


@register("detected_level", f"{WITH} SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END AS level, count(*) AS n FROM logs GROUP BY 1")
def detected_level(spark, sf_dir):
    return logql.entries(R.logs(spark, sf_dir)).groupBy(logql.detected_level().alias("level")).agg(F.count("*").alias("n"))


STEPS = "steps AS (SELECT i, {start} + i * {step} AS t FROM range(0, {n}) r(i))"


def metric(name: str, text: str, sql: str, start: int = T0 + DAY, step: int = 6 * HOUR, n: int = 20, digits: int = 6) -> None:
    """Register a metric query; in sql, `w` joins the logs to steps (i, t) whose window of {{width}} holds them."""
    steps = STEPS.format(start=start, step=step, n=n)

    @register(name, f"{WITH}, {steps} {sql}")
    def run(spark, sf_dir):
        out = logql.metric_query(R.logs(spark, sf_dir), text, start, start + (n - 1) * step, step)
        return out.select("t", "labels", F.round("value", digits).alias("value"))


def over(width: int, value: str, labels: str = "'event_type=' || event_type || ',user=' || usr", where: str = "true", having: str = "") -> str:
    return f"SELECT t, {labels} AS labels, round(CAST({value} AS DOUBLE), 6) AS value FROM steps JOIN logs ON ts_ns > t - {width} AND ts_ns <= t WHERE {where} GROUP BY t, {labels} {having}"


CENTS = "CAST(regexp_extract(message, 'cents=(-?[0-9]+)', 1) AS DOUBLE)"
SERIES = "'c=' || regexp_extract(message, 'cents=(-?[0-9]+)', 1) || ',event_type=' || event_type || ',user=' || usr"

metric("logql_count_over_time", 'count_over_time({event_type!="view"}[12h])', over(12 * HOUR, "count(*)", where="event_type <> 'view'"))
metric("logql_rate", "rate({}[5h])", over(5 * HOUR, "count(*) / 18000.0"))
metric("logql_bytes_over_time", 'bytes_over_time({user="1"}[1d])', over(DAY, "sum(strlen(message))", where="usr = '1'"))
metric("logql_bytes_rate", "sum(bytes_rate({}[12h]))", over(12 * HOUR, "sum(strlen(message)) / 43200.0", "''"))
metric("logql_sum_by", "sum by (event_type) (count_over_time({}[6h]))", over(6 * HOUR, "count(*)", "'event_type=' || event_type"))
metric("logql_sum_without", "sum without (user) (rate({}[6h]))", over(6 * HOUR, "count(*) / 21600.0", "'event_type=' || event_type"))
UNWRAP = '{event_type="purchase"} | regexp "cents=(?P<cents>[0-9]+)" | keep event_type, cents | unwrap cents | drop cents'
PERIOD = "{" + 'event_type="error"} | unwrap k'
K = "CAST(k AS DOUBLE)"
metric("logql_avg_unwrap", f"avg_over_time({PERIOD} [1d])", over(DAY, f"avg({K})", where="event_type = 'error'"))
metric("logql_sum_unwrap", f"sum_over_time({PERIOD} [1d])", over(DAY, f"sum({K})", where="event_type = 'error'"))
metric("logql_min_max", f"max_over_time({PERIOD} [1d]) - min_over_time({PERIOD} [1d])", over(DAY, f"max({K}) - min({K})", where="event_type = 'error'"))
metric("logql_first_last", f"last_over_time({PERIOD} [1d]) - first_over_time({PERIOD} [1d])", over(DAY, f"arg_max({K}, (ts_ns, off)) - arg_min({K}, (ts_ns, off))", where="event_type = 'error'"))
metric("logql_stddev", f"stddev_over_time({PERIOD} [1d])", over(DAY, f"stddev_pop({K})", where="event_type = 'error'"))
metric("logql_stdvar", f"stdvar_over_time({PERIOD} [1d])", over(DAY, f"var_pop({K})", where="event_type = 'error'"))
metric("logql_quantile", f"quantile_over_time(0.9, {PERIOD} [1d])", over(DAY, f"quantile_cont({K}, 0.9)", where="event_type = 'error'"))
metric(
    "logql_rate_counter",
    f"rate_counter({PERIOD} [1d])",
    f"""SELECT t, labels, round(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) / 86400.0, 6) AS value FROM
    (SELECT t, 'event_type=' || event_type || ',user=' || usr AS labels, {K} AS v, lag({K}) OVER (PARTITION BY t, usr ORDER BY ts_ns, off) AS p FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t WHERE event_type = 'error') GROUP BY 1, 2""",
)
metric(
    "logql_topk",
    "topk(3, sum by (event_type, user) (count_over_time({}[1d])))",
    f"SELECT t, labels, value FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value DESC, event_type, usr) AS n FROM (SELECT t, event_type, usr, 'event_type=' || event_type || ',user=' || usr AS labels, CAST(count(*) AS DOUBLE) AS value FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t GROUP BY 1, 2, 3)) WHERE n <= 3",
)
metric(
    "logql_bottomk_by",
    "bottomk by (event_type) (1, count_over_time({}[1d]))",
    f"SELECT t, labels, value FROM (SELECT *, row_number() OVER (PARTITION BY t, event_type ORDER BY value, usr) AS n FROM (SELECT t, event_type, usr, 'event_type=' || event_type || ',user=' || usr AS labels, CAST(count(*) AS DOUBLE) AS value FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t GROUP BY 1, 2, 3)) WHERE n = 1",
)
metric("logql_absent", 'absent_over_time({event_type="error", user="7"}[1h])', f"SELECT t, '' AS labels, CAST(1 AS DOUBLE) AS value FROM steps WHERE NOT EXISTS (SELECT 1 FROM logs WHERE event_type = 'error' AND usr = '7' AND ts_ns > t - {HOUR} AND ts_ns <= t)")
BY = f"SELECT t, event_type, CAST(count(*) AS DOUBLE) AS v FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t WHERE {{where}} GROUP BY 1, 2"
SUMS = "sum by (event_type) (count_over_time({{{0}}}[1d]))"
IN_ONE_TO_FIVE = "usr BETWEEN '1' AND '5'"
metric("logql_arith", f"({SUMS.format('')} * 2 + 1) % 7 ^ 2", f"SELECT t, 'event_type=' || event_type AS labels, pow(v * 2 + 1, 1) % 49 AS value FROM ({BY.format(where='true')})")
metric("logql_compare_filter", f"{SUMS.format('')} > 60", f"SELECT t, 'event_type=' || event_type AS labels, v AS value FROM ({BY.format(where='true')}) WHERE v > 60")
metric("logql_compare_bool", f"{SUMS.format('')} >= bool 60", f"SELECT t, 'event_type=' || event_type AS labels, CAST(v >= 60 AS DOUBLE) AS value FROM ({BY.format(where='true')})")
metric(
    "logql_binary_match",
    f"{SUMS.format('user=~`[1-5]`')} / on(event_type) {SUMS.format('')}",
    f"SELECT t, 'event_type=' || event_type AS labels, round(a.v / b.v, 6) AS value FROM ({BY.format(where=IN_ONE_TO_FIVE)}) a JOIN ({BY.format(where='true')}) b USING (t, event_type)",
)
metric(
    "logql_group_left",
    f"count_over_time({{}}[1d]) / on(event_type) group_left() {SUMS.format('')}",
    f"SELECT t, 'event_type=' || event_type || ',user=' || usr AS labels, round(a.v / b.v, 6) AS value FROM (SELECT t, event_type, usr, CAST(count(*) AS DOUBLE) AS v FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t GROUP BY 1, 2, 3) a JOIN ({BY.format(where='true')}) b USING (t, event_type)",
)
metric("logql_sort", f"sort_desc({SUMS.format('')})", f"SELECT t, 'event_type=' || event_type AS labels, v AS value FROM ({BY.format(where='true')})")
for op, sql in (("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "CAST(count(*) AS DOUBLE)"), ("stddev", "stddev_pop(v)"), ("stdvar", "var_pop(v)")):
    metric(f"logql_agg_{op}", f"{op} by (user) (count_over_time({{}}[1d]))", f"SELECT t, 'user=' || usr AS labels, round({sql}, 6) AS value FROM (SELECT t, usr, event_type, CAST(count(*) AS DOUBLE) AS v FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t GROUP BY 1, 2, 3) GROUP BY 1, 2")
metric(
    "logql_group_right",
    f"{SUMS.format('')} / on(event_type) group_right() count_over_time({{}}[1d])",
    f"SELECT t, 'event_type=' || event_type || ',user=' || usr AS labels, round(b.v / a.v, 6) AS value FROM (SELECT t, event_type, usr, CAST(count(*) AS DOUBLE) AS v FROM steps JOIN logs ON ts_ns > t - {DAY} AND ts_ns <= t GROUP BY 1, 2, 3) a JOIN ({BY.format(where='true')}) b USING (t, event_type)",
)
metric("logql_and", f"{SUMS.format('')} and on(event_type) ({SUMS.format('')} > 60)", f"SELECT t, 'event_type=' || event_type AS labels, v AS value FROM ({BY.format(where='true')}) WHERE v > 60")
metric("logql_unless", f"{SUMS.format('')} unless ({SUMS.format('')} > 60)", f"SELECT t, 'event_type=' || event_type AS labels, v AS value FROM ({BY.format(where='true')}) WHERE v <= 60")
metric("logql_or", f"({SUMS.format('')} > 70) or ({SUMS.format('')} * 10)", f"SELECT t, 'event_type=' || event_type AS labels, CASE WHEN v > 70 THEN v ELSE v * 10 END AS value FROM ({BY.format(where='true')})")


@register("index_stats", f"{WITH} SELECT count(DISTINCT (event_type, usr)) AS streams, count(*) AS entries, CAST(sum(strlen(message)) AS BIGINT) AS bytes FROM logs WHERE ts_ns BETWEEN {T0} AND {T1}")
def index_stats(spark, sf_dir):
    return discovery.index_stats(R.logs(spark, sf_dir), "{}", T0, T1)


@register("volume", f"{WITH} SELECT 'event_type=' || event_type AS labels, CAST(sum(strlen(message)) AS BIGINT) AS bytes FROM logs WHERE ts_ns BETWEEN {T0} AND {T1} GROUP BY 1")
def volume(spark, sf_dir):
    return discovery.volume(R.logs(spark, sf_dir), "{}", T0, T1, ["event_type"])


@register("label_names", "SELECT * FROM (VALUES ('event_type'), ('user')) v(name)")
def label_names(spark, sf_dir):
    return discovery.label_names(R.logs(spark, sf_dir))


@register("label_values", f"{WITH} SELECT DISTINCT usr AS value FROM logs")
def label_values(spark, sf_dir):
    return discovery.label_values(R.logs(spark, sf_dir), "user")


@register("series", f"{WITH} SELECT DISTINCT 'event_type=' || event_type || ',user=' || usr AS labels FROM logs WHERE event_type = 'click'")
def series(spark, sf_dir):
    return discovery.series(R.logs(spark, sf_dir), '{event_type="click"}')


@register("patterns", f"{WITH} SELECT {T0} + ((ts_ns - {T0}) // {DAY}) * {DAY} AS bucket, regexp_replace(message, '[A-Za-z0-9_./:-]*[0-9][A-Za-z0-9_./:-]*', '<_>', 'g') AS pattern, count(*) AS n FROM logs WHERE ts_ns BETWEEN {T0} AND {T1} GROUP BY 1, 2")
def patterns(spark, sf_dir):
    return discovery.patterns(R.logs(spark, sf_dir), "{}", T0, T1, DAY)


@register(
    "detected_fields",
    f"""{WITH}, kv AS (SELECT 'type' AS field, event_type AS v FROM logs UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM logs UNION ALL SELECT 'cents', regexp_extract(message, 'cents=(-?[0-9]+)', 1) FROM logs UNION ALL SELECT 'k', k FROM logs)
    SELECT field, CASE field WHEN 'k' THEN '' ELSE 'logfmt' END AS parsers, CASE WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+$')) THEN 'int' ELSE 'string' END AS type, count(DISTINCT v) AS cardinality FROM kv GROUP BY 1""",
)
def detected_fields(spark, sf_dir):
    return discovery.detected_fields(R.logs(spark, sf_dir)).withColumn("parsers", F.array_join("parsers", ","))


@register("label_values_in_range", f"{WITH} SELECT DISTINCT usr AS value FROM logs WHERE event_type = 'error' AND ts_ns BETWEEN {T0} AND {T0 + DAY // 4}")
def label_values_in_range(spark, sf_dir):
    return discovery.label_values(R.logs(spark, sf_dir), "user", '{event_type="error"}', T0, T0 + DAY // 4)


@register("detected_field_values", "SELECT DISTINCT event_type AS value FROM events")
def detected_field_values(spark, sf_dir):
    return discovery.detected_field_values(R.logs(spark, sf_dir), "type")
