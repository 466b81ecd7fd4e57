"""Expected values of the surfaces, over small fixed rows."""

import pytest
from pyspark.sql import functions as F

from sigloom import shared
from sigloom.functions import tokens as T
from sigloom.functions import units
from sigloom.operators import correlation, rollup, search, winners
from sigloom.plans import logql, promql, traceql
from sigloom.plans.vectors import QueryError
from sigloom.sinks import encode
from sigloom.sources import readers
from sigloom.streaming import live
from sigloom.streaming.run import drain

S = 1_000_000_000


def hits(spark, texts, test):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, message string")
    return [r.i for r in df.filter(test(F.col("message"))).orderBy("i").collect()]


def test_tokens_and_terms(spark):
    texts = ["cannot access storage", "cannot_access storage", "Cannot access", "é-access", "a a a b", "access denied", "storagé"]
    assert hits(spark, texts, lambda m: T.has_token(m, "access")) == [0, 2, 3, 5]
    assert hits(spark, texts, lambda m: T.has_token(m, "CANNOT", True)) == [0, 2]
    assert hits(spark, texts, lambda m: T.has_token(m, "not access")) == []
    assert hits(spark, texts, lambda m: T.has_term(m, "Access")) == [0, 1, 2, 3, 5]
    assert hits(spark, texts, lambda m: T.has_phrase(m, ["a", "a", "b"])) == [4]
    assert hits(spark, texts, lambda m: T.has_phrase(m, ["cannot", "storage"], 1)) == [0]
    assert hits(spark, texts, lambda m: T.has_phrase(m, ["cannot", "storage"], 0)) == []
    assert hits(spark, texts, lambda m: T.has_fuzzy(m, "storag", 1)) == [0, 1, 6]
    assert hits(spark, texts, lambda m: T.has_token_prefix(m, "den")) == [5]
    assert hits(spark, texts, lambda m: T.has_token_like(m, "^acc.*s$")) == [0, 2, 3, 5]


def test_all_tokens(spark):
    texts = ["a b", "b x a", "ab", "a"]
    assert hits(spark, texts, lambda m: T.has_all_tokens(m, ["a", "b"])) == hits(spark, texts, lambda m: T.has_token(m, "a") & T.has_token(m, "b"))


def test_requests_are_checked():
    for bad in ["nope=1", "relation=other", "columns=offset,offset", "columns=nope", "start_ns=5&end_ns=5", "order=timestamp_desc", "message_any=a&message_min_match=2", "group_by=body", "trace_id=00", "field_numeric=k:ge:x", "message_regex=(?=a)", "limit=1&limit=2"]:
        with pytest.raises(ValueError):
            search.parse([tuple(p.split("=", 1)) for p in bad.split("&")])


def log_rows(spark, lines, labels=None):
    rows = [((i + 1) * S, i, line, (labels or [{"app": "api"}] * len(lines))[i], {}) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "timestamp bigint, offset bigint, message string, labels map<string,string>, metadata map<string,string>")


def run_pipeline(spark, line, text):
    return logql.pipeline(logql.entries(log_rows(spark, [line])), logql.parse_selector(text)).collect()


def test_logql_pipelines(spark):
    row = run_pipeline(spark, '{"method":"GET","status":"500","duration":"42ms"}', '{app="api"} | json | duration >= 40ms and status =~ "5.." | label_format code=status | drop duration | line_format "{{.method}} {{.code}} {{__line__}}"')[0]
    assert row.labels == {"app": "api", "method": "GET", "code": "500"} and row.line.startswith('GET 500 {"method"')
    assert run_pipeline(spark, "user=alice ok", '{} | regexp "user=(?P<user>\\\\w+)"')[0].labels["user"] == "alice"
    assert len(run_pipeline(spark, "status=500 duration=42ms", "{} | logfmt | status = `500` and duration > 41ms")) == 1
    assert run_pipeline(spark, "request GET /health", '{} | pattern "request <method> <path>"')[0].labels["path"] == "/health"
    row = run_pipeline(spark, '{"_entry":"\\u001b[31mfailed\\u001b[0m","pod":"a"}', "{} | unpack | decolorize")[0]
    assert (row.line, row.labels["pod"]) == ("failed", "a")
    assert run_pipeline(spark, "not json", '{} | json | __error__ != ""')[0].labels["__error__"] == "JSONParserErr"
    assert run_pipeline(spark, '{"a":{"b":1,"c":[2]},"app":"x","n":null}', "{} | json")[0].labels == {"app": "api", "a_b": "1", "app_extracted": "x", "n": ""}


def test_logql_metrics(spark):
    logs = log_rows(spark, ["duration=100ms", "duration=300ms"], [{"app": "api", "pod": "a"}, {"app": "api", "pod": "b"}])

    def values(text):
        return sorted((r.labels, round(r.value, 6)) for r in logql.instant_query(logs, text, 2 * S).collect())

    assert values('sum by (app) (count_over_time({app="api"}[2s]))') == [("app=api", 2.0)]
    assert [v for _, v in values("avg_over_time({} | logfmt | unwrap duration [2s])")] == [0.1, 0.3]
    assert values("sum(count_over_time({}[2s])) > bool 1") == [("", 1.0)]
    assert values("count_over_time({}[1s])") == [("app=api,pod=b", 1.0)]
    for bad in ["sum(rate({}[1s])", "topk(0, rate({}[1s]))", "rate({} | unwrap x [1s])", "sum_over_time({}[1s])", "{} | a = `1` or b = `2`", "{} | line_format `{{ .a | lower }}`", "{a=`1`} |= "]:
        with pytest.raises(QueryError):
            logql.instant_query(logs, bad, S) if not bad.startswith("{") else logql.stream_query(logs, bad, 0, S)


def points(spark, rows):
    return spark.createDataFrame([(n, ts * 1_000_000, i, labels, float(v)) for i, (n, labels, ts, v) in enumerate(rows)], "name string, timestamp bigint, offset bigint, labels map<string,string>, value double")


def test_promql_counters(spark):
    p = points(spark, [("c", {}, t, v) for t, v in ((1000, 8), (2000, 10), (3000, 2), (4000, 4))])
    for text, want in (("rate(c[10s])", 2.0), ("irate(c[10s])", 2.0), ("increase(c[10s])", 6.0), ("resets(c[10s])", 1.0), ("changes(c[10s])", 3.0), ("delta(c[10s])", -4.0), ("c", 4.0), ("sgn(c - 4)", 1.0), ("c / 0", float("inf"))):
        assert promql.instant_query(p, text, 4000).first().value == want, text
    assert promql.instant_query(p, "max_over_time(up[5m:1m])", 4000).count() == 0


def test_promql_matching(spark):
    p = points(spark, [("left", {"job": "a", "inst": "1"}, 1000, 2), ("left", {"job": "a", "inst": "2"}, 1000, 3), ("right", {"job": "a", "zone": "west"}, 1000, 4), ("x", {"k": "1"}, 1000, 1), ("x", {"k": "2"}, 1000, 2), ("y", {"k": "1"}, 1000, 10), ("y", {"k": "3"}, 1000, 30)])
    got = {r.labels: r.value for r in promql.instant_query(p, "left * on(job) group_left(zone) right", 1000).collect()}
    assert got == {"inst=1,job=a,zone=west": 8.0, "inst=2,job=a,zone=west": 12.0}
    assert [r.value for r in promql.instant_query(p, "x and y", 1000).collect()] == [1.0]
    assert sorted(r.value for r in promql.instant_query(p, "x or y", 1000).collect()) == [1.0, 2.0, 30.0]
    assert [r.value for r in promql.instant_query(p, "x unless y", 1000).collect()] == [2.0]
    with pytest.raises(Exception, match="many-to-many"):
        promql.instant_query(p, "right * on(job) left", 1000).collect()
    for bad in ["topk(1, x)", "histogram_quantile(0.9, x)", "x[5m]", "x bool 1", "1 > 2", "rate(x)", "label_replace(x)"]:
        with pytest.raises(QueryError):
            promql.instant_query(p, bad, 1000)


def tree(spark, rows):
    spans = [("t", "x", str(s), str(p) if p else None, n, s * S, (s + 1) * S, S, 1, 0, a, {}) for s, p, n, a in rows]
    return spark.createDataFrame(spans, "tenant string, trace_id string, span_id string, parent_span_id string, name string, timestamp bigint, end_timestamp bigint, duration_nanos bigint, kind int, status_code int, attributes map<string,string>, resource_attributes map<string,string>")


def found(spans, text):
    return sorted(r.span_id for r in traceql.selected(spans, traceql.parse(text)).collect())


def test_traceql_structure(spark):
    spans = tree(spark, [(1, None, "root", {}), (2, 1, "child", {}), (3, 2, "grandchild", {}), (4, 1, "sibling", {}), (5, None, "orphan", {})])
    named = lambda n: f'{{ name = "{n}" }}'
    for text, want in ((f"{named('root')} >> {named('grandchild')}", ["3"]), (f"{named('child')} ~ {named('sibling')}", ["4"]), (f"{named('root')} !>> {named('orphan')}", ["5"]), (f"{named('root')} &> {named('child')}", ["1", "2"]), (f"{named('grandchild')} << {named('root')}", ["1"]), (f"{named('child')} !~ {named('sibling')}", []), (f"{named('nope')} && {named('root')}", []), (f"{named('root')} &>> {named('grandchild')}", ["1", "3"])):
        assert found(spans, text) == want, text
    cyclic = tree(spark, [(1, 2, "a", {}), (2, 1, "b", {}), (3, 3, "c", {})])
    assert found(cyclic, '{ name = "a" } >> { name = "b" }') == ["2"]


def test_traceql_values(spark):
    spans = tree(spark, [(1, None, "a", {"roles": '["reader","writer"]', "n": "7"}), (2, 1, "w", {}), (3, 1, "w", {})])
    assert found(spans, '{ span.roles = "writer" }') == ["1"] and found(spans, '{ span.roles != "reader" }') == []
    assert found(spans, "{ span.missing = nil }") == ["1", "2", "3"] and found(spans, '{ span.roles =~ "writ" }') == []
    assert found(spans, "{ .n > 6 }") == ["1"] and found(spans, '{ .n > "x" }') == [] and found(spans, "{ .missing != 1 }") == []
    assert found(spans, '{ name != "" } | by(name) | count() >= 2 | select(name, duration)') == ["2", "3"]
    for bad in ["{ (a = 1) }", "{ a = 1 } | compare({})", "{ a = 1 } | histogram_over_time(duration)", "{ a }", "{} |"]:
        with pytest.raises(QueryError):
            traceql.parse(bad)


def test_counter_rollup(spark):
    rows = spark.createDataFrame([(t, "s", i, float(v) * n) for t, n in (("a", 1), ("b", 10)) for i, v in enumerate((4, 9, 2))], "tenant string, series_id string, offset bigint, value double")
    assert sorted(tuple(r) for r in rollup.counters(rows).collect()) == [("a", "s", 11.0, 1, 3), ("b", "s", 110.0, 1, 3)]
    hist = spark.createDataFrame([("t", "h", 3, 1, {1: 2, 5: 1}, {}, 4, 2.0), ("t", "h", 3, 0, {1: 1}, {-2: 1}, 2, 1.0)], "tenant string, series_id string, scale int, zero_count bigint, positive map<int,bigint>, negative map<int,bigint>, count bigint, sum double")
    row = rollup.exponential_histograms(hist).first()
    assert row.positive == {1: 3, 5: 1} and row.negative == {-2: 1} and (row.zero_count, row["count"]) == (1, 6)


def test_winners_and_correlation(spark):
    rows = spark.createDataFrame([("t", "s", 1, 5, 1.0), ("t", "s", 1, 7, 2.0), ("t", "s", 2, 6, 3.0)], "tenant string, series_id string, timestamp bigint, offset bigint, value double")
    assert sorted((r.timestamp, r.value) for r in winners.winning_points(rows).collect()) == [(1, 2.0), (2, 3.0)]
    logs = spark.createDataFrame([("t", "logs", 0, i, i, f"{i % 2}", "r", {"a": "x"}) for i in range(4)], "tenant string, signal string, partition int, offset bigint, timestamp bigint, trace_id string, resource_id string, attributes map<string,string>")
    key = spark.range(1).select(correlation.fingerprint("string", F.lit("a"), F.lit("x"))).first()[0]
    found_ = correlation.lookup(correlation.postings(logs=logs), [("resource", "r"), ("attribute", key), ("trace", "1")])
    assert [r.offset for r in found_.collect()] == [1, 3] and correlation.lookup(correlation.postings(logs=logs), []).count() == 0


def test_units():
    assert units.parse_time_ns("1970-01-01T00:00:01.000000002Z") == 1_000_000_002 and units.parse_time_ns("1970-01-01T01:00:01+01:00") == S
    assert units.compound_ns("1h30m") == 5_400 * S and units.duration_ns("1.5s", fraction=True) == 1_500_000_000
    with pytest.raises(ValueError):
        units.duration_ns("1.5s")
    assert [units.prometheus_time_ms(t) for t in ("1.0005", "2", "-1.5", "0.0004")] == [1001, 2000, -1500, 0]
    assert [units.trace_time_ns(t) for t in ("2", "20000000000", "1970-01-01T00:00:02Z")] == [2 * S, 20 * S, 2 * S]
    assert units.delete_time_ns("3") == 3 * S and units.delete_time_ns("1.5") == 1_500_000_000 and units.parse_time_ns("3") == 3
    for parse, bad in ((units.prometheus_time_ms, "nan"), (units.trace_time_ns, "-1"), (units.trace_time_ns, "x")):
        with pytest.raises(ValueError):
            parse(bad)


SERIES = "tenant string, series_id string, timestamp bigint, offset bigint, value double, arrival bigint"


def test_points_are_judged_on_arrival(spark, tmp_path):
    minute = 60 * S
    # (timestamp, offset, value) as they arrive.
    came = [(20, 5, 1.0), (20, 6, 1.0), (20, 7, 2.0), (20, 3, 9.0), (15, 8, 4.0), (10, 9, 5.0), (9, 10, 6.0), (21, 11, 7.0), (11, 12, 8.0), (10, 13, 8.0)]
    rows = [("t", "s", at * minute, offset, value, n) for n, (at, offset, value) in enumerate(came)] + [("u", "s", minute, 1, 1.0, 0)]
    points = spark.createDataFrame(rows, SERIES)
    points.write.parquet(str(tmp_path / "points"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "points"))
    got = {(r.tenant, r.offset): (r.outcome, r.cumulative) for r in drain(live.in_order(stream)).collect()}
    want = ["inserted", "duplicate", "replaced", "obsolete", "out_of_order", "out_of_order", "rejected", "inserted", "out_of_order", "rejected"]
    total = 0.0
    for (_, offset, value), outcome in zip(came, want):
        total += value if outcome in ("inserted", "replaced", "out_of_order") else 0
        assert got["t", offset] == (outcome, total), offset
    assert got["u", 1] == ("inserted", 1.0)
    # In offset order nothing is obsolete.
    batch = {r.offset: r.outcome for r in winners.classify_points(points.filter("tenant = 't' AND offset <> 3")).collect()}
    assert batch == {offset: outcome for (_, offset, _), outcome in zip(came, want) if offset != 3}


def test_empty_streams_drain(spark, tmp_path):
    spark.createDataFrame([], SERIES).coalesce(1).write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema(SERIES).parquet(str(tmp_path / "none"))
    assert drain(stream).count() == 0 and drain(stream.groupBy("series_id").count(), "complete").count() == 0


def page(spark, messages, budget, after=None):
    rows = [(i * 7 * S, i, m) for i, m in enumerate(messages)]
    return sorted(r.offset for r in search.page_by_bytes(spark.createDataFrame(rows, "timestamp bigint, offset bigint, message string"), budget, after).collect())


def test_byte_pages(spark):
    assert page(spark, ["", None, "", "", ""], 2) == [0, 1, 2, 3, 4]
    assert page(spark, [None, None, None, "x" * 40, "y" * 10], 50) == [0, 1, 2, 3, 4]
    assert page(spark, ["x" * 90, "y", ""], 50) == [0] and page(spark, ["x" * 90, "y", ""], 50, (0, 0)) == [1, 2]
    texts = ["ab" * (i % 5) for i in range(60)]
    for budget in (1, 9, 40, 1000):
        want, total = [], 0
        for i, text in enumerate(texts):
            total += len(text)
            if total <= budget or not want:
                want.append(i)
            else:
                break
        assert page(spark, texts, budget) == want


def test_matchers_see_the_whole_value(spark):
    logs = log_rows(spark, ["one", "two"], [{"app": "api"}, {"app": "api\n"}])
    assert [r.line for r in logql.pipeline(logql.entries(logs), logql.parse_selector('{app=~"api"}')).collect()] == ["one"]
    assert [r.line for r in logql.pipeline(logql.entries(logs), logql.parse_selector('{} | app !~ "api"')).collect()] == ["two"]
    spans = tree(spark, [(1, None, "a", {"k": "v\n"}), (2, None, "a", {"k": "v"})])
    assert found(spans, '{ span.k =~ "v" }') == ["2"]


def test_windows_at_their_edges(spark):
    # Samples after a millisecond's beginning belong to the windows that end later; a window that ends right there holds the exact one.
    rows = [("x", {"a": "b"}, 1_000_000_000, 0, 1.0), ("x", {"a": "b"}, 1_000_000_500, 1, 10.0), ("x", {"a": "b"}, 2_000_000_000, 2, 100.0), ("x", {"a": "b"}, 3_000_000_001, 3, float("nan"))]
    p = spark.createDataFrame(rows, "name string, labels map<string,string>, timestamp bigint, offset bigint, value double")
    ask = lambda text: {r.t: r.value for r in promql.range_query(p, text, 1000, 4000, 500).collect()}
    assert ask("sum_over_time(x[1s])") == {1000: 1.0, 1500: 10.0, 2000: 100.0, 2500: 100.0, 3500: pytest.approx(float("nan"), nan_ok=True)}
    assert ask("increase(x[3s])")[2000] == 90.0 and ask("increase(x[3s])")[3000] == 90.0 and ask("changes(x[3s])")[3500] == 2.0
    assert ask("max_over_time(x[3s])")[4000] == 100.0 and ask("min_over_time(x[600ms])")[3500] != ask("min_over_time(x[600ms])")[3500]
    assert ask("delta(x[2s])")[2000] == 90.0 and ask("irate(x[2s])")[2000] == 90.0 and ask("last_over_time(x[1s])")[1000] == 1.0


def test_readers_refuse_what_is_malformed(spark):
    body = lambda text: spark.createDataFrame([(0, text)], "offset bigint, body string")
    for reader, texts in ((readers.pushed_logs, ['{"streams":[{"stream":{},"values":[["x","l"]]}]}', '{"streams":[{"stream":{},"values":[["1"]]}]}', "nothing", '{"streams":']), (readers.container_logs, ['{"stream":"stdout"}', "x"]), (readers.otlp_spans, ["[1]"])):
        for text in texts:
            with pytest.raises(Exception):
                reader(body(text)).collect()
    assert readers.pushed_logs(body('{"streams":[]}')).count() == 0 and readers.otlp_logs(body("{}")).count() == 0


def test_attribute_values_nest(spark):
    attributes = '[{"key":"a","value":{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"x","value":{"arrayValue":{"values":[{"doubleValue":1.5},{"boolValue":true},{"stringValue":"\\"q\\""},{}]}}}]}}]}}},{"key":"e"},{"key":"e","value":{"intValue":"7"}}]'
    row = spark.createDataFrame([(attributes,)], "t string").select(readers.rendered(F.array("t", F.lit(None).cast("string"))).alias("r")).first().r
    assert row[0].m == {"a": '[{"x":[1.5,true,"\\"q\\"",null]}]', "e": "7"} and row[0].j == '{"a":[{"x":[1.5,true,"\\"q\\"",null]}],"e":7}'
    assert row[1].m == {} and row[1].j == "{}"


def test_pages_of_correlations(spark):
    rows = [(t, "logs", 0, i, i, "1", "r") for t in ("a", "b") for i in range(5)]
    found_ = correlation.postings(logs=spark.createDataFrame(rows, "tenant string, signal string, partition int, offset bigint, timestamp bigint, trace_id string, resource_id string"))
    seen, after = [], None
    while True:
        part, after = correlation.page(found_, [("trace", "1")], 3, after)
        seen += [tuple(r) for r in part]
        if after is None:
            break
    assert seen == [(t, "logs", 0, i) for t in ("a", "b") for i in range(5)]


def test_queries_are_validated():
    for text in ('{a="b"} |= "x"', 'sum by (a) (rate({a="b"}[1m]))'):
        assert logql.validate(text) == text
    for bad in ('{a="b"', "rate({})", "{a=b}", 'topk(0, rate({a="b"}[1m]))'):
        with pytest.raises(Exception):
            logql.validate(bad)


def test_shared_folder_needs_a_name_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        shared.folder(Session)


def test_arrow_streams_hold_the_table(spark):
    rows = [(i, f"m{i}", {"k": str(i)}) for i in range(50)]
    df = spark.createDataFrame(rows, "offset bigint, message string, labels map<string,string>").repartition(3)
    parts = encode.arrow_streams(df)
    back = [tuple(r.values()) for batch in encode.arrow_table(parts) for r in batch.to_pylist()]
    assert sorted((o, m, dict(l)) for o, m, l in back) == rows and encode.arrow_streams(df.limit(0)).agg(F.sum("rows")).first()[0] in (None, 0)
