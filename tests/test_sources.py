import json

from pyspark.sql import functions as F

from ferrite.sources import html, validate, wire
from ferrite.streaming import stateful


def test_elements_and_outline(spark):
    page = "<form id=f><p>Name <b>x</b><p>Two<input name=card data-token='1' type=text><br><ul>" + "<li>a" * 50 + "</ul></form>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    rows = html.elements(df, "page_id").collect()
    assert {r.page_id for r in rows} == {1}
    by = {r.path: r for r in rows}
    assert by["0"].id == "f" and by["0/0"].text == "Name" and by["0/0/0"].text == "x" and by["0/1"].text == "Two"
    assert [tuple(x) for x in by["0/1/0"].data_attrs] == [("token", "1")]
    assert html.outline(html.elements(df, "page_id")).where("tag = 'li'").count() == 40
    same = html.collapse_repeats(html.elements(df, "page_id")).where("tag = 'li'").collect()
    assert [r.repeats for r in same] == [40]
    assert html.structural_hash(html.elements(df, "page_id"), "page_id").count() == 1


def test_walk_keeps_what_the_rules_keep():
    page = """<html><head><title>T</title></head><body><div><img src=a><span></span></div><div><p>Text <b>in</b> it</p></div><div></div>
    <section class="sr-only"><p>hid</p></section><p aria-hidden=true>no</p><script>x()</script><form><label for=m>Your mail</label><input id=m placeholder=mail>
    <label>Card <input name=card></label><input type=hidden value=1><select title=Pick><option>a</select><a href=/x aria-label=" Go ">go</a><a>anchor</a>
    <span aria-labelledby="m n">z</span><button role=tab></button></form><table>""" + "<tr><td>1<td>2<td>3</tr>" * 5 + "</table></body></html>"
    by = {}
    for r in html.read_elements(page):
        by.setdefault(r["tag"], []).append(r)
    kept = {t: [r["kept"] for r in rows] for t, rows in by.items()}
    # A container without a name goes with all below it; a leaf without one stays.
    assert kept["div"] == [False, True, True] and kept["img"] == [False] and kept["span"] == [False, True] and kept["b"] == [True]
    assert kept["section"] == [False] and kept["script"] == [False] and kept["head"] == [False] and kept["html"] == [False] and kept["input"] == [True, True, False]
    names = {t: [r["label"] for r in rows] for t, rows in by.items()}
    assert names["input"][:2] == ["Your mail", "Card"] and names["select"] == ["Pick"] and names["a"] == ["Go", "anchor"] and names["p"][0] == "Text in it"
    assert [r["of_role"] for r in by["a"]] == ["link", "generic"] and by["button"][0]["of_role"] == "tab" and by["select"][0]["of_role"] == "combobox"
    # Five equal rows: the first stays, with two of its own children.
    assert [r["shown"] for r in by["tr"]] == [True] + [False] * 4 and by["tr"][0]["repeats"] == 5
    assert [r["shown"] for r in by["td"]] == [True, True] + [False] * 13
    assert [r["place"] for r in by["body"]] == ["0"] and by["td"][1]["place"].count("/") == 3


def test_walk_bounds():
    deep = html.read_elements("<body>" + "".join(f"<div title={i}>x" for i in range(30)))
    assert [r["kept"] for r in deep] == [True] * 9 + [False] * 22
    pruned = html.read_elements("<body>" + "<div><br></div>" * 50 + "".join(f"<p>{i}" for i in range(50)))
    assert sum(r["kept"] for r in pruned if r["tag"] == "p") == 40  # pruned siblings take no room
    assert len(html.read_elements("<div>" * 20_000)) == 20_000


def test_large_page_ids_next_to_nulls(spark):
    df = spark.createDataFrame([(2**60 + 1, "<p>a"), (None, "<p>b<p>c")], "page_id bigint, html string").coalesce(1)
    assert sorted((r.page_id or 0, r.text) for r in html.elements(df, "page_id").collect()) == [(0, "b"), (0, "c"), (2**60 + 1, "a")]


def test_forms_and_sinks(spark, tmp_path):
    (tmp_path / "form_00.json").write_text(json.dumps({"id": "syn_00", "instances": [{"id": "i", "cls": "PAN", "value": "x", "channel": "dom", "node_id": "n", "span": [0, 1]}]}, indent=1))
    truth = wire.ground_truth(wire.forms(spark, str(tmp_path / "form_*.json")))
    assert truth.select("form_id", "cls", "span").first()[:] == ("syn_00", "PAN", [0, 1])
    wire.write_results(truth.select("form_id", "cls"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_provider_chunks(spark):
    raw = 'data: {"choices":[{"delta":{"content":"a"}}]}\ndata: bad\ndata: {"choices":[{"delta":{"content":"b"},"finish_reason":"content_filter"}]}\ndata: [DONE]'
    assert spark.range(1).select(wire.provider_chunks(F.lit(raw)).alias("r")).first().r[:] == ("ab", True)


def test_validation_splits(spark):
    df = spark.createDataFrame([("a", "PAN", "L1", 0.5, 0, 3), ("", "X", "L9", 2.0, 5, 1), (None, None, None, None, None, None)], "id string, cls string, source string, score double, start int, `end` int")
    good, bad = validate.split(validate.detections(df))
    assert [r.id for r in good.collect()] == ["a"]
    assert sorted(len(r.errors) for r in bad.collect()) == [4, 5]


def test_validation_of_each_shape(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    fine, flat = (0.0, 1.0, 2.0, 0.0), (0.0, float("nan"), 2.0, 0.0)
    shapes = {
        "redactions": (f"id string, box {box}, cls string, token string, method string, score double, source string, pixel_derived boolean", ("a", fine, "PAN", "[PAN_A1_0f]", "solid_fill", 1.0, "L1", False), ("", flat, "X", "[pan]", "blur", 1.1, "L4", None), 8),
        "manifests": ("schema_version string, session_id string, frame_hash string, signature string, l2_ner string, l3_face string, l3_text string, runtime string", ("1", "session-1", "0" * 16, "f" * 16, "a", "b", "c", "d"), ("", "s", "xyz", "f", None, None, None, None), 8),
        "nodes": (f"id string, role string, label string, value string, value_class string, bbox {box}, mark int, actions array<string>", ("a", "link", None, None, "public", None, 0, ["click"]), ("", "", "x" * 201, "x" * 201, "secret", flat, -1, ["jump"]), 8),
        "plans": ("schema_version string, session_id string, n_steps int, confidence double, needs array<string>", ("1", "session-1", 1, 0.0, []), (None, "s", 0, 2.0, ["x" * 301]), 5),
        "requests": ("schema_version string, session_id string, intent string, turn int, tier string", ("1", "session-1", "do it", None, None), ("", "s", "x" * 2001, -1, "T9"), 5),
        "verdicts": ("ok boolean, reasons array<string>, covered int, uncovered int, frame_hash string", (True, [], 0, 0, "a" * 64), (None, None, -1, -1, "a" * 65), 5),
    }
    for name, (schema, good, bad, n) in shapes.items():
        rows = getattr(validate, name)(spark.createDataFrame([good, bad], schema)).collect()
        assert rows[0].errors == [] and len(rows[1].errors) == n, name


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def _drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_throttle(spark, tmp_path):
    s = _stream(spark, tmp_path / "e", [(1, 10, 0), (1, 11, 5), (1, 12, 10), (2, 13, 3)], "user_id bigint, event_id bigint, t bigint")
    assert {r.event_id for r in _drain(stateful.throttle(s, 10), "throttled", tmp_path)} == {10, 12, 13}


def test_stream_frames(spark, tmp_path):
    s = _stream(spark, tmp_path / "f", [(1, 1, [0.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [9.0, 9.0])], "stream bigint, seq bigint, cells array<double>")
    assert {(r.seq, r.reason) for r in _drain(stateful.frame_gate(s), "gated", tmp_path)} == {(1, "first"), (2, "unchanged"), (3, "changed")}


def test_stream_debounce(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(1, t0 + dt.timedelta(milliseconds=m)) for m in (0, 100, 900)] + [(2, t0 + dt.timedelta(hours=1))]
    s = _stream(spark, tmp_path / "d", rows, "k bigint, ts timestamp")
    assert sorted((r.k, r.n) for r in _drain(stateful.debounce(s, "k", "ts", "400 milliseconds", "1 second"), "bursts", tmp_path)) == [(1, 1), (1, 2)]


def test_stream_watchdog(spark, tmp_path):
    import time

    s = _stream(spark, tmp_path / "w", [("a", "snapshot", 0), ("a", "send", 1000), ("b", "snapshot", 4_000_000_000_000_000)], "run string, stage string, t bigint")
    order = {"snapshot": 0, "send": 1}
    q = stateful.watchdog(s, order, {"snapshot": 8000, "send": 60_000}).writeStream.format("memory").queryName("stalled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck-w")).start()
    try:
        for _ in range(60):
            if spark.table("stalled").count():
                break
            time.sleep(1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("stalled").collect()] == [("a", "send")]
