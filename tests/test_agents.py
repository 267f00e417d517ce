"""Pages as a planner sees them, runs and reports, on small inputs against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from ferrite.operators import evaluate, events, frames, runs, screen
from ferrite.sources import html

PAGE = """<body><h1>Welcome</h1><p>Mail a@b.example.org or call</p><form><label for=u>Your name</label><input id=u value="Ann Lee">
<input type=password name=pw value=hunter2 aria-label=Password><button>Send</button></form><div data-user-email="c@d.example.org"><a href=/x>c@d.example.org</a></div></body>"""


def test_snapshot(spark):
    rows = html.elements(spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string"), "page_id")
    by = {(r.tag, r.label): r for r in screen.snapshot(rows, "page_id", "s").collect()}
    hit = lambda r: [(h.cls, h.source, h.text, h.start, h.end) for h in r.hits]
    secret = by["input", "Password"]
    assert hit(secret) == [("PASSWORD", "L0", "[PASSWORD]", 0, 7)] and secret.value_class == "sensitive" and secret.mark == 2
    assert hit(by["p", "Mail a@b.example.org or call"]) == [("EMAIL", "L1", "a@b.example.org", 5, 20)]
    assert by["p", "Mail a@b.example.org or call"].name.startswith("Mail [EMAIL_") and by["p", "Mail a@b.example.org or call"].value_class == "sensitive"
    box = next(r for (tag, _), r in by.items() if tag == "div")
    assert hit(box) == [("EMAIL", "L0", "", 0, 0)]  # what its attribute says; its text is a child's
    assert [r.mark for r in sorted(by.values(), key=lambda r: r.ord) if r.mark] == [1, 2, 3, 4]
    assert by["h1", "Welcome"].value_class == "public" and by["input", "Your name"].actions == "fill,focus,click"
    sent = screen.payload(screen.snapshot(rows, "page_id", "s"), "page_id").first().payload
    assert "hunter2" not in sent and "a@b.example.org" not in sent and '"valueClass":"sensitive"' in sent
    shown = screen.planner_text(screen.snapshot(rows, "page_id", "s"), "page_id").first().text
    assert '[2] textbox "Password" (hidden) <fill,focus,click>' in shown
    probe = screen.probe_nodes(rows, "page_id").collect()
    assert [(r.mark, r.role, r.label, r.value_class) for r in sorted(probe, key=lambda r: r.mark)] == [(1, "input", "u", "public"), (2, "input", "Password", "sensitive"), (3, "button", "button", "public"), (4, "a", "a", "public")]


def test_text_regions(spark):
    rng = np.random.default_rng(0)
    luma = np.full((96, 160), 30.0)
    luma[16:32, 24:80] = rng.integers(0, 255, (16, 56))
    luma[70:74, 100:104] = 255
    cells = {}
    for cy in range(12):
        for cx in range(20):
            e = n = 0
            for y in range(cy * 8, cy * 8 + 8):
                for x in range(cx * 8, cx * 8 + 8):
                    for yy, xx in ((y, x + 1), (y + 1, x)):
                        if yy < 96 and xx < 160:
                            e, n = e + abs(luma[y, x] - luma[yy, xx]), n + 1
            cells[cx, cy] = e / n
    dense = {c for c, e in cells.items() if e >= 0.35 * max(cells.values())}
    boxes = frames.text_boxes(luma, 640, 384)
    x0, y0, x1, y1 = min(x for x, _ in dense), min(y for _, y in dense), max(x for x, _ in dense), max(y for _, y in dense)
    assert len(boxes) == 1 and boxes[0][:4] == ((x0 - 1) * 32, (y0 - 1) * 32, (x1 - x0 + 3) * 32, (y1 - y0 + 3) * 32)
    assert abs(boxes[0][4] - min(0.95, 0.4 + 4 * len(dense) / 240)) < 1e-9
    assert frames.text_boxes(np.full((96, 160), 30.0), 640, 384) == [] and frames.text_boxes(luma[:4], 640, 16) == []
    df = spark.createDataFrame([(1, 640, 384, 160, luma.ravel().tolist()), (2, 4, 4, 1, [1.0]), (3, 640, 384, 160, None)], "id bigint, width int, height int, columns int, luma array<double>")
    assert [tuple(r) for r in frames.text_regions(df, "id").collect()] == [(1, *boxes[0])]


def test_places_in_order(spark):
    rng = random.Random(1)
    rows = [(k, None if rng.random() < 0.1 else rng.choice([rng.gauss(0, 1), 7.0, 1e9])) for k in [None, "a", "a", "b"] for _ in range(150)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.value for r in events.percentile_nearest(df, "v", p, "k").collect()}
        want = {}
        for k in {k for k, _ in rows}:
            v = sorted(x for kk, x in rows if kk == k and x is not None)
            if v:
                want[k] = v[max(0, int(np.ceil(p * len(v))) - 1)]
        assert got == want
    assert events.percentile_rounded(df.limit(0), "v", 0.5, "k").count() == 0


def test_throttle_streams_its_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), i, rng.randint(0, 400)) for i in range(300)]
    want = set()
    for key in (None, 1, 2):
        last = None
        for t, i in sorted((t, i) for k, i, t in rows if k == key):
            if last is None or t - last >= 15:
                want.add((key, i))
                last = t
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, t bigint").repartition(3)
    assert {tuple(r) for r in events.throttle(df, "user_id", "t", "event_id", 15).collect()} == want


def test_transcript_is_cut_as_it_grows(spark):
    rows = [(n, i) for n in (0, 1, 59, 60, 61, 80, 81, 82, 200) for i in range(n)]
    got = {}
    for r in runs.bounded_transcript(spark.createDataFrame(rows, "k int, i int"), "k", "i").collect():
        got.setdefault(r.k, []).append(r.i)
    for n in (1, 59, 60, 61, 80, 81, 82, 200):
        left = []
        for i in range(n):
            left.append(i)
            left = left[-40:] if len(left) > 60 else left
        assert sorted(got[n]) == left


def test_log_ring_survives(spark, tmp_path):
    rows = spark.createDataFrame([(t, t, "sw", None if t == 3 else f"line {t}", "info") for t in range(9)], "t int, k int, channel string, text string, level string")
    runs.persist_ring(rows, f"file://{tmp_path}/ring")
    assert sorted(r.t for r in runs.restore_ring(spark, f"file://{tmp_path}/ring", "t", "k", 4).collect()) == [5, 6, 7, 8]


def test_cascade_and_policy(spark):
    kind = "cls string, ord bigint, value string"
    truth = spark.createDataFrame([("A", 1, "ann lee"), ("A", 2, "bob"), ("B", 3, "x 1")], kind)
    base = spark.createDataFrame([("A", 1, "Ann"), ("B", 2, "zzz")], kind)
    model = spark.createDataFrame([("A", 1, "bob!", 0.9), ("A", 2, "ann", 0.7), ("B", 3, "X1", 0.5)], kind + ", score double")
    got = {r.layer: (r.tp, r.fp, r.fn) for r in evaluate.cascade(truth, base, model).collect()}
    assert got == {"base": (1, 1, 2), "model": (3, 0, 0), "cascade": (2, 2, 1)}
    counts = [("A", 0.5, 5, 5, 0), ("A", 0.9, 4, 1, 1), ("A", 1.01, 0, 0, 5), ("B", 0.5, 1, 9, 0), ("B", 1.01, 0, 0, 1)]
    out = evaluate.coordinate_sweep(spark.createDataFrame(counts, "cls string, threshold double, tp long, fp long, fn long"))
    assert [(c, t) for c, t, _ in out] == [("A", 0.9), ("B", 1.01)] and abs(out[-1][2] - 8 / 11) < 1e-9
