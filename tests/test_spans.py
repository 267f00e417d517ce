"""Span rules against their plain sequential form, and the plan of the rule scan."""

import random

import pytest
from pyspark.sql import functions as F

from ferrite.operators import elements, redaction, rules, spans


def test_bridges(spark):
    cases = [("Ann Lee", [(0, 3), (4, 7)], 1), ("Ann, Lee", [(0, 3), (5, 8)], 2), ("Ann  Lee", [(0, 3), (5, 8)], 1), ("Ann-Lee", [(0, 3), (4, 7)], 1), ("Ann--Lee", [(0, 3), (5, 8)], 2), ("Ann   Lee", [(0, 3), (6, 9)], 2), ("Ann\u00a0Lee", [(0, 3), (4, 7)], 1), ("Ann.\nLee", [(0, 3), (5, 8)], 2), ("AnnLee", [(0, 3), (3, 6)], 1), ("Ann Lee X", [(0, 9), (4, 7)], 1)]
    rows = [(i, t, [{"start": a, "end": b, "cls": "PERSON"} for a, b in s]) for i, (t, s, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "doc_id int, text string, s " + spans.SPAN)
    whole = {r.doc_id: [(x.start, x.end) for x in r.b] for r in df.select("doc_id", spans.bridge(F.col("text"), F.col("s")).alias("b")).collect()}
    assert [len(whole[i]) for i in range(len(cases))] == [n for _, _, n in cases]
    assert whole[9] == [(0, 7)]  # the merged span ends where the later one does
    flat = [(i, a, b, "PERSON", t[s[k - 1][1] : a] if k else "") for i, (t, s, _) in enumerate(cases) for k, (a, b) in enumerate(s)]
    by_rows = spans.bridge_rows(spark.createDataFrame(flat, "doc_id int, start int, `end` int, cls string, gap_text string"), "doc_id").collect()
    assert {(r.doc_id, r.start, r.end) for r in by_rows} == {(i, *x) for i, v in whole.items() for x in v}


def plain_merge(tokens):
    out, cur = [], None
    for entity, score, start, end in tokens:
        prefix, _, rest = entity.partition("-")
        label = rest or prefix
        if label == "O":
            out, cur = [*out, cur], None
            continue
        start = start if start is not None else (cur[3] if cur else 0)
        end = end if end is not None else start
        if cur and cur[0] == label and start <= cur[3]:
            cur = (label, min(cur[1], score), cur[2], max(cur[3], end))
        else:
            out, cur = [*out, cur], (label, score, start, end)
    return [c for c in [*out, cur] if c and c[0] in elements.MODEL_LABELS]


def test_merges_tokens(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        at, row = 0, []
        for _ in range(rng.randint(0, 12)):
            entity = rng.choice(["O", "B-PERSON", "I-PERSON", "PERSON", "B-AGE", "I-URL", "B-", "X-PERSON", "I-IBAN_CODE"])
            start = rng.choice([None, at, at, at + 1, max(0, at - 2)])
            end = rng.choice([None, at + 3, at + 1])
            row.append((entity, rng.randint(1, 9) / 10, start, end))
            at += rng.randint(0, 4)
        texts.append(row)
    rows = [(i, k, *t) for i, row in enumerate(texts) for k, t in enumerate(row)]
    got = spans.merge_tokens(spark.createDataFrame(rows, "doc_id int, ord int, entity string, score double, start int, `end` int"), "doc_id").collect()
    want = [(i, *x) for i, row in enumerate(texts) for x in plain_merge(row)]
    assert sorted(map(tuple, got)) == sorted(want)


def plain_fuse(hits):
    out = []
    for h in hits:
        h = dict(h)
        same = next((o for o in out if o["cls"] == h["cls"] and (abs(o["x"] - h["x"]) < 12 if o["x"] is not None and h["x"] is not None else o["start"] == h["start"])), None)
        if same is None:
            out.append(h)
        elif spans.LAYER_WEIGHT[h["source"]] > spans.LAYER_WEIGHT[same["source"]]:
            same |= {"source": h["source"], "score": max(same["score"], h["score"]), "text": h["text"], "x": h["x"] if h["x"] is not None else same["x"]}
    return out


def test_fuses_layers(spark):
    rng = random.Random(2)
    docs = [[{"cls": rng.choice("AB"), "source": rng.choice(["L0", "L1", "L2", "L3"]), "score": rng.randint(1, 9) / 10, "text": f"t{k}", "start": rng.randint(0, 3), "end": rng.randint(4, 6), "x": rng.choice([None, 0.0, 11.0, 20.0, 40.0])} for k in range(rng.randint(1, 8))] for _ in range(50)]
    rows = [(i, k, *h.values()) for i, d in enumerate(docs) for k, h in enumerate(d)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, cls string, source string, score double, text string, start int, `end` int, x double")
    df = df.withColumn("box", F.when(F.col("x").isNotNull(), F.struct("x", F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))))
    got = spans.fuse_rows(df, "ord", "doc_id").select("doc_id", "cls", "source", "score", "text", "start", "end", "box.x").collect()
    want = [(i, h["cls"], h["source"], h["score"], h["text"], h["start"], h["end"], h["x"]) for i, d in enumerate(docs) for h in plain_fuse(d)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("use", ["spans", "counts", "redacted"])
def test_each_rule_runs_once(spark, use):
    scanned = rules.scan(spark.createDataFrame([(1, "a@b.org")], "doc_id int, text string"))
    out = {
        "spans": lambda: rules.explode(scanned, "doc_id"),
        "counts": lambda: rules.explode(scanned, "doc_id").groupBy("cls").count(),
        "redacted": lambda: redaction.redact(scanned, "s").where(F.size("hits") > 0).select("doc_id", "redacted"),
    }[use]()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(rules.RULES)
