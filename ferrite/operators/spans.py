"""Span algebra: bridging, fusing, substituting, and merging of model tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import elements

#: Weights of the detection layers.
LAYER_WEIGHT = {"L0": 4, "L1": 3, "L2": 2, "L3": 1}
SPAN = "array<struct<start:int,end:int,cls:string>>"
#: What may stand between neighbours that are one value: a single mark, or white space, of BRIDGE characters at most.
JOINER, BRIDGE = r"^(?:[.,'-]|[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+)\z", 2
BOX = "struct<x:double,y:double,w:double,h:double>"
FUSED = f"array<struct<cls:string,source:string,score:double,text:string,start:int,end:int,box:{BOX}>>"


def bridge(text: Column, spans: Column) -> Column:
    """Merge neighbours of one class that overlap, touch or have a joiner between them; the merged span ends where the later one does."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    def add(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        gap = s["start"] - last["end"]
        joins = (last["cls"] == s["cls"]) & (gap <= BRIDGE) & ((gap <= 0) | F.substring(text, last["end"] + 1, gap).rlike(JOINER))
        merged = F.struct(last["start"].alias("start"), s["end"].alias("end"), s["cls"].alias("cls"))
        return F.when((F.size(out) > 0) & joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["cls"].alias("cls")))))

    return F.aggregate(ordered, F.array().cast(SPAN), add)


def substitute(text: Column, spans: Column, token) -> Column:
    """Replace spans left to right by ``token(value, cls)``; a span that starts before the cursor is skipped."""

    def add(s: Column, x: Column) -> Column:
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        put = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), token(value, x["cls"]))
        fresh = x["start"] >= s["at"]
        return F.struct(F.when(fresh, x["end"]).otherwise(s["at"]).alias("at"), F.when(fresh, put).otherwise(s["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def bridge_rows(spans: DataFrame, *by: str) -> DataFrame:
    """The same bridging over rows (…, start, end, cls, gap_text): gaps and islands. gap_text stands before a span."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(w)
    joins = (F.lag("cls").over(w) == F.col("cls")) & (gap <= BRIDGE) & ((gap <= 0) | F.col("gap_text").rlike(JOINER))
    marked = spans.withColumn("_fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "cls", "_island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.count("*").alias("n_merged")).drop("_island")


def fuse(hits: Column) -> Column:
    """FUSED from an array of such hits in order of arrival: one entry for what several layers saw.

    A hit joins the first entry of its class that has an overlapping box or, where either lacks one, the same start. If its
    layer is heavier than the entry's, the entry takes its source, text and box, and the higher score; else it adds nothing.
    """
    weight = lambda source: F.create_map(*[F.lit(x) for kv in LAYER_WEIGHT.items() for x in kv])[source]

    def add(out: Column, h: Column) -> Column:
        same = lambda o: (o["cls"] == h["cls"]) & F.when(h["box"].isNotNull() & o["box"].isNotNull(), boxes_overlap(o["box"], h["box"])).otherwise(h["start"] == o["start"])
        at = F.array_position(F.transform(out, lambda o: F.coalesce(same(o), F.lit(False))), F.lit(True))
        heavier = lambda o: weight(h["source"]) > weight(o["source"])
        taken = lambda o: F.struct(o["cls"].alias("cls"), h["source"].alias("source"), F.greatest(o["score"], h["score"]).alias("score"), h["text"].alias("text"), o["start"].alias("start"), o["end"].alias("end"), F.coalesce(h["box"], o["box"]).alias("box"))
        return F.when(at == 0, F.concat(out, F.array(h))).otherwise(F.transform(out, lambda o, i: F.when((i == at - 1) & heavier(o), taken(o)).otherwise(o)))

    return F.aggregate(hits.cast(FUSED), F.array().cast(FUSED), add)


def fuse_rows(hits: DataFrame, ord: str, *by: str) -> DataFrame:
    """``fuse`` over rows (…, cls, source, score, text, start, end, box), a page's hits in the order of ``ord``."""
    hit = F.struct(*[F.col(c) for c in ("cls", "source", "score", "text", "start", "end", "box")])
    rows = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("k"), hit.alias("h")))).alias("_h"))
    return rows.select(*by, F.explode(fuse(F.transform("_h", lambda x: x["h"]))).alias("f")).select(*by, "f.*")


def boxes_overlap(a: Column, b: Column, slack: float = 2.0) -> Column:
    return (a["x"] < b["x"] + b["w"] + slack) & (b["x"] < a["x"] + a["w"] + slack) & (a["y"] < b["y"] + b["h"] + slack) & (b["y"] < a["y"] + a["h"] + slack)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    both = w * h
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def merge_tokens(tokens: DataFrame, *by: str) -> DataFrame:
    """(…, label, score, start, end): spans from a text's model tokens (…, ord, entity, score, start, end).

    Tokens of one label whose start is not beyond the span so far are one span, whatever their prefixes, with the least
    score; ``O`` ends a span, also between such tokens. A missing start is where the span ends, a missing end the start.
    Labels that stand for no class are left out. One text's tokens, as many as a model takes, are folded in order.
    """
    rest = F.substring_index("entity", "-", 1)
    label = F.when(F.contains("entity", F.lit("-")) & (F.length("entity") > F.length(rest) + 1), F.substring("entity", F.length(rest) + 2, F.length("entity"))).otherwise(rest)
    token = F.struct("ord", F.when((F.col("entity") != "O") & (label != "O") & (label != ""), label).alias("label"), F.col("score").cast("double").alias("score"), "start", "end")
    rows = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(token)).alias("_t"))
    span = "struct<label:string,score:double,start:int,end:int>"

    def add(out: Column, t: Column) -> Column:
        last = F.element_at(out, -1)
        start = F.coalesce(t["start"], last["end"], F.lit(0))
        end = F.coalesce(t["end"], start)
        new = F.struct(t["label"].alias("label"), t["score"].alias("score"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        joined = F.struct(last["label"].alias("label"), F.least(last["score"], t["score"]).alias("score"), last["start"].alias("start"), F.greatest(last["end"], end).cast("int").alias("end"))
        # An empty last entry says that no span is open.
        joins = (last["label"] == t["label"]) & (start <= last["end"])
        return (
            F.when(t["label"].isNull(), F.concat(out, F.array(F.lit(None).cast(span))))
            .when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined)))
            .otherwise(F.concat(out, F.array(new)))
        )

    merged = F.aggregate("_t", F.array(F.lit(None).cast(span)), add, lambda out: F.filter(out, lambda s: s["label"].isNotNull() & elements.model_class(s["label"]).isNotNull()))
    return rows.select(*by, F.explode(merged).alias("s")).select(*by, "s.*")
