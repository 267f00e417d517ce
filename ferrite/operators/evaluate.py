"""Detector evaluation: precision and recall, threshold curves, box coverage, input reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(rows: DataFrame) -> DataFrame:
    """``rows`` with precision, recall and f1 from tp, fp and fn; an empty denominator gives 0."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)})


def match(truth: DataFrame, hits: DataFrame, on: list[str]) -> DataFrame:
    """(cls, tp, fp, fn): a truth is found if any hit shares its keys; a hit without truth is false. ``on`` includes cls."""
    found = truth.join(hits.select(*on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    by_truth = found.select("cls", F.col("_hit").isNotNull().cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("_hit").isNull().cast("long").alias("fn"))
    false = hits.join(truth.select(*on).distinct(), on, "left_anti").select("cls", F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return by_truth.unionByName(false).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def curve(scored: DataFrame, thresholds: list[float], reference: bool = False, *by: str) -> DataFrame:
    """A row per threshold from (by, score, positive): one pass, no join with the thresholds.

    ``reference`` counts every prediction as false, true ones included, as the published curves do.
    """
    points = scored.select(*by, "score", "positive", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    over = F.col("score") >= F.col("threshold")
    fp = F.count_if(over) if reference else F.count_if(over & ~F.col("positive"))
    out = points.groupBy(*by, "threshold").agg(F.count_if(over & F.col("positive")).alias("tp"), fp.alias("fp"), F.count_if(~over & F.col("positive")).alias("fn"), F.count_if(over).alias("n_pred"))
    return rates(out)


def best_threshold(curves: DataFrame, *by: str) -> DataFrame:
    """The point of greatest f1 of each curve, the least threshold among equals."""
    if not by:
        return curves.orderBy(F.col("f1").desc(), "threshold").limit(1)
    w = Window.partitionBy(*by).orderBy(F.col("f1").desc(), "threshold")
    return curves.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: What the pattern layer owns, and what may be a person's name.
OWNED = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b",
    r"\b[A-Z]{5}\d{4}[A-Z]\b",
    r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b",
    r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    r"\b[6-9]\d{9}\b",
    r"\b\d{4}\s?\d{4}\s?\d{4}\b",
)
NAMED = r"\b[A-Z][a-z]{1,15}\s+[A-Z][a-z]{1,15}\b"
#: The floor of each class of the model layer; above 1 never admits.
FLOORS = {"PERSON": 0.99, "EMAIL": 1.01, "PHONE": 1.01, "LOCATION": 1.01, "ORG": 1.01, "DATE": 1.01, "PASSPORT": 1.01}


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def pattern_covers(text: Column) -> Column:
    """Whether the pattern layer finds all that the model layer could add: an owned format and no likely name."""
    return text.rlike(_java("|".join(OWNED))) & ~text.rlike(_java(NAMED))


def reduce_input(texts: DataFrame, text: str = "text", clip: int = 200) -> DataFrame:
    """The distinct clipped texts that the model layer must see."""
    return texts.select(F.substring(text, 1, clip).alias(text)).dropDuplicates([text]).where(~pattern_covers(F.col(text)))


def admit(cls: Column, score: Column) -> Column:
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])[cls]
    return F.coalesce((floor <= 1.0) & (score >= floor), F.lit(False))


def greedy_claims(truth: DataFrame, found: DataFrame, key: str = "cls") -> DataFrame:
    """(cls, tp, fp, fn): within a class, truths in order claim the first unclaimed finding that contains them or that
    they contain, letters and digits only. Sequential by nature; a class's rows go to one task, so give a finer key
    (class and page, say) where classes are large."""
    import pandas as pd

    from ..session import ship_package

    ship_package(truth.sparkSession)
    plain = F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]", "")
    side = lambda df, name: df.select(F.col(key).alias("cls"), F.lit(name).alias("side"), F.col("ord").cast("long").alias("ord"), plain.alias("v"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord", kind="stable")
        wanted, free = g[g["side"] == "t"]["v"].tolist(), g[g["side"] == "f"]["v"].tolist()
        tp, n = 0, len(free)
        for w in wanted:
            k = next((i for i, f in enumerate(free) if f and w and (f in w or w in f)), None)
            if k is not None:
                free.pop(k)
                tp += 1
        return pd.DataFrame({"cls": [g["cls"].iloc[0]], "tp": [tp], "fp": [n - tp], "fn": [len(wanted) - tp]})

    return side(truth, "t").unionByName(side(found, "f")).groupBy("cls").applyInPandas(run, "cls string, tp long, fp long, fn long")


def score_nodes(truth: DataFrame, hits: DataFrame, literal: str = "[PASSWORD]") -> DataFrame:
    """(cls, channel, tp, fp, fn): a truth (page, node_id, cls, channel) is found by a hit of its class on its node.

    A hit (page, node_id, cls, text) on a node without a truth of its class is false, but for a password shown as such;
    false hits have no channel.
    """
    on = ["page", "node_id", "cls"]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    seen = truth.join(hits.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    found = seen.select("cls", "channel", F.when(F.col("_hit"), one).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(F.col("_hit"), zero).otherwise(one).alias("fn"))
    false = hits.where(~((F.col("cls") == "PASSWORD") & F.coalesce(F.col("text") == literal, F.lit(False)))).join(truth.select(*on).distinct(), on, "left_anti")
    rows = found.unionByName(false.select("cls", F.lit(None).cast("string").alias("channel"), zero.alias("tp"), one.alias("fp"), zero.alias("fn")))
    return rows.groupBy("cls", "channel").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def by_channel(scored: DataFrame) -> DataFrame:
    return scored.where("channel IS NOT NULL").groupBy("channel").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))


def missed_by_class(scored: DataFrame) -> DataFrame:
    """(cls, fn) of classes with a miss; a report sorts them."""
    return scored.groupBy("cls").agg(F.sum("fn").alias("fn")).where("fn > 0")


def macro(scored: DataFrame) -> DataFrame:
    """(n_classes, macro_f1): the plain mean of the classes' f1."""
    per = rates(scored.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    exact = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per.agg(F.count("*").alias("n_classes"), F.round(F.avg(exact), 6).alias("macro_f1"))


def _contain(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def plain(value: Column) -> Column:
    """Letters and digits in lower case: what loose containment compares."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def any_match(truth: DataFrame, base: DataFrame, fused: DataFrame, *on: str) -> DataFrame:
    """(cls, gt, base, fused): truths (on, value) that any finding with the same keys contains or is contained in, by layer.

    ``on`` includes cls; a finer key, such as the page, keeps what meets small. Each truth counts once.
    """
    t = truth.select(*on, plain(F.col("value")).alias("v")).groupBy(*on, "v").agg(F.count("*").alias("n"))

    def found(dets: DataFrame, name: str) -> DataFrame:
        d = dets.select(*on, plain(F.col("value")).alias("d")).distinct()
        return t.alias("t").join(d.alias("d"), (F.expr(" AND ".join(f"t.{c} = d.{c}" for c in on))) & _contain(F.col("t.v"), F.col("d.d")), "left_semi").withColumn(name, F.lit(1))

    keys = [*on, "v", "n"]
    rows = t.join(found(base, "_b"), keys, "left").join(found(fused, "_f"), keys, "left")
    return rows.groupBy("cls").agg(F.sum("n").alias("gt"), F.coalesce(F.sum(F.when(F.col("_b") == 1, F.col("n"))), F.lit(0)).alias("base"), F.coalesce(F.sum(F.when(F.col("_f") == 1, F.col("n"))), F.lit(0)).alias("fused"))


def cascade(truth: DataFrame, base: DataFrame, model: DataFrame, floor: float = 0.6) -> DataFrame:
    """(layer, tp, fp, fn, precision, recall, f1) of base, model alone, and base with the model's findings of ``floor`` or more.

    truth and findings: (cls, ord, value), the model's with score. Within a class truths claim findings one to one.
    """
    strong = base.select("cls", "ord", "value").unionByName(model.where(F.col("score") >= floor).select("cls", (F.col("ord") + (1 << 40)).alias("ord"), "value"))
    each = {"base": base, "model": model, "cascade": strong}
    mark = lambda df, layer: df.select(F.concat_ws("|", F.lit(layer), "cls").alias("key"), F.col("ord").cast("long").alias("ord"), "value")
    truths = findings = None
    for layer, df in each.items():
        truths = mark(truth, layer) if truths is None else truths.unionByName(mark(truth, layer))
        findings = mark(df, layer) if findings is None else findings.unionByName(mark(df, layer))
    claims = greedy_claims(truths, findings, "key").groupBy(F.substring_index("cls", "|", 1).alias("layer")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return rates(claims)


def coordinate_sweep(counts: DataFrame, never: float = 1.01) -> list[tuple[str, float, float]]:
    """(cls, threshold, f1 then) from (cls, threshold, tp, fp, fn): one class after the other takes its best threshold.

    Counts of classes add up, so a policy's score is a sum over as many rows as there are classes. Classes in order; one
    not yet chosen stands at ``never``; of equal scores the first threshold wins. A report: classes times grid rows.
    """
    table: dict[str, dict[float, tuple]] = {}
    for r in counts.select("cls", "threshold", "tp", "fp", "fn").orderBy("cls", "threshold").collect():
        table.setdefault(r["cls"], {})[r["threshold"]] = (r["tp"], r["fp"], r["fn"])
    chosen, out = {c: row[never] for c, row in table.items()}, []
    for c, row in table.items():
        best = (-1.0, never)
        for t, counted in row.items():
            tp, fp, fn = map(sum, zip(*(chosen | {c: counted}).values(), strict=True))
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            best = max(best, (f1, t), key=lambda x: x[0])
        chosen[c] = row[best[1]]
        out.append((c, best[1], best[0]))
    return out


def determinism(a: DataFrame, b: DataFrame, *span: str) -> DataFrame:
    """One row (n_a, n_b, identical, shared, distinct_spans): whether two runs found the same spans, as lists and as sets."""
    both = a.select(*span, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*span, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*span).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("na").alias("n_a"), total("nb").alias("n_b"), (F.count_if(F.col("na") != F.col("nb")) == 0).alias("identical"), F.count_if((F.col("na") > 0) & (F.col("nb") > 0)).alias("shared"), F.count("*").alias("distinct_spans"))
