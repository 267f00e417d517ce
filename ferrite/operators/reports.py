"""Roll-ups and reports: manifests as signed text, box metrics, model comparison, grounding, shares, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksums import bucket, fnv1a_hex
from . import spans


def build_manifest(hits: DataFrame, scale: float, session: str) -> DataFrame:
    """Hits (…, hit_id, cls, text, box) as entries: scaled boxes of 2 pixels at least, method and token."""
    from .elements import redaction_method
    from .redaction import token

    side = lambda v: F.greatest(F.lit(2.0), F.round(v * scale))
    box = F.struct(F.round(F.col("box.x") * scale).alias("x"), F.round(F.col("box.y") * scale).alias("y"), side(F.col("box.w")).alias("w"), side(F.col("box.h")).alias("h"))
    return hits.withColumn("method", redaction_method(F.col("cls"), F.col("box").isNotNull())).withColumn("token", token(F.col("text"), F.col("cls"), session)).withColumn("box", box).drop("text")


def _folded(text: Column, seed: int, factor: int) -> Column:
    """A 32-bit fold of the characters: xor, then multiply. Halves keep the products within a bigint."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("bigint"))
        high = (F.shiftright(x, 16) * factor).bitwiseAND(F.lit(0xFFFF).cast("bigint")) * 65536
        return (x.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * factor + high).bitwiseAND(mask)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(seed).cast("bigint"), step)


def sign(entries: DataFrame, frame_hash: Column, *by: str) -> DataFrame:
    """(by, signature) of entries (…, hit_id, cls, method, box) on a frame: against accidents, not attackers.

    Two folds over the entries in order, as JSON, and the frame's hash, then the length of the JSON. A missing side is left out.
    """
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    sides = [F.floor(F.col(f"box.{k}") + 0.5).cast("bigint").cast("string") for k in "xywh"]
    line = F.concat(F.lit("["), F.concat_ws(",", quoted("hit_id"), quoted("cls"), quoted("method"), *sides), F.lit("]"))
    order = F.concat_ws(",", "hit_id", "cls", "method", *sides)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), line.alias("v")))), lambda r: r["v"])
    rows = entries.withColumn("_f", frame_hash).groupBy(*by).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("_c"), F.max("_f").alias("_f"))
    hexed = lambda n: F.lower(F.lpad(F.hex(n), 8, "0"))
    whole = F.concat("_c", "_f")
    return rows.select(*by, F.concat(hexed(_folded(whole, 0x811C9DC5, 0x01000193)), hexed(_folded(whole, 0x01000193, 0x85EBCA6B)), hexed(F.length("_c"))).alias("signature"))


def noisy_counts(counts: DataFrame, session: str, epsilon: float = 1.0, n: str = "shown", key: str = "cls") -> DataFrame:
    """Counts with Laplace noise that depends on session and class alone, so that a retry releases the same."""
    u = (F.pmod(F.xxhash64(F.lit(session), F.col(key)), F.lit(1 << 40)) + 0.5) / float(1 << 40) - 0.5
    noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon
    shown = F.greatest(F.lit(0), F.round(F.col(n) + noise)).cast("bigint")
    return counts.withColumn("released", shown).withColumn("label", bucket(F.col("released")))


def render(manifest: DataFrame, mode: str = "exact") -> DataFrame:
    """One row of text from (cls, shown, label), classes in order."""
    about = "" if mode == "exact" else "about "
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls", "label"))), lambda r: F.concat(F.lit("  "), r["cls"], F.lit(": " + about), r["label"])), "\n")
    head = F.concat(F.lit("HIDDEN: "), F.coalesce(F.sum("shown"), F.lit(0)).cast("string"), F.lit(" item(s) in "), F.count("*").cast("string"), F.lit(" class(es)"))
    return manifest.agg(F.concat(head, F.when(F.count("*") > 0, F.concat(F.lit("\n"), lines)).otherwise("")).alias("summary"))


def box_metrics(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean IoU and coverage of true boxes ``a`` by painted boxes ``b`` (null where nothing was painted)."""
    iou = F.coalesce(spans.iou(F.col("a"), F.col("b")), F.lit(0.0))
    return pairs.withColumn("iou", iou).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.count_if(F.col("iou") > 0.001).alias("touched"), F.count_if(F.col("iou") >= 0.5).alias("half"), F.count_if(F.col("iou") >= 0.8).alias("most"), F.count_if(F.col("iou") <= 0.001).alias("leaked"))


def grounding(steps: DataFrame, marks: DataFrame, key: str = "plan_id") -> DataFrame:
    """(key, n_steps, used, invented): steps that use a mark of the page, and marks that it doesn't have."""
    known = marks.select(key, "mark").distinct().withColumn("_known", F.lit(True))
    rows = steps.join(known, [key, "mark"], "left")
    return rows.groupBy(key).agg(F.count("*").alias("n_steps"), F.count_if(F.col("_known")).alias("used"), F.count_if(F.col("mark").isNotNull() & F.col("_known").isNull()).alias("invented"))


def shares(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``rows`` with each one's share of its group's total."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return rows.withColumn("share", F.round(F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)), 6))


def project(stats: DataFrame, factors: dict[str, float], value: str) -> DataFrame:
    """Each measured row on each named device: the value times the device's factor."""
    table = F.array(*[F.struct(F.lit(k).alias("device"), F.lit(float(v)).alias("factor")) for k, v in factors.items()])
    return stats.withColumn("_d", F.explode(table)).withColumn("device", F.col("_d.device")).withColumn("projected", F.round(F.col(value) * F.col("_d.factor"), 2)).drop("_d")


def first_healthy(providers: DataFrame, *by: str) -> DataFrame:
    """The healthy provider that is preferred most (the least rank) for each ``by``."""
    return providers.groupBy(*by).agg(F.min(F.when(F.col("ok"), F.struct("rank", "name"))).alias("_best")).select(*by, F.col("_best.name").alias("provider"))


def screen_text(nodes: DataFrame, page: str, lines: int = 400, depth: int = 12) -> DataFrame:
    """(page, text): labels in page order, ``lines`` at most, no deeper than ``depth``. ``nodes``: page, ord, depth, text."""
    w = Window.partitionBy(page).orderBy("ord")
    kept = nodes.where((F.col("depth") <= depth) & (F.col("text") != "")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= lines)
    return kept.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda r: r["text"]), "\n").alias("text"))


def luma_cells(pixels: DataFrame, frame: str, width: int, height: int, cells: int = 8) -> DataFrame:
    """(frame, cells): box averages of luma over a cells x cells grid from (frame, x, y, r, g, b)."""
    luma = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    at = F.floor(F.col("y") * cells / height) * cells + F.floor(F.col("x") * cells / width)
    grid = pixels.groupBy(frame, at.cast("int").alias("i")).agg(F.avg(luma).alias("v"))
    return grid.groupBy(frame).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: F.round(r["v"], 3)).alias("cells"))


def redact_name(name: Column, hits: Column, session: str) -> Column:
    """A control's name with the first occurrence of each sure hit (0.5 or a password, two characters) as its token."""
    from .redaction import token

    sure = F.filter(hits, lambda h: ((h["cls"] == "PASSWORD") | (h["score"] >= 0.5)) & (F.length(h["text"]) >= 2) & F.contains(name, h["text"]))
    found = F.transform(sure, lambda h: F.struct((F.instr(name, h["text"]) - 1).cast("int").alias("start"), (F.instr(name, h["text"]) - 1 + F.length(h["text"])).cast("int").alias("end"), h["cls"].alias("cls")))
    return spans.substitute(name, spans.bridge(name, found), lambda v, c: token(v, c, session))


def compare_models(turns: DataFrame, model: str = "model") -> DataFrame:
    """A row per model from turns (model, parsed, used_mark, invented, truncated, ms, usd): counts, mean time, known cost.

    A turn that neither parsed nor was cut off is invalid; one unknown cost makes the sum unknown.
    """
    from .events import known_sum

    return turns.groupBy(model).agg(F.count("*").alias("turns"), F.count_if("parsed").alias("parsed"), F.count_if("used_mark").alias("used_mark"), F.sum("invented").alias("invented"), F.count_if("truncated").alias("truncated"), F.count_if(~F.col("parsed") & ~F.col("truncated")).alias("invalid"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(known_sum(F.col("usd")), 4).alias("usd"))


def task_histogram(tasks: DataFrame) -> DataFrame:
    """(expect_action, n, tier0, destructive) from tasks (expect_action, tier, checks)."""
    return tasks.groupBy("expect_action").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "T0").alias("tier0"), F.count_if(F.array_contains("checks", "destructive_confirmed")).alias("destructive"))


def low_confidence(hits: DataFrame, *by: str) -> DataFrame:
    """(by, low): how many hits are below one half. Reported, never dropped."""
    return hits.groupBy(*by).agg(F.count_if(F.col("score") < 0.5).alias("low"))
