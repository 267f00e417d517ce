"""Registered queries of the library's own operators, with the SQL that must give the same rows.

Each query reads whole tables. Inline fixtures stand in where the tables have no positive case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums, small
from ..operators import elements, evaluate, events, frames, policy, redaction, reports, rules, spans
from ..sources import html, wire
from . import agents, fixtures, scalars, sql

QUERIES: dict = agents.QUERIES | scalars.QUERIES
ORACLE: dict[str, str] = sql.ORACLE | agents.ORACLE | scalars.ORACLE
SESSION = "session-0001"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer partitions than there are cores is dealt out; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _scan(spark, d: str, resolve: bool = True) -> DataFrame:
    return rules.scan(_spread(_t(spark, d, "documents").select("doc_id", "text")), resolve=resolve)


def _hits(spark, d: str) -> DataFrame:
    return rules.explode(_scan(spark, d), "doc_id")


@query
def l1_class_counts(spark, d):
    return _hits(spark, d).groupBy("cls").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@query
def l1_spans(spark, d):
    return rules.explode(_scan(spark, d, resolve=False), "doc_id").select("doc_id", "rule_ord", "cls", "score", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("value"))


@query
def l1_spans_dedup(spark, d):
    return _hits(spark, d).select("doc_id", "rule_ord", "cls", "score", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query
def dedupe_overlaps(spark, d):
    rows = spark.createDataFrame(fixtures.OVERLAPS, "doc_id bigint, rule_ord int, cls string, score double, start int, `end` int")
    hit = F.struct("rule_ord", "cls", F.lit("L1").alias("source"), "score", F.lit("").alias("text"), "start", "end")
    chosen = rows.groupBy("doc_id").agg(F.collect_list(hit).cast(rules.HIT).alias("hits")).withColumn("hits", rules.dedupe(F.col("hits")))
    return rules.explode(chosen, "doc_id").select("doc_id", "cls", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query
def luhn_valid_cards(spark, d):
    digits = F.regexp_replace("text", "[ -]", "")
    return _hits(spark, d).where("cls = 'CREDIT_CARD'").select("doc_id", digits.alias("digits"), checksums.luhn(F.col("text")).alias("valid"))


@query
def verhoeff_keys(spark, d):
    number = F.lpad((F.col("c_custkey") * 99991).cast("string"), 12, "0")
    return _t(spark, d, "customer").select("c_custkey", checksums.verhoeff(number).alias("valid"))


@query
def iban_keys(spark, d):
    number = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    return _t(spark, d, "customer").select("c_custkey", checksums.iban(number).alias("valid"))


@query
def fnv1a_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", checksums.fnv1a_hex(F.col("p_name")).alias("hash"))


def _tokens(spark, d) -> DataFrame:
    return _hits(spark, d).withColumn("token", redaction.token(F.col("text"), F.col("cls"), SESSION))


@query
def pseudonym_tokens(spark, d):
    return _tokens(spark, d).select("doc_id", F.col("start").alias("span_start"), "cls", "token")


@query
def pseudonym_coreference(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("n_uses"), F.countDistinct("doc_id").alias("n_docs"))


@query
def redacted_text(spark, d):
    return redaction.redact(_scan(spark, d), SESSION).where(F.size("hits") > 0).select("doc_id", "redacted")


@query
def leakage_audit(spark, d):
    left = redaction.leaks(redaction.redact(_scan(spark, d), SESSION), "doc_id")
    return left.groupBy("cls").agg(F.count("*").alias("n_checked"), F.count_if("leaked").alias("n_leaked"))


@query
def bridge_spans(spark, d):
    """Neighbouring capitalised words as one span."""
    pattern = r"(?<!\w)[A-Z][a-z]{1,15}(?!\w)"
    found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    docs = _t(spark, d, "documents").select("doc_id", found.alias("m"), gaps.alias("g")).where(F.size("m") > 0)
    at = F.aggregate(F.sequence(F.lit(0), F.size("m") - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("o")), lambda s, i: F.struct((s["at"] + F.length(F.get("g", i)) + F.length(F.get("m", i))).alias("at"), F.concat(s["o"], F.array(s["at"] + F.length(F.get("g", i)))).alias("o")), lambda s: s["o"])
    rows = docs.withColumn("s", at).select("doc_id", F.posexplode(F.arrays_zip("s", "m", F.slice("g", F.lit(1), F.size("m")))).alias("k", "z"))
    rows = rows.select("doc_id", F.col("z.s").alias("start"), (F.col("z.s") + F.length("z.m")).alias("end"), F.lit("PERSON").alias("cls"), F.col("z.2").alias("gap_text"))
    return spans.bridge_rows(rows, "doc_id").select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "n_merged").where("n_merged > 1")


@query
def l2_input_reduction(spark, d):
    lines = _t(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("text")).where(F.length("text") > 2)
    clipped = lines.groupBy(F.substring("text", 1, 200).alias("text")).agg(F.count("*").alias("n"))
    return clipped.agg(F.sum("n").alias("n_raw"), F.count("*").alias("n_unique"), F.count_if(~evaluate.pattern_covers(F.col("text"))).alias("n_kept"))


@query
def manifest_exact(spark, d):
    return redaction.manifest(_hits(spark, d))


@query
def manifest_bucketed(spark, d):
    return redaction.manifest(_hits(spark, d), "bucketed")


@query
def manifest_top_tokens(spark, d):
    return redaction.top_tokens(_tokens(spark, d))


@query
def gate_verdict(spark, d):
    hits = _hits(spark, d).withColumn("hit_id", F.concat_ws(":", "doc_id", "start", "end"))
    entries = hits.where("score >= 0.5").select("doc_id", "hit_id", F.when(F.col("start") % 7 == 0, 0.0).otherwise((F.col("end") - F.col("start")) * 8.0).alias("w"), F.lit(16.0).alias("h"))
    return redaction.gate(hits, entries, "doc_id").select("doc_id", "n_items", "covered", "uncovered", "empty_boxes", "ok", "reasons")


@query
def log_scrub(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text", redaction.scrub(F.col("text")).alias("scrubbed")).where("scrubbed <> text").select("doc_id", "scrubbed")


@query
def injection_scan(spark, d):
    lines = spark.createDataFrame(fixtures.INJECTIONS, "id bigint, text string")
    turns = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), "text")
    found = lines.unionByName(turns).select("id", F.explode(policy.injection_findings(F.col("text"))).alias("f"))
    return found.select("id", "f.kind", F.col("f.match").alias("matched"))


@query
def destructive_scan(spark, d):
    lines = spark.createDataFrame(fixtures.VERBS, "id bigint, text string")
    return lines.select("id", F.col("text").rlike(policy.CLIENT_VERBS).alias("client"), F.col("text").rlike(policy.SERVER_VERBS).alias("server"))


@query
def action_safety(spark, d):
    rows = spark.createDataFrame(fixtures.SAFETY, "id bigint, action string, verb string, rerolled boolean, sensitive boolean")
    return rows.select("id", policy.decide_safety(F.col("action"), F.col("verb"), F.col("rerolled"), F.col("sensitive")).alias("rule"))


@query
def plan_check(spark, d):
    steps = spark.createDataFrame(fixtures.STEPS, "plan_id bigint, step_idx int, action string, mark int, value string, reason string")
    nodes = spark.createDataFrame(fixtures.NODES, "plan_id bigint, mark int, label string, sensitive boolean")
    return policy.plan_problems(steps, nodes)


@query
def semantic_elements(spark, d):
    rows = spark.createDataFrame(fixtures.ELEMENTS, fixtures.ELEMENT_SCHEMA)
    return elements.classify(rows).select("ord", "semantic.cls", "is_password")


@query
def plan_streams(spark, d):
    rows = spark.createDataFrame(fixtures.STREAMS, "id bigint, raw string").withColumn("r", wire.plan_stream(F.col("raw")))
    return rows.select("id", "r.ok", F.col("r.text").alias("plan"))


def _scored(spark, d) -> DataFrame:
    """A stated score, not a model: the share of marks other than letters, digits and white space."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    marks = F.length(F.regexp_replace("text", "[A-Za-z0-9À-ÿ \n\t]", ""))
    score = F.round(F.least(marks / F.greatest(F.length("text"), F.lit(1)) * 5, F.lit(1.0)), 6)
    return docs.select("doc_id", "lang", score.alias("score")).join(labels.select("doc_id", "quality"), "doc_id").withColumn("positive", F.col("quality") == 0)


GRID = [i / 20 for i in range(21)]


@query
def detector_prf(spark, d):
    rows = _scored(spark, d).withColumn("hit", F.col("score") >= 0.3)
    out = rows.groupBy(F.col("lang").alias("cls")).agg(F.count_if(F.col("hit") & F.col("positive")).alias("tp"), F.count_if(F.col("hit") & ~F.col("positive")).alias("fp"), F.count_if(~F.col("hit") & F.col("positive")).alias("fn"))
    return evaluate.rates(out)


@query
def pr_curve(spark, d):
    return evaluate.curve(_scored(spark, d), GRID)


@query
def pr_curve_ref(spark, d):
    return evaluate.curve(_scored(spark, d), GRID, True)


@query
def best_threshold(spark, d):
    return evaluate.best_threshold(evaluate.curve(_scored(spark, d), GRID, False, "lang"), "lang").select("lang", "threshold", "f1")


@query
def grouping_report(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    hits = _hits(spark, d).select("doc_id", "cls")
    sets = [[F.col("lang"), F.col("cls")], [F.col("lang")], [F.col("cls")], []]
    return hits.join(docs, "doc_id").groupingSets(sets, F.col("lang"), F.col("cls")).agg(F.count("*").alias("n_hits"))


def _boxes(spark, d) -> DataFrame:
    box = lambda k: F.struct(*[((F.col("p_partkey") * m + k * 13) % n).cast("double").alias(a) for a, m, n in (("x", 37, 400), ("y", 53, 300))], *[((F.col("p_partkey") * m) % n + 5 + k).cast("double").alias(a) for a, m, n in (("w", 11, 60), ("h", 17, 40))])
    return _t(spark, d, "part").select("p_partkey", box(0).alias("a"), box(1).alias("b"))


@query
def box_iou(spark, d):
    return _boxes(spark, d).select("p_partkey", F.round(spans.iou(F.col("a"), F.col("b")), 6).alias("iou"), spans.boxes_overlap(F.col("a"), F.col("b")).alias("overlaps"))


@query
def fuse_layers(spark, d):
    rows = spark.createDataFrame(fixtures.LAYERS, "doc_id bigint, ord int, cls string, source string, score double, start int, `end` int, x double")
    box = F.when(F.col("x").isNotNull(), F.struct("x", F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h")))
    fused = spans.fuse_rows(rows.withColumns({"text": F.col("ord").cast("string"), "box": box}), "ord", "doc_id")
    return fused.select("doc_id", "cls", "source", "score", "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "box.x")


@query
def merge_model_tokens(spark, d):
    rows = spark.createDataFrame(fixtures.TOKENS, "doc_id bigint, ord int, entity string, score double, start int, `end` int")
    return spans.merge_tokens(rows, "doc_id").select("doc_id", "label", "score", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query
def label_similarity(spark, d):
    p = _t(spark, d, "part")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return p.withColumn("next", F.lead("p_name").over(w)).where("next IS NOT NULL").select("p_partkey", F.round(frames.label_similarity(F.col("p_name"), F.col("next")), 6).alias("similarity"))


@query
def best_label_match(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label"))
    return frames.best_label(p, p, "page")


@query
def reading_order_marks(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label"), ((F.col("p_partkey") * 53) % 900).alias("y"), ((F.col("p_partkey") * 37) % 1200).alias("x"), (F.col("p_size") > 5).alias("eligible"))
    return frames.marks(p, "page", "node_id").select("page", "node_id", "mark")


def _frames(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("stream"), F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: F.round(x.cast("double") * 128, 3)).alias("cells"), F.col("label").cast("string").alias("dom_hash"))


@query
def frame_gate(spark, d):
    return frames.gate(_frames(spark, d), "stream", "seq").select("stream", "seq", "mad", F.coalesce(F.col("hamming"), F.lit(0)).cast("int").alias("hamming"), "reason")


@query
def frame_dhash(spark, d):
    return _frames(spark, d).select("seq", frames.dhash64(F.col("cells")).alias("dhash"))


def _pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("stream").orderBy("seq")
    return _frames(spark, d).withColumn("before", F.lag("cells").over(w)).where("before IS NOT NULL").select("seq", "cells", "before")


@query
def dirty_tiles(spark, d):
    return frames.dirty_tiles(_pairs(spark, d), "seq")


@query
def coalesce_tiles(spark, d):
    return frames.coalesce_tiles(frames.dirty_tiles(_pairs(spark, d), "seq"), "seq")


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", events.epoch_us("ts").alias("t"))


@query
def stage_durations(spark, d):
    out = events.stage_durations(_events(spark, d), "user_id", "t", "event_id", "event_type").where("ms IS NOT NULL")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))


@query
def watchdog_stalls(spark, d):
    out = events.stage_durations(_events(spark, d), "user_id", "t", "event_id", "event_type")
    return events.stalls(out, {"view": 8 * 3_600_000, "click": 15 * 3_600_000, "purchase": 60 * 3_600_000}, "event_type", 45 * 3_600_000).select("event_id", "event_type", "ms", "budget_ms")


@query
def forward_stages(spark, d):
    ranked = _events(spark, d).withColumn("rank", F.length("event_type"))
    return events.forward_stages(ranked, "user_id", "t", "event_id", "rank").select("event_id", "user_id", "event_type")


@query
def attempt_cap(spark, d):
    return events.attempts(_events(spark, d), "user_id", "t", "event_id").groupBy("user_id").agg(F.count("*").alias("n_attempts"), F.count_if("exhausted").alias("n_exhausted"))


@query
def session_summary(spark, d):
    e = _events(spark, d)
    kinds = ("click", "view", "purchase")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds], F.min("t").alias("first_us"), F.max("t").alias("last_us"))


@query
def session_recent(spark, d):
    limits = {"click": 3, "view": 5, "purchase": 3, "signup": 3, "logout": 3}
    return events.recent(_events(spark, d).where(F.col("event_type").isin(*limits)), "user_id", "event_type", "t", "event_id", limits, "event_id")


@query
def cost_rollup(spark, d):
    cost = F.when(F.col("event_id") % 997 != 0, F.col("value"))
    return _events(spark, d).withColumn("usd", cost).groupBy("user_id").agg(F.round(events.known_sum(F.col("usd")), 4).alias("usd"), F.count("usd").alias("n_known"))


@query
def throttle_events(spark, d):
    return events.throttle(_events(spark, d), "user_id", "t", "event_id", 12 * 3_600_000_000)


@query
def state_changes(spark, d):
    return events.changes(_events(spark, d), "user_id", "t", "event_id", "event_type").select("event_id", "user_id", "event_type", "previous")


@query
def debounce_sessions(spark, d):
    return events.debounce(_events(spark, d), "user_id", "t", "event_id", 6 * 3_600_000_000).select("user_id", "session", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "n")


@query
def log_ring(spark, d):
    return events.ring(_events(spark, d), "t", "event_id", 200).select("event_id", "t")


@query
def latency_percentiles(spark, d):
    e = _events(spark, d)
    at = lambda p, name: events.percentile_nearest(e, "value", p, "event_type").withColumnRenamed("value", name)
    whole = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))
    return whole.join(at(0.5, "p50"), "event_type").join(at(0.95, "p95"), "event_type")


@query
def latency_percentiles_ref(spark, d):
    e = _events(spark, d)
    one = lambda p: events.percentile_rounded(e, "value", p, "event_type").withColumnRenamed("value", f"p{round(p * 100)}")
    return one(0.5).join(one(0.95), "event_type")


@query
def plan_stop_index(spark, d):
    stop = F.col("event_type").isin("purchase", "logout", "error") & (F.col("value") > 50)
    return events.plan_stops(_events(spark, d), "user_id", "event_id", stop)


@query
def page_elements(spark, d):
    return html.elements(_t(spark, d, "pages"), "page_id").select("page_id", "ord", "parent", "depth", "path", "tag", "text")


@query
def page_outline(spark, d):
    return html.outline(html.elements(_t(spark, d, "pages"), "page_id")).select("page_id", "path", "tag", "text", "label", F.col("of_role").alias("role"))


@query
def collapse_repeats(spark, d):
    return html.collapse_repeats(html.elements(_t(spark, d, "pages"), "page_id")).select("page_id", "path", "tag", "repeats")


@query
def dom_hashes(spark, d):
    return html.structural_hash(html.elements(_t(spark, d, "pages"), "page_id"), "page_id")


@query
def clamp_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", small.clamp(F.col("text")).alias("line"))


@query
def capped_sizes(spark, d):
    w, h = F.col("p_partkey") * 7 % 3000 + 1, F.col("p_partkey") * 11 % 2000 + 1
    size = small.cap_to_edge(w, h)
    return _t(spark, d, "part").select("p_partkey", size["w"].alias("w"), size["h"].alias("h"), size["scale"].alias("scale"), small.send_tiles(F.col("p_size"), w, h).alias("tiles"))


@query
def device_tiers(spark, d):
    ram, vram, threads = F.col("p_size") % 9, F.col("p_partkey") * 97 % 3000, F.col("p_partkey") % 13 + 1
    gpu, isolated = F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 2 == 0
    plan = small.device_plan(ram, vram, threads, gpu, isolated)
    return _t(spark, d, "part").select("p_partkey", plan.alias("p")).select("p_partkey", "p.tier", "p.batch", "p.can_l2", "p.can_l3", "p.can_audit", "p.bottleneck")


@query
def manifest_signature(spark, d):
    hits = _hits(spark, d).withColumn("hit_id", F.concat_ws(":", F.lpad(F.col("start").cast("string"), 9, "0"), "end")).withColumn("method", elements.redaction_method(F.col("cls"), F.lit(True)))
    box = F.struct(F.col("start").cast("double").alias("x"), F.lit(0.2).alias("y"), ((F.col("end") - F.col("start")) * 8.0).alias("w"), F.lit(15.5).alias("h"))
    return reports.sign(hits.withColumn("box", box), F.lit("frame-1"), "doc_id")


@query
def manifest_summary(spark, d):
    return reports.render(redaction.manifest(_hits(spark, d)))


@query
def box_metrics(spark, d):
    return reports.box_metrics(_boxes(spark, d).join(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey"), "p_brand")


@query
def grounding_report(spark, d):
    steps = spark.createDataFrame(fixtures.STEPS, "plan_id bigint, step_idx int, action string, mark int, value string, reason string")
    nodes = spark.createDataFrame(fixtures.NODES, "plan_id bigint, mark int, label string, sensitive boolean")
    return reports.grounding(steps, nodes)


@query
def timeline_shares(spark, d):
    sums = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return reports.shares(sums, "n", "user_id")


@query
def device_projection(spark, d):
    stats = _events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    return reports.project(stats, {"laptop": 1.8, "tablet": 2.5, "phone": 3.5, "old": 4.5}, "mean")


@query
def provider_choice(spark, d):
    rows = _t(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("name"), F.col("s_suppkey").alias("rank"), (F.col("s_acctbal") > 0).alias("ok"))
    return reports.first_healthy(rows, "s_nationkey")


@query
def page_text(spark, d):
    return reports.screen_text(html.elements(_t(spark, d, "pages"), "page_id"), "page_id")
