"""Runs of an agent over event tables: deadlines, confirmations, turns, the panel's state, preconditions, ledgers.

Each is one ordered window or one aggregation by run; order is explicit everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Below this confidence a plan asks; the panel's bounds; messages that end a run.
CONFIDENCE_FLOOR, TURNS_MAX, TURNS_KEPT = 0.55, 60, 40
TERMINAL = ("redact:aborted", "panel:plan", "panel:answer", "panel:error")


def stage_deadlines(events: DataFrame, run: str, t: str, order: str, kind: str, budget: int) -> DataFrame:
    """``begin`` events with ``outcome``: refused, expired, cleared or pending.

    A run's deadline settles once, by an ``end`` or by running out; later begins are refused until a ``forget``. A begin
    that comes in time after another re-arms it.
    """
    along = Window.partitionBy(run).orderBy(t, order)
    epoch = F.sum((F.col(kind) == "forget").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.where(F.col(kind).isin("begin", "end", "forget")).withColumn("_epoch", epoch).where(F.col(kind) != "forget")
    within = Window.partitionBy(run, "_epoch").orderBy(t, order)
    late = F.lead(t).over(within)
    rows = rows.withColumns({"_next": F.lead(kind).over(within), "_late": late.isNotNull() & (late - F.col(t) > budget)})
    settles = ((F.col(kind) == "end") | F.col("_late")).cast("int")
    rows = rows.withColumn("_settled", F.coalesce(F.max(settles).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    outcome = F.when(F.col("_settled"), "refused").when(F.col("_late"), "expired").when(F.col("_next").isNull(), "pending").otherwise("cleared")
    return rows.where(F.col(kind) == "begin").withColumn("outcome", outcome).drop("_epoch", "_next", "_late", "_settled")


def confirmations(events: DataFrame, key: str, t: str, order: str, asks: Column, answers: Column, yes: Column, timeout: int) -> DataFrame:
    """The events that ask, with ``confirmed``: what the next answer of the key says, no if it takes longer than ``timeout``."""
    later = Window.partitionBy(key).orderBy(t, order).rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(answers, F.struct(F.col(t).alias("t"), yes.alias("yes"))), ignorenulls=True).over(later)
    rows = events.withColumns({"_ask": asks, "_answer": answer}).where("_ask")
    return rows.withColumn("confirmed", F.coalesce((F.col("_answer.t") - F.col(t) <= timeout) & F.col("_answer.yes"), F.lit(False))).drop("_ask", "_answer")


def turns(events: DataFrame, key: str, t: str, order: str, fresh: Column) -> DataFrame:
    """``events`` with ``session`` and ``turn``: a fresh start opens a session, each further event is its next turn."""
    along = Window.partitionBy(key).orderBy(t, order)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    # Fresh or not, the first event opens session 1.
    rows = events.withColumn("session", F.sum(fresh.cast("bigint")).over(so_far) + F.when(F.first(fresh).over(so_far), 0).otherwise(1))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key, "session").orderBy(t, order)) - 1)


def frame_decision(own: Column, target: Column, is_top: Column) -> Column:
    """struct(execute, reason): a frame acts only on messages that name it."""
    run = F.coalesce(own == target, F.lit(False))
    why = F.when(target.isNull(), "no target frame").when(run & is_top, "top frame").when(run, F.concat(F.lit("frame "), own.cast("string"))).otherwise(F.concat(F.lit("meant for frame "), target.cast("string")))
    return F.struct(run.alias("execute"), why.alias("reason"))


def panel(messages: DataFrame, run: str, seq: str) -> DataFrame:
    """A row per run from messages (run, seq, kind, redactions, opaque, bytes, tier, label): counters and whether it is busy."""
    last = lambda c: F.max_by(c, F.when(F.col("kind") == "redact:ready", F.col(seq)))
    ends = F.col("kind").isin(*TERMINAL) & ~((F.col("kind") == "panel:answer") & (F.coalesce("tier", F.lit("")) == "confirm"))
    aborted = (F.col("kind") == "redact:aborted") | ((F.col("kind") == "panel:ledger") & F.coalesce(F.col("label").startswith("aborted"), F.lit(False)))
    return messages.groupBy(run).agg(
        F.count_if(F.col("kind") == "panel:stage").alias("n_stages"),
        F.coalesce(last("redactions"), F.lit(0)).alias("redactions"),
        F.coalesce(last("opaque"), F.lit(0)).alias("opaque"),
        F.coalesce(F.sum(F.when(F.col("kind") == "redact:ready", F.col("bytes"))), F.lit(0)).alias("bytes_out"),
        F.count_if(aborted).alias("aborts"),
        (F.count_if(ends) == 0).alias("busy"),
    )


def step_states(messages: DataFrame, run: str, seq: str) -> DataFrame:
    """(run, action_index, status, note) after the last execute:done message of each step."""
    note = F.when(F.col("ok"), F.when(F.col("effect") == "unknown", "ran, not verified").otherwise("")).otherwise(F.col("status"))
    done = messages.where("kind = 'execute:done'").groupBy(run, "action_index").agg(F.max_by(F.struct(F.when(F.col("ok"), "done").otherwise("failed").alias("status"), note.alias("note")), seq).alias("s"))
    return done.select(run, "action_index", "s.status", "s.note")


def bounded_transcript(turns: DataFrame, key: str, order: str) -> DataFrame:
    """What is left of each transcript: whenever it passes TURNS_MAX turns it is cut to the last TURNS_KEPT."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    left = F.when(n <= TURNS_MAX, n).otherwise(TURNS_KEPT + (n - TURNS_MAX - 1) % (TURNS_MAX + 1 - TURNS_KEPT))
    rows = turns.withColumns({"_left": left, "_k": F.row_number().over(w.orderBy(F.col(order).desc()))})
    return rows.where("_k <= _left").drop("_left", "_k")


def overdue(messages: DataFrame, run: str, t: str, seq: str, starts: Column, ends: Column, stage: Column, budget: int, now: Column) -> DataFrame:
    """(run, started, last_stage) of runs without a terminal message within ``budget`` of their start, as of ``now``."""
    by = messages.groupBy(run).agg(F.min(F.when(starts, F.col(t))).alias("started"), F.min(F.when(ends, F.col(t))).alias("_ended"), F.collect_list(F.when(stage.isNotNull(), F.struct(F.col(t).alias("t"), F.col(seq).alias("k"), stage.alias("s")))).alias("_stages"))
    until = F.col("started") + budget
    before = F.transform(F.array_sort(F.filter("_stages", lambda s: s["t"] <= until)), lambda s: s["s"])
    late = F.col("started").isNotNull() & (F.coalesce("_ended", now) > until)
    return by.where(late).select(run, "started", F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("starting")).alias("last_stage"))


def precondition(abort_reason: Column, turn: Column, has_image: Column, n_tiles: Column, has_base: Column) -> Column:
    """The status that a request gets before anything else: 409, 400 or 200."""
    return F.when(F.coalesce(abort_reason, F.lit("")) != "", 409).when((turn > 0) & ~has_image & (n_tiles == 0), 400).when((n_tiles > 0) & ~has_image & ~has_base, 409).otherwise(200)


def escalate(plans: DataFrame, problems: DataFrame) -> DataFrame:
    """(plan_id, ask, confidence, reason) for plans (plan_id, confidence, exhausted, parse_error) and their problems (plan_id, step_idx, problem).

    A plan that does not parse passes, unless it was refused as destructive: then it asks, with no confidence. One that
    parses asks if its confidence is below the floor, its session has used up its attempts or a check found a problem.
    """
    found = problems.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", "problem"))).alias("_p"))
    rows = plans.join(found, "plan_id", "left")
    listed = F.transform(F.coalesce("_p", F.array().cast("array<struct<step_idx:int,problem:string>>")), lambda p: F.concat(F.lit("step "), p["step_idx"].cast("string"), F.lit(": "), p["problem"]))
    reasons = F.concat(F.array_compact(F.array(F.when(F.col("confidence") < CONFIDENCE_FLOOR, "low confidence"), F.when(F.col("exhausted"), "attempts used up"))), listed)
    destructive = F.contains(F.col("parse_error"), F.lit("destructive verb"))
    ask = F.when(F.col("parse_error").isNotNull(), destructive).otherwise(F.size(reasons) > 0)
    return rows.select("plan_id", ask.alias("ask"), F.when(F.col("parse_error").isNotNull() & destructive, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(ask, F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).otherwise(F.array_join(reasons, "; "))).alias("reason"))


def ledger(rows: DataFrame, run: str) -> DataFrame:
    """(run, bytes_sent, n_sent, n_aborted): an aborted frame is listed and has sent nothing."""
    sent = F.coalesce("aborted", F.lit(False)) == F.lit(False)
    return rows.groupBy(run).agg(F.coalesce(F.sum(F.when(sent, F.col("bytes"))), F.lit(0)).alias("bytes_sent"), F.count_if(sent).alias("n_sent"), F.count_if(~sent).alias("n_aborted"))


def log_metadata(session: Column, intent: Column, frame_hash: Column, image: Column, out: Column) -> Column:
    """What a log may say of a request: the ends of ids, hashes and lengths."""
    return F.struct(F.right(session, F.lit(8)).alias("session"), F.substring(F.sha2(intent, 256), 1, 12).alias("prompt"), F.substring(frame_hash, 1, 12).alias("frame"), F.length(F.coalesce(image, F.lit(""))).alias("bytes_out"), F.length(F.coalesce(out, F.lit(""))).alias("bytes_in"))


def persist_ring(entries: DataFrame, path: str) -> None:
    """Save a log ring's entries (t, order, channel, text, level); what was there before is replaced."""
    entries.write.mode("overwrite").parquet(path)


def restore_ring(spark: SparkSession, path: str, t: str, order: str, size: int = 200) -> DataFrame:
    """The last ``size`` saved entries that have a text."""
    from .events import ring

    return ring(spark.read.parquet(path).where("text IS NOT NULL"), t, order, size)


def plan_outcomes(steps: DataFrame, plan: str, order: str, cap: int = 20) -> DataFrame:
    """(plan, ok, executed, halted, failed, stopped_at, capped) of plans run step by step.

    steps: action, and what came of it: approved (a human's answer to ask_user), ok (the page's answer), needs_confirm (the
    page wants a human first), confirmed (that answer) and retry_ok (the one retry after it). ``none`` ends a plan, waits
    always pass; a decline or a failure stops it.
    """
    w = Window.partitionBy(plan)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = steps.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    asks, waits = F.col("action") == "ask_user", F.col("action") == "wait_for"
    declined = (asks & ~yes("approved")) | (yes("needs_confirm") & ~yes("confirmed"))
    done = F.when(yes("needs_confirm"), yes("retry_ok")).otherwise(yes("ok"))
    what = F.when(F.col("_i") >= cap, "beyond").when(F.col("action") == "none", "end").when(waits, "wait").when(asks & ~yes("approved"), "declined").when(declined, "declined").when(done, "executed").otherwise("failed")
    rows = rows.withColumn("_what", what).withColumn("_halts", F.when(waits | (F.col("action") == "none"), 0).otherwise(asks.cast("int") + (yes("needs_confirm") & (~asks | yes("approved"))).cast("int")))
    stop = F.min(F.when(F.col("_what").isin("end", "declined", "failed"), F.col("_i"))).over(w)
    rows = rows.withColumn("_stop", stop).where(F.col("_i") <= F.coalesce("_stop", F.lit(cap - 1)))
    return rows.groupBy(plan).agg(
        (F.count_if(F.col("_what").isin("declined", "failed")) == 0).alias("ok"),
        F.count_if(F.col("_what") == "executed").alias("executed"),
        F.sum("_halts").alias("halted"),
        F.count_if(F.col("_what") == "failed").alias("failed"),
        F.max("_stop").cast("bigint").alias("stopped_at"),
        (F.max("_n") > cap).alias("capped"),
    )
