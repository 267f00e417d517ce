"""Action safety, plan checks, injection scan and costs, as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs and patterns of the policies. The client's and the server's lists differ and both are kept.
DESTRUCTIVE_ACTIONS = ("submit", "send", "pay", "delete")
CLIENT_VERBS = r"(?i)\b(submit|send|pay|delete|confirm order|place order|transfer|withdraw|proceed|continue as)\b"
SERVER_VERBS = r"(?i)\b(submit|send\s+(?:money|payment|message)|pay|delete|remove\s+account|place\s+order|confirm\s+order|transfer|wire|close\s+account)\b"
IDLE = ("none", "ask_user", "wait_for")
ACTIONS = ("click", "fill", "focus", "select", "scroll", "hover", "navigate", "extract", "wait_for", "ask_user", "none")
FILLABLE = ("fill", "select")
PLACEHOLDER = r"^\[[A-Z_]+_\d+\]$|^\[PASSWORD\]$|^\[[A-Z_]+_[0-9A-F]{1,2}_[0-9a-f]{8}\]$"
INJECTION = (
    ("instruction_override", r"(?i)\b(ignore|disregard|forget)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all)\b[^.\n]{0,20}\b(instruction|prompt|rule|direction|message)s?\b"),
    ("role_reassignment", r"(?i)\byou\s+are\s+now\b|\bnew\s+(system\s+)?(prompt|instruction)s?\s*:|\bact\s+as\s+(if\s+you\s+are\s+)?(a\s+)?(different|new|unrestricted)\b"),
    ("system_prompt_leak", r"(?i)\b(reveal|print|repeat|show|output)\b[^.\n]{0,30}\b(your\s+)?(system\s+prompt|initial\s+instructions|hidden\s+instructions)\b"),
    ("exfiltration_instruction", r"(?i)\b(send|post|upload|transmit|forward|email)\b[^.\n]{0,40}\b(to\s+)?(https?://|attacker|exfil|webhook|my\s+server)\b"),
    ("credential_lure", r"(?i)\b(verify|confirm|re-enter|revalidate)\b[^.\n]{0,30}\b(password|otp|one[- ]time|2fa|pin|security\s+code|cvv)\b"),
    ("mark_injection", r"(?i)\[\s*(MARK|mark)\s*#?\s*\d+\s*\]|\btarget\s+mark\s*#?\s*\d+"),
)


def decide_safety(action: Column, verb: Column, rerolled: Column, sensitive: Column) -> Column:
    """The rule that asks for confirmation, or ``none``."""
    a = F.lower(F.coalesce(action, F.lit("")))
    hot = F.coalesce(sensitive, F.lit(False))
    return (
        F.when(a.isin(*IDLE), "none")
        .when(a.isin(*DESTRUCTIVE_ACTIONS), "destructive_action")
        .when(F.coalesce(verb, F.lit("")).rlike(CLIENT_VERBS), "destructive_verb")
        .when(hot & (a == "fill"), "fill_into_sensitive")
        .when(F.coalesce(rerolled, F.lit(False)) & hot, "reroll_into_sensitive")
        .otherwise("none")
    )


def injection_findings(text: Column, limit: int = 5) -> Column:
    """array<struct<kind, match>>: the first match of each kind, in the patterns' order, ``limit`` at most."""
    each = [F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.substring(F.trim(F.regexp_extract(text, p, 0)), 1, 120).alias("match"))) for k, p in INJECTION]
    return F.slice(F.array_compact(F.array(*each)), 1, limit)


def page_findings(texts: DataFrame, page: str, order: str, text: str = "text", limit: int = 5) -> DataFrame:
    """(page, kind, match): ``limit`` findings of each page over its texts in order."""
    found = texts.select(page, order, F.posexplode(injection_findings(F.col(text), limit)).alias("k", "f"))
    w = Window.partitionBy(page).orderBy(order, "k")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(page, "n", "f.kind", "f.match")


def plan_problems(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, step_idx, problem) for every broken rule.

    steps: (plan_id, step_idx, action, mark, value, reason) and, where a plan has them, text, url, name and selector; nodes:
    (plan_id, mark, label, sensitive). A plan whose page has no marks is not held to them.
    """
    last = F.max("step_idx").over(Window.partitionBy("plan_id"))
    known = nodes.select("plan_id", "mark", "label", "sensitive").withColumn("known", F.lit(True))
    some = nodes.select("plan_id").distinct().withColumn("has_marks", F.lit(True))
    rows = steps.withColumn("last", last).join(known, ["plan_id", "mark"], "left").join(some, "plan_id", "left")
    acting = ~F.col("action").isin("ask_user", "none")
    words = F.concat_ws(" ", "action", *[c for c in ("value", "text", "reason", "url", "name", "selector") if c in steps.columns])
    say = lambda when, what: F.when(when, F.lit(what))
    problems = F.array_compact(
        F.array(
            say(~F.col("action").isin(*ACTIONS), "unknown action"),
            say((F.col("action") == "none") & (F.col("step_idx") != F.col("last")), "none must be last"),
            say(F.col("action").isin(*FILLABLE) & F.col("mark").isNull(), "needs a mark"),
            say(F.col("mark") < 0, "negative mark"),
            say(acting & words.rlike(SERVER_VERBS), "destructive words"),
            say(F.col("mark").isNotNull() & F.col("has_marks") & F.col("known").isNull(), "unknown mark"),
            say(acting & F.col("label").rlike(SERVER_VERBS), "destructive label"),
            say(F.col("action").isin(*FILLABLE) & F.col("sensitive"), "sensitive field"),
            say((F.col("action") == "fill") & F.col("sensitive") & (F.length("value") > 3) & ~F.trim("value").rlike(PLACEHOLDER), "raw value"),
        )
    )
    return rows.select("plan_id", "step_idx", F.explode(problems).alias("problem"))


def usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost in dollars at prices a million tokens; an unknown price gives null."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000
