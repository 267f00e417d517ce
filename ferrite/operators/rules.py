"""The rule scan: personal data in text by pattern, with exact spans and check digits.

Offsets are code points. Patterns use ASCII classes; ``\\b`` is rewritten for Java, whose own is not ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums


@dataclass(frozen=True)
class Rule:
    cls: str
    pattern: str
    score: float
    #: Cheap test that every match passes; texts that fail it are not scanned.
    hint: str
    check: str | None = None
    checked_score: float = 0.0
    group: int = 0
    ignore_case: bool = False


FAILED_SCORE = 0.45
#: Classes, patterns and scores of the rules, in rule order.
RULES = (
    Rule("JWT", r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{4,}", 0.97, "eyJ"),
    Rule("API_KEY", r"\b(?:sk|pk|rk|api|key|ghp|gho|xox[abps])[-_][A-Za-z0-9_-]{16,}\b", 0.9, "(?:sk|pk|rk|api|key|ghp|gho|xox[abps])[-_]"),
    Rule("API_KEY", r"\bAIza[0-9A-Za-z_-]{35}\b", 0.97, "AIza"),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b", 0.96, "@"),
    Rule("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 0.55, "[0-9][ -]?[0-9][ -]?[0-9]", "luhn", 0.98),
    Rule("AADHAAR", r"(?:\b|\bAadhaar[:\s]*)\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", 0.6, "[2-9][0-9]{3}", "verhoeff", 0.99),
    Rule("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.93, "[A-Z][0-9]{4}[A-Z]"),
    Rule("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b", 0.98, "[A-Z][0-9]{4}[A-Z]"),
    Rule("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.97, "[A-Z]0"),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.95, "[A-Z]{2}[0-9]{2}", "iban", 0.99),
    Rule("PHONE", r"(?:\+?91[-\s]?|0)?\b[6-9]\d{4}[-\s]?\d{5}\b", 0.72, "[6-9][0-9]{4}"),
    Rule("PHONE", r"\+\d{1,3}[ -]?(?:\(?\d{2,4}\)?[ -]?){2,4}\d{2,4}\b", 0.6, r"\+[0-9]"),
    Rule("PASSPORT", r"\b[A-PR-WY][0-9]{7}\b", 0.8, "[A-Z][0-9]{7}"),
    Rule("DOB", r"\b(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b", 0.78, "[0-9][/-][0-9]"),
    Rule("DOB", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0.75, "[0-9]{4}-"),
    Rule("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", 0.7, r"[0-9]\.[0-9]"),
    Rule("BANK_ACCOUNT", r"\b(?:account|acct|a/c)\s*(?:no\.?|number|#)?\s*[:\-]?\s*(\d{9,18})\b", 0.88, "[0-9]{9}", group=1, ignore_case=True),
    Rule("MONEY", r"(?:₹|rs\.?|inr|usd|\$|€|£)\s?\d[\d,]*(?:\.\d{1,2})?", 0.55, r"(?i)(?:₹|rs\.?|inr|usd|\$|€|£)\s?\d", ignore_case=True),
    Rule("ADDRESS", r"\b\d{1,4}\s*,\s*[A-Za-z][A-Za-z0-9.'-]*(?:\s+[A-Za-z0-9][A-Za-z0-9.'-]*){0,4}\s*(?:road|rd\.?|street|st\.?|salai|avenue|ave\.?|lane|ln\.?|sector|sec\.?|block|blk\.?|plot|marg|cross|nagar|colony|boulevard|blvd\.?|park|square|gali|main|byepass|highway)\b\.?[^.\n]{0,40}?\b\d{6}\b", 0.8, r"[0-9]\s*,", ignore_case=True),
)

HIT = "array<struct<rule_ord:int,cls:string,source:string,score:double,text:string,start:int,end:int>>"


def java(rule: Rule) -> str:
    """The rule's pattern for Java: ASCII word borders spelt out."""
    body = rule.pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
    return ("(?i)" if rule.ignore_case else "") + body


def re2(rule: Rule) -> str:
    return ("(?i)" if rule.ignore_case else "") + rule.pattern


def rule_hits(text: Column, rule: Rule, order: int) -> Column:
    """HIT array of one rule. Starts follow from the lengths of the matches and of the gaps between them."""
    pattern = java(rule)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    # A match and the gap before it travel together, so each array is made once; the last gap has no match.
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def add(s: Column, x: Column) -> Column:
        whole, at = x["m"], s["at"] + F.length(x["g"])
        value = whole if not rule.group else F.regexp_extract(whole, pattern, rule.group)
        start = at if not rule.group else at + F.instr(whole, value) - 1
        score = F.lit(rule.score)
        if rule.check:
            plain = F.regexp_replace(whole, "[^0-9]", "") if rule.check == "verhoeff" else whole
            subject = F.substring(plain, F.greatest(F.length(plain) - 11, F.lit(1)), F.lit(12)) if rule.check == "verhoeff" else plain
            score = F.when(getattr(checksums, rule.check)(subject), rule.checked_score).otherwise(min(rule.score, FAILED_SCORE))
        hit = F.struct(F.lit(order).alias("rule_ord"), F.lit(rule.cls).alias("cls"), F.lit("L1").alias("source"), score.cast("double").alias("score"), value.alias("text"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"))
        more = F.struct((at + F.length(whole)).alias("at"), F.concat(s["hits"], F.array(hit)).alias("hits"))
        return F.when(whole.isNull(), s).otherwise(more)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("hits"))
    # Matches and gaps are two more passes and folds are interpreted: texts without a match reach neither.
    return F.when(text.rlike(rule.hint) & text.rlike(pattern), F.aggregate(pairs, zero, add, lambda s: s["hits"])).otherwise(F.array().cast(HIT))


def all_hits(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """HIT array of all rules, in rule order; null text has none."""
    return F.flatten(F.array(*[rule_hits(F.coalesce(text, F.lit("")), r, k) for k, r in enumerate(rules)]))


def dedupe(hits: Column) -> Column:
    """Greedy choice of hits that don't overlap: best score first, then earlier start, then rule order."""
    compare = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["rule_ord"] < b["rule_ord"], -1).when(a["rule_ord"] > b["rule_ord"], 1).otherwise(0)
    )
    keep = lambda kept, h: F.when(F.exists(kept, lambda k: (h["start"] < k["end"]) & (k["start"] < h["end"])), kept).otherwise(F.concat(kept, F.array(h)))
    chosen = F.aggregate(F.array_sort(hits, compare), F.array().cast(HIT), keep)
    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    return F.when(F.size(hits) > 1, F.array_sort(chosen, by_start)).otherwise(hits)


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: a generated row holds it, so what reads it, a filter too, can't repeat it."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def scan(docs: DataFrame, text: str = "text", resolve: bool = True, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with an array column ``hits``; with ``resolve``, overlaps are settled."""
    out = _computed(docs, "hits", all_hits(F.col(text), rules))
    return _computed(out, "hits", dedupe(F.col("hits"))) if resolve else out


def explode(scanned: DataFrame, *keep: str) -> DataFrame:
    """One row a hit, with the columns in ``keep``."""
    return scanned.select(*keep, F.explode_outer("hits").alias("h")).where(F.col("h").isNotNull()).select(*keep, "h.*")
