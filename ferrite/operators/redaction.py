"""Pseudonyms, redacted text, manifests, the fail-closed gate, log scrubbing and leakage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksums import bucket, fnv1a_hex
from . import spans

PASSWORD_TOKEN = "[PASSWORD]"


def token(value: Column, cls: Column, session: str) -> Column:
    """A session's pseudonym of a value: equal values of a class share it, case and spacing aside."""
    tag = F.upper(F.substring(F.ltrim(fnv1a_hex(F.lit(session)), F.lit("0")), 1, 2))
    plain = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.when(cls == "PASSWORD", PASSWORD_TOKEN).otherwise(F.concat(F.lit("["), cls, F.lit("_"), tag, F.lit("_"), fnv1a_hex(F.concat(F.lit(session + ":"), plain)), F.lit("]")))


def redact(scanned: DataFrame, session: str, text: str = "text") -> DataFrame:
    """``scanned`` with ``redacted``: hits bridged and replaced by their tokens."""
    narrow = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["cls"].alias("cls")))
    bridged = F.when(F.size("hits") > 0, spans.bridge(F.col(text), narrow)).otherwise(F.array().cast(spans.SPAN))
    out = scanned.withColumn("_spans", bridged)
    return out.withColumn("redacted", spans.substitute(F.col(text), F.col("_spans"), lambda v, c: token(v, c, session))).drop("_spans")


def manifest(hits: DataFrame, mode: str = "exact") -> DataFrame:
    """(cls, shown, label): counts by class, exact or as powers of two."""
    n = F.count("*")
    return hits.groupBy("cls").agg(n.alias("shown")).withColumn("label", F.col("shown").cast("string") if mode == "exact" else bucket(F.col("shown")))


def top_tokens(hits: DataFrame, k: int = 6) -> DataFrame:
    """(cls, tokens): the k first tokens of each class in order, with an ellipsis if there are more.

    Rows are first brought down to distinct tokens, then ranked within a class; only k + 1 of a class go on.
    """
    distinct = hits.select("cls", "token").distinct()
    ranked = distinct.withColumn("k", F.row_number().over(Window.partitionBy("cls").orderBy("token"))).where(F.col("k") <= k + 1)
    listed = ranked.groupBy("cls").agg(F.array_sort(F.collect_list("token")).alias("t"))
    return listed.select("cls", F.concat(F.array_join(F.slice("t", 1, k), " "), F.when(F.size("t") > k, F.lit(" …")).otherwise("")).alias("tokens"))


def gate(items: DataFrame, entries: DataFrame, *by: str) -> DataFrame:
    """Fail-closed verdict per ``by``: every detected item needs an entry, every entry an area.

    items: (…, hit_id, cls); entries: (…, hit_id, w, h). Where entries have a cls, they must also declare as many opaque
    regions as were detected.
    """
    joined = items.join(entries, [*by, "hit_id"], "left")
    out = joined.groupBy(*by).agg(F.count("*").alias("n_items"), F.count("w").alias("covered"), F.count_if(F.col("w").isNull()).alias("uncovered"), F.count_if((F.col("w") * F.col("h")) <= 0).alias("empty_boxes"), F.count_if(F.col("w").isNull() & (F.col("cls") == "OPAQUE_REGION")).alias("opaque_uncovered"))
    reasons = F.array_compact(F.array(F.when(F.col("uncovered") > 0, F.concat(F.col("uncovered").cast("string"), F.lit(" uncovered"))), F.when(F.col("empty_boxes") > 0, F.concat(F.col("empty_boxes").cast("string"), F.lit(" without area"))), F.when(F.col("opaque_uncovered") > 0, F.lit("opaque region uncovered"))))
    if "cls" in entries.columns:
        opaque = lambda rows, name: rows.groupBy(*by).agg(F.count_if(F.col("cls") == "OPAQUE_REGION").alias(name))
        out = out.join(opaque(items, "_seen"), [*by], "left").join(opaque(entries, "_declared"), [*by], "left")
        declared = F.coalesce("_declared", F.lit(0))
        reasons = F.concat(reasons, F.array_compact(F.array(F.when(F.col("_seen") != declared, F.concat(declared.cast("string"), F.lit(" of "), F.col("_seen").cast("string"), F.lit(" opaque regions declared"))))))
    return out.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("ok", F.col("reasons") == "").drop("_seen", "_declared")


#: What a log line may not hold. Borders are spelt out for Java by ``_java``.
KEYS = r"\b(?:sk|pk|rk|hf|ghp|glpat|xoxb|api)[-_][A-Za-z0-9_-]{12,}\b"
JWTS = r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\b"
NAMED = r"(?i)\b(api[_-]?key|apikey|secret|password|passwd|token|authorization|bearer)\b(\s*[:=]\s*)(?:\"[^\s\",}]+\"|[^\s\",}]+)"
LONG = r"\b[A-Za-z0-9_-]{40,}\b"


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def scrub(text: Column) -> Column:
    """Credentials and long opaque runs become ``[redacted]``; a named one keeps its name and separator."""
    out = F.regexp_replace(text, _java(KEYS), "[redacted]")
    out = F.regexp_replace(out, _java(JWTS), "[redacted]")
    out = F.regexp_replace(out, _java(NAMED), "$1$2[redacted]")
    runs = F.regexp_extract_all(out, F.lit(_java(LONG)), F.lit(0))
    gaps = F.split(out, _java(LONG), -1)
    shown = F.transform(runs, lambda r: F.when(F.length(r) > 64, F.concat(F.lit("[redacted:"), F.length(r).cast("string"), F.lit(" chars]"))).otherwise("[redacted]"))
    rebuilt = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), shown), gaps, lambda v, g: F.concat(v, g)), "")
    return F.when(F.size(runs) > 0, rebuilt).otherwise(out)


def leaks(redacted: DataFrame, *keep: str) -> DataFrame:
    """(…, cls, value, leaked): whether a hit's value of four or more characters is still in the redacted text."""
    rows = redacted.select(*keep, "redacted", F.explode("hits").alias("h")).where(F.length("h.text") >= 4)
    return rows.select(*keep, F.col("h.cls").alias("cls"), F.col("h.text").alias("value"), F.contains(F.col("redacted"), F.col("h.text")).alias("leaked"))
