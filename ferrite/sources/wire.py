"""Streams and files of other programs: server-sent plans, provider chunks, forms with ground truth, result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORM = (
    "schema_version string, id string, title string, category string, split string, adversarial_kind int, html string, sha256 string, notes string, "
    "instances array<struct<id:string,cls:string,value:string,channel:string,node_id:string,selector:string,span:array<int>,box:array<double>,redaction_method:string,note:string>>, "
    "field_ids array<string>, submit_node string"
)


def forms(spark: SparkSession, path: str) -> DataFrame:
    """Form descriptions, one JSON document a file, with an explicit schema."""
    return spark.read.schema(FORM).option("multiLine", True).json(path)


def ground_truth(forms: DataFrame) -> DataFrame:
    return forms.select(F.col("id").alias("form_id"), F.explode("instances").alias("i")).select("form_id", "i.*")


def complete_json(text: Column) -> Column:
    """Whether the text is a whole JSON object or array."""
    return F.trim(text).rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull()


def plan_stream(raw: Column) -> Column:
    """struct(ok, text) of a stream of ``data:`` lines: deltas add up; one that is a whole document replaces."""
    lines = F.transform(F.split(F.regexp_replace(raw, "\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    payloads = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    kept = F.filter(payloads, lambda p: (p != "") & (p != "[DONE]"))
    deltas = F.filter(F.transform(kept, lambda p: F.get_json_object(p, "$.delta")), lambda d: d.isNotNull())
    text = F.aggregate(deltas, F.lit(""), lambda acc, d: F.when(complete_json(d), d).otherwise(F.concat(acc, d)))
    return F.struct(F.coalesce(complete_json(text), F.lit(False)).alias("ok"), text.alias("text"))


def provider_chunks(raw: Column) -> Column:
    """struct(content, filtered) of an OpenAI-style stream; lines that don't parse are skipped."""
    lines = F.filter(F.transform(F.split(raw, "\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("data:"))
    body = F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    content = F.array_join(F.filter(F.transform(body, lambda p: F.get_json_object(p, "$.choices[0].delta.content")), lambda c: c.isNotNull()), "")
    filtered = F.exists(body, lambda p: F.coalesce(F.get_json_object(p, "$.choices[0].finish_reason") == "content_filter", F.lit(False)))
    return F.struct(content.alias("content"), filtered.alias("filtered"))


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    """Results as JSON lines or as CSV with a header."""
    (df.write.mode("overwrite").option("header", True).csv if form == "csv" else df.write.mode("overwrite").json)(path)


def model_rows(raw: Column) -> Column:
    """A token model's answer as a list of token lists: one for each text of a batch, or the only one of a single text."""
    token = "struct<entity:string,score:double,word:string,start:int,end:int>"
    nested = raw.rlike(r"^\s*\[\s*\[")
    return F.when(nested, F.from_json(raw, f"array<array<{token}>>")).when(raw.rlike(r"^\s*\[\s*\]\s*$"), F.array().cast(f"array<array<{token}>>")).otherwise(F.array(F.from_json(raw, f"array<{token}>")))


def blocked_result(raw: Column) -> Column:
    """Whether a result says that its message was blocked."""
    return F.coalesce(F.get_json_object(raw, "$.blocked") == "true", F.lit(False))
