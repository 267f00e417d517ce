import json
import math

from pyspark.sql import functions as F

from ferrite.functions import small
from ferrite.operators import redaction, reports, rules


def test_offsets_of_pieces(spark):
    df = spark.createDataFrame([(["[CLS]", "Ann", "##e", "Lee", "zz", "ann", None], "Anne Lee, ann")], "w array<string>, s string")
    got = df.select(small.recover_offsets(F.col("w"), F.col("s")).alias("r")).first().r
    assert [(r.word, r.start, r.end) for r in got] == [("Ann", 0, 3), ("##e", 3, 4), ("Lee", 5, 8), ("ann", 10, 13)]


def test_names_lose_only_first_occurrences(spark):
    df = rules.scan(spark.createDataFrame([("mail a@b.example.com",)], "text string"))
    out = df.withColumn("name", F.lit("Write a@b.example.com or a@b.example.com")).select(reports.redact_name(F.col("name"), F.col("hits"), "s")).first()[0]
    assert out.startswith("Write [EMAIL_") and out.endswith(" or a@b.example.com")


def test_noise_is_stable_and_counts_stay_whole(spark):
    m = spark.createDataFrame([("EMAIL", 12), ("PAN", 1)], "cls string, shown bigint")
    one = [tuple(r) for r in reports.noisy_counts(m, "s-1").collect()]
    assert one == [tuple(r) for r in reports.noisy_counts(m, "s-1").collect()] and all(r[2] >= 0 for r in one)
    wide = spark.range(400).select(F.col("id").cast("string").alias("cls"), F.lit(100).cast("bigint").alias("shown"))
    assert abs(reports.noisy_counts(wide, "s").agg(F.avg("released")).first()[0] - 100) < 0.5


def test_manifest_and_signature(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    hits = spark.createDataFrame([(1, "a", "EMAIL", "x@y.example.org", (1.0, 1.0, 0.4, 9.0)), (1, "b", "FACE", "", None)], f"page int, hit_id string, cls string, text string, box {box}")
    rows = {r.hit_id: r for r in reports.build_manifest(hits, 2.0, "s").collect()}
    assert rows["a"].box.w == 2.0 and rows["a"].box.h == 18.0 and rows["a"].method == "solid_fill" and rows["b"].method == "pixelate"
    boxed = spark.createDataFrame([(1, "a", "EMAIL", "x", (1.2, 1.0, 0.4, 9.0)), (1, "b", "FACE", "", (7.0, 3.0, 20.0, 9.0)), (1, 'q"', "PAN", "", (7.0, 3.0, 20.0, 9.0))], hits.schema)
    entries = reports.build_manifest(boxed, 2.0, "s")
    signed = reports.sign(entries, F.lit("frame"), "page").first().signature
    rows = sorted(([e.hit_id, e.cls, e.method, *(math.floor(e.box[k] + 0.5) for k in "xywh")] for e in entries.collect()), key=lambda r: ",".join(map(str, r)))
    text = json.dumps(rows, separators=(",", ":"))
    h1, h2 = 0x811C9DC5, 0x01000193
    for c in text + "frame":
        h1, h2 = (h1 ^ ord(c)) * 0x01000193 % 2**32, (h2 ^ ord(c)) * 0x85EBCA6B % 2**32
    assert signed == f"{h1:08x}{h2:08x}{len(text):08x}"
    assert reports.render(redaction.manifest(hits.limit(0))).first()[0] == "HIDDEN: 0 item(s) in 0 class(es)"


def test_luma_cells(spark):
    px = spark.range(16 * 16).select(F.lit(1).alias("frame"), (F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"), F.when(F.col("id") % 16 < 8, 255).otherwise(0).alias("r"), F.when(F.col("id") % 16 < 8, 255).otherwise(0).alias("g"), F.when(F.col("id") % 16 < 8, 255).otherwise(0).alias("b"))
    assert reports.luma_cells(px, "frame", 16, 16, 2).first().cells == [255.0, 0.0, 255.0, 0.0]


def test_model_verdicts(spark):
    rows = [(True, 1, 1, 0, 0, 0, "UNUSABLE"), (False, 3, 0, 0, 0, 0, "NO GROUNDING"), (False, 3, 2, 1, 0, 0, "INVENTS MARKS"), (False, 3, 3, 0, 0, 1, "TRUNCATES"), (False, 3, 3, 0, 0, 0, "USABLE")]
    df = spark.createDataFrame(rows, "e boolean, t int, u int, i int, v int, c int, want string")
    assert df.where(small.model_verdict(*[F.col(x) for x in "etuivc"]) != F.col("want")).count() == 0
