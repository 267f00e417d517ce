"""Small scalar functions of the pipeline around the detectors, as native expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as browsers know it, for use in a character class.
WHITE = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def clamp(text: Column, most: int = 500) -> Column:
    """One line without white space around it: breaks become a mark, and what is longer than ``most`` ends in an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(text, f"[{WHITE}]*\n[{WHITE}]*", " ⏎ "), f"^[{WHITE}]+|[{WHITE}]+\\z", "")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def image_bytes(encoded: Column) -> Column:
    """Bytes behind a base64 text, by its length."""
    return F.floor(F.length(F.coalesce(encoded, F.lit(""))) * 3 / 4).cast("bigint")


def round_scaled(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines and C do, halves of the scaled number away from zero; Spark's own goes by the decimals shown."""
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


def cap_to_edge(w: Column, h: Column, edge: int = 1280) -> Column:
    """struct(w, h, scale) with the longer side at most ``edge``."""
    long = F.greatest(w, h)
    scale = F.when(long <= edge, 1.0).otherwise(F.lit(float(edge)) / long)
    return F.struct(F.floor(w * scale + 0.5).cast("int").alias("w"), F.floor(h * scale + 0.5).cast("int").alias("h"), F.round(scale, 6).alias("scale"))


def send_tiles(turn: Column, tile_bytes: Column, full_bytes: Column) -> Column:
    """Whether tiles go instead of the frame: later turns only, and only if they are smaller."""
    return F.coalesce((turn > 1) & (tile_bytes > 0) & (tile_bytes < full_bytes), F.lit(False))


def capture_mode(tab: Column, visible: Column, live: Column, region: Column, prefer_region: Column) -> Column:
    """struct(mode, crop): a live stream where it is wanted and can be had, else snapshots, else the page's text alone."""
    stream = tab & live
    return F.struct(F.when(stream, "stream").when(visible, "snapshot").otherwise("pixel-only").alias("mode"), (stream & region & prefer_region).alias("crop"))


def device_tier(ram: Column, vram: Column, threads: Column, gpu: Column) -> Column:
    """minimal, reduced or full, by memory, video memory and cores; unknown memory (0) is not held against a device."""
    return F.when((ram != 0) & (ram < 2) & (threads < 4), "minimal").when(gpu & (vram > 0) & (vram < 512), "reduced").otherwise("full")


def token_batch(vram: Column, threads: Column, gpu: Column, isolated: Column, tier: Column) -> Column:
    """Texts per model call on a device."""
    usable = F.when(isolated, F.greatest(threads - 1, F.lit(1))).otherwise(1)
    cpu = F.when(usable >= 4, 8).when(usable >= 2, 4).otherwise(2)
    return F.when(tier != "full", 0).when(~gpu, cpu).when(vram >= 2048, 16).when(vram >= 1024, 8).otherwise(4)


def device_plan(ram: Column, vram: Column, threads: Column, gpu: Column, isolated: Column) -> Column:
    """struct(tier, can_l2, can_l3, can_audit, batch, bottleneck, reason): which layers a device can run, and why."""
    tier = device_tier(ram, vram, threads, gpu)
    usable = F.when(isolated, F.greatest(threads - 1, F.lit(1))).otherwise(1)
    bottleneck = F.when(tier == "minimal", "ram").when(gpu, "vram").when(isolated, "threads").otherwise("unknown")
    reason = (
        F.when(tier == "minimal", "little memory and few cores: patterns and field names only")
        .when(tier == "reduced", F.concat(F.lit("no room for the token model in "), vram.cast("string"), F.lit(" MB of video memory")))
        .when(gpu, F.concat(vram.cast("string"), F.lit(" MB of video memory")))
        .when(isolated, F.concat(F.lit("no GPU: "), usable.cast("string"), F.lit(" threads")))
        .otherwise("no GPU: one thread")
    )
    full = tier == "full"
    return F.struct(tier.alias("tier"), full.alias("can_l2"), (tier != "minimal").alias("can_l3"), (full & gpu & (vram >= 2048)).alias("can_audit"), token_batch(vram, threads, gpu, isolated, tier).alias("batch"), bottleneck.alias("bottleneck"), reason.alias("reason"))


def model_verdict(error: Column, turns: Column, used_mark: Column, invented: Column, invalid: Column, truncated: Column) -> Column:
    """One word about a compared model; marks that it invents weigh more than slowness."""
    return (
        F.when(error | (turns == 0), "UNUSABLE")
        .when(used_mark == 0, "NO GROUNDING")
        .when(invented > 0, "INVENTS MARKS")
        .when(invalid > 0, "INVALID PLANS")
        .when(truncated > 0, "TRUNCATES")
        .otherwise("USABLE")
    )


def recover_offsets(words: Column, source: Column) -> Column:
    """array<struct<word, start, end>> of sub-word pieces walked along the text; pieces that don't occur are dropped.

    A piece is sought from the end of the last one, else anywhere.
    """
    kind = "array<struct<word:string,start:int,end:int>>"
    low = F.lower(source)

    def step(s: Column, w: Column) -> Column:
        piece = F.regexp_replace(w, "^##", "")
        ahead = F.call_function("locate", F.lower(piece), low, s["at"] + 1)
        at = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", F.lower(piece), low, F.lit(1)))
        skip = w.isNull() | w.isin("[CLS]", "[SEP]", "[PAD]", "[UNK]") | (piece == "") | (at == 0)
        hit = F.struct(w.alias("word"), (at - 1).alias("start"), (at - 1 + F.length(piece)).alias("end"))
        return F.when(skip, s).otherwise(F.struct((at - 1 + F.length(piece)).alias("at"), F.concat(s["out"], F.array(hit)).alias("out")))

    return F.aggregate(words, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])
