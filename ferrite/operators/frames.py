"""Change detection between frames given as arrays of luma cells, and ordering and matching of page controls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HAMMING_CUT, MAD_CUT, CELL_CUT, TILE_SHARE = 2, 1.2, 6.0, 0.02
#: Labels of up to this many words meet through subsets of their words, longer ones through their rarer words.
SHORT_LABEL = 6


def mean_abs_diff(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def dhash64(cells: Column, width: int = 8) -> Column:
    """64 comparisons of each cell with its right neighbour, the last column with the first, as 16 hex digits."""
    right = lambda i: F.when(i % width == width - 1, i - (width - 1)).otherwise(i + 1)
    bits = F.transform(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: F.when(F.get(cells, i) > F.get(cells, right(i)), "1").otherwise("0"))
    return F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))


def dhash_ref(cells: Column, width: int = 64) -> Column:
    """The published fold: comparisons 0 to 31 make the low word; all later ones are ORed into the high word by position mod 32."""
    n = F.size(cells)
    index = F.filter(F.sequence(F.lit(0), n - 2), lambda i: i % width != width - 1)
    bit = F.zip_with(index, F.sequence(F.lit(0), F.size(index) - 1), lambda i, k: F.when(F.get(cells, i) > F.get(cells, i + 1), k))
    word = lambda low: F.aggregate(F.filter(bit, lambda k: k.isNotNull() & ((k < 32) if low else (k >= 32))), F.lit(0).cast("bigint"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k % 32)))
    return F.lower(F.concat(F.lpad(F.hex(word(False)), 8, "0"), F.lpad(F.hex(word(True)), 8, "0")))


def hamming_hex(a: Column, b: Column) -> Column:
    half = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def gate(frames: DataFrame, stream: str, seq: str, cells: str = "cells", dom_hash: str = "dom_hash") -> DataFrame:
    """Frames with ``reason``: first, pixels, structure, both or unchanged, against the frame before."""
    w = Window.partitionBy(stream).orderBy(seq)
    rows = frames.withColumn("_d", dhash64(F.col(cells))).withColumn("_pc", F.lag(cells).over(w)).withColumn("_ph", F.lag(dom_hash).over(w))
    rows = rows.withColumn("_pd", F.lag("_d").over(w)).withColumn("mad", F.round(mean_abs_diff(F.col(cells), F.col("_pc")), 4)).withColumn("hamming", hamming_hex(F.col("_d"), F.col("_pd")))
    pixels, structure = (F.col("hamming") > HAMMING_CUT) | (F.col("mad") > MAD_CUT), ~F.col(dom_hash).eqNullSafe(F.col("_ph"))
    reason = F.when(F.col("_pc").isNull(), "first").when(pixels & structure, "both").when(pixels, "pixels").when(structure, "structure").otherwise("unchanged")
    return rows.withColumn("reason", reason).drop("_d", "_pc", "_ph", "_pd")


def dirty_tiles(pairs: DataFrame, *by: str, width: int = 8, tile: int = 2, cut: float = CELL_CUT, share: float = TILE_SHARE) -> DataFrame:
    """(by, tx, ty, change) of the tiles in which more than ``share`` of the cells moved by more than ``cut``.

    ``pairs`` has the arrays ``cells`` and ``before``.
    """
    moved = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: (F.abs(F.get(F.col("cells"), i).cast("double") - F.get(F.col("before"), i).cast("double")) > cut).cast("double"))
    cells = pairs.select(*by, F.posexplode(moved).alias("i", "m"))
    tx, ty = F.floor(F.col("i") % width / tile).cast("int"), F.floor(F.floor(F.col("i") / width) / tile).cast("int")
    return cells.groupBy(*by, tx.alias("tx"), ty.alias("ty")).agg(F.round(F.avg("m"), 6).alias("change")).where(F.col("change") > share)


def rectangles(tiles: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Tiles (x, y, change) joined into rectangles with their greatest change, greedily: as far right as they go, then as far down."""
    change = {(x, y): c for x, y, c in tiles}
    left = set(change)
    out = []
    for x, y in sorted(left, key=lambda c: (c[1], c[0])):
        if (x, y) not in left:
            continue
        w = 1
        while (x + w, y) in left:
            w += 1
        h = 1
        while all((x + i, y + h) in left for i in range(w)):
            h += 1
        inside = {(x + i, y + j) for i in range(w) for j in range(h)}
        left -= inside
        out.append((x, y, w, h, max(change[c] for c in inside)))
    return out


def coalesce_tiles(tiles: DataFrame, frame: str) -> DataFrame:
    """(frame, x, y, w, h, change): each frame's tiles (tx, ty, change) as rectangles. The greedy order is sequential within one small frame."""
    from ..session import ship_package

    ship_package(tiles.sparkSession)
    kind = tiles.schema[frame].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = rectangles(zip(group["tx"].tolist(), group["ty"].tolist(), group["change"].tolist(), strict=True))
        return pd.DataFrame([(group[frame].iloc[0], *r) for r in rows], columns=[frame, "x", "y", "w", "h", "change"])

    return tiles.where(F.col(frame).isNotNull()).groupBy(frame).applyInPandas(run, f"{frame} {kind}, x int, y int, w int, h int, change double")


def marks(controls: DataFrame, page: str, order: str, band: int = 24) -> DataFrame:
    """Eligible controls with ``mark``, 1-based in reading order: bands of ``band`` pixels, then x."""
    w = Window.partitionBy(page).orderBy(F.floor(F.col("y") / band), "x", order)
    return controls.where("eligible").withColumn("mark", F.row_number().over(w)).withColumn("label", F.substring("label", 1, 80))


def label_tokens(label: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))


def label_similarity(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Jaccard similarity of two labels' words, ``x`` and ``y`` if known; if either has none, 1 for equal labels and else 0."""
    x, y = label_tokens(a) if x is None else x, label_tokens(b) if y is None else y
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(none, F.when(F.lower(a) == F.lower(b), 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _parts(words: Column) -> Column:
    """All non-empty subsets of a short set of words; the single words of a longer one."""
    subsets = F.aggregate(words, F.array(F.array().cast("array<string>")), lambda s, w: F.concat(s, F.transform(s, lambda x: F.concat(x, F.array(w)))))
    return F.when(F.size(words) <= SHORT_LABEL, F.filter(subsets, lambda x: F.size(x) > 0)).otherwise(F.transform(words, lambda w: F.array(w)))


def _first_two(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """Rows of the first two places in order, all that share one, with their place ``_k``."""
    return rows.withColumn("_k", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).where("_k <= 2")


def _named(df: DataFrame, page: str) -> DataFrame:
    return df.select(page, "node_id", "label").where(F.col(page).isNotNull() & F.col("node_id").isNotNull() & F.col("label").isNotNull())


def _best_two(wanted: DataFrame, live: DataFrame, page: str) -> DataFrame:
    """(page, label, x0, x1): for each wanted label the two most similar live nodes b, best first, s being the similarity below zero.

    Candidates share at least one word, or are equal labels without words. Labels with the same words are one class, which
    two nodes stand for, as one may be the node itself. Classes of up to ``SHORT_LABEL`` words meet in the subset that they
    share: of all sets with that subset and one size only the least two nodes count, so neither copies nor frequent words
    are paired. Where a longer class takes part, single words give a bound first, and the pairs that can still reach it are
    found by the rarer words of the wanted label.
    """
    tokens = label_tokens(F.col("label"))
    words = F.when(F.size(tokens) == 0, F.array(F.concat(F.lit("="), F.lower("label")))).otherwise(F.sort_array(tokens))
    key, size = [page, "words"], F.size("words")

    # Equal labels meet first, so that only different ones are taken apart. Words depend on a value of the group, always
    # true, or what the joins below ask of them would be moved down and worked out for every row of every scan.
    least = _first_two(_named(live, page), [page, "label"], "node_id").select(page, F.when(F.col("_k") > 0, words).alias("words"), F.col("node_id").alias("b"))
    nodes = _first_two(least, key, "b").select(*key, "b").distinct()
    labels = _named(wanted, page).groupBy(page, "label").agg(F.count("*").alias("_n")).select(page, "label", F.when(F.col("_n") > 0, words).alias("words"))
    asked = labels.select(*key).distinct()
    index = nodes.select(page, F.explode(_parts(F.col("words"))).alias("part"), size.alias("m"), "b")
    index = _first_two(index, [page, "part", "m"], "b").select(page, "part", "m", "b").distinct()
    shared = asked.select(*key, F.explode(_parts(F.col("words"))).alias("part")).join(index, [page, "part"])
    similarity = F.round(F.size("part") / (size + F.col("m") - F.size("part")), 6).alias("similarity")
    best = lambda df: _first_two(df.groupBy(*key, "b").agg(F.max("similarity").alias("similarity")), key, F.col("similarity").desc(), "b").drop("_k")
    near = best(shared.select(*key, "b", similarity))

    # A set that shares c words with a wanted one has one of all but its c - 1 most frequent words. Single words are done, and
    # the second best so far asks for a share of the wanted words, rounding allowed for.
    classes = nodes.groupBy(*key).agg(F.collect_list("b").alias("bs"))
    of_live = classes.select(page, F.col("words").alias("other"), "bs", (size > SHORT_LABEL).alias("long"), F.explode("words").alias("word"))
    bound = near.groupBy(*key).agg(F.when(F.count("*") == 2, F.min("similarity") - 1e-6).otherwise(0.0).alias("bound"))
    heads = bound.select(*key, (size - F.greatest(F.lit(2), F.ceil(size * F.col("bound"))) + 1).alias("keep"), F.explode("words").alias("word"))
    heads = heads.join(of_live.groupBy(page, "word").agg(F.count("*").alias("df")), [page, "word"], "left")
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("df", F.lit(0)), "word"))).where("k <= keep")
    heads = heads.select(*key, "word", F.explode(F.when(size > SHORT_LABEL, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("long"))
    pairs = heads.join(of_live, [page, "word", "long"]).select(*key, "other", "bs").distinct()
    far = pairs.select(*key, F.explode("bs").alias("b"), F.round(F.size(F.array_intersect("words", "other")) / F.size(F.array_union("words", "other")), 6).alias("similarity"))

    two = best(near.unionByName(far)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "b"))).alias("two"))
    return labels.join(two, key).select(page, "label", F.get("two", F.lit(0)).alias("x0"), F.get("two", F.lit(1)).alias("x1"))


def _other_than(node: Column) -> Column:
    """The better of ``_best_two`` that isn't the node itself."""
    return F.when(F.col("x0.b") != node, F.col("x0")).when(F.col("x0.b") == node, F.col("x1"))


def best_label(wanted: DataFrame, live: DataFrame, page: str) -> DataFrame:
    """(page, node_id, best_node, similarity): each wanted label's most similar live one on its page, itself excluded."""
    found = _named(wanted, page).join(_best_two(wanted, live, page), [page, "label"]).select(page, "node_id", _other_than(F.col("node_id")).alias("x")).where("x IS NOT NULL")
    return found.groupBy("node_id", page).agg(F.min("x").alias("x")).select(page, "node_id", F.col("x.b").alias("best_node"), (-F.col("x.s")).alias("similarity"))


def resolve_marks(assigned: DataFrame, live: DataFrame, page: str) -> DataFrame:
    """(page, mark, status, node): ok if the node still carries its label, reassigned to the best match, or lost.

    The best match is that of ``best_label``, found per label and brought to the rows before they meet the live ones.
    """
    found = assigned.select(page, "mark", "node_id", "label").join(_best_two(assigned, live, page), [page, "label"], "left")
    best = F.min(_other_than(F.col("node_id"))).over(Window.partitionBy("node_id", page))
    found = found.select(page, "mark", "node_id", "label", best.alias("x"))
    here = found.join(live.select("node_id", page, F.col("label").alias("now")), ["node_id", page], "left")
    kept, changed = F.col("label") == F.col("now"), F.col("label") != F.col("now")
    here = here.withColumns({"before": F.when(changed, label_tokens(F.col("label"))), "after": F.when(changed, label_tokens(F.col("now"))), "best": -F.col("x.s")})
    own = F.when(kept, 1.0).when(changed, label_similarity(F.col("label"), F.col("now"), F.col("before"), F.col("after")))
    status = F.when(F.col("own") >= 0.99, "ok").when(F.col("best") >= 0.55, "reassigned").when(F.col("own") >= 0.34, "ok").otherwise("lost")
    here = here.withColumn("own", own).withColumn("status", status)
    return here.select(page, "mark", "status", F.when(F.col("status") == "reassigned", F.col("x.b")).when(F.col("status") == "ok", F.col("node_id")).alias("node"))


def badge_rect(box: Column, scale: Column, size: float = 22.0) -> Column:
    """The square of a mark's badge, pinned to its element's top left corner and kept on the page."""
    s = scale * size
    corner = lambda v: F.greatest(F.lit(0.0), v - s * 0.35)
    return F.struct(corner(box["x"]).alias("x"), corner(box["y"]).alias("y"), s.alias("w"), s.alias("h"))


def crop_rects(tiles: DataFrame, cols: int, rows: int, width: int, height: int) -> DataFrame:
    """Tiles (tx, ty, tw, th) of a grid as pixel rectangles x, y, w, h of a frame; those under two pixels are left out."""
    at = lambda t, n, size: F.greatest(F.lit(0), F.floor(F.col(t) / n * size + 0.5)).cast("int")
    side = lambda t, n, size, start: F.greatest(F.lit(1), F.least(F.lit(size) - F.col(start), F.floor(F.col(t) / n * size + 0.5).cast("int"))).cast("int")
    out = tiles.withColumns({"x": at("tx", cols, width), "y": at("ty", rows, height)})
    return out.withColumns({"w": side("tw", cols, width, "x"), "h": side("th", rows, height, "y")}).where("w >= 2 AND h >= 2")


def recomposite(base: DataFrame, tiles: DataFrame, *frame: str) -> DataFrame:
    """(frame, i, value): the cells of a session's last whole frame with the tiles sent since stamped on, the latest on top.

    base: (frame, i, value); tiles: (frame, seq, i, value).
    """
    rows = base.select(*frame, "i", F.lit(None).cast("bigint").alias("seq"), "value").unionByName(tiles.select(*frame, "i", F.col("seq").cast("bigint").alias("seq"), "value"))
    # Cells of tiles outside the base frame are cut off.
    top = rows.groupBy(*frame, "i").agg(F.max_by("value", F.coalesce("seq", F.lit(-1))).alias("value"), F.count_if(F.col("seq").isNull()).alias("_n"))
    return top.where("_n > 0").drop("_n")


#: Analysis cells at a quarter of the frame's scale, and from which energy on a cell holds text.
CELL, SCALE, PEAK, SHARE = 8, 4, 6.0, 0.35


def text_boxes(luma: np.ndarray, width: int, height: int) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, score) of regions dense in strokes, from a frame's luma at a quarter of its scale."""
    rows, cols = luma.shape[0] // CELL, luma.shape[1] // CELL
    if not rows or not cols:
        return []
    total, n = np.zeros(luma.shape), np.zeros(luma.shape)
    total[:, :-1] += np.abs(np.diff(luma, axis=1))
    total[:-1] += np.abs(np.diff(luma, axis=0))
    n[:, :-1] += 1
    n[:-1] += 1
    cells = lambda a: a[: rows * CELL, : cols * CELL].reshape(rows, CELL, cols, CELL).sum((1, 3))
    energy = cells(total) / np.maximum(cells(n), 1)
    if energy.max() < PEAK:
        return []
    left = {(int(x), int(y)) for y, x in np.argwhere(energy >= SHARE * energy.max())}
    out = []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            x, y = todo.pop()
            group.append((x, y))
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
            left -= near
            todo += near
        if len(group) < 2:
            continue
        (x0, y0), (x1, y1) = map(min, zip(*group, strict=True)), map(max, zip(*group, strict=True))
        x, y = max(0, (x0 - 1) * CELL * SCALE), max(0, (y0 - 1) * CELL * SCALE)
        w, h = min(width - x, (x1 - x0 + 3) * CELL * SCALE), min(height - y, (y1 - y0 + 3) * CELL * SCALE)
        if w >= 12 and h >= 6:
            out.append((x, y, w, h, min(0.95, 0.4 + 4 * len(group) / (rows * cols))))
    return sorted(out, key=lambda b: (b[1], b[0]))


def text_regions(frames: DataFrame, frame: str) -> DataFrame:
    """(frame, x, y, w, h, score) from (frame, width, height, columns, luma): luma is row by row at a quarter of the scale."""
    from ..session import ship_package

    ship_package(frames.sparkSession)
    rows = frames.select(frame, "width", "height", "columns", "luma")
    schema = StructType([rows.schema[frame], *StructType.fromDDL("x int, y int, w int, h int, score double").fields])
    kinds = [pa.int32()] * 4 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, (width, height, columns, luma) in enumerate(zip(*[b.column(k).to_pylist() for k in range(1, 5)], strict=True)):
                if luma and columns and width >= CELL and height >= CELL:
                    found += [(i, *box) for box in text_boxes(np.array(luma, np.float64)[: len(luma) // columns * columns].reshape(-1, columns), width, height)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in found], pa.int64())), *[pa.array([r[k + 1] for r in found], t) for k, t in enumerate(kinds)]], schema.names)

    return rows.mapInArrow(run, schema)
