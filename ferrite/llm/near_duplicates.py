"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, connected components.

1. One pass over whole texts gives each document's set size, a 128-bit hash of its shingle set and the band keys of its
   SuperMinHash signature. Documents with equal sets form a class, told apart no further; its least id stands for it.
2. Representatives that share a band key form a bucket. Buckets with the same members as another are dropped.
3. Stars: every member of a bucket is confirmed against the bucket's least member, on full sets. That is one pair a member,
   however large the bucket, and a group of copies becomes one component by it.
4. Cells: only buckets whose members are still in several components go on. Their members are dealt into chunks of bounded
   rows and bytes, those of the largest component apart from the others, and every two chunks of which one holds others
   meet in a cell. A prefix filter, which loses no link, finds the pairs of a cell to confirm on full sets.
5. Alternating stars join all links into components; classes and then documents take their labels.

The number of bands follows from ``percent``: a pair at just that similarity misses every band with probability MISS.
Nothing else can lose a link, at any size of a bucket.

Defined results: texts without words have an empty set and no links; their component is themselves. A null doc_id takes
no part: component_id null, kept true. Rows that share a doc_id count as one document with the links of any of its
texts; each row is returned. Ties go to the least id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connect

MISS = 1e-5
#: Members, and bytes of their sets, that a star's part or a chunk of a cell has on average at most.
CHUNK, CHUNK_BYTES = 256, 1 << 24
#: Ids that a bitmap of BITS_PER_ID each picks out of all texts; more are found by a join.
BITMAP_IDS, BITS_PER_ID = 1 << 24, 8
_MEMO_LIMIT = 500_000
_U = np.uint64
_C1, _C2, _GOLD = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of each) of signatures for links at ``percent`` or more."""
    rows = 4 if percent >= 75 else 2
    miss = 1 - (percent / 100) ** rows
    return (math.ceil(math.log(MISS) / math.log(miss)) if miss > MISS else 1), rows


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_memo = _Memo()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _C1
    x ^= x >> _U(33)
    x *= _C2
    x ^= x >> _U(33)
    return x


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at blanks and \\x09-\\x0D: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence where it is shorter."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(_memo.__getitem__, w), np.uint64, len(w))
    size = min(k, len(a))
    n = len(a) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mix(h * _GOLD + a[i : i + n])
    return np.unique(h)


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash, level by level over all elements at once.

    At level j every element sends j + r, r uniform in [0, 1), to the j-th slot of its own random permutation, which a
    Fisher-Yates step extends. Once each slot holds less than j + 1, later levels cannot lower any: the early stop.
    Values are (level << 32) | fraction.
    """
    h = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return h
    perm = None
    rows = np.arange(n)
    for j in range(m):
        rnd = _mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = ((rnd >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64) + j
        if j == 0:
            slot, first = pick, pick
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (n, 1))
                perm[rows, first] = 0
                perm[rows, 0] = first
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(h, slot, (rnd & _U(0xFFFFFFFF)) | _U(j << 32))
        if int(h.max()) >> 32 <= j:
            break
    return h


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    v = signature.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        h = _mix(h * _GOLD + v[:, i])
    return h.view(np.int64)


def features(docs: DataFrame, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table (doc_id, n, h1, h2, keys); hashes and keys are null for empty sets."""
    common.python_ready(docs.sparkSession)
    bands, rows = banding(percent)

    def work():
        def compute(texts: list) -> list[pa.Array]:
            n, h1, h2, keys = [], [], [], []
            for t in texts:
                s = shingles(t)
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                n.append(len(s))
                h1.append(d and int.from_bytes(d[:8], "big", signed=True))
                h2.append(d and int.from_bytes(d[8:], "big", signed=True))
                keys.append(band_keys(super_minhash(s, bands * rows), bands, rows) if len(s) else None)
            return [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]

        return compute

    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    return common.materialise(common.map_column(narrow, "_text", "n bigint, h1 bigint, h2 bigint, keys array<bigint>", work), "features")


def buckets_of(representatives: DataFrame) -> DataFrame:
    """The written table (bucket, centre, rep, low, high) of (rep, n, keys): members of buckets of two or more, centres included.

    ``centre`` is a struct of the bucket's least rep, and low and high are the sizes of a rep's sets: equal, but for rows that
    share a doc_id.
    """
    # Rows of one doc_id share its rep: each rep is one member, or a pair of them would cancel in the xor.
    rows = representatives.select("rep", "n", F.explode("keys").alias("bucket")).groupBy("rep", "bucket").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", "low", "high")).alias("centre"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("size > 1")
    buckets = common.materialise(sizes.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("centre").alias("centre")).select("bucket", "centre"), "buckets")
    return common.materialise(rows.join(buckets, "bucket").select("bucket", "centre", "rep", "low", "high"), "members")


def wanted_bitmap(reps: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, set at the hashes of the ids: a filter that lets some others pass."""
    bit = F.pmod(F.xxhash64("rep"), F.lit(bits))
    words = reps.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("b"))
    out = np.zeros(bits // 32, np.uint32)
    got = words.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def full_sets(docs: DataFrame, reps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table (rep, elements) of the documents ``reps``, and of few others."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("_text"))
    n = reps.count()

    def work():
        return lambda texts: [pa.array([shingles(t).tobytes() for t in texts], pa.binary())]

    if n > BITMAP_IDS:  # texts cross once, and none in vain
        return common.materialise(common.map_column(rows.join(reps, "rep", "left_semi"), "_text", "elements binary", work), "sets")
    bits = 1 << max(16, (n * BITS_PER_ID - 1).bit_length()) if n else 1 << 16
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(reps, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            at = b.column(1).to_numpy()
            part = b.filter(pa.array((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())], ["rep", "elements"])

    rows = rows.select("rep", F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("bit"), "_text")
    return common.materialise(rows.mapInArrow(run, "rep bigint, elements binary"), "sets")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _parts(count: Column, n: Column) -> Column:
    """How many parts hold ``count`` members with ``n`` elements in all, within the bounds on rows and bytes."""
    return F.greatest(F.ceil(count / CHUNK), F.ceil(n * 8 / CHUNK_BYTES)).cast("int")


def star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of buckets and their centres, where linked."""
    # Sets whose sizes are too far apart can't be linked, whatever they hold.
    close = (100 * F.col("centre.high") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("centre.low"))
    spokes = members.where((F.col("rep") != F.col("centre.rep")) & close).groupBy(F.col("centre.rep").alias("centre"), "rep").agg(F.max("high").alias("n"))
    spokes = common.materialise(spokes, "spokes")
    wheels = common.materialise(spokes.groupBy("centre").agg(_parts(F.count("*"), F.sum("n")).alias("parts")), "wheels")
    ends = spokes.join(wheels, "centre").select("centre", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    hubs = wheels.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("rep"))
    # The centre comes first in each part, so a task holds its sets and one batch of others.
    rows = ends.unionByName(hubs).join(sets, "rep").select("centre", "part", "rep", "elements")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("rep") != F.col("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, []
        for b in batches:
            found = []
            for centre, part, rep, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now != (centre, part):
                    now, hub = (centre, part), []
                elements = np.frombuffer(raw, np.uint64)
                if rep == centre:
                    hub.append(elements)
                elif any(linked(elements, h, percent) for h in hub):
                    found.append((rep, centre))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def cells(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, i, j, rep, label): where members meet that may still be linked across components."""
    # Centres have met all members of their buckets.
    rest = members.where(F.col("rep") != F.col("centre.rep"))
    known = rest.join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.col("high").alias("n"), F.coalesce("root", "rep").alias("label"))
    known = common.materialise(known, "labelled-members")
    by_label = known.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    shape = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("c", "n", "label")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("labels > 1")
    whole = _parts(F.col("c"), F.col("n")) == 1
    shape = common.materialise(shape.select("bucket", F.col("top.label").alias("top"), F.when(whole, 0).otherwise(_parts(F.col("top.c"), F.col("top.n"))).alias("p"), F.when(whole, 1).otherwise(_parts(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n"))).alias("q")), "mixed")
    mine = known.join(shape, "bucket").withColumn("major", (F.col("p") > 0) & (F.col("label") == F.col("top")))
    mine = mine.withColumn("k", F.pmod(F.xxhash64("rep", "bucket"), F.when(F.col("major"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # Chunks of the largest component have negative numbers; they meet the others, not each other.
    others = F.transform(F.filter(upto(F.col("q")), lambda x: (x != F.col("k")) | (F.col("q") == 1)), lambda x: cell(F.least(x, F.col("k")), F.greatest(x, F.col("k"))))
    minor = F.concat(others, F.transform(upto(F.col("p")), lambda x: cell(-1 - x, F.col("k"))))
    major = F.transform(upto(F.col("q")), lambda x: cell(-1 - F.col("k"), x))
    return mine.select("bucket", "rep", "label", F.explode(F.when(F.col("major"), major).otherwise(minor)).alias("cell")).select("bucket", "cell.i", "cell.j", "rep", "label")


def cell_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components of one cell. A pair within a component, known or found, needs no look.

    Two sets at the threshold share more than what is left of either after its prefix, its rarest elements in one order
    of all the cell's elements; so they share an element of both prefixes, and all other pairs can be passed over.
    """
    n = len(ids)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict = {}
    for x in range(n):
        for name in (("label", labels[x]), ("id", ids[x])):
            parent[find(x)] = find(first.setdefault(name, x))
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return []
    owner = np.repeat(np.arange(n), size)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((element, count[element], owner))
    prefix = size + (-percent * size) // 100 + 1  # size - ceil(percent * size / 100) + 1
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    order = order[place < prefix[owner]]
    order = order[np.argsort(element[order], kind="stable")]
    element, owner = element[order], owner[order]
    group = np.array([find(x) for x in range(n)])[owner]
    begin = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
    mixed = np.minimum.reduceat(group, begin) != np.maximum.reduceat(group, begin)
    end = np.r_[begin[1:], len(element)]
    near = np.zeros((n, n), bool)
    for a, b in zip(begin[mixed], end[mixed], strict=True):
        who = owner[a:b]
        near[np.ix_(who, who)] = True
    links = []
    for x, y in np.argwhere(np.triu(near, 1)).tolist():
        if find(x) != find(y) and linked(sets[x], sets[y], percent):
            parent[find(y)] = find(x)
            links.append((ids[x], ids[y]))
    return links


def confirm(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each cell's links."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = cell_links(group["rep"].tolist(), group["label"].tolist(), [np.frombuffer(x, np.uint64) for x in group["elements"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.join(sets, "rep").groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint")


def group(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    seen = features(docs, percent, key, text)
    classes = common.materialise(seen.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    placed = common.materialise(seen.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left").select("doc_id", "n", "rep"), "placed")
    representatives = seen.where("n > 0").join(classes.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "n", "keys")
    members = buckets_of(representatives)
    sets = full_sets(docs, members.select("rep").distinct(), key, text)
    # Texts of one doc_id in several classes link these.
    several = common.materialise(placed.where("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id"), "several")
    links = star_links(members, sets, percent)
    if not several.isEmpty():
        links = links.unionByName(placed.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = common.materialise(connect(links), "roots")
    more = common.materialise(confirm(cells(members, roots), sets, percent), "cell-links")
    if not more.isEmpty():
        roots = common.materialise(connect(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    common.discard(seen, classes, members, sets, several, more)
    out = placed.join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: near-duplicate groups of all documents."""
    return group(common.table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a near duplicate of a smaller id.

    Of rows that share an id one stays. Only ids go through the join; the side that is dropped is the smaller one.
    """
    gone = common.materialise(group(docs, percent, key, text).where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    left = docs.join(gone, key, "left_anti").select(*docs.columns)
    repeated = docs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") > 1)).select(key)
    repeated = common.materialise(repeated, "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, key, "left_semi").dropDuplicates([key])
    return left.join(repeated, key, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
