"""Benchmark decontamination by template windows. DataFrame functions only.

Texts become atoms: numbers and words of letters. Canonicalisation replaces a number, a unit and a capitalised word inside
a sentence (not one in capitals throughout) by the placeholder of its type and lower-cases the rest. A template
window is WINDOW neighbouring canonical atoms; its hash meets the windows of benchmark items in a hash join. A document
holds an item if the windows it shares with it are CONTAINMENT or more of the item's.

Slots are then checked for consistency: along one alignment of a document with an item, a value of the item must always
stand for the same value of the document. Windows on slots that contradict each other don't count. So an item with other
numbers, names or units is found, and text that only has the same outline is not.

Beside the template windows go literal ones: all windows of lower-cased words and numbers, without slots, so that a copy
is found whatever its slots, its capitals and the text before it; and loose templates, in which every capitalised word is
a name, at sentence starts too. An item of SHORT to LONG atoms is also found by a passage that is one edit away, an atom
replaced, added or left out, unless it has fewer than LITERALS words (another number makes another list): texts that share enough of its literal or loose windows are compared with it atom by atom.
LONG atoms or more keep CONTAINMENT of their windows through any one edit. A pair is reported once, by the first form
that finds it; matched_windows are the windows of that form, and after an edit containment can be below CONTAINMENT.

Defined results: null and empty texts hold nothing. Template windows with fewer than LITERALS words outside slots are not
used; an item of fewer than WINDOW atoms is one window; an item without atoms is never found. Marks between atoms are not
compared. Items that share a text are each found. Rows with equal doc_id and text count once; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, LITERALS, CONTAINMENT = 5, 3, 0.8
#: Windows of this many items at most are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
ATOM = r"\p{N}[\p{N}.,:/]*|\p{L}+[.!?\n]*"
#: Units of measure and money that may follow a number.
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles g mg kg lb lbs oz pound pounds gram grams kilogram kilograms ton tons l ml liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj n pa kpa k c f degree degrees percent pct usd eur gbp dollar dollars euro euros cent cents b kb mb gb tb bit bits byte bytes mph kmh".split()
#: Of these, the words that are units only right after a number.
AFTER_NUMBER = "m g l s h c f v w a j n b in ft ma pa kj min pct bit second".split()
NUMBER, UNIT, NAME = 1, 2, 3
STOPS = ".!?\n"
#: What windows are made of, in order of preference.
TEMPLATE, LITERAL, LOOSE = 0, 1, 2
FORMS = {TEMPLATE: "h", LITERAL: "l", LOOSE: "g"}
#: Items of so many atoms are also found after one edit. From LONG on, WINDOW lost windows leave CONTAINMENT of them.
SHORT, LONG = 6, 29
#: Seeds of items too short for one edit to leave a whole window: any edit of SHORT atoms or more leaves SEED together.
SEED = 3


def _bare(x: Column) -> Column:
    return F.lower(F.rtrim(x, F.lit(STOPS)))


def _slot(x: Column, before: Column) -> Column:
    """The placeholder of an atom, null for a word that stands for itself. ``before`` is null at the start."""
    first = F.ascii(x)
    number = first.between(48, 57) | ((first > 127) & x.rlike(r"^\p{N}"))
    unit = _bare(x).isin([u for u in UNITS if u not in AFTER_NUMBER]) | (F.coalesce(F.ascii(before).between(48, 57), F.lit(False)) & _bare(x).isin(AFTER_NUMBER))
    inside = before.isNotNull() & ~F.right(before, F.lit(1)).isin(list(STOPS))
    return F.when(number, NUMBER).when(unit, UNIT).when(_capital(x) & inside, NAME)


def _capital(x: Column) -> Column:
    first, head = F.ascii(x), F.substring(x, 1, 1)
    return (first.between(65, 90) | ((first > 127) & (head != F.lower(head)))) & (x != F.upper(x))


def atoms(text: Column) -> Column:
    """Numbers and words, each with the stops that follow it: a capital after a stop is no sign of a name."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ATOM), F.lit(0))


def canonical(of: str) -> Column:
    """One bigint for each atom of the array column ``of``: a placeholder's number or a word's hash."""
    a = F.col(of)
    return F.transform(a, lambda x, i: F.coalesce(_slot(x, F.get(a, i - 1)).cast("bigint"), F.xxhash64(_bare(x))))


def literal(of: str) -> Column:
    """One bigint for each atom of the array column ``of``: the hash of the lower-cased word or of the number."""
    return F.transform(F.col(of), lambda x: F.xxhash64(F.lower(F.rtrim(x, F.lit(STOPS + ",:/")))))


def loose(of: str, strict: str) -> Column:
    """The canonical array ``strict`` of the atoms ``of``, with every capitalised word a name."""
    return F.transform(F.col(of), lambda x, i: F.when(~F.get(F.col(strict), i).between(1, 3) & _capital(x), F.lit(NAME).cast("bigint")).otherwise(F.get(F.col(strict), i)))


def _forms(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h": canonical("a"), "l": literal("a")}).withColumn("g", loose("a", "h"))


def _hash(form: int, of: str, at: Column, size: int) -> Column:
    """Hash of the window of ``size`` atoms at ``at``; null where it does not fit."""
    return F.when(at + size <= F.size(of), F.xxhash64(F.lit(form), *[F.get(F.col(of), at + k) for k in range(size)]))


def _slices(of: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(of) - size), lambda i: F.slice(of, i + 1, F.lit(size)))


def item_windows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """The written table (item_id, form, at, size, hash, slots, n) of usable windows; n is how many the item has in the form and size, m its atoms."""
    rows = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), atoms(F.col(text)).alias("a"))
    rows = _forms(rows).withColumn("m", F.size("a"))
    each = None
    for size in range(1, WINDOW + 1):
        fits = F.col("m") >= WINDOW if size == WINDOW else F.col("m").between(SHORT, 2 * WINDOW) | (F.col("m") == size) if size == SEED else F.col("m") == size
        for form, of in FORMS.items():
            fit = F.col("m") == size if form == TEMPLATE and size < WINDOW else fits
            slots = F.size(F.filter("w", lambda v: v.between(1, 3))) if form != LITERAL else F.lit(0)
            part = rows.where(fit).select("item_id", "m", F.posexplode(_slices(of, size)).alias("at", "w")).select("item_id", "m", F.lit(form).alias("form"), "at", F.lit(size).alias("size"), _hash(form, "w", F.lit(0), size).alias("hash"), slots.alias("slots"))
            each = part if each is None else each.unionByName(part)
    usable = each.where((F.col("size") - F.col("slots") >= F.least(F.lit(LITERALS), F.col("size") - F.when(F.col("m") > F.col("size"), WINDOW - F.col("size")).otherwise(0))) & (F.col("slots") < F.col("size")))
    count = usable.groupBy("item_id", "form", "size").agg(F.count("*").alias("n"))
    return common.materialise(usable.join(count, ["item_id", "form", "size"]), "item-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, containment): one row for each document and item it holds."""
    items = item_windows(benchmark, item_key, item_text)
    shape = items.agg(F.collect_set(F.struct("form", "size")).alias("shapes"), F.count("*").alias("n")).first()  # five sizes of each form at most
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull() & F.col("doc_id").isNotNull())
    split = narrow.select("doc_id", F.xxhash64("_text").alias("th"), atoms(F.col("_text")).alias("a"))
    split = _forms(split).drop("a")
    side = items.select("item_id", "form", "at", "size", "hash", "slots", "n", "m")
    if shape["n"] <= BROADCAST_WINDOWS:
        side = F.broadcast(side)
    # One pass: each place of a text gives its window of every form and size.
    here = F.array(*[_hash(form, FORMS[form], F.col("pos"), size) for form, size in sorted(shape["shapes"]) or [(TEMPLATE, WINDOW)]])
    places = split.select("doc_id", "th", *FORMS.values(), F.posexplode("l").alias("pos", "_l")).select("doc_id", "th", "pos", F.explode(here).alias("hash")).where("hash IS NOT NULL")
    hits = common.materialise(places.join(side, "hash").select("doc_id", "th", "pos", "item_id", "form", "at", "size", "slots", "n", "m"), "hits")
    seeds = hits.where((F.col("form") != TEMPLATE) & F.col("m").between(SHORT, LONG - 1) & (F.col("size") == F.when(F.col("m") > 2 * WINDOW, WINDOW).otherwise(SEED)))
    hits = hits.where((F.col("size") == WINDOW) | (F.col("size") == F.col("m")))
    pair = ["doc_id", "th", "item_id", "form"]

    def enough(rows: DataFrame) -> DataFrame:
        # Distinct places first, by partial aggregation; an item has no more of them than it has windows.
        places = rows.select(*pair, "at", "n").distinct()
        return places.groupBy(*pair).agg(F.count("*").alias("matched"), F.max("n").alias("n")).where(F.col("matched") >= CONTAINMENT * F.col("n"))

    flagged = common.materialise(enough(hits).select(*pair), "flagged")
    # Slot values are looked up only for flagged pairs with slots.
    slotted = common.materialise(hits.where("slots > 0").join(flagged, pair, "left_semi").select(*pair, "pos", "at", "size"), "slotted")
    texts = narrow.withColumn("th", F.xxhash64("_text")).join(slotted.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    mine = texts.select("doc_id", "th", atoms(F.col("_text")).alias("a"))
    theirs = benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), atoms(F.col(item_text)).alias("b")).dropDuplicates(["item_id"])
    values = (
        slotted.join(mine, ["doc_id", "th"])
        .join(theirs, "item_id")
        .select(*pair, "at", (F.col("pos") - F.col("at")).alias("shift"), F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.struct(F.coalesce(_slot(F.get("b", F.col("at") + k), F.get("b", F.col("at") + k - 1)), F.when((F.col("form") == LOOSE) & _capital(F.get("b", F.col("at") + k)), NAME)).alias("kind"), _bare(F.get("b", F.col("at") + k)).alias("theirs"), _bare(F.get("a", F.col("pos") + k)).alias("mine")))).alias("v"))
        .where("v.kind IS NOT NULL")
        .select(*pair, "at", "shift", "v.theirs", "v.mine")
    )
    clash = values.groupBy(*pair, "shift", "theirs").agg(F.min("mine").alias("low"), F.max("mine").alias("high")).where("low <> high").select(*pair, "shift", "theirs")
    bad = common.materialise(values.join(clash, [*pair, "shift", "theirs"], "left_semi").select(*pair, "at", "shift").distinct(), "inconsistent")
    sound = hits.join(flagged, pair, "left_semi").withColumn("shift", F.col("pos") - F.col("at")).join(bad, [*pair, "at", "shift"], "left_anti")
    found = enough(sound).select("doc_id", "th", "item_id", "form", "matched", "n")
    edited = _one_edit(seeds.join(found.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_anti"), narrow, theirs)
    found = found.unionByName(edited).groupBy("doc_id", "item_id", "form").agg(F.max("matched").alias("matched_windows"), F.max("n").alias("item_windows"))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.min(F.struct("form", "matched_windows", "item_windows")).alias("r"))
        .select("doc_id", "item_id", "r.matched_windows", "r.item_windows")
        .withColumn("containment", F.round(F.col("matched_windows") / F.col("item_windows"), 6))
    )


def _one_edit(seeds: DataFrame, narrow: DataFrame, theirs: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, form, matched, n): pairs of which the text holds the whole item but for one edit, slots consistent.

    One edit costs an item ``size`` windows at most. Of an alignment with a seed, a prefix of the item must match there and the
    rest, but for one atom, there or one atom further on either side; or the rest there and the prefix so.
    """
    pair = ["doc_id", "th", "item_id", "form"]
    shared = seeds.select(*pair, "at", "n", "size").distinct().groupBy(*pair).agg(F.count("*").alias("matched"), F.max("n").alias("n"), F.max("size").alias("size")).where(F.col("matched") >= F.greatest(F.lit(1), F.col("n") - F.col("size"))).drop("size")
    near = common.materialise(seeds.select(*pair, (F.col("pos") - F.col("at")).alias("shift"), "m").distinct().join(shared, pair), "near-items")
    texts = narrow.withColumn("th", F.xxhash64("_text")).join(near.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    first = F.greatest(F.col("shift") - 2, F.lit(0))
    rows = near.join(texts.select("doc_id", "th", atoms(F.col("_text")).alias("whole")), ["doc_id", "th"])
    rows = _forms(rows.select(*near.columns, F.slice("whole", first + 1, F.col("m") + 5).alias("a"), (F.col("shift") - first).alias("o")))
    rows = rows.select(*near.columns, "o", F.col("a").alias("mine"), F.when(F.col("form") == LOOSE, F.col("g")).otherwise(F.col("l")).alias("x"))
    items = _forms(theirs.select("item_id", F.col("b").alias("a"))).where(F.size(F.filter("g", lambda v: v != NUMBER)) >= LITERALS).select("item_id", F.col("a").alias("b"), "g", "l")
    rows = rows.join(items, "item_id").withColumn("y", F.when(F.col("form") == LOOSE, F.col("g")).otherwise(F.col("l"))).drop("g", "l")
    ways = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(j).alias("q")) for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    rows = rows.withColumn("way", F.explode(ways))
    each = F.sequence(F.lit(0), F.col("m") - 1)

    def run(d: Column, backwards: bool) -> Column:
        same = F.transform(each, lambda k: F.coalesce(F.get("x", F.col("o") + k + d) == F.get("y", k), F.lit(False)))
        stop = F.array_position(F.reverse(same) if backwards else same, F.lit(False)).cast("int")
        return F.when(stop == 0, F.col("m")).otherwise(stop - 1)

    rows = rows.withColumn("head", run(F.col("way.p"), False)).withColumn("tail", F.least(run(F.col("way.q"), True), F.col("m") - F.col("head")))
    rows = rows.where(F.col("head") + F.col("tail") >= F.col("m") - 1)
    slots = F.filter(each, lambda k: F.get("y", k).between(1, 3) & ((k < F.col("head")) | (k >= F.col("m") - F.col("tail"))))
    values = F.transform(slots, lambda k: F.struct(_bare(F.get("b", k)).alias("t"), _bare(F.get("mine", F.col("o") + k + F.when(k < F.col("head"), F.col("way.p")).otherwise(F.col("way.q")))).alias("v")))
    rows = rows.withColumn("values", F.array_distinct(values)).where(F.size(F.array_distinct(F.transform("values", lambda z: z["t"]))) == F.size("values"))
    return rows.select(*pair, "matched", "n").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the documents that hold benchmark items."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id holds no benchmark item."""
    gone = common.materialise(contaminated(docs, benchmark, key, text).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(gone, key, "left_anti").select(*docs.columns)
