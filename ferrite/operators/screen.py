"""A page's elements as a planner may see them: hits of the first two layers, names without personal data, marks, texts.

Input is the table of ``sources.html.elements`` or one with its columns. Everything but the fingerprint and the texts is a
column of an element's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksums import fnv1a_hex
from . import elements, reports, rules

#: From which score a hit makes a node sensitive; which control tags a probe looks at.
SENSITIVE = 0.6
PROBED = ("input", "button", "select", "textarea", "a")


def hits_of(rows: DataFrame) -> DataFrame:
    """``rows`` with semantic, is_password and ``hits``: what the attributes say (L0), then what a leaf's text holds (L1).

    An L0 hit spans the element's value, the value of a password aside, which is never shown. ``name_hits`` are those of
    an element with children too, found in its label: no hits of its own, but what its name may not show.
    """
    known = elements.classify(rows if "cleared" in rows.columns else rows.withColumn("cleared", F.lit(False)))
    value = F.when(F.col("tag").isin("input", "textarea"), F.coalesce("value", F.lit(""))).otherwise("")
    own = F.struct(F.lit(-1).alias("rule_ord"), F.col("semantic.cls").alias("cls"), F.lit("L0").alias("source"), F.lit(0.99).alias("score"), F.when(F.col("is_password"), "[PASSWORD]").otherwise(value).alias("text"), F.lit(0).alias("start"), F.length(value).alias("end"))
    leaf = (F.col("n_children") == 0) & (F.col("text") != "")
    found = rules.scan(known.withColumn("_scanned", F.when(leaf, F.col("text")).when(F.col("n_children") > 0, F.col("label"))), "_scanned")
    none = F.array().cast(rules.HIT)
    said = F.when(F.col("semantic").isNotNull(), F.array(own.cast(rules.HIT[6:-1]))).otherwise(none)
    return found.withColumns({"hits": F.concat(said, F.when(leaf, F.col("hits")).otherwise(none)), "name_hits": F.concat(said, "hits")}).drop("_scanned")


def value_class(hits: Column, name: Column) -> Column:
    """sensitive if a hit is sure or a password, masked if the name holds a placeholder, else public."""
    sure = F.exists(hits, lambda h: (h["cls"] == "PASSWORD") | (h["score"] >= SENSITIVE))
    return F.when(sure, "sensitive").when(name.rlike(r"\[[A-Z]+_[A-Z0-9]*_?\d+\]"), "masked").otherwise("public")


def sensitive_target(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sensitive_target``: a password by the names that an action's target is judged by (title, alt and data- left out)."""
    bare = rows.withColumns({"title": F.lit(None).cast("string"), "alt": F.lit(None).cast("string"), "data_attrs": F.array().cast("array<struct<k:string,v:string>>"), "cleared": F.lit(False)})
    return elements.classify(bare).select("*", F.col("is_password").alias("sensitive_target"))


def value_type(tag: Column, kind: Column, editable: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    of_input = F.when(k.isin("password", "email", "tel", "number"), k).when(k.isin("checkbox", "radio"), "checkbox").otherwise("text")
    return F.when(tag == "input", of_input).when(tag == "textarea", "text").when(tag == "select", "select").when(F.coalesce(editable, F.lit(False)), "text").otherwise("none")


def snapshot(rows: DataFrame, key: str, session: str) -> DataFrame:
    """Kept elements with hits, redacted name, value_class, actions and, for controls, the running mark."""
    seen = hits_of(rows.where("kept"))
    seen = seen.withColumn("name", reports.redact_name(F.col("label"), F.col("name_hits"), session))
    seen = seen.withColumns({"value_class": value_class(F.col("hits"), F.col("name")), "actions": elements.actions(F.col("of_role"))})
    control = F.col("actions") != ""
    number = F.sum(control.cast("int")).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("mark", F.when(control, number.cast("int")))


def _joined(rows: DataFrame, order: str, line: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("v")))), lambda r: r["v"]), sep)


def fingerprint(nodes: DataFrame, key: str) -> DataFrame:
    """(key, frame_hash): a hash of what a snapshot shows, an element after its children, padded to 16 digits."""
    line = F.concat_ws("|", "of_role", "name", "value_class", F.coalesce("mark", F.lit(-1)).cast("string"), "actions")
    return nodes.groupBy(key).agg(F.rpad(fnv1a_hex(_joined(nodes, "closed", line, "\n")), 16, "0").alias("frame_hash"))


def controls(nodes: DataFrame, key: str) -> DataFrame:
    """(key, mark, label, sensitive) of every marked node."""
    return nodes.where("mark IS NOT NULL").select(key, "mark", F.col("name").alias("label"), (F.col("value_class") == "sensitive").alias("sensitive"))


def texts(nodes: DataFrame, key: str) -> DataFrame:
    """(key, label): every name that is not empty, for the injection scan; never values."""
    return nodes.where(F.col("name") != "").select(key, F.col("name").alias("label"))


def planner_text(nodes: DataFrame, key: str, depth: int = 6, children: int = 12) -> DataFrame:
    """(key, text): the shown tree as indented lines, no deeper than ``depth``, the first ``children`` of each node.

    nodes: key, ord, place, of_role, name, value_class, actions, mark, n_children.
    """
    steps = F.split("place", "/")
    level = F.size(steps) - 1
    parts = F.array_compact(F.array(F.when(F.col("mark").isNotNull(), F.concat(F.lit("["), F.col("mark").cast("string"), F.lit("]"))), F.col("of_role"), F.when(F.col("name") != "", F.concat(F.lit('"'), F.substring("name", 1, 80), F.lit('"'))), F.when(F.col("value_class") == "sensitive", "(hidden)"), F.when(F.col("actions") != "", F.concat(F.lit("<"), F.array_join(F.slice(F.split("actions", ","), 1, 3), ","), F.lit(">")))))
    within = nodes.where(F.col("place").isNotNull() & (level <= depth) & F.forall(F.slice(steps, 2, depth + 1), lambda s: s.cast("int") < children))
    line = F.concat(F.repeat(F.lit("  "), level), F.array_join(parts, " "))
    said = within.where((F.size(parts) > 1) | (F.col("n_children") > 0))
    return said.groupBy(key).agg(_joined(said, "ord", line, "\n").alias("text"))


def probe_nodes(rows: DataFrame, key: str) -> DataFrame:
    """(key, mark, role, label, actions, value_class) of a page's links and controls, numbered in page order."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    label = F.substring(F.coalesce(text("aria_label"), text("placeholder"), text("name"), text("id"), F.col("tag")), 1, 70)
    mark = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return rows.where(F.col("tag").isin(*PROBED)).select(key, mark.alias("mark"), F.col("tag").alias("role"), label.alias("label"), F.when(F.col("tag").isin("input", "textarea"), "fill").otherwise("click").alias("actions"), F.when(F.col("type") == "password", "sensitive").otherwise("public").alias("value_class"))


def payload(nodes: DataFrame, key: str) -> DataFrame:
    """(key, payload): the JSON list that would leave the device; a sensitive node has a class and never a value."""
    node = F.struct(F.col("path").alias("id"), F.col("of_role").alias("role"), F.when(F.col("name") != "", F.col("name")).alias("label"), F.col("value_class").alias("valueClass"))
    return nodes.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", node.alias("n")))), lambda r: r["n"])).alias("payload"))


def reclassify(recovered: DataFrame, text: str = "text") -> DataFrame:
    """Rows (…, text, box) of text recovered from pixels, with ``hits``: sure enough hits of the pattern layer, no passwords; the box is the region's."""
    return rules.scan(recovered, text).withColumn("hits", F.filter("hits", lambda h: (h["cls"] != "PASSWORD") & (h["score"] >= 0.5)))
