"""HTML pages as element tables. One parse gives every element a row, with what the tree alone can tell of it:

its path, its accessible name, its role, how many children it has, whether a bounded walk from the body keeps it, and how
often it repeats among its siblings. What follows are filters on these columns; no join puts the tree together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import elements as semantics
from ..session import ship_package

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ATTRIBUTES = ("type", "id", "name", "placeholder", "aria-label", "title", "alt", "autocomplete", "value", "role", "href", "multiple")
ELEMENT = "ord int, parent int, depth int, path string, tag string, " + ", ".join(f"{a.replace('-', '_')} string" for a in ATTRIBUTES) + ", data_attrs array<struct<k:string,v:string>>, text string, n_children int, label string, of_role string, kept boolean, shown boolean, repeats int, place string, closed int"
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
#: What a walk passes over, and its bounds.
SKIPPED = ("script", "style", "noscript", "template", "head", "meta", "link")
SKIPPED_CLASS = re.compile(r"(^|[-_\s])(veil-|sr-only|visually-hidden)([-_\s]|$)")
MAX_DEPTH, MAX_CHILDREN, LABEL, SAME, FEW = 8, 40, 80, 30, 2
CONTROLS = ("input", "textarea", "select")
BATCH = 4000


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.attrs: list[dict] = []
        self.stack: list[int] = []
        self.open: dict[str, int] = {}
        #: Pieces of text, each clipped where no name can reach, and the pieces inside each element.
        self.pieces: list[str] = []
        self.inside: list[list[int]] = []
        self.top = {"n_children": 0}
        self.n_closed = 0

    def _close(self, i: int) -> None:
        self.rows[i]["closed"] = self.n_closed
        self.n_closed += 1
        self.inside[i][1] = len(self.pieces)

    def handle_starttag(self, tag, attrs):
        while self.stack and tag in ("p", "li", "tr", "td", "option") and self.rows[self.stack[-1]]["tag"] == tag:
            self._pop()
        parent = self.stack[-1] if self.stack else None
        siblings = self.rows[parent] if parent is not None else self.top
        k = siblings["n_children"]
        siblings["n_children"] += 1
        a = dict(reversed(attrs))
        row = {"ord": len(self.rows), "parent": parent, "depth": len(self.stack), "path": str(k) if parent is None else f"{self.rows[parent]['path']}/{k}", "tag": tag, "text": [], "n_children": 0}
        row |= {x.replace("-", "_"): (a[x] or "") if x in a else None for x in ATTRIBUTES}
        row["data_attrs"] = [{"k": n[5:], "v": v or ""} for n, v in attrs if n.startswith("data-")]
        self.rows.append(row)
        self.attrs.append(a)
        self.inside.append([len(self.pieces), len(self.pieces)])
        if tag not in VOID:
            self.stack.append(row["ord"])
            self.open[tag] = self.open.get(tag, 0) + 1
        else:
            self._close(row["ord"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def _pop(self):
        i = self.stack.pop()
        self.open[self.rows[i]["tag"]] -= 1
        self._close(i)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while self.rows[self.stack[-1]]["tag"] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.stack or self.rows[self.stack[-1]]["tag"] in ("script", "style"):
            return
        self.rows[self.stack[-1]]["text"].append(data)
        clipped = " ".join(data.split())[: LABEL + 2]
        if clipped or not self.pieces or self.pieces[-1] != " ":
            self.pieces.append((" " if data[0].isspace() and clipped else "") + (clipped + (" " if data[-1].isspace() else "") if clipped else " "))

    def content(self, i: int) -> str:
        """The first LABEL characters of all text in the element, white space collapsed."""
        parts, n = [], 0
        for k in range(*self.inside[i]):
            parts.append(self.pieces[k])
            n += len(self.pieces[k].strip())
            if n > LABEL:
                break
        return " ".join("".join(parts).split())[:LABEL]


def _name_elements(reader: _Reader) -> None:
    """label and of_role of each row: the first of aria-label, labelled-by texts, a control's label, placeholder and title, or its text."""
    by_id = {}
    label_for, label_around = {}, {}
    for r, a in zip(reader.rows, reader.attrs, strict=True):
        if a.get("id"):
            by_id.setdefault(a["id"], r["ord"])
        if r["tag"] == "label" and a.get("for"):
            label_for.setdefault(a["for"], r["ord"])
        up = r["parent"]
        if up is not None and (reader.rows[up]["tag"] == "label" or up in label_around):
            label_around[r["ord"]] = up if reader.rows[up]["tag"] == "label" else label_around[up]
    for r, a in zip(reader.rows, reader.attrs, strict=True):
        i, tag = r["ord"], r["tag"]
        name = (a.get("aria-label") or "").strip() if a.get("aria-label") else None
        if name is None and a.get("aria-labelledby"):
            name = " ".join(filter(None, (reader.content(by_id[x]) for x in a["aria-labelledby"].split() if x in by_id))) or None
        if name is None and tag in CONTROLS:
            owner = label_for.get(a.get("id") or None, label_around.get(i))
            name = (reader.content(owner) if owner is not None else "") or None
            if name is None and tag != "select":
                name = (a.get("placeholder") or "").strip() if a.get("placeholder") else None
            if name is None:
                name = (a.get("title") or "").strip() if a.get("title") else None
        r["label"] = reader.content(i) if name is None else name
        kind = (a.get("type") or "").lower()
        plain = "link" if tag == "a" and "href" in a else "generic" if tag == "a" else semantics.INPUT_ROLES.get(kind, "textbox") if tag == "input" else ("listbox" if "multiple" in a else "combobox") if tag == "select" else semantics.ROLES.get(tag, tag)
        r["of_role"] = a.get("role") or plain


def _walk(reader: _Reader) -> None:
    """kept: in a walk from the body, within its bounds, not pruned. shown: kept after repeats have been collapsed."""
    rows = reader.rows
    body = next((r for r in rows if r["tag"] == "body"), None)
    start = body["depth"] if body else 0
    children: dict[int, list[int]] = {}
    taken: dict = {}
    for r, a in zip(rows, reader.attrs, strict=True):
        i, up = r["ord"], r["parent"]
        root = r is body if body else up is None
        style = (a.get("style") or "").replace(" ", "").lower()
        hidden = a.get("aria-hidden") == "true" or "hidden" in a or r["tag"] == "input" and (a.get("type") or "").lower() == "hidden" or "display:none" in style or "visibility:hidden" in style
        noise = r["of_role"] not in semantics.ACTIONS and not r["label"] and r["n_children"] > 0
        room = root or up is not None and rows[up]["kept"] and taken.get(up, 0) < MAX_CHILDREN
        r["kept"] = bool(room and r["depth"] - start <= MAX_DEPTH and r["tag"] not in SKIPPED and not SKIPPED_CLASS.search(a.get("class") or "") and not hidden and not noise)
        r["shown"], r["repeats"] = r["kept"], 1 if r["kept"] else 0
        if r["kept"] and not root:
            taken[up] = taken.get(up, 0) + 1
            children.setdefault(up, []).append(i)
    for siblings in children.values():
        first: dict[tuple, dict] = {}
        for i in siblings:
            r = rows[i]
            same = first.setdefault((r["of_role"], r["label"][:SAME]), r)
            if same is not r:
                same["repeats"] += 1
                r["shown"] = False
    for up, siblings in children.items():
        if rows[up]["repeats"] > 1:  # of a repeated element's own children few stay
            for i in [i for i in siblings if rows[i]["shown"]][FEW:]:
                rows[i]["shown"] = False
    for r in rows:
        if r["shown"] and r["parent"] is not None and r["repeats"] and r is not body and rows[r["parent"]]["kept"] and not rows[r["parent"]]["shown"]:
            r["shown"] = False
    count: dict = {}
    for r in rows:  # the path among what is shown
        up = r["parent"] if r is not body else None
        above = rows[up]["place"] if up is not None and rows[up]["place"] is not None else None
        r["place"] = None
        if r["shown"]:
            at = count[up] = count.get(up, -1) + 1
            r["place"] = str(at) if above is None else f"{above}/{at}"


def read_elements(source: str | None) -> list[dict]:
    """The elements of a page in order, each with its own text; null and empty pages have none."""
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    while reader.stack:
        reader._pop()
    _name_elements(reader)
    _walk(reader)
    for r in reader.rows:
        r["text"] = " ".join("".join(r["text"]).split())
    return reader.rows


def elements(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """(key, ELEMENT) rows, one per element, by an Arrow batch at a time."""
    ship_package(pages.sparkSession)
    own = pages.schema[key]
    schema = StructType([own, *StructType.fromDDL(ELEMENT).fields])
    kinds = [(f.name, _ARROW.get(f.dataType.simpleString(), pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *[pa.array([r[n] for r in rows], t) for n, t in kinds]], schema.names)  # noqa: B023

            for i, h in enumerate(b.column(1).to_pylist()):
                found = read_elements(h)
                rows += found
                of += [i] * len(found)
                if len(rows) >= BATCH:
                    yield batch()
                    rows, of = [], []
            yield batch()

    return pages.select(key, source).mapInArrow(run, schema)


def outline(rows: DataFrame) -> DataFrame:
    """The elements that the walk keeps: a filter."""
    return rows.where("kept")


def collapse_repeats(rows: DataFrame) -> DataFrame:
    """The outline with the first of each run of (role, first 30 characters of the label) under a parent, and how often it repeats."""
    return rows.where("shown")


def structural_hash(rows: DataFrame, key: str) -> DataFrame:
    """(key, dom_hash): FNV-1a of the tags and depths in page order."""
    from ..functions.checksums import fnv1a_hex

    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "tag", F.col("depth").cast("string")).alias("p")))).alias("p"))
    return parts.select(key, fnv1a_hex(F.array_join(F.transform("p", lambda x: x["p"]), ">")).alias("dom_hash"))
