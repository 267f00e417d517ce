"""Schema checks as projections: every row gets the list of rules it breaks; none are dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes, sources and methods of the wire schema.
CLASSES = "PASSWORD PERSON EMAIL PHONE ADDRESS CREDIT_CARD AADHAAR PAN GSTIN IFSC IBAN PASSPORT DL DOB IP_ADDRESS API_KEY JWT BANK_ACCOUNT ORG MONEY LOCATION DATE FACE TEXT_REGION OPAQUE_REGION".split()
SOURCES = ("L0", "L1", "L2", "L3")
METHODS = ("solid_fill", "pixelate", "placeholder")
VALUE_CLASSES = ("public", "sensitive", "masked")
ACTIONS = ("click", "fill", "focus", "select", "scroll", "hover", "navigate", "extract", "wait_for", "ask_user", "none")
DIRECTIONS = ("up", "down", "left", "right")
TIERS = ("T0", "T1", "T2")
PLACEHOLDER = r"^\[(?:PASSWORD|[A-Z_]+(?:_[A-Z0-9]{1,2})?_[0-9a-f]{1,8})\]$"
FRAME_HASH = r"^[0-9a-f]{16,64}$"


def errors(**checks: Column) -> Column:
    """The names of the checks that fail; a null outcome fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def _at_most(column: str, n: int) -> Column:
    return F.col(column).isNull() | (F.length(column) <= n)


def _count(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) >= 0)


def _box(column: str) -> Column:
    """A box with finite corners and sides that aren't negative."""
    b = F.col(column)
    finite = [~F.isnan(b[k]) & (F.abs(b[k]) < float("inf")) for k in "xywh"]
    return finite[0] & finite[1] & finite[2] & finite[3] & (b["w"] >= 0) & (b["h"] >= 0)


def detections(rows: DataFrame) -> DataFrame:
    """Detections (id, cls, source, score, start, end) with ``errors``."""
    span = F.col("start").isNull() & F.col("end").isNull() | (F.col("start") >= 0) & (F.col("end") >= F.col("start"))
    return rows.withColumn("errors", errors(id=F.length("id") > 0, cls=F.col("cls").isin(*CLASSES), source=F.col("source").isin(*SOURCES), score=F.col("score").between(0, 1), span=span))


def states(rows: DataFrame) -> DataFrame:
    """Screen states (session_id, frame_hash, url, title) with ``errors``."""
    return rows.withColumn("errors", errors(session_id=F.length("session_id") >= 8, frame_hash=F.col("frame_hash").rlike(FRAME_HASH), url=F.length("url") <= 2000, title=F.length("title") <= 300))


def redactions(rows: DataFrame) -> DataFrame:
    """Manifest entries (id, box, cls, token, method, score, source, pixel_derived) with ``errors``."""
    return rows.withColumn("errors", errors(id=F.length("id") > 0, box=_box("box"), cls=F.col("cls").isin(*CLASSES), token=F.col("token").rlike(PLACEHOLDER), method=F.col("method").isin(*METHODS), score=F.col("score").between(0, 1), source=F.col("source").isin(*SOURCES), pixel_derived=F.col("pixel_derived").isNotNull()))


def manifests(rows: DataFrame) -> DataFrame:
    """Manifests (schema_version, session_id, frame_hash, signature, l2_ner, l3_face, l3_text, runtime) with ``errors``."""
    versions = {c: F.col(c).isNotNull() for c in ("l2_ner", "l3_face", "l3_text", "runtime")}
    return rows.withColumn("errors", errors(schema_version=F.length("schema_version") > 0, session_id=F.length("session_id") >= 8, frame_hash=F.col("frame_hash").rlike(FRAME_HASH), signature=F.length("signature") >= 16, **versions))


def nodes(rows: DataFrame) -> DataFrame:
    """Screen nodes (id, role, label, value, value_class, bbox, mark, actions array) with ``errors``."""
    allowed = F.col("actions").isNull() | F.forall("actions", lambda a: F.coalesce(a.isin(*ACTIONS), F.lit(False)))
    return rows.withColumn("errors", errors(id=F.length("id") > 0, role=F.length("role") > 0, label=_at_most("label", 200), value=_at_most("value", 200), value_class=F.col("value_class").isin(*VALUE_CLASSES), bbox=F.col("bbox").isNull() | _box("bbox"), mark=_count("mark"), actions=allowed))


def steps(rows: DataFrame) -> DataFrame:
    """Actions (action, mark, selector, role, name, value, text, url, direction, amount, reason, confidence) with ``errors``."""
    lengths = {"selector": 500, "role": 100, "name": 200, "value": 2000, "text": 2000, "url": 2000, "reason": 500}
    finite = F.col("amount").isNull() | (~F.isnan("amount") & (F.abs("amount") < float("inf")))
    return rows.withColumn("errors", errors(action=F.col("action").isin(*ACTIONS), mark=_count("mark"), **{c: _at_most(c, n) for c, n in lengths.items()}, direction=F.col("direction").isNull() | F.col("direction").isin(*DIRECTIONS), amount=finite, confidence=F.col("confidence").isNull() | F.col("confidence").between(0, 1)))


def plans(rows: DataFrame) -> DataFrame:
    """Plans (schema_version, session_id, n_steps, confidence, needs array) with ``errors``."""
    needs = F.col("needs").isNull() | F.forall("needs", lambda x: F.coalesce(F.length(x) <= 300, F.lit(False)))
    return rows.withColumn("errors", errors(schema_version=F.length("schema_version") > 0, session_id=F.length("session_id") >= 8, n_steps=F.col("n_steps") >= 1, confidence=F.col("confidence").between(0, 1), needs=needs))


def tiles(rows: DataFrame) -> DataFrame:
    """Tiles (x, y, w, h, b64) with ``errors``."""
    return rows.withColumn("errors", errors(x=F.col("x").isNotNull(), y=F.col("y").isNotNull(), w=F.col("w") > 0, h=F.col("h") > 0, b64=F.col("b64").isNotNull()))


def requests(rows: DataFrame) -> DataFrame:
    """Requests (schema_version, session_id, intent, turn, tier) with ``errors``; their parts have checks of their own."""
    return rows.withColumn("errors", errors(schema_version=F.length("schema_version") > 0, session_id=F.length("session_id") >= 8, intent=F.length("intent") <= 2000, turn=_count("turn"), tier=F.col("tier").isNull() | F.col("tier").isin(*TIERS)))


def verdicts(rows: DataFrame) -> DataFrame:
    """Gate verdicts (ok, reasons, covered, uncovered, frame_hash) with ``errors``."""
    return rows.withColumn("errors", errors(ok=F.col("ok").isNotNull(), reasons=F.col("reasons").isNotNull(), covered=F.col("covered") >= 0, uncovered=F.col("uncovered") >= 0, frame_hash=F.col("frame_hash").rlike(FRAME_HASH)))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)."""
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)
