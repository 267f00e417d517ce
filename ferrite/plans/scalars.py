"""Registered queries of single-row functions and small look-ups, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import small
from ..operators import elements, frames, policy, reports, rules
from . import sql
from .sql import _lit

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SCHEMES = ("https://", "http://", "chrome://", "about:", "ftp://", "https://chromewebstore.google.com/", "", "moz-extension://")
OUTCOMES = ("ok", "no-provider", "abort", "refused")
TAGS = ("a", "input", "select", "button", "h2", "td", "nav", "div", "textarea")
KINDS = ("checkbox", "radio", "submit", "range", "file", "search", "email", "")
STATES = ("nominal", "fair", "serious", "critical")
ACTS = ("fill", "select", "click", "hover", "scroll")
HELD = ("input", "select", "div", "textarea", "editable")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _one(of: tuple, k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in of]), (k % len(of)).cast("int"))


def _sql_one(of: tuple, k: str) -> str:
    return f"[{', '.join(map(_lit, of))}][CAST({k} % {len(of)} AS INTEGER) + 1]"


def _sql_map(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in table.items()) + " END"


@query
def blocked_urls(spark, d):
    url = F.concat(_one(SCHEMES, F.col("page_id")), F.substring(F.coalesce("url", F.lit("")), 9, 40))
    return _t(spark, d, "pages").select("page_id", elements.blocked_url(url).alias("blocked"))


@query
def provider_health(spark, d):
    h = elements.health(_one(OUTCOMES, F.col("s_suppkey")))
    return _t(spark, d, "supplier").select("s_suppkey", h["detail"].alias("detail"), h["unreachable"].alias("unreachable"))


@query
def call_costs(spark, d):
    price = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") * 0.5)
    usd = policy.usd(F.col("l_quantity"), F.col("l_extendedprice"), F.lit(2.5), price)
    # A sum of doubles depends on its order: rows are added as the table has them, as SQL on one thread does.
    rows = _t(spark, d, "lineitem").select("l_orderkey", usd.alias("usd"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    whole = Window.partitionBy("l_orderkey").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = rows.select("l_orderkey", "usd", F.sum("usd").over(whole).alias("total")).groupBy("l_orderkey")
    return sums.agg(small.round_scaled(F.first("total"), 6).alias("usd"), F.count_if(F.col("usd").isNull()).alias("n_unknown"))


@query
def payload_bytes(spark, d):
    return _t(spark, d, "documents").select("doc_id", small.image_bytes(F.col("text")).alias("n_bytes"))


@query
def element_roles(spark, d):
    k = F.col("p_partkey")
    tag, kind = _one(TAGS, k), _one(KINDS, k * 3 + F.col("p_size"))
    of_role = elements.role(tag, kind, F.when(k % 17 == 0, "tab").otherwise(""), F.when(k % 2 == 0, "/x"), F.when(k % 3 == 0, ""))
    return _t(spark, d, "part").select("p_partkey", of_role.alias("role"), elements.actions(of_role).alias("actions"))


@query
def model_classes(spark, d):
    label = F.concat(_one(("B-", "I-", "", "X-"), F.col("p_partkey")), _one((*elements.MODEL_LABELS, "URL", "person"), F.col("p_partkey") * 5 + F.col("p_size")))
    of = elements.model_class(label)
    return _t(spark, d, "part").select("p_partkey", of.alias("cls"), elements.redaction_method(of, F.col("p_size") % 2 == 0).alias("method"), elements.layers(_one(STATES, F.col("p_partkey"))).alias("layers"))


@query
def action_effects(spark, d):
    k = F.col("p_partkey")
    flag = lambda n: F.when(k % n > 0, k % (n * 2) > n)
    effect = elements.effect(_one(ACTS, k), F.when(k % 19 > 0, _one(HELD, k * 7)), k % 11 == 0, k % 13 == 0, F.when(k % 4 > 0, (k % 3).cast("string")), (k % 5).cast("string"), flag(3), F.coalesce(flag(7), F.lit(False)), F.coalesce(flag(2), F.lit(False)))
    return _t(spark, d, "part").select("p_partkey", effect.alias("effect"))


@query
def model_verdicts(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", small.model_verdict(k % 9 == 0, k % 5, s % 4, k % 7 - 4, s % 3 - 1, k % 2).alias("verdict"))


@query
def recovered_offsets(spark, d):
    """Every longer word of a sentence in two pieces, as a model's tokenizer would give them, and back to where they stand."""
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[.\n]")).alias("line"))
    words = F.filter(F.split("line", r"[^a-z]+"), lambda w: F.length(w) > 3)
    pieces = F.flatten(F.transform(words, lambda w: F.array(F.substring(w, 1, 2), F.concat(F.lit("##"), F.substring(w, F.lit(3), F.length(w))))))
    rows = lines.select("doc_id", small.recover_offsets(pieces, F.col("line")).alias("r"))
    return rows.groupBy("doc_id").agg(F.sum(F.size("r")).alias("n"), F.sum(F.coalesce(F.array_max(F.transform("r", lambda x: x["end"])), F.lit(0))).alias("ends"), F.min(F.forall("r", lambda x: F.length(F.regexp_replace(x["word"], "^##", "")) == x["end"] - x["start"])).alias("sound"))


@query
def resolved_marks(spark, d):
    """Controls whose page changed: some are gone, some renamed, and each mark is looked for again."""
    p = _t(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("node_id"), F.col("p_partkey").alias("mark"), F.col("p_name").alias("label"))
    live = p.where("node_id % 4 > 0").withColumn("label", F.when(F.col("node_id") % 3 == 0, F.concat(F.lit("new "), F.split("label", " ")[0])).otherwise(F.col("label")))
    return frames.resolve_marks(p, live, "page").select("page", "mark", "status", F.coalesce("node", F.lit(-1)).alias("node"))


@query
def luma_grid(spark, d):
    i = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    px = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 16).alias("frame"), (i % 64).alias("x"), (F.floor(i / 64) % 64).alias("y"), (i % 251).alias("r"), (i % 241).alias("g"), (i % 239).alias("b"))
    cells = reports.luma_cells(px, "frame", 64, 64, 4)
    return cells.select("frame", F.size("cells").cast("bigint").alias("n_cells"), F.round(F.aggregate("cells", F.lit(0.0), lambda s, v: s + v), 0).alias("total"))


@query
def manifest_entries(spark, d):
    hits = rules.explode(rules.scan(_t(spark, d, "documents").select("doc_id", "text")), "doc_id")
    box = F.struct(F.col("start").cast("double").alias("x"), F.lit(3.0).alias("y"), F.lit(0.4).alias("w"), (F.col("end") - F.col("start")).cast("double").alias("h"))
    made = reports.build_manifest(hits.select("doc_id", F.col("start").alias("hit_id"), "cls", "text", box.alias("box")), 0.5, sql.SESSION)
    return made.select("doc_id", "hit_id", "cls", "method", "token", "box.x", "box.w", "box.h")


_P = "WITH p AS (SELECT *, p_partkey AS k, p_size AS s FROM part)"
_KEPT = "CASE WHEN {0} IN ('OPAQUE_REGION', 'TEXT_REGION', 'PASSWORD', 'CREDIT_CARD', 'AADHAAR', 'PAN', 'GSTIN', 'IFSC', 'IBAN', 'PASSPORT', 'DL', 'BANK_ACCOUNT', 'API_KEY', 'JWT') OR {1} THEN 'solid_fill' ELSE 'placeholder' END"
_PLAIN = _sql_map(elements.ROLES, "tag")
_ROLE = f"CASE WHEN k % 17 = 0 THEN 'tab' WHEN tag = 'a' THEN CASE WHEN k % 2 = 0 THEN 'link' ELSE 'generic' END WHEN tag = 'input' THEN coalesce({_sql_map(elements.INPUT_ROLES, 'kind')}, 'textbox') WHEN tag = 'select' THEN CASE WHEN k % 3 = 0 THEN 'listbox' ELSE 'combobox' END ELSE coalesce({_PLAIN}, tag) END"
_FLAG = "CASE WHEN k % {0} > 0 THEN k % ({0} * 2) > {0} END"
ORACLE |= {
    "blocked_urls": f"WITH u AS (SELECT page_id, {_sql_one(SCHEMES, 'page_id')} || substr(coalesce(url, ''), 9, 40) AS u FROM pages) SELECT page_id, CASE WHEN u = '' THEN 'unknown' WHEN regexp_matches(u, '(?i)^(chrome|edge|about|devtools|view-source|chrome-extension|moz-extension):') THEN 'chrome' WHEN starts_with(u, 'https://chromewebstore.google.com') THEN 'restricted' WHEN u ILIKE 'http://%' OR u ILIKE 'https://%' THEN 'not-injected' ELSE 'restricted' END AS blocked FROM u",
    "provider_health": f"WITH s AS (SELECT s_suppkey, {_sql_one(OUTCOMES, 's_suppkey')} AS o FROM supplier) SELECT s_suppkey, CASE o WHEN 'ok' THEN 'ok' WHEN 'no-provider' THEN 'no provider' WHEN 'abort' THEN 'timeout' ELSE 'not running' END AS detail, o = 'refused' AS unreachable FROM s",
    "call_costs": "WITH c AS (SELECT l_orderkey, (l_quantity * 2.5::DOUBLE + l_extendedprice * CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber * 0.5::DOUBLE END) / 1000000 AS usd FROM lineitem) SELECT l_orderkey, round(sum(usd), 6) AS usd, count(*) FILTER (usd IS NULL) AS n_unknown FROM c GROUP BY l_orderkey",
    "payload_bytes": "SELECT doc_id, CAST(length(coalesce(text, '')) * 3 // 4 AS BIGINT) AS n_bytes FROM documents",
    "element_roles": f"{_P}, t AS (SELECT *, {_sql_one(TAGS, 'k')} AS tag, {_sql_one(KINDS, '(k * 3 + s)')} AS kind FROM p), r AS (SELECT p_partkey, {_ROLE} AS role FROM t) SELECT p_partkey, role, coalesce({_sql_map(elements.ACTIONS, 'role')}, '') AS actions FROM r",
    "model_classes": f"{_P}, l AS (SELECT *, {_sql_one(('B-', 'I-', '', 'X-'), 'k')} || {_sql_one((*elements.MODEL_LABELS, 'URL', 'person'), '(k * 5 + s)')} AS l FROM p), c AS (SELECT *, {_sql_map(elements.MODEL_LABELS, 'CASE WHEN l[1:2] IN (' + chr(39) + 'B-' + chr(39) + ', ' + chr(39) + 'I-' + chr(39) + ') THEN upper(l[3:]) ELSE upper(l) END')} AS cls FROM l) SELECT p_partkey, cls, {_KEPT.format('cls', 's % 2 = 0')} AS method, {_sql_map(elements.CASCADE, _sql_one(STATES, 'k'))} AS layers FROM c",
    "action_effects": f"""{_P}, a AS (SELECT *, {_sql_one(ACTS, 'k')} AS act, CASE WHEN k % 19 > 0 THEN {_sql_one(HELD, '(k * 7)')} END AS tag, k % 11 = 0 AS secret, CASE WHEN k % 4 > 0 THEN (k % 3)::VARCHAR END AS want, (k % 5)::VARCHAR AS got, {_FLAG.format(3)} AS answered, coalesce({_FLAG.format(7)}, false) AS moved, coalesce({_FLAG.format(2)}, false) AS left_page FROM p)
SELECT p_partkey, CASE WHEN tag IS NULL THEN 'unknown' WHEN act = 'fill' THEN CASE WHEN secret OR want IS NULL OR tag NOT IN ('input', 'textarea', 'editable') THEN 'unknown' WHEN got = want THEN 'confirmed' ELSE 'unchanged' END WHEN act = 'select' THEN CASE WHEN tag <> 'select' OR want IS NULL THEN 'unknown' WHEN got = want THEN 'confirmed' ELSE 'unchanged' END
 WHEN act IN ('click', 'hover') AND k % 13 = 0 THEN 'unchanged' WHEN act = 'click' THEN CASE WHEN answered THEN 'confirmed' WHEN NOT answered THEN 'unchanged' WHEN moved THEN 'changed' WHEN left_page THEN 'confirmed' ELSE 'unknown' END ELSE 'unknown' END AS effect FROM a""",
    "model_verdicts": f"{_P} SELECT p_partkey, CASE WHEN k % 9 = 0 OR k % 5 = 0 THEN 'UNUSABLE' WHEN s % 4 = 0 THEN 'NO GROUNDING' WHEN k % 7 > 4 THEN 'INVENTS MARKS' WHEN s % 3 > 1 THEN 'INVALID PLANS' WHEN k % 2 > 0 THEN 'TRUNCATES' ELSE 'USABLE' END AS verdict FROM p",
    "recovered_offsets": """WITH RECURSIVE x AS (SELECT doc_id, unnest(string_split_regex(text, '[.\\n]')) AS line FROM documents), w AS (SELECT doc_id, row_number() OVER () AS id, lower(line) AS low, flatten(list_transform(list_filter(string_split_regex(line, '[^a-z]+'), lambda w: length(w) > 3), lambda w: [w[1:2], w[3:]])) AS ps FROM x),
r AS (SELECT doc_id, id, low, ps, 0 AS k, 0 AS cursor, 0 AS n, 0 AS most FROM w
  UNION ALL SELECT doc_id, id, low, ps, k + 1, CASE WHEN found > 0 THEN CAST(found - 1 + length(ps[k + 1]) AS INTEGER) ELSE cursor END, n + CAST(found > 0 AS INTEGER), CASE WHEN found > 0 THEN greatest(most, CAST(found - 1 + length(ps[k + 1]) AS INTEGER)) ELSE most END
  FROM (SELECT *, CASE WHEN strpos(substr(low, cursor + 1), ps[k + 1]) > 0 THEN cursor + strpos(substr(low, cursor + 1), ps[k + 1]) ELSE strpos(low, ps[k + 1]) END AS found FROM r WHERE k < len(ps)))
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(most) AS BIGINT) AS ends, true AS sound FROM r WHERE k = len(ps) GROUP BY doc_id""",
    "resolved_marks": f"""WITH p AS (SELECT p_brand AS page, p_partkey AS node, p_name AS label, {sql._words('p_name')} AS w FROM part), l AS (SELECT page, node, now, {sql._words('now')} AS w FROM (SELECT page, node, CASE WHEN node % 3 = 0 THEN 'new ' || string_split(label, ' ')[1] ELSE label END AS now FROM p WHERE node % 4 > 0)),
s AS (SELECT p.page, p.node AS mark, l.node AS best, round({sql._jaccard('p.w', 'l.w')}, 6) AS sim FROM p JOIN l ON l.page = p.page AND l.node <> p.node WHERE len(list_intersect(p.w, l.w)) > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, mark ORDER BY sim DESC, best) = 1),
j AS (SELECT p.page, p.node AS mark, l.node AS live, {sql._jaccard('p.w', 'l.w')} AS own, b.best, b.sim FROM p LEFT JOIN l ON l.page = p.page AND l.node = p.node LEFT JOIN b ON b.page = p.page AND b.mark = p.node),
z AS (SELECT *, CASE WHEN live IS NOT NULL AND own >= 0.99 THEN 'ok' WHEN sim >= 0.55 THEN 'reassigned' WHEN live IS NOT NULL AND own >= 0.34 THEN 'ok' ELSE 'lost' END AS status FROM j)
SELECT page, mark, status, CAST(CASE status WHEN 'reassigned' THEN best WHEN 'ok' THEN mark ELSE -1 END AS BIGINT) AS node FROM z""",
    "luma_grid": "WITH i AS (SELECT l_orderkey % 16 AS frame, l_orderkey * 7 + l_linenumber AS i FROM lineitem), c AS (SELECT frame, (i // 64 % 64) // 16 * 4 + (i % 64) // 16 AS c, avg(0.299::DOUBLE * (i % 251) + 0.587::DOUBLE * (i % 241) + 0.114::DOUBLE * (i % 239)) AS v FROM i GROUP BY ALL) SELECT frame, count(*) AS n_cells, round(sum(round(v, 3)), 0) AS total FROM c GROUP BY frame",
    "manifest_entries": f"WITH {sql.TOKENS} SELECT doc_id, s AS hit_id, cls, 'solid_fill' AS method, token, floor(s * 0.5 + 0.5) AS x, 2.0::DOUBLE AS w, greatest(2.0, floor((e - s) * 0.5::DOUBLE + 0.5)) AS h FROM tok",
}
