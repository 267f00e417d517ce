"""Registered queries of pages as a planner sees them, of an agent's runs and of detector reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import small
from ..operators import elements, evaluate, events, frames, policy, reports, rules, runs, screen
from ..sources import html, synthetic, validate, wire
from . import fixtures, sql
from .sql import EVENTS, SPANS, _lit, _values

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SESSION = "session-0001"
HOUR = 3_600_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", events.epoch_us("ts").alias("t"))


# -- pages


def _elements(spark, d) -> DataFrame:
    return html.elements(_t(spark, d, "pages"), "page_id")


@query
def element_hits(spark, d):
    return rules.explode(screen.hits_of(_elements(spark, d)), "page_id", "ord").select("page_id", "ord", "cls", "source", "score", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query
def page_snapshot(spark, d):
    return screen.snapshot(_elements(spark, d), "page_id", SESSION).select("page_id", "ord", "of_role", "name", "value_class", "actions", "mark", screen.value_type(F.col("tag"), F.col("type"), F.lit(False)).alias("value_type"))


@query
def page_fingerprints(spark, d):
    return screen.fingerprint(screen.snapshot(_elements(spark, d), "page_id", SESSION), "page_id")


@query
def page_planner_text(spark, d):
    return screen.planner_text(screen.snapshot(_elements(spark, d), "page_id", SESSION), "page_id")


@query
def page_payload(spark, d):
    return screen.payload(screen.snapshot(_elements(spark, d), "page_id", SESSION), "page_id")


@query
def page_controls(spark, d):
    return screen.probe_nodes(_elements(spark, d), "page_id")


@query
def page_label_scan(spark, d):
    names = screen.texts(screen.snapshot(_elements(spark, d), "page_id", SESSION), "page_id")
    return names.select("page_id", F.explode(policy.injection_findings(F.col("label"))).alias("f")).select("page_id", "f.kind")


@query
def sensitive_targets(spark, d):
    rows = spark.createDataFrame(fixtures.ELEMENTS, fixtures.ELEMENT_SCHEMA)
    return screen.sensitive_target(rows).select("ord", "sensitive_target")


def _shown(spark) -> DataFrame:
    return spark.createDataFrame(fixtures.NODES_SHOWN, "page bigint, ord int, place string, closed int, of_role string, name string, value_class string, actions string, mark int, n_children int")


@query
def planner_text(spark, d):
    return screen.planner_text(_shown(spark), "page")


@query
def frame_fingerprint(spark, d):
    return screen.fingerprint(_shown(spark), "page")


@query
def marked_controls(spark, d):
    return screen.controls(_shown(spark), "page")


@query
def value_classes(spark, d):
    hits = rules.scan(_t(spark, d, "documents").select("doc_id", "lang", "text"))
    name = F.concat(F.lit("["), F.upper("lang"), F.lit("_1]"))
    return hits.select("doc_id", screen.value_class(F.col("hits"), name).alias("value_class"))


NODES = f"n(page, ord, place, closed, of_role, name, value_class, actions, mark, n_children) AS ({_values(fixtures.NODES_SHOWN)})"
ORACLE |= {
    "planner_text": f"""WITH {NODES}, l AS (SELECT *, string_split(place, '/') AS steps FROM n),
p AS (SELECT *, list_filter([CASE WHEN mark IS NOT NULL THEN '[' || mark || ']' END, of_role, CASE WHEN name <> '' THEN '"' || substr(name, 1, 80) || '"' END, CASE WHEN value_class = 'sensitive' THEN '(hidden)' END, CASE WHEN actions <> '' THEN '<' || array_to_string(string_split(actions, ',')[1:3], ',') || '>' END], lambda x: x IS NOT NULL) AS parts
  FROM l WHERE len(steps) - 1 <= 6 AND len(list_filter(steps[2:], lambda s: s::INTEGER >= 12)) = 0)
SELECT CAST(page AS BIGINT) AS page, string_agg(repeat('  ', len(steps) - 1) || array_to_string(parts, ' '), chr(10) ORDER BY ord) AS text FROM p WHERE len(parts) > 1 OR n_children > 0 GROUP BY page""",
    "frame_fingerprint": f"WITH {NODES}, l AS (SELECT page, string_agg(of_role || '|' || name || '|' || value_class || '|' || coalesce(mark, -1) || '|' || actions, chr(10) ORDER BY closed) AS x FROM n GROUP BY page) SELECT CAST(page AS BIGINT) AS page, rpad({sql._fnv('x')}, 16, '0') AS frame_hash FROM l",
    "marked_controls": f"WITH {NODES} SELECT CAST(page AS BIGINT) AS page, mark, name AS label, value_class = 'sensitive' AS sensitive FROM n WHERE mark IS NOT NULL",
    "value_classes": f"WITH {sql.HITS}, s AS (SELECT DISTINCT doc_id FROM kept WHERE cls = 'PASSWORD' OR score >= 0.6) SELECT d.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN 'sensitive' WHEN regexp_matches('[' || upper(lang) || '_1]', '\\[[A-Z]+_[A-Z0-9]*_?\\d+\\]') THEN 'masked' ELSE 'public' END AS value_class FROM documents d LEFT JOIN s USING (doc_id)",
}


# -- what an element's attributes say, as SQL


def _line(*parts: str) -> str:
    text = "concat_ws(' ', " + ", ".join(parts) + ")"
    split = f"regexp_replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"(' ' || array_to_string(list_filter(string_split_regex(lower({split}), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ')"


def _holds(line: str, words) -> str:
    return "(" + " OR ".join(f"contains({line}, ' {w} ')" for w in words) + ")"


def _semantic_sql(result: str, names: tuple[str, ...] = ("id", "name", "placeholder", "aria_label", "title", "autocomplete"), data: bool = True) -> str:
    longest = sorted(elements.PHRASES, key=lambda pc: -len(pc[0].split()))
    phrase = "CASE " + " ".join(f"WHEN contains(f, ' {p} ') THEN '{c}'" for p, c in longest) + " END"
    holds = "CASE " + " ".join(f"WHEN regexp_matches(a.v, {_lit(rules.re2(r))}) THEN '{r.cls}'" for r in rules.RULES if r.score >= 0.7 and not r.check) + " END"
    key = _line("a.k")
    found = f"CASE WHEN NOT {_holds(key, elements.DATA_KEYS)} OR length(a.v) < 3 THEN NULL WHEN regexp_matches(a.v, '(?i)^(true|1|yes)$') THEN 'PASSWORD' WHEN {holds} IS NOT NULL THEN {holds} WHEN {_holds(key, elements.NAME_KEYS)} AND contains(a.v, ' ') THEN 'PERSON' END"
    of_data = f"list_filter(list_transform(data, lambda a: {found}), lambda c: c IS NOT NULL)[1]" if data else "NULL"
    columns = ("ord", "tag", "type", "id", "name", "placeholder", "aria_label", "title", "alt", "autocomplete", "cleared", "data", "value")

    def lit(v) -> str:
        return "[" + ", ".join(f"{{'k': {_lit(x['k'])}, 'v': {_lit(x['v'])}}}" for x in v) + "]::STRUCT(k VARCHAR, v VARCHAR)[]" if isinstance(v, list) else _lit(v)

    rows = "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in fixtures.ELEMENTS)
    listed = ", ".join(f"'{a}'" for a in elements.AUTOCOMPLETE)
    password = f"(ty = 'password' OR {_holds('f', elements.PASSWORD_WORDS)} OR contains(ac, 'password') OR contains(ac, 'one-time-code'))"
    return f"""WITH e({', '.join(columns)}) AS ({rows}), x AS (SELECT *, {_line('id', 'name', 'alt', 'title')} AS im, {_line(*names)} AS f, lower(trim(coalesce(type, ''))) AS ty, lower(trim(coalesce(autocomplete, ''))) AS ac FROM e),
c AS (SELECT ord, CASE WHEN tag IN ('img', 'picture', 'source', 'video') AND {_holds('im', elements.FACE_WORDS)} THEN 'FACE' WHEN tag = 'video' AND NOT cleared THEN 'OPAQUE_REGION' WHEN tag IN ('img', 'picture', 'source', 'video') THEN NULL
 WHEN tag IN ('canvas', 'iframe', 'frame', 'embed', 'object') THEN CASE WHEN NOT cleared THEN 'OPAQUE_REGION' END WHEN {password} THEN 'PASSWORD' WHEN ac IN ({listed}) AND contains(ac, 'cc-') THEN 'CREDIT_CARD'
 WHEN ac IN ({listed}) AND regexp_matches(ac, '(^| )(billing|shipping|street|address|locality|region|postal|country)') THEN 'ADDRESS' WHEN ac IN ({listed}) THEN 'PERSON' WHEN {phrase} IS NOT NULL THEN {phrase} WHEN ty = 'email' THEN 'EMAIL' WHEN ty = 'tel' THEN 'PHONE' ELSE {of_data} END AS cls FROM x)
SELECT {result} FROM c"""


ORACLE["semantic_elements"] = _semantic_sql("ord, cls, coalesce(cls = 'PASSWORD', false) AS is_password")
ORACLE["sensitive_targets"] = _semantic_sql("ord, coalesce(cls = 'PASSWORD', false) AS sensitive_target", ("id", "name", "placeholder", "aria_label", "autocomplete"), False)
_COMPLETE = "(regexp_matches(trim({0}), '^[{{\\[]') AND coalesce(json_valid({0}), false))"
ORACLE["plan_streams"] = f"""WITH v(id, raw) AS ({_values(fixtures.STREAMS)}),
p AS (SELECT id, list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: starts_with(x, 'data:')), lambda x: trim(substr(x, 6))), lambda x: x <> '' AND x <> '[DONE]' AND json_valid(x)) AS p FROM v),
d AS (SELECT id, list_filter(list_transform(p, lambda x: json_extract_string(x, '$.delta')), lambda x: x IS NOT NULL) AS d FROM p),
t AS (SELECT id, list_reduce(list_prepend('', d), lambda a, x: CASE WHEN {_COMPLETE.format('x')} THEN x ELSE a || x END) AS plan FROM d)
SELECT CAST(id AS BIGINT) AS id, {_COMPLETE.format('plan')} AS ok, plan FROM t"""


# -- the generator


def _corpus(spark, d) -> DataFrame:
    return synthetic.corpus(_t(spark, d, "customer"), "c_custkey")


def _digits(n: int, salt: int = 0) -> str:
    return f"lpad(CAST((k * 7919 + 104729 + {salt}) % {10 ** min(n, 12)} AS VARCHAR), {n}, '0')"


def _sought(body: str, test) -> str:
    return f"list_filter(['0','1','2','3','4','5','6','7','8','9'], lambda g: {test(f'({body} || g)')})[1]"


def _generated() -> str:
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    aadhaar, card, rest = f"(CAST(k % 8 + 2 AS VARCHAR) || {_digits(10)})", f"('4' || {_digits(14)})", f"('WEST' || {_digits(14)})"
    # An IBAN's check digits are 98 less the remainder of the rest with 00 in their place.
    iban = f"'GB' || lpad(CAST(98 - (CAST('32142829' || {_digits(14)} || '161100' AS HUGEINT) % 97) AS VARCHAR), 2, '0') || {rest}"
    made = [
        f"'eyJhbGciOiJI' || {_digits(9)} || '.eyJzdWIi' || {_digits(9, 1)} || '.' || {_digits(9, 2)}", f"'sk-' || {_digits(18)}", f"'AIza' || {_digits(35)}", f"{aadhaar} || {_sought(aadhaar, sql._verhoeff)}",
        f"'ABCDE' || {_digits(4)} || 'F'", f"{two('k % 37')} || 'ABCDE' || {_digits(4)} || 'F1Z5'", f"'HDFC0' || {_digits(6)}", iban, f"'9' || {_digits(9)}", f"'A' || {_digits(7)}",
        f"{two('k % 28 + 1')} || '/' || {two('k % 12 + 1')} || '/' || (k % 70 + 1950)", f"(k % 70 + 1950) || '-' || {two('k % 12 + 1')} || '-' || {two('k % 28 + 1')}", _digits(12), "'$ ' || (k % 9000 + 1) || '.50'",
        f"'12, Gandhi Road, Chennai 6' || {_digits(5)}", f"{card} || {_sought(card, sql._luhn)}",
    ]
    value = "CASE k % 16 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(made)) + " END"
    cls = "CASE k % 16 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(synthetic.CLASSES)) + " END"
    head = "'Note x' || k || 'x: ' || CASE WHEN k % 16 = 12 THEN 'account no: ' ELSE '' END"
    return f"g AS MATERIALIZED (SELECT k AS doc_id, {cls} AS cls, {value} AS value, {head} AS head FROM (SELECT c_custkey AS k FROM customer)), documents AS MATERIALIZED (SELECT doc_id, head || value || ' end' AS text FROM g)"


@query
def synthetic_corpus(spark, d):
    return _corpus(spark, d).select("doc_id", "text", "cls", "value", F.col("start").alias("span_start"))


@query
def synthetic_spans(spark, d):
    scanned = rules.scan(_corpus(spark, d).select("doc_id", "text"), resolve=False)
    return rules.explode(scanned, "doc_id").select("doc_id", "rule_ord", "cls", "score", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("value"))


@query
def synthetic_recall(spark, d):
    made = _corpus(spark, d)
    found = rules.explode(rules.scan(made.select("doc_id", "text")), "doc_id")
    truth = made.select("doc_id", "cls", "start", F.col("value").alias("text"))
    return evaluate.rates(evaluate.match(truth, found.select("doc_id", "cls", "start", "text"), ["doc_id", "cls", "start", "text"]))


ORACLE |= {
    "synthetic_corpus": f"WITH {_generated()} SELECT doc_id, text, cls, value, CAST(length(head) AS INTEGER) AS span_start FROM g JOIN documents USING (doc_id)",
    "synthetic_spans": f"WITH {_generated()}, {SPANS} SELECT doc_id, rule_ord, cls, score, s AS span_start, CAST(s + length(v) AS INTEGER) AS span_end, v AS value FROM spans",
    "synthetic_recall": f"WITH RECURSIVE {_generated()}, {SPANS}, {sql._greedy('SELECT *, s + length(v) AS e FROM spans')}, h AS (SELECT DISTINCT doc_id, cls, s, v FROM kept), gt AS (SELECT doc_id, cls, length(head) AS s, value AS v FROM g), a AS (SELECT gt.cls, CAST(h.v IS NOT NULL AS INTEGER) AS tp, 0 AS fp, CAST(h.v IS NULL AS INTEGER) AS fn FROM gt LEFT JOIN h USING (doc_id, cls, s, v) UNION ALL SELECT kept.cls, 0, 1, 0 FROM kept ANTI JOIN gt USING (doc_id, cls, s, v)), "
    + "t AS (SELECT cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM a GROUP BY cls) " + sql._rates("SELECT * FROM t", "cls"),
}


# -- runs


@query
def stage_deadlines(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in {"view": "begin", "click": "end", "signup": "forget"}.items() for x in kv])[F.col("event_type")]
    return runs.stage_deadlines(_events(spark, d).withColumn("kind", kind), "user_id", "t", "event_id", "kind", 8 * HOUR).select("event_id", "outcome")


@query
def confirmations(spark, d):
    is_ask, is_answer = F.col("event_type") == "purchase", F.col("event_type").isin("click", "error")
    return runs.confirmations(_events(spark, d), "user_id", "t", "event_id", is_ask, is_answer, F.col("event_type") == "click", 10 * HOUR).select("event_id", "confirmed")


@query
def session_turns(spark, d):
    return runs.turns(_events(spark, d), "user_id", "t", "event_id", F.col("event_type") == "signup").select("event_id", "session", F.col("turn").cast("bigint").alias("turn"))


@query
def frame_scoping(spark, d):
    decided = runs.frame_decision(F.col("p_partkey") % 3, F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("bigint") % 3), F.col("p_partkey") % 3 == 0)
    return _t(spark, d, "part").select("p_partkey", decided["execute"].alias("execute"), decided["reason"].alias("reason"))


_KINDS = {"view": "panel:stage", "click": "redact:ready", "purchase": "panel:plan", "error": "redact:aborted", "signup": "execute:done"}


def _messages(spark, d) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("event_type")]
    cents = F.floor("value").cast("bigint")
    return _events(spark, d).select("t", F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), (cents % 7).alias("redactions"), (cents % 3).alias("opaque"), cents.alias("bytes"), F.lit(None).cast("string").alias("tier"), F.lit("").alias("label"), (cents % 4).alias("action_index"), (cents % 2 == 0).alias("ok"), F.when(cents % 5 == 0, "unknown").otherwise("confirmed").alias("effect"), F.lit("refused").alias("status"))


@query
def panel_state(spark, d):
    return runs.panel(_messages(spark, d), "run", "seq")


@query
def step_states(spark, d):
    return runs.step_states(_messages(spark, d), "run", "seq")


@query
def transcript_bound(spark, d):
    return runs.bounded_transcript(_events(spark, d), "user_id", "event_id").select("user_id", "event_id")


@query
def overdue_runs(spark, d):
    m = _messages(spark, d)
    return runs.overdue(m, "run", "t", "seq", F.col("kind") == "redact:ready", F.col("kind").isin(*runs.TERMINAL), F.when(F.col("kind") == "panel:stage", F.col("seq").cast("string")), 20 * HOUR, F.lit(4_000_000_000_000_000).cast("bigint"))


@query
def request_status(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", runs.precondition(F.when(k % 7 == 0, "gate"), k % 3, k % 2 == 0, F.col("p_size") % 4, k % 5 > 0).alias("status"))


@query
def bytes_ledger(spark, d):
    return runs.ledger(_events(spark, d).select("user_id", F.floor("value").cast("bigint").alias("bytes"), (F.col("event_type") == "error").alias("aborted")), "user_id")


@query
def request_log(spark, d):
    meta = runs.log_metadata(F.concat(F.lit("session-"), F.col("conv_id").cast("string")), F.col("text"), F.sha2("role", 256), F.col("text"), F.col("role"))
    return _t(spark, d, "conversations").select("conv_id", "turn", meta.alias("m")).select("conv_id", "turn", "m.*")


@query
def escalations(spark, d):
    plans = spark.createDataFrame(fixtures.PLANS, "plan_id bigint, confidence double, exhausted boolean, parse_error string")
    steps = spark.createDataFrame(fixtures.STEPS, "plan_id bigint, step_idx int, action string, mark int, value string, reason string")
    nodes = spark.createDataFrame(fixtures.NODES, "plan_id bigint, mark int, label string, sensitive boolean")
    return runs.escalate(plans, policy.plan_problems(steps, nodes))


@query
def plan_outcomes(spark, d):
    """Each user's events as the steps of a plan."""
    cents = F.floor(F.col("value") * 100).cast("bigint")
    action = F.create_map(*[F.lit(x) for kv in {"signup": "ask_user", "error": "wait_for"}.items() for x in kv])[F.col("event_type")]
    steps = _t(spark, d, "events").select(F.floor(F.col("event_id") / 7).alias("plan"), "event_id", F.when(cents % 29 == 0, "none").otherwise(F.coalesce(action, F.lit("click"))).alias("action"), (cents % 5 > 0).alias("approved"), (cents % 11 > 0).alias("ok"), (cents % 7 == 0).alias("needs_confirm"), (cents % 3 > 0).alias("confirmed"), (cents % 2 == 0).alias("retry_ok"))
    return runs.plan_outcomes(steps, "plan", "event_id", 5).withColumn("stopped_at", F.coalesce("stopped_at", F.lit(-1)))


@query
def capture_modes(spark, d):
    k = F.col("p_partkey")
    m = small.capture_mode(k % 2 == 0, k % 3 > 0, k % 5 > 1, k % 7 > 2, F.col("p_size") > 20)
    return _t(spark, d, "part").select("p_partkey", m["mode"].alias("mode"), m["crop"].alias("crop"))


@query
def tile_checks(spark, d):
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select("p_partkey", F.when(k % 11 > 0, k % 50).alias("x"), (k % 40).alias("y"), (k % 5).alias("w"), (k % 7 - 1).alias("h"), F.when(k % 13 > 0, "AA==").alias("b64"))
    return validate.tiles(rows).select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query
def step_checks(spark, d):
    k = F.col("p_partkey")
    one = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    rows = _t(spark, d, "part").select("p_partkey", one("click", "fill", "dance", None).alias("action"), (k % 9 - 1).alias("mark"), F.col("p_name").alias("selector"), F.repeat("p_name", 8).alias("role"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("value"), F.lit("x").alias("text"), F.lit("").alias("url"), one("up", None, "sideways").alias("direction"), F.lit(1.5).alias("amount"), F.repeat("p_type", 30).alias("reason"), (F.col("p_size") / 40).alias("confidence"))
    return validate.steps(rows).select("p_partkey", F.array_join("errors", ",").alias("errors"))


_ORDERED = "(PARTITION BY user_id ORDER BY t, event_id)"
ORACLE |= {
    "stage_deadlines": f"""WITH RECURSIVE {EVENTS}, k AS (SELECT user_id, event_id, t, CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'end' WHEN 'signup' THEN 'forget' END AS kind FROM e),
o AS (SELECT *, row_number() OVER w AS n, lead(kind) OVER w AS nk, lead(t) OVER w AS nt FROM k WHERE kind IS NOT NULL WINDOW w AS {_ORDERED}),
s AS (SELECT user_id, 0::BIGINT AS n, false AS settled, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT o.user_id, o.n, CASE WHEN o.kind = 'forget' THEN false WHEN s.settled OR o.kind = 'end' THEN true ELSE coalesce(o.nk <> 'forget' AND o.nt - o.t > {8 * HOUR}, false) END, o.event_id,
    CASE WHEN o.kind <> 'begin' THEN NULL WHEN s.settled THEN 'refused' WHEN o.nk IS NULL OR o.nk = 'forget' THEN 'pending' WHEN o.nt - o.t > {8 * HOUR} THEN 'expired' ELSE 'cleared' END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
SELECT event_id, outcome FROM s WHERE outcome IS NOT NULL""",
    "confirmations": f"""WITH {EVENTS}, a AS (SELECT * FROM e WHERE event_type IN ('click', 'error')), p AS (SELECT * FROM e WHERE event_type = 'purchase'),
r AS (SELECT p.event_id, p.t, arg_min(struct_pack(t := a.t, y := a.event_type = 'click'), struct_pack(t := a.t, i := a.event_id)) AS z FROM p LEFT JOIN a ON a.user_id = p.user_id AND (a.t > p.t OR a.t = p.t AND a.event_id > p.event_id) GROUP BY p.event_id, p.t)
SELECT event_id, coalesce(z.y AND z.t - t <= {10 * HOUR}, false) AS confirmed FROM r""",
    "session_turns": f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER {_ORDERED} AS k FROM e), s AS (SELECT *, count(*) FILTER (event_type = 'signup' OR k = 1) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT event_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY t, event_id) - 1 AS turn FROM s",
    "frame_scoping": "WITH p AS (SELECT p_partkey, p_partkey % 3 AS own, CASE WHEN p_partkey % 5 > 0 THEN p_size % 3 END AS target FROM part) SELECT p_partkey, coalesce(own = target, false) AS execute, CASE WHEN target IS NULL THEN 'no target frame' WHEN own <> target THEN 'meant for frame ' || target WHEN own = 0 THEN 'top frame' ELSE 'frame ' || own END AS reason FROM p",
    "panel_state": f"""WITH {EVENTS} SELECT user_id AS run, count(*) FILTER (event_type = 'view') AS n_stages, coalesce(arg_max(floor(value)::BIGINT % 7, event_id) FILTER (event_type = 'click'), 0) AS redactions, coalesce(arg_max(floor(value)::BIGINT % 3, event_id) FILTER (event_type = 'click'), 0) AS opaque,
 CAST(coalesce(sum(floor(value)::BIGINT) FILTER (event_type = 'click'), 0) AS BIGINT) AS bytes_out, count(*) FILTER (event_type = 'error') AS aborts, count(*) FILTER (event_type IN ('purchase', 'error')) = 0 AS busy FROM e GROUP BY user_id""",
    "step_states": f"WITH {EVENTS}, m AS (SELECT user_id AS run, event_id, floor(value)::BIGINT AS c FROM e WHERE event_type = 'signup') SELECT run, c % 4 AS action_index, arg_max(CASE WHEN c % 2 = 0 THEN 'done' ELSE 'failed' END, event_id) AS status, arg_max(CASE WHEN c % 2 > 0 THEN 'refused' WHEN c % 5 = 0 THEN 'ran, not verified' ELSE '' END, event_id) AS note FROM m GROUP BY run, c % 4",
    "transcript_bound": """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS x FROM (SELECT DISTINCT user_id FROM o) UNION ALL SELECT o.user_id, o.k, CASE WHEN len(x) = 60 THEN list_append(x, o.event_id)[-40:] ELSE list_append(x, o.event_id) END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, unnest(arg_max(x, k)) AS event_id FROM s GROUP BY user_id""",
    "overdue_runs": f"""WITH {EVENTS}, b AS (SELECT user_id, min(t) FILTER (event_type = 'click') AS started, min(t) FILTER (event_type IN ('purchase', 'error')) AS ended FROM e GROUP BY user_id)
SELECT b.user_id AS run, started, coalesce(arg_max(e.event_id::VARCHAR, struct_pack(t := e.t, i := e.event_id)), 'starting') AS last_stage FROM b LEFT JOIN e ON e.user_id = b.user_id AND e.event_type = 'view' AND e.t <= started + {20 * HOUR} WHERE started IS NOT NULL AND coalesce(ended, 4000000000000000) > started + {20 * HOUR} GROUP BY b.user_id, started""",
    "request_status": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 409 WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 AND p_size % 4 = 0 THEN 400 WHEN p_size % 4 > 0 AND p_partkey % 2 > 0 AND p_partkey % 5 = 0 THEN 409 ELSE 200 END AS status FROM part",
    "bytes_ledger": "SELECT user_id, CAST(coalesce(sum(floor(value)::BIGINT) FILTER (event_type <> 'error'), 0) AS BIGINT) AS bytes_sent, count(*) FILTER (event_type <> 'error') AS n_sent, count(*) FILTER (event_type = 'error') AS n_aborted FROM events GROUP BY user_id",
    "request_log": "SELECT conv_id, turn, right('session-' || conv_id, 8) AS session, substr(sha256(text), 1, 12) AS prompt, substr(sha256(role), 1, 12) AS frame, CAST(length(coalesce(text, '')) AS INTEGER) AS bytes_out, CAST(length(coalesce(role, '')) AS INTEGER) AS bytes_in FROM conversations",
    "plan_outcomes": """WITH RECURSIVE c AS (SELECT event_id // 7 AS plan, event_id, CAST(floor(value * 100) AS BIGINT) AS c, event_type FROM events),
s AS (SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY plan) AS n, CASE WHEN c % 29 = 0 THEN 'none' WHEN event_type = 'signup' THEN 'ask_user' WHEN event_type = 'error' THEN 'wait_for' ELSE 'click' END AS a, c % 5 > 0 AS ap, c % 11 > 0 AS ok, c % 7 = 0 AS nc, c % 3 > 0 AS cf, c % 2 = 0 AS ro FROM c),
r AS (SELECT DISTINCT plan, -1::BIGINT AS i, 0 AS executed, 0 AS halted, 0 AS failed, NULL::BIGINT AS stopped_at, true AS good FROM s
  UNION ALL SELECT s.plan, s.i, executed + CASE WHEN a IN ('none', 'wait_for') OR (a = 'ask_user' AND NOT ap) OR (nc AND NOT cf) THEN 0 WHEN CASE WHEN nc THEN ro ELSE ok END THEN 1 ELSE 0 END,
    halted + CASE WHEN a IN ('none', 'wait_for') THEN 0 ELSE CASE WHEN a = 'ask_user' THEN 1 ELSE 0 END + CASE WHEN nc AND NOT (a = 'ask_user' AND NOT ap) THEN 1 ELSE 0 END END,
    failed + CASE WHEN a IN ('none', 'wait_for') OR (a = 'ask_user' AND NOT ap) OR (nc AND NOT cf) THEN 0 WHEN CASE WHEN nc THEN ro ELSE ok END THEN 0 ELSE 1 END,
    CASE WHEN a = 'wait_for' THEN NULL WHEN a = 'none' OR (a = 'ask_user' AND NOT ap) OR (nc AND NOT cf) OR NOT CASE WHEN nc THEN ro ELSE ok END THEN s.i END, a IN ('none', 'wait_for') OR NOT ((a = 'ask_user' AND NOT ap) OR (nc AND NOT cf) OR NOT CASE WHEN nc THEN ro ELSE ok END)
  FROM r JOIN s ON s.plan = r.plan AND s.i = r.i + 1 WHERE r.stopped_at IS NULL AND s.i < 5)
SELECT r.plan AS plan, bool_and(good) AS ok, CAST(max(executed) AS BIGINT) AS executed, CAST(max(halted) AS BIGINT) AS halted, CAST(max(failed) AS BIGINT) AS failed, CAST(coalesce(max(stopped_at), -1) AS BIGINT) AS stopped_at, any_value(n) > 5 AS capped FROM r JOIN (SELECT DISTINCT plan, n FROM s) USING (plan) GROUP BY r.plan""",
    "tile_checks": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'x' END, CASE WHEN p_partkey % 5 = 0 THEN 'w' END, CASE WHEN p_partkey % 7 < 2 THEN 'h' END, CASE WHEN p_partkey % 13 = 0 THEN 'b64' END) AS errors FROM part",
    "step_checks": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 4 > 1 THEN 'action' END, CASE WHEN p_partkey % 9 = 0 THEN 'mark' END, CASE WHEN length(p_name) > 500 THEN 'selector' END, CASE WHEN 8 * length(p_name) > 100 THEN 'role' END, CASE WHEN length(p_type) > 200 THEN 'name' END, CASE WHEN 30 * length(p_type) > 500 THEN 'reason' END, CASE WHEN p_partkey % 3 = 2 THEN 'direction' END, CASE WHEN p_size > 40 THEN 'confidence' END) AS errors FROM part",
    "capture_modes": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 > 1 THEN 'stream' WHEN p_partkey % 3 > 0 THEN 'snapshot' ELSE 'pixel-only' END AS mode, p_partkey % 2 = 0 AND p_partkey % 5 > 1 AND p_partkey % 7 > 2 AND p_size > 20 AS crop FROM part",
    "escalations": f"""WITH pl(plan_id, confidence, exhausted, parse_error) AS ({_values(fixtures.PLANS)}), found AS ({sql.ORACLE['plan_check']}), l AS (SELECT plan_id, list('step ' || step_idx || ': ' || problem ORDER BY step_idx, problem) AS p FROM found GROUP BY plan_id),
r AS (SELECT pl.*, list_concat(list_filter([CASE WHEN confidence < 0.55 THEN 'low confidence' END, CASE WHEN exhausted THEN 'attempts used up' END], lambda x: x IS NOT NULL), coalesce(p, [])) AS rs FROM pl LEFT JOIN l USING (plan_id))
SELECT CAST(plan_id AS BIGINT) AS plan_id, CASE WHEN parse_error IS NULL THEN len(rs) > 0 ELSE contains(parse_error, 'destructive verb') END AS ask, CAST(CASE WHEN contains(parse_error, 'destructive verb') THEN 0.0 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN parse_error IS NULL AND len(rs) > 0 THEN array_to_string(rs, '; ') WHEN contains(parse_error, 'destructive verb') THEN parse_error END AS reason FROM r""",
}


@query
def conversation_findings(spark, d):
    """The first findings of each conversation, the fixture's lines as one of their own."""
    lines = spark.createDataFrame(fixtures.INJECTIONS, "turn bigint, text string").select(F.lit(-1).cast("bigint").alias("conv_id"), "turn", "text")
    return policy.page_findings(lines.unionByName(_t(spark, d, "conversations").select("conv_id", "turn", "text")), "conv_id", "turn").select("conv_id", F.col("n").cast("bigint").alias("n"), "kind", F.col("match").alias("matched"))


@query
def provider_streams(spark, d):
    rows = spark.createDataFrame(fixtures.CHUNKS, "id bigint, raw string").withColumn("r", wire.provider_chunks(F.col("raw")))
    return rows.select("id", "r.content", "r.filtered")


ORACLE |= {
    "conversation_findings": f"WITH c AS (SELECT -1 AS conv_id, turn, text FROM ({_values(fixtures.INJECTIONS)}) v(turn, text) UNION ALL SELECT conv_id, turn, text FROM conversations), o AS (SELECT *, row_number() OVER () AS id FROM c), lines AS (SELECT id, text FROM o), f AS ({sql.INJECTED}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM f), j AS (SELECT conv_id, kind, matched, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r) AS q FROM k JOIN o USING (id) WHERE r <= 5) SELECT CAST(conv_id AS BIGINT) AS conv_id, q AS n, kind, matched FROM j WHERE q <= 5",
    "provider_streams": f"""WITH v(id, raw) AS ({_values(fixtures.CHUNKS)}), l AS (SELECT id, list_filter(list_transform(list_filter(string_split(replace(raw, chr(13), ''), chr(10)), lambda x: starts_with(trim(x), 'data:')), lambda x: trim(substr(trim(x), 6))), lambda x: json_valid(x)) AS l FROM v)
SELECT CAST(id AS BIGINT) AS id, coalesce(array_to_string(list_filter(list_transform(l, lambda x: json_extract_string(x, '$.choices[0].delta.content')), lambda c: c IS NOT NULL), ''), '') AS content, len(list_filter(l, lambda x: coalesce(json_extract_string(x, '$.choices[0].finish_reason') = 'content_filter', false))) > 0 AS filtered FROM l""",
}


# -- reports


def _scored_nodes(spark) -> DataFrame:
    truth = spark.createDataFrame(fixtures.TRUTH, "page bigint, node_id string, cls string, channel string")
    return evaluate.score_nodes(truth, spark.createDataFrame(fixtures.NODE_HITS, "page bigint, node_id string, cls string, text string"))


@query
def node_scores(spark, d):
    return _scored_nodes(spark)


@query
def channel_scores(spark, d):
    return evaluate.by_channel(_scored_nodes(spark))


@query
def missed_classes(spark, d):
    return evaluate.missed_by_class(_scored_nodes(spark))


@query
def macro_scores(spark, d):
    return evaluate.macro(_scored_nodes(spark))


def _part_values(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truths by brand, what a base detector finds of them, and what a model finds."""
    p = _t(spark, d, "part").select(F.col("p_brand").alias("cls"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"), "p_size")
    base = p.where("p_size > 25").select("cls", "ord", F.split("value", " ")[0].alias("value"))
    model = p.where("p_size <= 30").select("cls", "ord", F.concat(F.lit("the "), F.upper("value"), F.lit("!")).alias("value"), (F.col("p_size") / 30).alias("score"))
    return p.select("cls", "ord", "value"), base, model


@query
def any_match_delta(spark, d):
    truth, base, model = _part_values(spark, d)
    return evaluate.any_match(truth, base, base.unionByName(model.where("score >= 0.6").select(*base.columns)), "cls")


@query
def cascade_scores(spark, d):
    truth, base, model = _part_values(spark, d)
    return evaluate.cascade(truth, base, model)


@query
def threshold_policy(spark, d):
    hits = _t(spark, d, "part").select(F.col("p_brand").alias("cls"), (F.col("p_size") / 50).alias("score"), (F.col("p_partkey") % 3 > 0).alias("positive"))
    grid = [0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.01]
    out = evaluate.coordinate_sweep(evaluate.curve(hits, grid, False, "cls"))
    return spark.createDataFrame([(c, t, round(f, 6)) for c, t, f in out], "cls string, threshold double, f1 double")


@query
def batching_determinism(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_size")
    return evaluate.determinism(p.where("p_size < 40"), p.where("p_size > 10"), "p_brand", "p_size")


@query
def model_comparison(spark, d):
    return reports.compare_models(spark.createDataFrame(fixtures.MODEL_TURNS, "model string, parsed boolean, used_mark boolean, invented int, truncated boolean, ms double, usd double"))


@query
def task_histogram(spark, d):
    return reports.task_histogram(spark.createDataFrame(fixtures.TASKS, "expect_action string, tier string, checks array<string>"))


@query
def low_confidence_hits(spark, d):
    return reports.low_confidence(rules.explode(rules.scan(_t(spark, d, "documents").select("doc_id", "text")), "doc_id"), "cls")


@query
def model_answer_rows(spark, d):
    rows = spark.createDataFrame(fixtures.MODEL_ANSWERS, "id bigint, raw string").select("id", F.posexplode(wire.model_rows(F.col("raw"))).alias("row", "tokens"))
    return rows.select("id", F.col("row").cast("bigint").alias("row"), F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join(F.transform("tokens", lambda t: t["entity"]), ",").alias("entities"))


@query
def admitted_hits(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.element_at(F.array(F.lit("PERSON"), F.lit("EMAIL"), F.lit("AGE")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("cls"), (F.col("p_size") / 50).alias("score"))
    return p.select("p_partkey", evaluate.admit(F.col("cls"), F.col("score")).alias("admitted"))


@query
def recovered_hits(spark, d):
    regions = _t(spark, d, "documents").select("doc_id", "text", F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("w"), F.lit(4.0).alias("h")).alias("box"))
    return rules.explode(screen.reclassify(regions), "doc_id", "box").select("doc_id", "cls", F.col("start").alias("span_start"), "box.w")


@query
def badge_rects(spark, d):
    box = F.struct(((F.col("p_partkey") * 37) % 400).cast("double").alias("x"), ((F.col("p_partkey") * 53) % 300).cast("double").alias("y"))
    b = frames.badge_rect(box, F.lit(0.5))
    return _t(spark, d, "part").select("p_partkey", F.round(b["x"], 6).alias("x"), F.round(b["y"], 6).alias("y"), b["w"].alias("w"), b["h"].alias("h"))


@query
def crop_rects(spark, d):
    tiles = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 64).cast("int").alias("tx"), (F.col("p_partkey") * 7 % 64).cast("int").alias("ty"), (F.col("p_size") % 9).alias("tw"), (F.col("p_size") % 5).alias("th"))
    return frames.crop_rects(tiles, 64, 64, 1280, 77).select("p_partkey", "x", "y", "w", "h")


@query
def recomposited_frames(spark, d):
    v = _t(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("stream"), F.col("vec_id").alias("seq"), F.posexplode(F.transform("embedding", lambda x: F.round(x.cast("double") * 128, 3))).alias("i", "value"))
    base = v.where("seq < 8").select("stream", "i", "value")
    return frames.recomposite(base, v.where("seq >= 8 AND (i + seq) % 5 = 0"), "stream")


@query
def text_regions(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.lit(320).alias("width"), F.lit(192).alias("height"), F.lit(80).alias("columns"))
    # Strokes in three bands of the page, a smooth ground elsewhere.
    k = F.col("vec_id")
    ink = lambda i: F.when((F.floor(i / 80 / 12) % 3 == k % 3) & (i % 80 > k % 30) & (i % 80 < 40 + k % 30), (i * 37 + k * 11) % 97 * 2.0).otherwise(i % 80 * 0.05)
    return frames.text_regions(v.withColumn("luma", F.transform(F.sequence(F.lit(0), F.lit(80 * 48 - 1)), ink)), "vec_id").withColumn("score", F.round("score", 6))


PARTS = "tr AS (SELECT p_brand AS cls, p_name AS value, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS v, p_partkey AS ord, p_size FROM part), b AS (SELECT cls, regexp_replace(lower(string_split(value, ' ')[1]), '[^\\p{L}\\p{N}]', '', 'g') AS v FROM tr WHERE p_size > 25), m AS (SELECT cls, 'the' || v AS v, p_size / 30 AS score FROM tr WHERE p_size <= 30)"
TRUTHS = f"gt(page, node_id, cls, channel) AS ({_values(fixtures.TRUTH)}), h(page, node_id, cls, txt) AS ({_values(fixtures.NODE_HITS)}), ns AS (SELECT cls, channel, CAST(count(*) FILTER (hit) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS fn FROM (SELECT gt.*, EXISTS (SELECT 1 FROM h WHERE h.page = gt.page AND h.node_id = gt.node_id AND h.cls = gt.cls) AS hit FROM gt) GROUP BY cls, channel UNION ALL SELECT cls, NULL, 0, count(*), 0 FROM h WHERE NOT (cls = 'PASSWORD' AND txt = '[PASSWORD]') AND NOT EXISTS (SELECT 1 FROM gt WHERE h.page = gt.page AND h.node_id = gt.node_id AND h.cls = gt.cls) GROUP BY cls)"
_MEET = "(contains({0}, {1}) OR contains({1}, {0}))"
ORACLE |= {
    "node_scores": f"WITH {TRUTHS} SELECT * FROM ns",
    "channel_scores": f"WITH {TRUTHS} SELECT channel, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn FROM ns WHERE channel IS NOT NULL GROUP BY channel",
    "missed_classes": f"WITH {TRUTHS} SELECT cls, CAST(sum(fn) AS BIGINT) AS fn FROM ns GROUP BY cls HAVING sum(fn) > 0",
    "macro_scores": f"WITH {TRUTHS}, c AS (SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ns GROUP BY cls) SELECT count(*) AS n_classes, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM c",
    "any_match_delta": f"""WITH {PARTS}, f AS (SELECT cls, v FROM b UNION ALL SELECT cls, v FROM m WHERE score >= 0.6)
SELECT cls, count(*) AS gt, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.cls = tr.cls AND {_MEET.format('b.v', 'tr.v')})) AS base, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.cls = tr.cls AND {_MEET.format('f.v', 'tr.v')})) AS fused FROM tr GROUP BY cls""",
    "batching_determinism": "WITH a AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size < 40 GROUP BY ALL), b AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size > 10 GROUP BY ALL), j AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (p_brand, p_size)) SELECT CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b, bool_and(na = nb) AS identical, count(*) FILTER (na > 0 AND nb > 0) AS shared, count(*) AS distinct_spans FROM j",
    "model_comparison": f"WITH v(model, parsed, used_mark, invented, truncated, ms, usd) AS ({_values(fixtures.MODEL_TURNS)}) SELECT model, count(*) AS turns, count(*) FILTER (parsed) AS parsed, count(*) FILTER (used_mark) AS used_mark, CAST(sum(invented) AS BIGINT) AS invented, count(*) FILTER (truncated) AS truncated, count(*) FILTER (NOT parsed AND NOT truncated) AS invalid, CAST(round(avg(ms), 4) AS DOUBLE) AS mean_ms, CASE WHEN count(*) = count(usd) THEN CAST(round(sum(usd), 4) AS DOUBLE) END AS usd FROM v GROUP BY model",
    "task_histogram": "WITH v(expect_action, tier, checks) AS (VALUES " + ", ".join(f"('{a}', '{t}', {c}::VARCHAR[])" for a, t, c in fixtures.TASKS) + ") SELECT expect_action, count(*) AS n, count(*) FILTER (tier = 'T0') AS tier0, count(*) FILTER (list_contains(checks, 'destructive_confirmed')) AS destructive FROM v GROUP BY expect_action",
    "low_confidence_hits": f"WITH {sql.HITS} SELECT cls, count(*) FILTER (score < 0.5) AS low FROM kept GROUP BY cls",
    "model_answer_rows": f"WITH v(id, raw) AS ({_values(fixtures.MODEL_ANSWERS)}), l AS (SELECT id, CASE WHEN json_type(raw, '$[0]') = 'ARRAY' THEN CAST(raw AS JSON[]) WHEN json_array_length(raw) = 0 THEN [] ELSE [CAST(raw AS JSON)] END AS rs FROM v), u AS (SELECT id, unnest(range(len(rs))) AS row, unnest(rs) AS r FROM l) SELECT CAST(id AS BIGINT) AS id, row, CAST(json_array_length(r) AS BIGINT) AS n_tokens, array_to_string(list_transform(CAST(r AS JSON[]), lambda t: json_extract_string(t, '$.entity')), ',') AS entities FROM u",
    "admitted_hits": "SELECT p_partkey, p_partkey % 3 = 0 AND p_size / 50 >= 0.99 AS admitted FROM part",
    "recovered_hits": f"WITH {sql.HITS} SELECT doc_id, cls, s AS span_start, CAST(3.0 AS DOUBLE) AS w FROM kept WHERE cls <> 'PASSWORD' AND score >= 0.5",
    "badge_rects": "WITH b AS (SELECT p_partkey, ((p_partkey * 37) % 400)::DOUBLE AS x, ((p_partkey * 53) % 300)::DOUBLE AS y FROM part) SELECT p_partkey, round(greatest(x - 11 * 0.35::DOUBLE, 0), 6) AS x, round(greatest(y - 11 * 0.35::DOUBLE, 0), 6) AS y, 11::DOUBLE AS w, 11::DOUBLE AS h FROM b",
    "crop_rects": """WITH t AS (SELECT p_partkey, p_partkey % 64 AS tx, p_partkey * 7 % 64 AS ty, p_size % 9 AS tw, p_size % 5 AS th FROM part), a AS (SELECT *, CAST(floor(tx / 64 * 1280 + 0.5) AS INTEGER) AS x, CAST(floor(ty / 64 * 77 + 0.5) AS INTEGER) AS y FROM t),
b AS (SELECT p_partkey, x, y, CAST(greatest(1, least(1280 - x, floor(tw / 64 * 1280 + 0.5))) AS INTEGER) AS w, CAST(greatest(1, least(77 - y, floor(th / 64 * 77 + 0.5))) AS INTEGER) AS h FROM a) SELECT * FROM b WHERE w >= 2 AND h >= 2""",
    "recomposited_frames": "WITH v AS (SELECT vec_id % 8 AS stream, vec_id AS seq, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda x: round(x::DOUBLE * 128, 3))) AS value FROM embeddings), b AS (SELECT stream, i FROM v WHERE seq < 8), k AS (SELECT * FROM v WHERE seq < 8 OR (i + seq) % 5 = 0) SELECT stream, CAST(i AS INTEGER) AS i, arg_max(value, seq) AS value FROM k SEMI JOIN b USING (stream, i) GROUP BY stream, i",
}
