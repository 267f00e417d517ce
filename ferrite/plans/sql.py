"""DuckDB SQL that must give the same rows as the registered queries."""

from __future__ import annotations

from ..operators import elements, evaluate, policy, redaction, rules
from ..functions import small
from . import fixtures


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)


def _luhn(x: str) -> str:
    d = f"CAST(substr({x}, length({x}) - CAST(i AS INTEGER), 1) AS INTEGER)"
    return f"(list_sum(list_transform(range(length({x})), lambda i: CASE WHEN i % 2 = 0 THEN {d} ELSE ({d} * 2) // 10 + ({d} * 2) % 10 END)) % 10 = 0)"


def _verhoeff(x: str) -> str:
    from ..functions.checksums import _dihedral, _powers

    product = [_dihedral(a, b) for a in range(10) for b in range(10)]
    powers = [v for row in _powers() for v in row]
    return f"(list_reduce(list_prepend(0, range(12)), lambda c, i: {product}[c * 10 + {powers}[(i % 8) * 10 + CAST(substr({x}, 12 - CAST(i AS INTEGER), 1) AS INTEGER) + 1] + 1]) = 0)"


def _iban(x: str) -> str:
    moved = f"(substr({x}, 5) || substr({x}, 1, 4))"
    value = f"(CASE WHEN unicode(substr({moved}, CAST(i AS INTEGER), 1)) < 58 THEN unicode(substr({moved}, CAST(i AS INTEGER), 1)) - 48 ELSE unicode(substr({moved}, CAST(i AS INTEGER), 1)) - 55 END)"
    return f"(list_reduce(list_prepend(0, range(1, length({moved}) + 1)), lambda r, i: (r * (CASE WHEN {value} > 9 THEN 100 ELSE 10 END) + {value}) % 97) = 1)"


def _fnv(x: str) -> str:
    return f"lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0')"


def _rule(order: int, r: rules.Rule) -> str:
    p = _lit(rules.re2(r))
    value = f"regexp_extract(w, {p}, {r.group})"
    score = repr(r.score)
    if r.check:
        digits = "regexp_replace(w, '[ -]', '', 'g')"
        test = {"luhn": _luhn("dg"), "verhoeff": _verhoeff("dg"), "iban": _iban("dg")}[r.check]
        digits = "right(regexp_replace(w, '[^0-9]', '', 'g'), 12)" if r.check == "verhoeff" else digits
        score = f"CASE WHEN {test} THEN {r.checked_score} ELSE {min(r.score, rules.FAILED_SCORE)} END"
    else:
        digits = "w"
    return f"""SELECT doc_id, {order} AS rule_ord, '{r.cls}' AS cls, CAST({score} AS DOUBLE) AS score, CAST(pos0 + CASE WHEN {r.group} > 0 THEN strpos(w, v) - 1 ELSE 0 END AS INTEGER) AS s, v FROM (
      SELECT doc_id, w, {digits} AS dg, {value} AS v, pos0 FROM (
        SELECT doc_id, m[i] AS w, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS pos0 FROM (
          SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM documents WHERE regexp_matches(text, {p})))))"""


SPANS = "spans AS (" + " UNION ALL ".join(_rule(k, r) for k, r in enumerate(rules.RULES)) + ")"


def _greedy(source: str) -> str:
    """``kept``: the greedy choice from (doc_id, rule_ord, cls, score, s, e)."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s, rule_ord) AS k FROM ({source})),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::INTEGER[][] AS taken, false AS took FROM o
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN len(list_filter(taken, lambda x: o.s < x[2] AND x[1] < o.e)) = 0 THEN list_append(taken, [o.s::INTEGER, o.e::INTEGER]) ELSE taken END, len(list_filter(taken, lambda x: o.s < x[2] AND x[1] < o.e)) = 0
  FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.k = walk.k + 1),
kept AS (SELECT o.* FROM o JOIN walk USING (doc_id, k) WHERE took)"""


HITS = f"RECURSIVE {SPANS}, {_greedy('SELECT *, s + length(v) AS e FROM spans')}"
SESSION = "session-0001"


def _token(value: str, cls: str) -> str:
    tag = f"upper(substr(ltrim({_fnv(_lit(SESSION))}, '0'), 1, 2))"
    plain = f"trim(regexp_replace(lower({value}), '\\s+', ' ', 'g'))"
    key = f"('{SESSION}:' || {plain})"
    return f"('[' || {cls} || '_' || {tag} || '_' || {_fnv(key)} || ']')"


TOKENS = f"{HITS}, tok AS (SELECT *, {_token('v', 'cls')} AS token FROM kept)"
REDACTED = f"""{TOKENS}, nb AS (
  SELECT k.*, d.text, CASE WHEN cls = lag(cls) OVER w AND s - lag(e) OVER w <= 2 AND (s - lag(e) OVER w <= 0 OR regexp_matches(substr(d.text, CAST(lag(e) OVER w + 1 AS INTEGER), CAST(s - lag(e) OVER w AS INTEGER)), '^([.,''-]|\\s+)$')) THEN 0 ELSE 1 END AS fresh
  FROM tok k JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.s)
), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM nb),
br AS (SELECT doc_id, any_value(text) AS text, any_value(cls) AS cls, min(s) AS s, arg_max(e, s) AS e FROM isl GROUP BY doc_id, island),
vt AS (SELECT *, substr(text, s + 1, CAST(e - s AS INTEGER)) AS bv FROM br), bt AS (SELECT *, {_token('bv', 'cls')} AS btoken FROM vt),
pieces AS (
  SELECT doc_id, s, substr(text, CAST(coalesce(lag(e) OVER w, 0) + 1 AS INTEGER), CAST(s - coalesce(lag(e) OVER w, 0) AS INTEGER)) || btoken AS piece, substr(text, CAST(e + 1 AS INTEGER)) AS tail
  FROM bt WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), red AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) || arg_max(tail, s) AS redacted FROM pieces GROUP BY doc_id)"""
BUCKET = "CASE WHEN n <= 0 THEN 'none' WHEN n = 1 THEN '1' ELSE CAST(CAST(pow(2, floor(log2(n))) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pow(2, floor(log2(n))) AS BIGINT) * 2 - 1 AS VARCHAR) END"
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"
STAGES = f"{EVENTS}, st AS (SELECT *, (lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t) // 1000 AS ms FROM e)"
SCORED = """sc AS (SELECT d.doc_id, d.lang, quality = 0 AS positive, round(least(length(regexp_replace(text, '[A-Za-z0-9À-ÿ \n\t]', '', 'g')) / greatest(length(text), 1) * 5, 1.0), 6) AS score FROM documents d JOIN labels USING (doc_id))"""


def _rates(rows: str, keep: str) -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
    return f"SELECT {keep}, tp, fp, fn, round({p}, 6) AS precision, round({r}, 6) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS f1 FROM ({rows})"


def _curve(by: str, reference: bool = False) -> str:
    fp = "count(*) FILTER (score >= threshold)" if reference else "count(*) FILTER (score >= threshold AND NOT positive)"
    group = f"{by}, threshold" if by else "threshold"
    rows = f"SELECT {group}, count(*) FILTER (score >= threshold AND positive) AS tp, {fp} AS fp, count(*) FILTER (score < threshold AND positive) AS fn, count(*) FILTER (score >= threshold) AS n_pred FROM sc, (SELECT i / 20 AS threshold FROM range(21) x(i)) GROUP BY {group}"
    return _rates(rows, f"{group}, n_pred")


BOXES = "b AS (SELECT p_partkey, " + ", ".join(f"(({'p_partkey' } * {m} + {k * 13}) % {n})::DOUBLE AS {a}{k}" for k in (0, 1) for a, m, n in (("x", 37, 400), ("y", 53, 300))) + ", " + ", ".join(f"((p_partkey * {m}) % {n} + 5 + {k})::DOUBLE AS {a}{k}" for k in (0, 1) for a, m, n in (("w", 11, 60), ("h", 17, 40))) + " FROM part)"
_W, _H = "greatest(least(x0 + w0, x1 + w1) - greatest(x0, x1), 0.0)", "greatest(least(y0 + h0, y1 + h1) - greatest(y0, y1), 0.0)"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), ' +'), lambda t: length(t) > 1))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


FRAMES = "f AS (SELECT vec_id % 8 AS stream, vec_id AS seq, list_transform(embedding, lambda x: round(x::DOUBLE * 128, 3)) AS cells, label::VARCHAR AS dom_hash FROM embeddings)"
BITS = "array_to_string(list_transform(range(0, len(cells)), lambda i: CASE WHEN cells[i + 1] > cells[CASE WHEN i % 8 = 7 THEN i - 6 ELSE i + 2 END] THEN '1' ELSE '0' END), '')"
DIRTY = f"""{FRAMES}, p AS (SELECT seq, cells, lag(cells) OVER (PARTITION BY stream ORDER BY seq) AS before FROM f),
c AS (SELECT seq, unnest(range(64)) AS i, unnest(list_transform(list_zip(cells, before), lambda z: CASE WHEN abs(z[1] - z[2]) > 6.0 THEN 1.0 ELSE 0.0 END)) AS m FROM p WHERE before IS NOT NULL),
tiles AS (SELECT seq, CAST((i % 8) // 2 AS INTEGER) AS tx, CAST((i // 8) // 2 AS INTEGER) AS ty, round(avg(m), 6) AS change FROM c GROUP BY ALL HAVING round(avg(m), 6) > 0.02)"""
INJECTED = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {n} AS n, substr(trim(regexp_extract(text, {_lit(p)})), 1, 120) AS matched FROM lines WHERE regexp_matches(text, {_lit(p)})" for n, (k, p) in enumerate(policy.INJECTION))

ORACLE: dict[str, str] = {
    "l1_class_counts": f"WITH {HITS} SELECT cls, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM kept GROUP BY cls",
    "l1_spans": f"WITH {SPANS} SELECT doc_id, rule_ord, cls, score, s AS span_start, CAST(s + length(v) AS INTEGER) AS span_end, v AS value FROM spans",
    "l1_spans_dedup": f"WITH {HITS} SELECT doc_id, rule_ord, cls, score, s AS span_start, CAST(e AS INTEGER) AS span_end FROM kept",
    "dedupe_overlaps": f"WITH RECURSIVE x(doc_id, rule_ord, cls, score, s, e) AS ({_values(fixtures.OVERLAPS)}), {_greedy('SELECT * FROM x')} SELECT CAST(doc_id AS BIGINT) AS doc_id, cls, s AS span_start, e AS span_end FROM kept",
    "luhn_valid_cards": f"WITH {HITS}, c AS (SELECT doc_id, regexp_replace(v, '[ -]', '', 'g') AS digits FROM kept WHERE cls = 'CREDIT_CARD') SELECT doc_id, digits, {_luhn('digits')} AS valid FROM c",
    "verhoeff_keys": f"WITH c AS (SELECT c_custkey, lpad((c_custkey * 99991)::VARCHAR, 12, '0') AS x FROM customer) SELECT c_custkey, {_verhoeff('x')} AS valid FROM c",
    "iban_keys": f"WITH c AS (SELECT c_custkey, 'GB' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || 'WEST' || lpad(c_custkey::VARCHAR, 14, '0') AS x FROM customer) SELECT c_custkey, {_iban('x')} AS valid FROM c",
    "fnv1a_names": f"SELECT p_partkey, {_fnv('p_name')} AS hash FROM part",
    "pseudonym_tokens": f"WITH {TOKENS} SELECT doc_id, s AS span_start, cls, token FROM tok",
    "pseudonym_coreference": f"WITH {TOKENS} SELECT token, count(*) AS n_uses, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY token",
    "redacted_text": f"WITH {REDACTED} SELECT doc_id, redacted FROM red",
    "leakage_audit": f"WITH {REDACTED} SELECT cls, count(*) AS n_checked, count(*) FILTER (contains(redacted, v)) AS n_leaked FROM tok JOIN red USING (doc_id) WHERE length(v) >= 4 GROUP BY cls",
    "bridge_spans": r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-z]{1,15}\b') AS m, string_split_regex(text, '\b[A-Z][a-z]{1,15}\b') AS g FROM documents WHERE regexp_matches(text, '\b[A-Z][a-z]{1,15}\b')),
i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, g[i] AS gap, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s, length(m[i]) AS n FROM i),
j AS (SELECT *, CASE WHEN s - lag(s + n) OVER w <= 2 AND (s - lag(s + n) OVER w <= 0 OR regexp_matches(gap, '^([.,''-]|\s+)$')) THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM j)
SELECT doc_id, min(s) AS span_start, CAST(max(s + n) AS INTEGER) AS span_end, count(*) AS n_merged FROM k GROUP BY doc_id, island HAVING count(*) > 1""",
    "l2_input_reduction": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents), r AS (SELECT text FROM l WHERE length(text) > 2), u AS (SELECT DISTINCT substr(text, 1, 200) AS text FROM r)
SELECT (SELECT count(*) FROM r) AS n_raw, count(*) AS n_unique, count(*) FILTER (NOT (regexp_matches(text, {_lit('|'.join(evaluate.OWNED))}) AND NOT regexp_matches(text, {_lit(evaluate.NAMED)}))) AS n_kept FROM u""",
    "manifest_exact": f"WITH {HITS} SELECT cls, count(*) AS shown, count(*)::VARCHAR AS label FROM kept GROUP BY cls",
    "manifest_bucketed": f"WITH {HITS}, c AS (SELECT cls, count(*) AS n FROM kept GROUP BY cls) SELECT cls, n AS shown, {BUCKET} AS label FROM c",
    "manifest_top_tokens": f"WITH {TOKENS}, l AS (SELECT cls, list_sort(list(DISTINCT token)) AS t FROM tok GROUP BY cls) SELECT cls, array_to_string(t[1:6], ' ') || CASE WHEN len(t) > 6 THEN ' …' ELSE '' END AS tokens FROM l",
    "gate_verdict": f"""WITH {HITS}, g AS (SELECT doc_id, count(*) AS n_items, count(*) FILTER (score >= 0.5) AS covered, count(*) FILTER (score < 0.5) AS uncovered, count(*) FILTER (score >= 0.5 AND s % 7 = 0) AS empty_boxes FROM kept GROUP BY doc_id),
r AS (SELECT *, concat_ws('; ', CASE WHEN uncovered > 0 THEN uncovered || ' uncovered' END, CASE WHEN empty_boxes > 0 THEN empty_boxes || ' without area' END) AS reasons FROM g) SELECT *, reasons = '' AS ok FROM r""",
    "log_scrub": f"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, {_lit(redaction.KEYS)}, '[redacted]', 'g'), {_lit(redaction.JWTS)}, '[redacted]', 'g'), {_lit(redaction.NAMED)}, '\\1\\2[redacted]', 'g') AS x FROM documents),
b AS (SELECT doc_id, text, x, regexp_extract_all(x, {_lit(redaction.LONG)}) AS m, string_split_regex(x, {_lit(redaction.LONG)}) AS g FROM a),
c AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN length(m[i - 1]) > 64 THEN '[redacted:' || length(m[i - 1]) || ' chars]' ELSE '[redacted]' END || g[i]), '') AS scrubbed FROM b)
SELECT doc_id, scrubbed FROM c WHERE scrubbed <> text""",
    "injection_scan": f"WITH lines AS (SELECT * FROM ({_values(fixtures.INJECTIONS)}) v(id, text) UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations), f AS ({INJECTED}), k AS (SELECT *, row_number() OVER (PARTITION BY id, text_k ORDER BY n) AS r FROM (SELECT *, 0 AS text_k FROM f)) SELECT CAST(id AS BIGINT) AS id, kind, matched FROM k WHERE r <= 5",
    "destructive_scan": f"SELECT CAST(id AS BIGINT) AS id, regexp_matches(text, {_lit(policy.CLIENT_VERBS)}) AS client, regexp_matches(text, {_lit(policy.SERVER_VERBS)}) AS server FROM ({_values(fixtures.VERBS)}) v(id, text)",
    "action_safety": f"""WITH v(id, action, verb, rerolled, sensitive) AS ({_values(fixtures.SAFETY)}), a AS (SELECT id, lower(coalesce(action, '')) AS a, coalesce(verb, '') AS verb, rerolled, sensitive FROM v)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN a IN ('none', 'ask_user', 'wait_for') THEN 'none' WHEN a IN ('submit', 'send', 'pay', 'delete') THEN 'destructive_action' WHEN regexp_matches(verb, {_lit(policy.CLIENT_VERBS)}) THEN 'destructive_verb' WHEN sensitive AND a = 'fill' THEN 'fill_into_sensitive' WHEN rerolled AND sensitive THEN 'reroll_into_sensitive' ELSE 'none' END AS rule FROM a""",
    "plan_check": f"""WITH s(plan_id, step_idx, action, mark, value, reason) AS ({_values(fixtures.STEPS)}), n(plan_id, mark, label, sensitive) AS ({_values(fixtures.NODES)}),
r AS (SELECT s.*, n.label, n.sensitive, n.mark IS NOT NULL AS known, EXISTS (SELECT 1 FROM n x WHERE x.plan_id = s.plan_id) AS has_marks, max(step_idx) OVER (PARTITION BY s.plan_id) AS last, s.action NOT IN ('ask_user', 'none') AS acting FROM s LEFT JOIN n ON n.plan_id = s.plan_id AND n.mark = s.mark),
p AS (SELECT plan_id, step_idx, unnest([
 CASE WHEN action NOT IN ({', '.join(map(_lit, policy.ACTIONS))}) THEN 'unknown action' END, CASE WHEN action = 'none' AND step_idx <> last THEN 'none must be last' END, CASE WHEN action IN ('fill', 'select') AND mark IS NULL THEN 'needs a mark' END,
 CASE WHEN mark < 0 THEN 'negative mark' END, CASE WHEN acting AND regexp_matches(concat_ws(' ', action, value, reason), {_lit(policy.SERVER_VERBS)}) THEN 'destructive words' END, CASE WHEN mark IS NOT NULL AND has_marks AND NOT known THEN 'unknown mark' END,
 CASE WHEN acting AND regexp_matches(label, {_lit(policy.SERVER_VERBS)}) THEN 'destructive label' END, CASE WHEN action IN ('fill', 'select') AND sensitive THEN 'sensitive field' END, CASE WHEN action = 'fill' AND sensitive AND length(value) > 3 AND NOT regexp_matches(trim(value), {_lit(policy.PLACEHOLDER)}) THEN 'raw value' END]) AS problem FROM r)
SELECT CAST(plan_id AS BIGINT) AS plan_id, step_idx, problem FROM p WHERE problem IS NOT NULL""",
    "detector_prf": f"WITH {SCORED} " + _rates("SELECT lang AS cls, count(*) FILTER (score >= 0.3 AND positive) AS tp, count(*) FILTER (score >= 0.3 AND NOT positive) AS fp, count(*) FILTER (score < 0.3 AND positive) AS fn FROM sc GROUP BY lang", "cls"),
    "pr_curve": f"WITH {SCORED} {_curve('')}",
    "pr_curve_ref": f"WITH {SCORED} {_curve('', True)}",
    "best_threshold": f"WITH {SCORED}, c AS ({_curve('lang')}) SELECT lang, threshold, f1 FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold) = 1",
    "grouping_report": f"WITH {HITS} SELECT lang, cls, count(*) AS n_hits FROM kept JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, cls), (lang), (cls), ())",
    "box_iou": f"WITH {BOXES} SELECT p_partkey, round({_W} * {_H} / (w0 * h0 + w1 * h1 - {_W} * {_H}), 6) AS iou, x0 < x1 + w1 + 2 AND x1 < x0 + w0 + 2 AND y0 < y1 + h1 + 2 AND y1 < y0 + h0 + 2 AS overlaps FROM b",
    "fuse_layers": f"""WITH RECURSIVE v(doc_id, k, cls, source, score, s, e, x) AS ({_values(fixtures.LAYERS)}),
w(source, weight) AS (VALUES ('L0', 4), ('L1', 3), ('L2', 2), ('L3', 1)),
r AS (SELECT v.*, weight FROM v JOIN w USING (source)),
f AS (SELECT DISTINCT doc_id, 0 AS k, []::STRUCT(cls VARCHAR, source VARCHAR, weight INTEGER, score DOUBLE, txt VARCHAR, s INTEGER, e INTEGER, x DOUBLE)[] AS o FROM v
  UNION ALL SELECT doc_id, k, CASE WHEN slot IS NULL THEN list_append(o, h) ELSE list_transform(o, lambda z, i: CASE WHEN i = slot AND h.weight > z.weight THEN struct_pack(cls := z.cls, source := h.source, weight := h.weight, score := greatest(z.score, h.score), txt := h.txt, s := z.s, e := z.e, x := coalesce(h.x, z.x)) ELSE z END) END
  FROM (SELECT f.doc_id, r.k, f.o, struct_pack(cls := r.cls, source := r.source, weight := r.weight::INTEGER, score := r.score::DOUBLE, txt := r.k::VARCHAR, s := r.s::INTEGER, e := r.e::INTEGER, x := r.x::DOUBLE) AS h,
    list_position(list_transform(f.o, lambda z: z.cls = r.cls AND CASE WHEN z.x IS NOT NULL AND r.x IS NOT NULL THEN z.x < r.x + 12 AND r.x < z.x + 12 ELSE z.s = r.s END), true) AS slot
    FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)),
z AS (SELECT doc_id, unnest(arg_max(o, k)) AS q FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, q.cls AS cls, q.source AS source, q.score AS score, q.txt AS text, q.s AS span_start, q.e AS span_end, q.x AS x FROM z""",
    "merge_model_tokens": f"""WITH RECURSIVE v(doc_id, ord, entity, score, s, e) AS ({_values(fixtures.TOKENS)}),
t AS (SELECT doc_id, ord, score::DOUBLE AS score, s, e, CASE WHEN entity = 'O' THEN NULL WHEN regexp_matches(entity, '^[^-]*-.+$') THEN regexp_replace(entity, '^[^-]*-', '') ELSE string_split(entity, '-')[1] END AS label FROM v),
c AS (SELECT DISTINCT doc_id, -1 AS ord, NULL::VARCHAR AS label, NULL::DOUBLE AS score, NULL::INTEGER AS s, NULL::INTEGER AS e, 0 AS span FROM t
  UNION ALL SELECT doc_id, ord, label, CASE WHEN joins THEN least(was, score) ELSE score END, CASE WHEN label IS NULL THEN NULL WHEN joins THEN began ELSE s0 END, CASE WHEN label IS NULL THEN NULL WHEN joins THEN greatest(until, e0) ELSE e0 END, CASE WHEN joins THEN span ELSE span + 1 END
  FROM (SELECT t.doc_id, t.ord, t.label, t.score, c.score AS was, c.s AS began, c.e AS until, c.span, coalesce(t.s, c.e, 0) AS s0, coalesce(t.e, t.s, c.e, 0) AS e0, t.label IS NOT NULL AND c.label = t.label AND coalesce(t.s, c.e, 0) <= c.e AS joins
    FROM c JOIN t ON t.doc_id = c.doc_id AND t.ord = c.ord + 1))
SELECT CAST(doc_id AS BIGINT) AS doc_id, any_value(label) AS label, min(score) AS score, min(s) AS span_start, max(e) AS span_end FROM c WHERE label IN ({', '.join(map(_lit, elements.MODEL_LABELS))}) GROUP BY doc_id, span""",
    "label_similarity": f"WITH n AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nx FROM part), w AS (SELECT p_partkey, {_words('p_name')} AS a, {_words('nx')} AS b FROM n WHERE nx IS NOT NULL) SELECT p_partkey, round({_jaccard('a', 'b')}, 6) AS similarity FROM w",
    "best_label_match": f"WITH p AS (SELECT p_brand AS page, p_partkey AS node_id, {_words('p_name')} AS w FROM part), s AS (SELECT a.page, a.node_id, b.node_id AS best_node, round({_jaccard('a.w', 'b.w')}, 6) AS similarity FROM p a JOIN p b ON a.page = b.page AND a.node_id <> b.node_id WHERE len(list_intersect(a.w, b.w)) > 0) SELECT page, node_id, best_node, similarity FROM s QUALIFY row_number() OVER (PARTITION BY page, node_id ORDER BY similarity DESC, best_node) = 1",
    "reading_order_marks": "SELECT p_brand AS page, p_partkey AS node_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY ((p_partkey * 53) % 900) // 24, (p_partkey * 37) % 1200, p_partkey) AS INTEGER) AS mark FROM part WHERE p_size > 5",
    "frame_gate": f"""WITH {FRAMES}, g AS (SELECT *, {BITS} AS bits FROM f), l AS (SELECT *, lag(cells) OVER w AS pc, lag(bits) OVER w AS pb, lag(dom_hash) OVER w AS ph FROM g WINDOW w AS (PARTITION BY stream ORDER BY seq)),
m AS (SELECT *, round(list_sum(list_transform(list_zip(cells, pc), lambda z: abs(z[1] - z[2]))) / len(cells), 4) AS mad, CAST(coalesce(hamming(bits, pb), 0) AS INTEGER) AS hamming FROM l)
SELECT stream, seq, CASE WHEN pc IS NOT NULL THEN mad END AS mad, hamming, CASE WHEN pc IS NULL THEN 'first' WHEN (hamming > 2 OR mad > 1.2) AND dom_hash IS DISTINCT FROM ph THEN 'both' WHEN hamming > 2 OR mad > 1.2 THEN 'pixels' WHEN dom_hash IS DISTINCT FROM ph THEN 'structure' ELSE 'unchanged' END AS reason FROM m""",
    "frame_dhash": f"WITH {FRAMES}, g AS (SELECT seq, {BITS} AS bits FROM f) SELECT seq, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', CAST(1 + list_sum(list_transform(range(0, 4), lambda k: CAST(substr(bits, CAST(i * 4 + k + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 3 - k) AS INTEGER))) AS INTEGER), 1)), '') AS dhash FROM g",
    "dirty_tiles": f"WITH {DIRTY} SELECT * FROM tiles",
    "stage_durations": f"WITH {STAGES} SELECT event_type, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms FROM st WHERE ms IS NOT NULL GROUP BY event_type",
    "watchdog_stalls": f"WITH {STAGES}, b AS (SELECT *, CAST(CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 15 WHEN 'purchase' THEN 60 ELSE 45 END AS BIGINT) * 3600000 AS budget_ms FROM st) SELECT event_id, event_type, ms, budget_ms FROM b WHERE ms > budget_ms",
    "forward_stages": f"WITH {EVENTS}, r AS (SELECT *, max(length(event_type)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT event_id, user_id, event_type FROM r WHERE b IS NULL OR length(event_type) > b",
    "attempt_cap": "SELECT user_id, count(*) AS n_attempts, greatest(count(*) - 2, 0) AS n_exhausted FROM events GROUP BY user_id",
    "session_summary": f"WITH {EVENTS} SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase, min(t) AS first_us, max(t) AS last_us FROM e GROUP BY user_id",
    "session_recent": f"WITH {EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) AS k FROM e WHERE event_type IN ('click', 'view', 'purchase', 'signup', 'logout')) SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY t, event_id) AS recent FROM k WHERE k <= CASE WHEN event_type = 'view' THEN 5 ELSE 3 END GROUP BY user_id, event_type",
    "cost_rollup": "SELECT user_id, CASE WHEN count(*) = count(u) THEN round(sum(u), 4) END AS usd, count(u) AS n_known FROM (SELECT user_id, CASE WHEN event_id % 997 <> 0 THEN value END AS u FROM events) GROUP BY user_id",
    "throttle_events": f"""WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e),
w AS (SELECT user_id, k, t AS kept_t, event_id, true AS took FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.t - kept_t >= 43200000000 THEN o.t ELSE kept_t END, o.event_id, o.t - kept_t >= 43200000000 FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id FROM w WHERE took""",
    "state_changes": f"WITH {EVENTS}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous FROM e) SELECT event_id, user_id, event_type, previous FROM l WHERE previous IS DISTINCT FROM event_type",
    "debounce_sessions": f"WITH {EVENTS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, session",
    "log_ring": f"WITH {EVENTS} SELECT event_id, t FROM e ORDER BY t DESC, event_id DESC LIMIT 200",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "latency_percentiles_ref": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(value) FILTER (k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95 FROM r GROUP BY event_type",
    "plan_stop_index": "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_type IN ('purchase', 'logout', 'error') AND value > 50 AS stop FROM events), g AS (SELECT user_id, count(*) AS n_steps, min(idx) FILTER (stop) AS stop_at FROM s GROUP BY user_id) SELECT user_id, n_steps, stop_at, least(coalesce(stop_at + 1, n_steps), 20) AS n_run FROM g",
    "clamp_lines": f"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[{small.WHITE}]*\n[{small.WHITE}]*', ' ⏎ ', 'g'), '^[{small.WHITE}]+|[{small.WHITE}]+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 500 THEN substr(x, 1, 499) || '…' ELSE x END AS line FROM l""",
    "capped_sizes": """WITH s AS (SELECT p_partkey, p_size, p_partkey * 7 % 3000 + 1 AS w0, p_partkey * 11 % 2000 + 1 AS h0 FROM part), c AS (SELECT *, CASE WHEN greatest(w0, h0) <= 1280 THEN 1.0::DOUBLE ELSE 1280.0::DOUBLE / greatest(w0, h0) END AS k FROM s)
SELECT p_partkey, CAST(floor(w0 * k + 0.5) AS INTEGER) AS w, CAST(floor(h0 * k + 0.5) AS INTEGER) AS h, round(k, 6) AS scale, p_size > 1 AND w0 < h0 AS tiles FROM c""",
    "device_tiers": """WITH s AS (SELECT p_partkey, p_size % 9 AS ram, p_partkey * 97 % 3000 AS vram, p_partkey % 13 + 1 AS threads, p_partkey % 3 > 0 AS gpu, p_partkey % 2 = 0 AS isolated FROM part),
t AS (SELECT *, CASE WHEN ram <> 0 AND ram < 2 AND threads < 4 THEN 'minimal' WHEN gpu AND vram > 0 AND vram < 512 THEN 'reduced' ELSE 'full' END AS tier, CASE WHEN isolated THEN greatest(threads - 1, 1) ELSE 1 END AS usable FROM s)
SELECT p_partkey, tier, CASE WHEN tier <> 'full' THEN 0 WHEN NOT gpu THEN CASE WHEN usable >= 4 THEN 8 WHEN usable >= 2 THEN 4 ELSE 2 END WHEN vram >= 2048 THEN 16 WHEN vram >= 1024 THEN 8 ELSE 4 END AS batch,
 tier = 'full' AS can_l2, tier <> 'minimal' AS can_l3, tier = 'full' AND gpu AND vram >= 2048 AS can_audit, CASE WHEN tier = 'minimal' THEN 'ram' WHEN gpu THEN 'vram' WHEN isolated THEN 'threads' ELSE 'unknown' END AS bottleneck FROM t""",
    "manifest_signature": f"""WITH {HITS}, l AS (SELECT doc_id, lpad(s::VARCHAR, 9, '0') || ':' || e AS id, cls, s, CAST((e - s) * 8 AS BIGINT) AS w FROM kept),
c AS (SELECT doc_id, '[' || string_agg('["' || id || '","' || cls || '","solid_fill",' || s || ',0,' || w || ',16]', ',' ORDER BY id || ',' || cls || ',solid_fill,' || s || ',0,' || w || ',16') || ']' AS c FROM l GROUP BY doc_id),
u AS (SELECT doc_id, c, list_transform(string_split(c || 'frame-1', ''), lambda x: unicode(x)::HUGEINT) AS u FROM c)
SELECT doc_id, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::HUGEINT, u), lambda h, x: (xor(h, x) * 16777619) & 4294967295)::BIGINT)), 8, '0') || lpad(lower(to_hex(list_reduce(list_prepend(16777619::HUGEINT, u), lambda h, x: (xor(h, x) * 2246822507) & 4294967295)::BIGINT)), 8, '0') || lpad(lower(to_hex(length(c))), 8, '0') AS signature FROM u""",
    "manifest_summary": f"WITH {HITS}, c AS (SELECT cls, count(*) AS n FROM kept GROUP BY cls) SELECT 'HIDDEN: ' || CAST(sum(n) AS BIGINT) || ' item(s) in ' || count(*) || ' class(es)' || chr(10) || string_agg('  ' || cls || ': ' || n, chr(10) ORDER BY cls) AS summary FROM c",
    "box_metrics": f"WITH {BOXES}, i AS (SELECT p_partkey, {_W} * {_H} / (w0 * h0 + w1 * h1 - {_W} * {_H}) AS iou FROM b) SELECT p_brand, count(*) AS n, round(avg(iou), 6) AS mean_iou, count(*) FILTER (iou > 0.001) AS touched, count(*) FILTER (iou >= 0.5) AS half, count(*) FILTER (iou >= 0.8) AS most, count(*) FILTER (iou <= 0.001) AS leaked FROM i JOIN part USING (p_partkey) GROUP BY p_brand",
    "grounding_report": f"WITH s(plan_id, step_idx, action, mark, value, reason) AS ({_values(fixtures.STEPS)}), n(plan_id, mark, label, sensitive) AS ({_values(fixtures.NODES)}) SELECT CAST(s.plan_id AS BIGINT) AS plan_id, count(*) AS n_steps, count(n.mark) AS used, count(*) FILTER (s.mark IS NOT NULL AND n.mark IS NULL) AS invented FROM s LEFT JOIN n ON n.plan_id = s.plan_id AND n.mark = s.mark GROUP BY s.plan_id",
    "timeline_shares": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c",
    "device_projection": "WITH c AS (SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type) SELECT event_type, mean, device, round(mean * factor, 2) AS projected FROM c, (VALUES ('laptop', 1.8::DOUBLE), ('tablet', 2.5::DOUBLE), ('phone', 3.5::DOUBLE), ('old', 4.5::DOUBLE)) d(device, factor)",
    "provider_choice": "SELECT s_nationkey, arg_min(s_name, s_suppkey) FILTER (s_acctbal > 0) AS provider FROM supplier GROUP BY s_nationkey",
}
