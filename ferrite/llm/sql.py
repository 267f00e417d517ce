"""DuckDB SQL for the training-data queries that SQL can express, by plain brute force."""

from __future__ import annotations

from . import decontaminate as d

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM h
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM r JOIN n ON n.doc_id = r.a GROUP BY n.doc_id, n.n
"""


def _canonical(text: str) -> str:
    """List of [placeholder or bare word, bare word] of each atom, by the operator's rules."""
    stops = "chr(10) || '.!?'"
    bare = f"lower(rtrim(a[i], {stops}))"
    units = ", ".join(f"'{u}'" for u in d.UNITS if u not in d.AFTER_NUMBER)
    after = ", ".join(f"'{u}'" for u in d.AFTER_NUMBER)
    capital = "(unicode(a[i]) BETWEEN 65 AND 90 OR (unicode(a[i]) > 127 AND a[i][1] <> lower(a[i][1]))) AND a[i] <> upper(a[i])"
    kind = (
        f"CASE WHEN regexp_matches(a[i], '^\\p{{N}}') THEN '#1' WHEN {bare} IN ({units}) OR (i > 1 AND regexp_matches(a[i - 1], '^[0-9]') AND {bare} IN ({after})) THEN '#2' "
        f"WHEN {capital} AND i > 1 AND NOT contains({stops}, right(a[i - 1], 1)) THEN '#3' ELSE {bare} END"
    )
    return f"(SELECT list_transform(range(1, len(a) + 1), lambda i: [{kind}, {bare}]) FROM (SELECT regexp_extract_all(coalesce({text}, ''), '\\p{{N}}[\\p{{N}}.,:/]*|\\p{{L}}+[.!?\\n]*') AS a))"


_SLOTS = "len(list_filter(c[p0 + 1:p0 + size], lambda z: z[1] IN ('#1', '#2', '#3')))"
LEAKS = f"""
WITH b AS (SELECT item_id, {_canonical('text')} AS c FROM benchmark), bl AS (SELECT item_id, c, least(len(c), {d.WINDOW}) AS size FROM b WHERE len(c) > 0),
bp AS (SELECT item_id, c, size, unnest(range(0, len(c) - size + 1)) AS p0 FROM bl),
bw AS (SELECT item_id, p0, size, array_to_string(list_transform(c[p0 + 1:p0 + size], lambda z: z[1]), ' ') AS w, c[p0 + 1:p0 + size] AS bv, count(*) OVER (PARTITION BY item_id) AS n FROM bp WHERE size - {_SLOTS} >= least({d.LITERALS}, size) AND {_SLOTS} < size),
dc AS (SELECT doc_id, {_canonical('text')} AS c FROM documents), sizes AS (SELECT DISTINCT size FROM bw),
dp AS (SELECT doc_id, c, size, unnest(range(0, len(c) - size + 1)) AS pos FROM dc, sizes WHERE len(c) >= size),
dw AS (SELECT doc_id, pos, size, array_to_string(list_transform(c[pos + 1:pos + size], lambda z: z[1]), ' ') AS w, c[pos + 1:pos + size] AS dv FROM dp),
hits AS (SELECT doc_id, item_id, pos - p0 AS shift, p0, n, bv, dv FROM dw JOIN bw USING (size, w)),
v AS (SELECT doc_id, item_id, shift, p0, unnest(list_zip(bv, dv)) AS z FROM hits), sv AS (SELECT doc_id, item_id, shift, p0, z[1][2] AS theirs, z[2][2] AS mine FROM v WHERE z[1][1] IN ('#1', '#2', '#3')),
clash AS (SELECT doc_id, item_id, shift, theirs FROM sv GROUP BY ALL HAVING min(mine) <> max(mine)), bad AS (SELECT DISTINCT doc_id, item_id, shift, p0 FROM sv JOIN clash USING (doc_id, item_id, shift, theirs)),
ok AS (SELECT DISTINCT doc_id, item_id, p0, n FROM hits ANTI JOIN bad USING (doc_id, item_id, shift, p0))
SELECT doc_id, item_id, count(*) AS matched_windows, CAST(max(n) AS BIGINT) AS item_windows, round(count(*) / max(n), 6) AS containment FROM ok GROUP BY doc_id, item_id HAVING count(*) >= {d.CONTAINMENT} * max(n)
"""
