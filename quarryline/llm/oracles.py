"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROL, END, MID, OPEN
from .divergence import LEAST_DOCUMENTS, SCALE, SMOOTHING, TOP_TERMS
from .line_dedup import LEAST_CHARS
from .near_dedup import SHINGLE, SIMILAR
from .ranked_search import TOP
from .secrets import RULES
from .sharding import SHARDS
from .substring_dedup import WINDOW

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY 1),
g AS (SELECT DISTINCT doc_id, i + k AS pos FROM p JOIN f USING (h), range({WINDOW}) t(k) WHERE first < doc_id),
k AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w) ANTI JOIN g USING (doc_id, pos)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM k GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, md5(array_to_string(list_slice(ws, i, i + {SHINGLE - 1}), ' ')) AS h, count(*) AS n FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, least(len(ws), 1) + 1))) AS i FROM w) GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS total FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE shared >= {SIMILAR} * (x.total + y.total - shared)
UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON coalesce(x.text, chr(1)) = coalesce(y.text, chr(1)) AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY 1
"""


def escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({len(OPEN) + len(MID) + len(END)} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1
"""


def spans_sql(order: int) -> str:
    """One row a match of a rule: starts add up the gaps and matches before."""
    kind, pattern, group, least = RULES[order]
    p = pattern.replace("'", "''")
    value = f"regexp_extract(m, '{p}', {group})" if group else "m"
    return f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, CAST(upto - length(m) AS BIGINT) AS s, CAST(upto AS BIGINT) AS e FROM
(SELECT doc_id, i, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM
(SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g FROM
(SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS ms, regexp_split_to_array(coalesce(text, ''), '{p}') AS gs FROM documents) WHERE len(ms) > 0)) WHERE length({value}) >= {least}"""


SECRETS = f"""
WITH f AS ({" UNION ALL ".join(spans_sql(i) for i in range(len(RULES)))}),
g AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in RULES)} FROM f GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, concat({", ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= {LEAST_CHARS} GROUP BY 1),
g AS (SELECT l.*, coalesce(first < doc_id, false) AS gone FROM l LEFT JOIN f ON l.key = f.key),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
CASE WHEN max(i) FILTER (gone) < 255 THEN 1 WHEN max(i) FILTER (gone) < 65535 THEN 2 ELSE 4 END AS w FROM g GROUP BY 1),
r AS (SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g WHERE gone) GROUP BY doc_id, run),
b AS (SELECT doc_id, string_agg(lpad(lower(hex(s)), 2 * w, '0') || lpad(lower(hex(e)), 2 * w, '0'), '' ORDER BY s) AS edges FROM r JOIN k USING (doc_id) GROUP BY 1)
SELECT k.doc_id, n_lines, n_dropped, kept_sha256, coalesce('0' || w || edges, '') AS keep FROM k LEFT JOIN b ON k.doc_id = b.doc_id
"""

SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({SMALL}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, sum(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTHING})) // (total + {SMOOTHING} * terms) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + {SMOOTHING})) // (any_value(total) + {SMOOTHING} * any_value(terms)) AS q FROM c JOIN (SELECT lang, sum(total) AS total, any_value(terms) AS terms FROM g GROUP BY ALL) USING (lang) GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y USING (lang, term) GROUP BY ALL) w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

TERMS_OF = f"regexp_extract_all({SMALL}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {TERMS_OF} AS ws FROM documents),
n AS (SELECT doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
g AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM n),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({TERMS_OF}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, g GROUP BY term, all_docs),
s AS (SELECT item_id, t.doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN n ON n.doc_id = t.doc_id, g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""

#: Counts differ by one at most, and the slots of a shard have no gaps.
SHARDING_LAW = f"""
SELECT CAST(s AS INTEGER) AS shard, n, CAST(0 AS BIGINT) AS first_slot, n - 1 AS last_slot, n AS slots
FROM (SELECT s, all_docs // {SHARDS} + CASE WHEN s < all_docs % {SHARDS} THEN 1 ELSE 0 END AS n FROM range({SHARDS}) t(s), (SELECT count(*) AS all_docs FROM documents)) WHERE n > 0
"""
