"""SQL of the text operators whose results SQL can express."""

from __future__ import annotations

import string

#: Kinds of secrets as the contract has them, then the weak ones: name, pattern, the group whose length counts, its least length.
#: Written out here, so that the patterns of the operator are held against them (fixed values).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
WEAK = (
    ("ident", r"""(?i:username|user_name|user_id|login|client_?id|account_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    ("secret", "[A-Za-z0-9+/_-]+", 0, 32),
    ("endpoint", r"""(?i:https?|ftps?|postgres|postgresql|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+""", 0, 10),
)
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
SCOPE = 200

_REACH = """reach AS (SELECT id, id AS c FROM nodes UNION SELECT e.y, reach.c FROM reach JOIN edges e ON reach.id = e.x),
    least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1), degree AS (SELECT x AS id, count(*) AS n_links FROM edges GROUP BY 1)"""


def jaccard(size: int = 3, percent: int = 90) -> str:
    a, b = string.ascii_uppercase, string.ascii_lowercase
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{a}', '{b}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: list_aggregate(w[i:i + {size - 1}], 'string_agg', ' ')) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)), edges AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
    SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM least LEFT JOIN n ON n.doc_id = id LEFT JOIN degree USING (id)"""


def cosine(least: float = 0.98) -> str:
    return f"""WITH RECURSIVE ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {least}),
    edges AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
    SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN degree USING (id)"""


def secrets(scope: int = SCOPE) -> str:
    parts = []
    for i, (name, pattern, group, least) in enumerate((*BASE, *WEAK)):
        p = "'" + pattern.replace("'", "''") + "'"
        own = f"regexp_extract_all(t, {p}, {group})"
        ok = " AND ".join([f"length(v) >= {least}", *(f"regexp_matches(v, '{c}')" for c in MIXED if name == "secret")])
        parts.append(
            f"SELECT doc_id, {i} AS kind, nth, length(v0) AS size, sum(length(b)) OVER w + sum(length(v0)) OVER w - length(v0) AS start, {ok} AS ok FROM (SELECT doc_id, unnest(regexp_extract_all(t, {p})) AS v0, unnest({own}) AS v, "
            f"unnest(string_split_regex(t, {p})[:len(regexp_extract_all(t, {p}))]) AS b, unnest(range(len(regexp_extract_all(t, {p})))) AS nth FROM d) WINDOW w AS (PARTITION BY doc_id ORDER BY nth)"
        )
    near = f"EXISTS (FROM s b WHERE b.doc_id = a.doc_id AND b.kind IN ({{}}) AND (b.start, b.kind) <> (a.start, a.kind) AND CASE WHEN (b.start, b.kind) < (a.start, a.kind) THEN a.start - b.e ELSE b.start - a.e END <= {scope})"
    k = {n: str(KINDS.index(n)) for n in KINDS}
    ids, secret, end = near.format(f"{k['access']}, {k['ident']}"), near.format(f"{k['assign']}, {k['hex']}, {k['secret']}"), near.format(k["endpoint"])
    covered = f"EXISTS (FROM s b WHERE b.doc_id = a.doc_id AND b.kind < {len(BASE)} AND b.start < a.e AND b.e > a.start)"
    names = "[" + ", ".join(f"'{n}'" for n in KINDS) + "]"
    one = f"{names}[kind + 1] || ':' || start::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{KINDS[i]}" for i in range(len(BASE)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}), s AS (SELECT doc_id, kind, start::BIGINT AS start, (start + size)::BIGINT AS e FROM f WHERE ok),
    q AS (SELECT * FROM s a WHERE kind < {len(BASE)} OR kind = {k['ident']} AND {secret} OR kind = {k['secret']} AND ({ids} OR {end}) AND NOT {covered} OR kind = {k['endpoint']} AND {ids} AND {secret})
    SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, kind, e) FILTER (kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY start, kind, e), '') AS spans
    FROM d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id"""


def trie(family: int = 5, shared: int = 9) -> str:
    crc = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda k: ascii(k)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))))"
    return f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS l FROM t GROUP BY c), h AS (SELECT c, l, {crc} % {shared} AS h FROM o),
    b AS (SELECT h.c, list_concat(coalesce(o.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o ON o.c = h.c - h.c % {family}),
    m AS (SELECT c, len(l) = d AS over, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM b)),
    n AS (SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (over), '')) AS ends FROM m GROUP BY p, d),
    k AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY 1), v AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (n - 1) * strlen(n.p[d].x) ELSE 0 END AS s FROM n LEFT JOIN k USING (p)),
    u AS (SELECT p[1:e] AS p, count(*) FILTER (k = 0) AS leaves, sum(s) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM v) GROUP BY 1)
    SELECT v.c::BIGINT AS conv_id, v.d::BIGINT AS depth, a.c::BIGINT AS parent_conv_id, v.n::BIGINT AS n_convs, v.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
    FROM v JOIN u USING (p) LEFT JOIN v a ON v.d > 0 AND a.p = v.p[1:v.d - 1]"""


def sql() -> dict[str, str]:
    return {"op2_credential_linking": secrets(), "op6_multi_order_jaccard": jaccard(), "op7_rotated_codes": cosine(), "op12_prefix_trie": trie()}
