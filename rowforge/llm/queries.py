"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from rowforge.session import ship

from . import collocations, decontamination, fill_in_middle, jaccard_join, language_id, license_scan, minhash, mixing, pii, pivot_search, sharding, suffix_dedup, toxicity

_BUILDERS = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_pivot_search": pivot_search.op2,
    "op3_toxicity": toxicity.op3,
    "op4_sharding": sharding.op4,
    "op5_mixing": mixing.op5,
    "op6_license_scan": license_scan.op6,
    "op7_pii": pii.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_language_id": language_id.op9,
    "op10_decontamination": decontamination.op10,
    "op11_collocations": collocations.op11,
    "op12_fill_in_middle": fill_in_middle.op12,
    "op13_minhash": minhash.op13,
}
QUERIES = {name: (lambda spark, sf_dir, build=build: build(ship(spark), sf_dir)) for name, build in _BUILDERS.items()}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20"""

_OP8 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(generate_series(1, len(l) - 2), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.c + ny.c - i)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce((SELECT c FROM n WHERE n.doc_id = d.doc_id), 0) AS n_shingles, (SELECT min(reach) FROM r WHERE r.doc_id = d.doc_id) AS component_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links FROM documents d"""

_NAMES = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = rf"""WITH d AS (SELECT doc_id, {_NAMES} AS w FROM documents), b AS (SELECT item_id, {_NAMES} AS w FROM benchmark),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, g FROM (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(generate_series(1, len(w) - least(10, len(w)) + 1), lambda k: array_to_string(w[k : k + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM i),
x AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS k, w FROM d, z WHERE len(w) >= n),
h AS (SELECT doc_id, x.n, k, item FROM x JOIN i ON i.n = x.n AND i.g = array_to_string(w[k : k + x.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OP11 = rf"""WITH w AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(l)) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(generate_series(1, len(l) - m + 1), lambda i: l[i : i + m - 1])) AS g FROM w, (SELECT unnest(generate_series(1, 5)) AS m) WHERE len(l) >= m) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS l, f FROM g WHERE m > 1),
e AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, array_to_string(l[1 : m - 1], ' ') AS phrase, f FROM c UNION ALL SELECT lang, array_to_string(l[2 : m], ' '), f FROM c) GROUP BY 1, 2),
k AS (SELECT lang, phrase, f, unnest(generate_series(1, m - 1)) AS k, l, m FROM c ANTI JOIN e ON c.lang = e.lang AND c.phrase = e.phrase AND 100 * e.longer >= 100 * c.f),
s AS (SELECT k.lang, k.phrase, k.f AS a, k, x.f AS l, y.f AS r, t.n, CAST(1000 AS HUGEINT) * k.f * t.n // (CAST(x.f AS HUGEINT) * y.f) AS score FROM k JOIN t USING (lang) JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(k.l[1 : k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(k.l[k + 1 : k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000"""

_OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(l) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(s, CAST(i AS INTEGER), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_OP13 = _OP8.replace("100 * i >= 90 *", "100 * i >= 85 *").split("SELECT d.doc_id, ")[0] + """SELECT d.doc_id, coalesce((SELECT c FROM n WHERE n.doc_id = d.doc_id), 0) AS n_shingles, (SELECT min(reach) FROM r WHERE r.doc_id = d.doc_id) AS component_id, component_id = d.doc_id AS kept FROM documents d"""

#: The others train models, hash rows or build trees; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_pivot_search": _OP2, "op8_jaccard_join": _OP8, "op10_decontamination": _OP10, "op11_collocations": _OP11, "op12_fill_in_middle": _OP12, "op13_minhash": _OP13}
