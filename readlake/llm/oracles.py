"""SQL of the corpus queries that DuckDB can express: all pairs, and links followed to their ends."""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, vec_id = coalesce(c.c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.x = vec_id
"""

NEAR_DOCUMENTS = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(32) || w[i + 1])) END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM s),
class AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM k WHERE n > 0 GROUP BY 1),
x AS (SELECT class.rep, class.n, unnest(s.s) AS g FROM class JOIN s ON s.doc_id = class.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
c AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, coalesce(c.c, class.rep, k.doc_id) AS component_id, k.doc_id = coalesce(c.c, class.rep, k.doc_id) AS kept
FROM k LEFT JOIN class ON class.h = k.h AND k.n > 0 LEFT JOIN c ON c.x = class.rep
"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int, holds: str | None = None) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    good = f" AND regexp_matches(hit, '{holds}')" if holds else ""
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, s, s + length(hit) AS e FROM (
        SELECT doc_id, hits[i] AS hit, found[i] AS found, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, gaps, hits, found, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(t, {quoted}) AS gaps, regexp_extract_all(t, {quoted}) AS hits, regexp_extract_all(t, {quoted}, {group}) AS found FROM d WHERE regexp_matches(t, {quoted}))))
        WHERE length(found) >= {least}{good}"""


def linked_secrets(base, weak, roles, scope: int) -> str:
    """SQL of the secret report from the same patterns; it takes every doc_id to be one row's."""
    kinds = [*base, *((k, p, g, n, h) for k, _, p, g, n, h in weak)]
    parts = " UNION ALL ".join(_spans(k, o, *rest) for o, (k, *rest) in enumerate(kinds))
    secret = "(" + ", ".join(f"'{k}'" for k, r in roles.items() if r == "secret") + ")"
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in base)
    names = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), parts AS ({parts}),
    kept AS (SELECT * FROM parts w WHERE o < {len(base)} OR EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND (p.kind IN {secret}) <> (w.kind IN {secret})
        AND p.s - w.e <= {scope} AND w.s - p.e <= {scope} AND (p.s >= w.e OR w.s >= p.e))),
    per AS (SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (o < {len(base)}), '')) AS base_sha256, {listed} AS spans, count(*) FILTER (o >= {len(base)}) AS n_linked FROM kept GROUP BY 1)
    SELECT d.doc_id, {names}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""




def _tree(name: str, start: str, fanout: int, levels: int) -> str:
    """CTEs of trees over ``start`` (g, i, h): ``{name}_top`` (g, h), and ``{name}_side`` (g, level, i, l, r), the
    digests left and right of a node in its run, of the levels where its tree has several nodes."""
    parts = [f"{name}0 AS (SELECT g, i, h FROM {start})"]
    for k in range(levels):
        many = f"(SELECT g AS m FROM {name}{k} GROUP BY g HAVING count(*) > 1)"
        parts.append(f"{name}{k + 1} AS (SELECT g, i // {fanout} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} a SEMI JOIN {many} b ON a.g IS NOT DISTINCT FROM b.m GROUP BY 1, 2)")
    runs = " UNION ALL ".join(f"SELECT {k} AS level, g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}" for k in range(levels + 1))
    parts.append(f"{name}_all AS ({runs})")
    parts.append(f"{name}_top AS (SELECT g, h FROM {name}_all WHERE n = 1)")
    parts.append(
        f"""{name}_side AS (SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM {name}_all a JOIN {name}_all b ON a.level = b.level AND a.g IS NOT DISTINCT FROM b.g AND a.i // {fanout} = b.i // {fanout} WHERE a.n > 1 GROUP BY ALL)"""
    )
    return ",\n".join(parts)


def manifest(fanout: int, levels: int = 4) -> str:
    """Trees of up to ``fanout ** levels`` documents a source, and as many sources. The checksum of an id
    goes byte by byte through a table of 256 values, which is made bit by bit."""

    def leaf(text: str) -> str:
        values = ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    bit = "i"
    for _ in range(8):
        bit = f"list_transform([{bit}], lambda c: xor(c // 2, 3988292384 * (c % 2)))[1]"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])"
    folds = ["f0 AS (SELECT *, CASE WHEN hit THEN tampered ELSE leaf END AS f, '' AS proof FROM numbered)"]
    for k in range(2 * levels):
        side, place = (("inner_side", f"x.i // {fanout**k}") if k < levels else ("outer_side", f"x.place // {fanout ** (k - levels)}"))
        on = f"s.level = {k % levels} AND s.i = {place}" + (" AND s.g IS NOT DISTINCT FROM x.g" if k < levels else "")
        folds.append(f"f{k + 1} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, proof || coalesce(s.l || s.r, '') AS proof FROM f{k} x LEFT JOIN {side} s ON {on})")
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, {bit} AS c FROM (SELECT range::BIGINT AS i FROM range(256)))),
leaves AS (SELECT doc_id, source AS g, {leaf("text")} AS leaf, {leaf(lower)} AS tampered,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii((doc_id::varchar)[k])::BIGINT)), {step}), 4294967295) % 5 = 0, false) AS hit
    FROM documents, crc),
numbered AS (SELECT l.*, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM leaves l),
leafrow AS (SELECT g, i, leaf AS h FROM numbered),
{_tree("inner", "leafrow", fanout, levels)},
sources AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM inner_top),
{_tree("outer", "sources", fanout, levels)},
{", ".join(folds)}
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = o.h AS verified
FROM f{2 * levels} x JOIN inner_top t ON t.g IS NOT DISTINCT FROM x.g CROSS JOIN outer_top o
"""
