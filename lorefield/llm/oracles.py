"""The SQL that the operators' queries must agree with, where SQL can express them."""

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, {LOWER.format(f"trim(line, {WHITE})")} AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN owners o ON k.key = o.key
GROUP BY k.doc_id
"""

OP6 = f"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), {WHITE}, '') AS body FROM documents
), g AS (
  SELECT body, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""

WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SHINGLE = 4
OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(ws) - {SHINGLE} + 2)), lambda i: array_to_string(ws[i:i + {SHINGLE} - 1], ' '))) AS sh
  FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM w UNION SELECT ends.b, reach.c FROM reach JOIN ends ON ends.a = reach.doc_id
), low AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)
"""

ITEM_WORDS = "regexp_extract_all({0}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP8 = f"""
WITH d AS (
  SELECT doc_id, {ITEM_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), i AS (
  SELECT item_id, {ITEM_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, unnest(list_transform(range(1, greatest(2, len(ws) - 8)), lambda k: array_to_string(ws[k:k + 9], ' '))) AS phrase
  FROM i WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos, ws FROM d, sizes WHERE len(ws) >= size
), found AS (
  SELECT doc_id, pos, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND array_to_string(ws[pos:pos + p.size - 1], ' ') = phrase
), hits AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS w FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def _op12(buckets: int = 10_000) -> str:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    grams = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    step = f"xor(({table})[CAST((xor(c, x) & 255) + 1 AS BIGINT)], c >> 8)"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {ITEM_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), b AS (
  SELECT {ITEM_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark
), dg AS MATERIALIZED (
  SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest({grams}) AS g FROM d) GROUP BY ALL
), bg AS MATERIALIZED (
  SELECT g, count(*) AS n FROM (SELECT unnest({grams}) AS g FROM b) GROUP BY ALL
), spelled AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM dg UNION SELECT g FROM bg)
), hashed AS MATERIALIZED (
  SELECT g, CAST(xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)), lambda c, x: {step}, 4294967295), 4294967295) % {buckets} AS BIGINT) AS bucket FROM spelled
), s AS (
  SELECT bucket, sum(n) AS s FROM dg JOIN hashed USING (g) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS t FROM bg JOIN hashed USING (g) GROUP BY bucket
), totals AS (
  SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS ss, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS tt
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + {buckets}) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + {buckets})))) AS BIGINT) AS gain
  FROM range({buckets}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
), w AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM dg JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (doc_id)
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20 QUALIFY rank <= 5 * count(*) OVER () // 100
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    dot = "list_dot_product"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v FROM embeddings"
        " WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS r(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < {entries})",
    ]
    for i in range(rounds + 1):
        near = f"CAST({dot}(t.x, t.x) - 2 * {dot}(t.x, b.x) + {dot}(b.x, b.x) AS BIGINT) * {entries} + e"
        steps.append(f"near{i} AS MATERIALIZED (SELECT vec_id, p, any_value(t.x) AS x, min({near}) AS best FROM parts t JOIN book{i} b USING (p) GROUP BY vec_id, p)")
        if i < rounds:
            steps.append(
                f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM ("
                f"SELECT p, best % {entries} AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) m USING (p, e))"
            )
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"


ORACLES = {"op2_line_dedup": OP2, "op3_near_dedup": OP3, "op6_exact_dedup": OP6, "op8_decontaminate": OP8, "op12_importance_resample": _op12(), "op13_vector_codes": _op13()}
