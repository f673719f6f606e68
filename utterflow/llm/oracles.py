"""DuckDB SQL for the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MATCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""
_DAMAGE = _CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")


def _repair_state(q: int) -> str:
    """Cheapest way on from state q (0 start, 1 after s, 2 after u, 3 after a) at a row, without insertions before it."""
    extra = "CASE WHEN truncated THEN 5 ELSE 0 END"
    to, role = (3, "assistant") if q == 2 else (2, "user")
    keep = lambda initial, t: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {{'c': f{t}.c + {extra}, 's': 'K' || f{t}.s, 't': list_prepend(role || ':' || text, f{t}.t)}} END"
    options = [f"{{'c': f{q}.c + 2, 's': 'D' || f{q}.s, 't': f{q}.t}}", keep("a" if q == 2 else "u", to)] + [keep("s", 1)] * (q == 0)
    options.append(f"CASE WHEN NOT gone THEN {{'c': f{to}.c + 1 + {extra}, 's': 'R' || f{to}.s, 't': list_prepend('{role}:' || text, f{to}.t)}} END")
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1] AS b{q}"


def _repair_inserted(q: int) -> str:
    """The same with up to two insertions before the row."""
    one, two = (3, 2) if q == 2 else (2, 3)
    a, b = ("assistant", "user") if q == 2 else ("user", "assistant")
    return (
        f"list_sort([b{q}, {{'c': b{one}.c + 5, 's': 'I' || b{one}.s, 't': list_prepend('{a}:', b{one}.t)}}, "
        f"{{'c': b{two}.c + 10, 's': 'II' || b{two}.s, 't': list_prepend('{a}:', list_prepend('{b}:', b{two}.t))}}])[1] AS f{q}"
    )


ORACLE_SQL = {
    "op2_near_duplicates": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT a AS id, a AS r FROM link UNION SELECT l.b, reach.r FROM reach JOIN link l ON reach.id = l.a
), component AS (
  SELECT id, min(r) AS r FROM reach GROUP BY id
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r, w.doc_id) AS component_id, coalesce(r, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sized s ON w.doc_id = s.doc_id LEFT JOIN component c ON w.doc_id = c.id
""",
    "op10_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_MATCH}') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_MATCH}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM win
), place AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT r, item_id, i, p.size FROM place p JOIN win USING (size, g)
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN ids ON d.r = ids.r
""",
    "benchmark_proximity": rf"""
WITH tok AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_MATCH}') AS w FROM documents)
), freq AS (
  SELECT term, count(*) AS n FROM tok GROUP BY term
), term AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_MATCH}')) AS term FROM benchmark
), ranked AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), term) AS k,
    count(*) OVER (PARTITION BY item_id) AS total, min(coalesce(n, 0)) OVER (PARTITION BY item_id) AS fewest
  FROM term LEFT JOIN freq USING (term)
), posting AS (
  SELECT doc_id, item_id, k, least(total, 3) AS needed, pos FROM tok JOIN ranked USING (term) WHERE k <= 3 AND fewest > 0
), near AS (
  SELECT a.doc_id, a.item_id, a.pos FROM posting a
  LEFT JOIN posting b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.k > 1 AND abs(b.pos - a.pos) < 20
  WHERE a.k = 1 GROUP BY a.doc_id, a.item_id, a.pos, a.needed HAVING count(DISTINCT b.k) = a.needed - 1
)
SELECT doc_id, item_id, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n_places FROM near GROUP BY doc_id, item_id
""",
    "op6_host_quality": rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), trigram AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM trigram) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
  SELECT b.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.r = c.r LEFT JOIN lines l ON b.r = l.r
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS f FROM judged GROUP BY source
), prior AS (
  SELECT avg(f / n) AS m, CASE WHEN var_pop(f / n) > 1e-12 THEN greatest(avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1, 0.0) ELSE avg(CAST(n AS DOUBLE)) END AS k FROM hosts
), verdict AS (
  SELECT source, (f + m * k) / (n + k) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(rate, 9) AS host_failure_rate, (NOT base_failed AND NOT rate > 0.5) AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest, size) ELSE page_id END AS response FROM p
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN response IS NULL OR response IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM r
""",
    "op9_mix_sources": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|17') AS key FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3.0 * source_size / weight AS ratio,
    sum(3.0 * source_size) OVER w AS fixed, sum(weight) OVER () - sum(weight) OVER w AS open_weight,
    sum(source_size) OVER () AS total, row_number() OVER w AS k, lead(3.0 * source_size / weight) OVER w AS next_ratio
  FROM by_source WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT 0 AS k, max(total) / sum(weight) AS level, min(ratio) AS next_ratio FROM ordered
  UNION ALL SELECT k, (total - fixed) / open_weight, next_ratio FROM ordered WHERE open_weight > 0
), level AS (
  SELECT level FROM levels WHERE next_ratio IS NULL OR next_ratio > level ORDER BY k LIMIT 1
), target AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target FROM by_source, level
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    floor(floor(target) / source_size) * size
    + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - place)) END AS BIGINT) AS taken
FROM placed
""",
    "op11_conversations": rf"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, h, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {_DAMAGE} % 20 AS h FROM conversations)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again
  FROM (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM (SELECT * FROM damaged WHERE h > 0 UNION ALL SELECT * FROM damaged WHERE h = 3)
  )
), faulty AS (
  SELECT *, substr(role, 1, 1) AS initial, blank OR again AS gone, NOT blank AND again AS repeated,
    NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM placed)
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS i, {{'c': CAST(0 AS BIGINT), 's': '', 't': CAST([] AS VARCHAR[])}} AS f0, {{'c': CAST(10 AS BIGINT), 's': 'II', 't': ['user:', 'assistant:']}} AS f1,
    {{'c': CAST(5 AS BIGINT), 's': 'I', 't': ['assistant:']}} AS f2, {{'c': CAST(0 AS BIGINT), 's': '', 't': CAST([] AS VARCHAR[])}} AS f3
  FROM counts
  UNION ALL
  SELECT conv_id, i, {', '.join(map(_repair_inserted, range(4)))}
  FROM (SELECT dp.conv_id, r.i, {', '.join(map(_repair_state, range(4)))} FROM dp JOIN faulty r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = dp.i - 1)
), best AS (
  SELECT conv_id, f0 FROM dp WHERE i = 1
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(f0.c, 0) AS BIGINT) AS cost,
  coalesce(f0.s, '') AS audit, sha256(coalesce(array_to_string(f0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
""",
}
