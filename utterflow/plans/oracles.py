"""DuckDB SQL for the registered queries, on the same derived tables."""

from __future__ import annotations

from ..functions.text import ANNOTATIONS, CALL_PUNCTUATION, CALL_REPLACEMENTS

UTT = r"""utt AS (
  SELECT 'ls/' || substr(source, 4) || '/' || CAST(doc_id % 7 AS VARCHAR) || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key,
    'ls/' || substr(source, 4) || '/' || CAST(doc_id % 7 AS VARCHAR) || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.wav' AS path,
    n_chars * 160 AS num_frames, CAST(16000 AS INTEGER) AS sample_rate, 'ls/' || substr(source, 4) AS speaker_id,
    'ls/' || CAST(doc_id % 7 AS VARCHAR) AS recording_id, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'm' ELSE 'f' END AS gender,
    lang AS language_tag, trim(regexp_replace(regexp_replace(lower(text), '[^ ''a-z]', '', 'g'), '\s+', ' ', 'g')) AS transcription, doc_id
  FROM documents
)"""
EMB = """emb AS (
  SELECT 'vc1/id' || label || '/' || (vec_id % 5) || '/' || vec_id AS key, 'vc1/id' || label AS spk, 'vc1/id' || label || '/' || (vec_id % 5) AS ses,
    CASE WHEN label % 2 = 0 THEN 'm' ELSE 'f' END AS gender, embedding, label, vec_id
  FROM embeddings
)"""
TEL = "tel AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step, event_type AS metric, value, ts FROM events)"
REC = "rec AS (SELECT key, language_tag, CASE WHEN transcription = '' THEN 0 ELSE len(string_split(transcription, ' ')) END AS n FROM utt)"
TOK = r"""tok AS (
  SELECT conv_id AS file_id, turn * 100000 + i AS line_no, CAST(turn AS INTEGER) AS sentence_no,
    CASE WHEN (role = 'user') = (conv_id % 5 <> 0) THEN 'A' ELSE 'B' END AS channel, turn * 100 + i * 0.5 AS start_s, 0.5 AS dur_s, w AS token
  FROM (SELECT conv_id, turn, role, unnest(w) AS w, unnest(range(0, len(w))) AS i
        FROM (SELECT conv_id, turn, role, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations))
  WHERE w <> '' AND NOT regexp_matches(w, '[\[\]]')
), sent AS (
  SELECT file_id, channel, sentence_no, CAST(min(start_s) AS DOUBLE) AS start_s, CAST(arg_max(start_s + dur_s, line_no) AS DOUBLE) AS end_s, string_agg(token, ' ' ORDER BY line_no) AS text
  FROM tok GROUP BY ALL
)"""
LABELLED = "s AS (SELECT lang, l.doc_id, toxic AS y, CAST(CAST('0x' || substr(md5(CAST(l.doc_id AS VARCHAR)), 1, 4) AS BIGINT) AS DOUBLE) / 65535 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _pairs(source: str, limit: str, kind: str, same_sex: bool = True) -> str:
    """CTEs ending in ``pairs_<kind>`` (l, r): pairs ranked in their generator, taken by (rank, generator descending)."""
    grp = {"pos": "ses", "over": "spk", "neg": "spk"}[kind]
    member = f"m_{kind} AS (SELECT *, row_number() OVER (PARTITION BY {grp} ORDER BY md5(key || '|1337'), key) - 1 AS i, count(*) OVER (PARTITION BY {grp}) AS m FROM {source})"
    if kind == "pos":
        pair = "SELECT a.ses || '|' || b.ses AS g, a.i * b.m + b.i AS k, a.key AS l, b.key AS r FROM m_pos a JOIN m_pos b ON a.spk = b.spk AND a.ses < b.ses"
    elif kind == "over":
        pair = "SELECT a.spk AS g, a.i * 1000000 + b.i AS k, a.key AS l, b.key AS r FROM m_over a JOIN m_over b ON a.spk = b.spk AND a.i < b.i"
    else:
        sex = "AND a.gender = b.gender" if same_sex else ""
        pair = f"SELECT a.spk || '|' || b.spk AS g, a.i * b.m + b.i AS k, a.key AS l, b.key AS r FROM m_neg a JOIN m_neg b ON a.spk < b.spk {sex}"
    return f"""{member}, all_{kind} AS ({pair}), rank_{kind} AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS rank FROM all_{kind}),
pairs_{kind} AS (SELECT least(l, r) AS "left", greatest(l, r) AS "right" FROM (SELECT *, row_number() OVER (ORDER BY rank, g DESC) AS n FROM rank_{kind}) WHERE n <= {limit})"""


def _both(source: str, limit: str, same_sex: bool = True) -> str:
    return f"""{_pairs(source, limit, 'pos')}, {_pairs(source, limit, 'neg', same_sex)},
t AS (SELECT "left", "right", true AS same_speaker FROM pairs_pos UNION ALL SELECT "left", "right", false FROM pairs_neg)"""


_SCORED = """scored AS (
  SELECT "left", "right", CAST(same_speaker AS INTEGER) AS y, least(greatest((list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2, 0), 1) AS score
  FROM t JOIN emb a ON a.key = "left" JOIN emb b ON b.key = "right"
)"""


def _rates(scores: str, by: str, tie: str) -> str:
    """CTEs ending in ``rates`` (by, eer, eer_threshold, mdc, mdc_threshold) of ``scores``."""
    return f"""tot AS (SELECT {by}, sum(y) AS p, sum(1 - y) AS q FROM {scores} GROUP BY {by}),
pt AS (SELECT {by}, score, sum(y) AS pos, sum(1 - y) AS neg FROM {scores} GROUP BY {by}, score),
cur AS (SELECT pt.{by}, score, (sum(neg) OVER w - neg) / q AS x0, (sum(pos) OVER w - pos) / p + (sum(neg) OVER w - neg) / q AS s0, sum(neg) OVER w / q AS x1, sum(pos) OVER w / p + sum(neg) OVER w / q AS s1
  FROM pt JOIN tot ON pt.{by} = tot.{by} WHERE p > 0 AND q > 0 WINDOW w AS (PARTITION BY pt.{by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
cross_ AS (SELECT {by}, max(score) FILTER (s1 >= 1) AS score, min(score) FILTER (s1 < 1) AS prev FROM cur GROUP BY {by}),
eers AS (SELECT cur.{by}, x0 + (1 - s0) / (s1 - s0) * (x1 - x0) AS eer, CASE WHEN prev IS NULL THEN cur.score ELSE prev + (1 - s0) / (s1 - s0) * (cur.score - prev) END AS eer_threshold
  FROM cross_ JOIN cur ON cur.{by} = cross_.{by} AND cur.score = cross_.score),
row_ AS (SELECT s.{by}, score, row_number() OVER w AS n, 1.0 * (sum(y) OVER w / p) * 0.05 + 1.0 * (1 - sum(1 - y) OVER w / q) * 0.95 AS cost
  FROM {scores} s JOIN tot ON s.{by} = tot.{by} WHERE p > 0 AND q > 0 WINDOW w AS (PARTITION BY s.{by} ORDER BY score, {tie} ROWS UNBOUNDED PRECEDING)),
best_ AS (SELECT {by}, score, cost, row_number() OVER (PARTITION BY {by} ORDER BY cost, n) AS k FROM row_),
rates AS (SELECT tot.{by}, eer, eer_threshold, cost / 0.05 AS mdc, best_.score AS mdc_threshold, CASE WHEN p = 0 OR q = 0 THEN 'single_class' ELSE 'ok' END AS status
  FROM tot LEFT JOIN eers ON tot.{by} = eers.{by} LEFT JOIN best_ ON tot.{by} = best_.{by} AND k = 1)"""


def _stats(by: str = "") -> str:
    on = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    q = lambda c, n: ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}_q{int(p * 100)}" for p in (0.1, 0.2, 0.8, 0.9))
    return f"""WITH {UTT}, plain AS (
  SELECT {on}count(*) AS samples, count(DISTINCT key) AS unique_keys, count(*) FILTER (gender = 'm') AS samples_m, count(*) FILTER (gender = 'f') AS samples_f, 0 AS samples_other_gender,
    round(avg(num_frames), 6) AS frames_avg, min(num_frames) AS frames_min, max(num_frames) AS frames_max, {q('num_frames', 'frames')},
    CAST(sum(num_frames) AS BIGINT) AS frames_total, round(sum(num_frames) / 16000.0, 6) AS seconds_total, round(sum(num_frames) / 16000.0 / 3600.0, 6) AS hours_total,
    min(length(transcription)) AS transcript_min, max(length(transcription)) AS transcript_max, {q('length(transcription)', 'transcript')},
    round(sum(length(transcription)) / count(*), 6) AS transcript_avg, round(avg(length(transcription)), 6) AS transcript_avg_transcribed, CAST(sum(length(transcription)) AS BIGINT) AS transcript_total
  FROM utt {group}
), spk AS (
  SELECT {on}speaker_id, min(gender) AS g, count(DISTINCT split_part(key, '/', 3)) AS n FROM utt GROUP BY {on}speaker_id
), speakers AS (
  SELECT {on}count(*) AS speakers, count(*) FILTER (g = 'm') AS speakers_m, count(*) FILTER (g = 'f') AS speakers_f, 0 AS gender_conflicts, CAST(sum(n) AS BIGINT) AS speaker_sessions,
    round(avg(n), 6) AS sessions_avg, min(n) AS sessions_min, max(n) AS sessions_max FROM spk {group}
), bare AS (
  SELECT {on}count(DISTINCT split_part(key, '/', 3)) AS sessions FROM utt {group}
)
SELECT * FROM plain JOIN speakers {using} JOIN bare {using}"""


_STATISTICS = (
    "samples unique_keys samples_m samples_f samples_other_gender frames_avg frames_min frames_max frames_q10 frames_q20 frames_q80 frames_q90 frames_total seconds_total hours_total "
    "transcript_min transcript_max transcript_q10 transcript_q20 transcript_q80 transcript_q90 transcript_avg transcript_avg_transcribed transcript_total "
    "speakers speakers_m speakers_f gender_conflicts speaker_sessions sessions_avg sessions_min sessions_max sessions"
).split()


def _split(source: str, group: str, ratio: str, seed: int) -> str:
    return f"""c AS (SELECT {group} AS g, count(*) AS n FROM {source} GROUP BY 1),
o AS (SELECT g, n, sum(n) OVER (ORDER BY md5(g || '|{seed}'), g ROWS UNBOUNDED PRECEDING) - n AS before FROM c),
flag AS (SELECT g, before < {ratio} * (SELECT count(*) FROM {source}) AS is_split FROM o)"""


_SPECIALS = "sp AS (SELECT * FROM (VALUES (0, '<blank>'), (1, '<s>'), (2, '</s>'), (3, '<unk>'), (4, '|')) v(idx, char))"
_CHARS = "ch AS (SELECT unnest(string_split(transcription, '')) AS char FROM utt WHERE transcription <> '')"
_VOCAB = "voc AS (SELECT idx, char FROM sp UNION ALL SELECT 4 + row_number() OVER (ORDER BY char), char FROM (SELECT DISTINCT char FROM ch WHERE char <> ' '))"


def _pieces(**sections: str) -> str:
    """The pieces of a document whose sections have the rows (idx, v, k)."""
    parts, marks = [], []
    for n, (name, rows) in enumerate(sections.items()):
        opening, closing = ("[", "]") if "NULL AS k" in rows else ("{", "}")
        entry = "to_json(v)" if opening == "[" else "to_json(CAST(k AS VARCHAR)) || ': ' || to_json(v)"
        parts.append(f"SELECT {n} AS section, CAST(idx AS BIGINT) AS idx, CASE WHEN idx = min(idx) OVER () THEN '' ELSE ',' END || {entry} AS value FROM ({rows})")
        last = "}" if n == len(sections) - 1 else ""
        marks += [f"({n}, -1, '{', ' if n else '{'}\"{name}\": {opening}')", f"({n}, 4611686018427387904, '{closing}{last}')"]
    return f"piece AS ({' UNION ALL '.join(parts)} UNION ALL SELECT * FROM (VALUES {', '.join(marks)}) m(section, idx, value)) SELECT CAST(section AS INTEGER) AS section, CAST(idx AS BIGINT) AS idx, value FROM piece"


_DIST = "dist AS (SELECT char, count(*) / (SELECT count(*) FROM ch) AS freq FROM (SELECT CASE WHEN char = ' ' THEN '|' ELSE char END AS char FROM ch) GROUP BY char UNION ALL SELECT char, 0.0 FROM sp WHERE idx < 4)"
_SPEAKERS = "row_number() OVER (ORDER BY CAST(regexp_extract(speaker_id, '/(?:id)?(\\d+)$', 1) AS BIGINT), speaker_id) - 1"


def _clean_call(text: str) -> str:
    out = text
    for old, new in CALL_REPLACEMENTS:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"translate({out}, '{CALL_PUNCTUATION}', '{' ' * len(CALL_PUNCTUATION)}')"
    return f"CASE WHEN {out} = {text} THEN {text} ELSE trim(regexp_replace({out}, ' {{2,}}', ' ', 'g')) END"


def _annotations(text: str) -> str:
    out = f"lower({text})"
    for pattern, new in ANNOTATIONS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out})"


def _buffered(items: str, size: int, name: str) -> str:
    """CTEs ending in ``name`` (g, key, place): the items (g, key, i from 0) of each g, shuffled through a buffer."""
    draw = f"1 + CAST('0x' || substr(md5(s.g || '|0|1337|' || s.i), 1, 8) AS BIGINT) % {size}"
    return f"""{name}_walk AS (
  SELECT DISTINCT g, CAST(-1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS o FROM {items}
  UNION ALL
  SELECT g, i, CASE WHEN slot IS NULL THEN list_append(held, key) ELSE list_concat(list_concat(held[1:slot - 1], [key]), held[slot + 1:]) END, CASE WHEN slot IS NOT NULL THEN held[slot] END
  FROM (SELECT s.g, s.i, s.key, w.held, CASE WHEN len(w.held) = {size} THEN {draw} END AS slot FROM {name}_walk w JOIN {items} s ON s.g = w.g AND s.i = w.i + 1)
), {name}_left AS (
  SELECT g, unnest(held) AS key FROM {name}_walk QUALIFY i = max(i) OVER (PARTITION BY g)
), {name} AS (
  SELECT g, key, row_number() OVER (PARTITION BY g ORDER BY phase, i, h, key) - 1 AS place
  FROM (SELECT g, o AS key, 0 AS phase, i, '' AS h FROM {name}_walk WHERE o IS NOT NULL UNION ALL SELECT g, key, 1, 0, md5(key || '|0|1337') FROM {name}_left)
)"""


_HEAP = """p AS (SELECT key, num_frames, CAST((row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 256 AS BIGINT) AS shard_idx FROM utt
), r AS (
  SELECT key, shard_idx, num_frames AS n, row_number() OVER (PARTITION BY shard_idx ORDER BY key) AS i FROM p WHERE num_frames BETWEEN 0 AND 400000
), heap AS (
  SELECT DISTINCT shard_idx, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(n BIGINT, i BIGINT, key VARCHAR)[]) AS h, CAST(NULL AS STRUCT(n BIGINT, i BIGINT, key VARCHAR)) AS o FROM r
  UNION ALL
  SELECT shard_idx, i, CASE WHEN len(g) = 64 THEN g[2:] ELSE g END, CASE WHEN len(g) = 64 THEN g[1] END
  FROM (SELECT r.shard_idx, r.i, list_sort(list_append(h, {'n': r.n, 'i': r.i, 'key': r.key})) AS g FROM heap JOIN r ON r.shard_idx = heap.shard_idx AND r.i = heap.i + 1)
), left_over AS (
  SELECT shard_idx, unnest(h) AS o FROM heap QUALIFY i = max(i) OVER (PARTITION BY shard_idx)
), q AS (
  SELECT shard_idx, o.key AS key, o.n AS n, row_number() OVER (PARTITION BY shard_idx ORDER BY phase, step, o.n, o.i) AS j
  FROM (SELECT shard_idx, o, 0 AS phase, i AS step FROM heap WHERE o IS NOT NULL UNION ALL SELECT shard_idx, o, 1, 0 FROM left_over)
), walk AS (
  SELECT shard_idx, j, key, CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS place, n AS longest FROM q WHERE j = 1
  UNION ALL
  SELECT q.shard_idx, q.j, q.key, CASE WHEN full_ THEN w.batch_id + 1 ELSE w.batch_id END, CASE WHEN full_ THEN 0 ELSE w.place + 1 END, CASE WHEN full_ THEN q.n ELSE greatest(w.longest, q.n) END
  FROM walk w JOIN q ON q.shard_idx = w.shard_idx AND q.j = w.j + 1, LATERAL (SELECT (w.place + 2) * greatest(w.longest, q.n) > 1600000 AS full_)
)
SELECT shard_idx, key, batch_id, place FROM walk"""
_REC_ERRORS = f"WITH {UTT}, {REC}, e AS (SELECT language_tag, key, n, len(list_filter(range(0, n), lambda i: i % 60 IN (10, 30, 50))) AS d FROM rec)"

ORACLE_SQL: dict[str, str] = {
    "sv_eer_mindcf": f"""WITH {EMB}, {_both('emb', '20 * (SELECT count(*) FROM emb)')}, {_SCORED}, one AS (SELECT 1 AS g, * FROM scored), {_rates('one', 'g', '"left", "right"')}
SELECT round(eer, 9) AS eer, round(eer_threshold, 9) AS eer_threshold, round(mdc, 9) AS mdc, round(mdc_threshold, 9) AS mdc_threshold, CAST(0 AS BIGINT) AS n_missing, status FROM rates""",
    "eer_by_group": f"""WITH {LABELLED}, {_rates('s', 'lang', 'doc_id')}
SELECT lang, round(eer, 9) AS eer, round(eer_threshold, 9) AS eer_threshold, round(mdc, 9) AS mdc, round(mdc_threshold, 9) AS mdc_threshold, status FROM rates""",
    "sv_scores": f"""WITH {EMB}, {_both('emb', '20 * (SELECT count(*) FROM emb)')}, flat AS (SELECT key, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS d FROM emb),
st AS (SELECT d, avg(CAST(x AS DOUBLE)) AS m, stddev_samp(CAST(x AS DOUBLE)) AS s FROM flat GROUP BY d),
cen AS (SELECT key, list((x - m) / (s + 1e-12) ORDER BY d) AS v FROM flat JOIN st USING (d) GROUP BY key)
SELECT "left", "right", CAST(same_speaker AS INTEGER) AS y, round(least(greatest((list_cosine_similarity(a.v, b.v) + 1) / 2, 0), 1), 6) AS score
FROM t JOIN cen a ON a.key = "left" JOIN cen b ON b.key = "right" """,
    "score_describe": f"""WITH {LABELLED}, l AS (SELECT 'y' AS col, CAST(y AS DOUBLE) AS v FROM s UNION ALL SELECT 'score', score FROM s)
SELECT col, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max FROM l GROUP BY col""",
    "embedding_center_stats": """SELECT CAST(d AS INTEGER) AS d, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(x AS DOUBLE)), 6) AS std
FROM (SELECT unnest(embedding) AS x, unnest(range(0, len(embedding))) AS d FROM embeddings) GROUP BY d""",
    "top1_accuracy": f"""WITH {EMB} SELECT gender, round(avg(CAST(list_position(embedding, list_max(embedding)) - 1 = vec_id % 64 AS INTEGER)), 9) AS accuracy, count(*) AS n FROM emb GROUP BY gender""",
    "frame_pooling": f"""WITH {EMB} SELECT key, CAST(d % 16 AS INTEGER) AS d, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT key, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS d FROM emb) GROUP BY key, d % 16""",
    "manifest_build": f"WITH {UTT} SELECT * EXCLUDE (doc_id) FROM utt",
    "manifest_keys": f"""WITH {UTT} SELECT key, split_part(key, '/', 1) AS dataset, split_part(key, '/', 2) AS speaker, split_part(key, '/', 3) AS recording, split_part(key, '/', 4) AS utterance,
CAST(split_part(key, '/', 2) AS BIGINT) AS speaker_number, key AS found_key FROM utt""",
    "manifest_violations": f"""WITH {UTT}, d AS (SELECT doc_id, num_frames // 160 AS n, speaker_id, recording_id, key FROM utt)
SELECT rule, n FROM (
  SELECT 'sample_rate' AS rule, count(*) AS n FROM d WHERE n % 11 = 0 UNION ALL SELECT 'gender', count(*) FROM d WHERE n % 13 = 0
  UNION ALL SELECT 'key_format', count(*) FROM d WHERE n % 17 = 0 UNION ALL SELECT 'speaker_id', count(*) FROM d WHERE n % 17 = 0
  UNION ALL SELECT 'num_frames_positive', count(*) FROM d WHERE n <= 0
  UNION ALL SELECT 'duplicate_path', CASE WHEN count(*) > 1 THEN 1 ELSE 0 END FROM d WHERE n % 19 = 0
) WHERE n > 0""",
    "filter_samples": f"""WITH {UTT} SELECT key, num_frames, language_tag FROM utt WHERE transcription <> '' AND language_tag IN ('en', 'fr') AND num_frames < 400000 AND length(transcription) < 3000 AND num_frames BETWEEN 16000 AND 300000""",
    "filter_by_set": f"""WITH {UTT} SELECT key, CASE WHEN gender = 'm' THEN 'clean' ELSE 'other' END AS set_name FROM utt WHERE gender = 'f' OR (transcription <> '' AND language_tag IN ('en', 'fr'))""",
    "trial_membership": f"""WITH {EMB}, {_both('emb', '1 * (SELECT count(*) FROM emb)')} SELECT key, label FROM emb WHERE key IN (SELECT "left" FROM t UNION SELECT "right" FROM t)""",
    "speaker_lookup": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE lang END AS lang, quality, CASE WHEN l.doc_id IS NULL THEN 'unmatched' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "transcript_lookup": f"""WITH {UTT} SELECT key, CASE WHEN num_frames % 3 <> 0 THEN transcription END AS transcription, CASE WHEN num_frames % 3 <> 0 THEN language_tag END AS language_tag FROM utt""",
    "metadata_tidy": """SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '"MALE"' ELSE 'F' END AS sex, 'sw' AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender FROM customer""",
    "language_tags": """SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE lang || '-US' END AS language_tag FROM documents""",
    "corpus_stats": _stats(),
    "corpus_stats_by_lang": _stats("language_tag"),
    "corpus_rollup": f"""WITH {UTT} SELECT language_tag, gender, CAST(GROUPING(language_tag, gender) AS BIGINT) AS level, count(*) AS samples, CAST(sum(num_frames) AS BIGINT) AS frames_total, round(sum(num_frames) / 16000.0 / 3600.0, 6) AS hours_total FROM utt GROUP BY ROLLUP (language_tag, gender)""",
    "stats_report": f"""WITH r AS ({_stats()}) """ + " UNION ALL ".join(
        f"SELECT '{c}' AS statistic, " + (f"format('{{:,.2f}}', {c})" if "_avg" in c or "_q" in c or c in ("seconds_total", "hours_total") else f"CAST({c} AS VARCHAR)") + " AS value FROM r" for c in _STATISTICS
    ),
    "char_vocab": f"WITH {UTT}, {_SPECIALS}, {_CHARS}, {_VOCAB} SELECT CAST(idx AS BIGINT) AS idx, char FROM voc",
    "char_distribution": f"WITH {UTT}, {_SPECIALS}, {_CHARS}, {_DIST} SELECT char, round(freq, 6) AS freq FROM dist",
    "class_prior": f"""WITH {UTT}, {_SPECIALS}, {_CHARS}, {_VOCAB}, {_DIST} SELECT CAST(idx AS INTEGER) AS idx, CASE WHEN idx = 0 THEN 0.25 ELSE round(freq, 6) END AS freq FROM voc JOIN dist USING (char)""",
    "speaker_map": f"WITH {UTT} SELECT {_SPEAKERS} AS idx, speaker_id, min(gender) AS gender, count(DISTINCT gender) AS n_genders FROM utt GROUP BY speaker_id",
    "label_encoding": f"WITH {UTT}, m AS (SELECT speaker_id, {_SPEAKERS} AS label FROM utt WHERE gender = 'm' GROUP BY speaker_id) SELECT key, speaker_id, label FROM utt JOIN m USING (speaker_id)",
    "vocabulary_json": f"WITH {UTT}, {_SPECIALS}, {_CHARS}, {_VOCAB}, {_pieces(characters='SELECT idx, char AS v, NULL AS k FROM voc', char_to_idx='SELECT idx, idx AS v, char AS k FROM voc', idx_to_char='SELECT idx, char AS v, idx AS k FROM voc')}",
    "speaker_map_document": f"""WITH {UTT}, spk AS (
      SELECT {_SPEAKERS} AS idx, speaker_id, min(gender) FILTER (CAST(substr(speaker_id, 4) AS INTEGER) % 3 > 0) AS gender FROM utt GROUP BY speaker_id
    ), {_pieces(speakers='SELECT idx, speaker_id AS v, NULL AS k FROM spk', speaker_to_idx='SELECT idx, idx AS v, speaker_id AS k FROM spk', idx_to_speaker='SELECT idx, speaker_id AS v, idx AS k FROM spk', gender='SELECT idx, gender AS v, speaker_id AS k FROM spk WHERE gender IS NOT NULL')}""",
    "encode_text": f"""WITH {UTT}, {_SPECIALS}, ch AS (SELECT unnest(string_split(transcription, '')) AS char FROM utt WHERE transcription <> '' AND language_tag = 'en'), {_VOCAB},
p AS (SELECT key, unnest(string_split(transcription, '')) AS c, unnest(range(0, length(transcription))) AS i FROM utt WHERE transcription <> ''),
e AS (SELECT key, string_agg(CAST(CASE WHEN c = ' ' THEN 4 ELSE coalesce(idx, 3) END AS VARCHAR), ' ' ORDER BY i) AS codes FROM p LEFT JOIN voc ON c = char GROUP BY key)
SELECT key, coalesce(codes, '') AS codes FROM utt LEFT JOIN e USING (key)""",
    "split_by_speaker": f"WITH {UTT}, {_split('utt', 'speaker_id', '0.13', 1337)} SELECT key, is_split FROM utt JOIN flag ON speaker_id = g",
    "split_by_recording": f"WITH {UTT}, {_split('utt', 'recording_id', '0.3', 7)} SELECT key, is_split FROM utt JOIN flag ON recording_id = g",
    "split_balanced": f"""WITH {UTT}, c AS (SELECT speaker_id AS s, gender AS g, count(*) AS n FROM utt GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(s || '|1337'), s) AS step FROM c),
st AS (SELECT step, sum(n) AS n FROM r GROUP BY step HAVING count(*) = 2), o AS (SELECT step, sum(n) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) - n AS before FROM st),
pick AS (SELECT s FROM r JOIN o USING (step) WHERE before < 0.3 * (SELECT count(*) FROM utt))
SELECT key, speaker_id IN (SELECT s FROM pick) AS is_split FROM utt""",
    "split_orders_by_customer": f"""WITH {_split('orders', 'o_custkey', '0.05', 1337).replace("g || '|1337'", "CAST(g AS VARCHAR) || '|1337'")} SELECT is_split, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN flag ON o_custkey = g GROUP BY is_split""",
    "demux_rows": f"""WITH {UTT}, n AS (SELECT key, speaker_id, CAST(split_part(speaker_id, '/', 2) AS INTEGER) AS k FROM utt) SELECT key, speaker_id, CAST(CASE WHEN k % 4 = 0 THEN 1 WHEN k % 3 = 0 THEN 0 END AS INTEGER) AS split_idx FROM n""",
    "manifest_violation_rows": f"""WITH {UTT}, d AS (
  SELECT num_frames // 160 AS n, CASE WHEN num_frames // 160 % 17 = 0 THEN 'xx' || key ELSE key END AS key, CASE WHEN num_frames // 160 % 19 = 0 THEN 'same.wav' ELSE path END AS path FROM utt
)
SELECT 'sample_rate' AS rule, key, path AS detail FROM d WHERE n % 11 = 0 UNION ALL SELECT 'gender', key, path FROM d WHERE n % 13 = 0
UNION ALL SELECT 'key_format', key, path FROM d WHERE n % 17 = 0 UNION ALL SELECT 'speaker_id', key, path FROM d WHERE n % 17 = 0
UNION ALL SELECT 'duplicate_path', min(key), CAST(count(*) AS VARCHAR) FROM d GROUP BY path HAVING count(*) > 1""",
    "demux_routes": f"""WITH {UTT}, n AS (SELECT CAST(split_part(speaker_id, '/', 2) AS INTEGER) AS k FROM utt) SELECT CAST(CASE WHEN k % 4 = 0 THEN 1 WHEN k % 3 = 0 THEN 0 END AS INTEGER) AS split_idx, count(*) AS n FROM n GROUP BY 1""",
    "split_overlap": f"WITH {UTT}, {_split('utt', 'speaker_id', '0.2', 1337)}, f AS (SELECT recording_id, is_split FROM utt JOIN flag ON speaker_id = g) SELECT recording_id FROM f WHERE is_split INTERSECT SELECT recording_id FROM f WHERE NOT is_split",
    "shard_random": f"""WITH {UTT}, p AS (SELECT key, CAST((row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 128 AS BIGINT) AS shard_idx FROM utt), n AS (SELECT shard_idx, count(*) AS n FROM p GROUP BY 1)
SELECT key, shard_idx, n < (SELECT max(n) FROM n) AS partial_shard FROM p JOIN n USING (shard_idx)""",
    "shard_length_sorted": f"""WITH {UTT}, p AS (SELECT num_frames, CAST((row_number() OVER (ORDER BY num_frames, key) - 1) // 128 AS BIGINT) AS shard_idx FROM utt), n AS (SELECT shard_idx, count(*) AS n, min(num_frames) AS shortest, max(num_frames) AS longest FROM p GROUP BY 1)
SELECT shard_idx, n < (SELECT max(n) FROM n) AS partial_shard, n, shortest, longest FROM n""",
    "shard_single": f"WITH {UTT} SELECT key, CAST(0 AS BIGINT) AS shard_idx, false AS partial_shard FROM utt",
    "shard_lineitem": """WITH k AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, CAST(l_quantity AS BIGINT) AS nf FROM lineitem),
p AS (SELECT key, CAST((row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 5000 AS BIGINT) AS shard_idx FROM k), n AS (SELECT shard_idx, count(*) AS n, min(key) AS first_key FROM p GROUP BY 1)
SELECT shard_idx, n < (SELECT max(n) FROM n) AS partial_shard, n, first_key FROM n""",
    "worker_shards": """WITH f AS (SELECT 'shard.' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.tar' AS path FROM part), r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM f)
SELECT path, CAST(i % 7 AS INTEGER) AS worker FROM r WHERE i < (SELECT count(*) // 7 * 7 FROM f)""",
    "trials_positive": f"""WITH {EMB}, {_pairs('emb', '5 * (SELECT count(*) FROM emb)', 'pos')} SELECT *, true AS same_speaker FROM pairs_pos""",
    "trials_positive_overlap": f"""WITH {EMB}, {_pairs('emb', '5 * (SELECT count(*) FROM emb)', 'over')} SELECT *, true AS same_speaker FROM pairs_over""",
    "trials_negative": f"""WITH {EMB}, {_pairs('emb', '5 * (SELECT count(*) FROM emb)', 'neg')} SELECT *, false AS same_speaker FROM pairs_neg""",
    "trials_capped": f"""WITH {UTT}, src AS (SELECT key, speaker_id AS spk, speaker_id || '/' || split_part(key, '/', 3) AS ses, gender FROM utt), {_both('src', '2 * (SELECT count(*) FROM utt)', False)}
SELECT "left" || ' ' || "right" || ' ' || CAST(same_speaker AS INTEGER) AS line, same_speaker FROM t""",
    "wer_corpus": f"{_REC_ERRORS} SELECT CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS ref_words, round(sum(d) / sum(n), 6) AS wer FROM e",
    "wer_by_lang": f"{_REC_ERRORS} SELECT language_tag, CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS ref_words, round(sum(d) / sum(n), 6) AS wer FROM e GROUP BY language_tag",
    "wer_batches": f"{_REC_ERRORS} SELECT language_tag, round(avg(r), 6) AS wer_mean, count(*) AS batches FROM (SELECT language_tag, substr(md5(key), 1, 2) AS b, sum(d) / nullif(sum(n), 0) AS r FROM e GROUP BY ALL) GROUP BY language_tag",
    "ctc_greedy": f"""WITH {EMB}, f AS (SELECT key, i, list_position(embedding[i * 8 + 1:i * 8 + 8], list_max(embedding[i * 8 + 1:i * 8 + 8])) - 1 AS b FROM (SELECT key, embedding, unnest(range(0, vec_id % 9)) AS i FROM emb)),
k AS (SELECT key, i, b FROM (SELECT *, lag(b) OVER (PARTITION BY key ORDER BY i) AS p FROM f) WHERE (p IS NULL OR p <> b) AND b <> 0),
o AS (SELECT key, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY i) AS indices, string_agg(CASE WHEN b >= 4 THEN [' ', 'a', 'b', 'c'][b - 3] ELSE '' END, '' ORDER BY i) AS text FROM k GROUP BY key)
SELECT emb.key AS sample_id, coalesce(indices, '') AS indices, coalesce(trim(text), '') AS text FROM emb LEFT JOIN o ON emb.key = o.key""",
    "chunk_start": f"WITH {EMB} SELECT key, CAST(0 AS BIGINT) AS chunk_idx, CAST(20 AS BIGINT) AS num_frames, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[20] AS DOUBLE), 6) AS last FROM emb",
    "chunk_random": f"""WITH {EMB}, r AS (SELECT *, CAST('0x' || substr(md5(key || '|0|0'), 1, 8) AS BIGINT) % 45 AS s FROM emb)
SELECT key, CAST(0 AS BIGINT) AS chunk_idx, CAST(20 AS BIGINT) AS num_frames, round(CAST(embedding[s + 1] AS DOUBLE), 6) AS first, round(CAST(embedding[s + 20] AS DOUBLE), 6) AS last FROM r""",
    "chunk_contiguous": f"WITH {EMB} SELECT key, c AS chunk_idx, CAST(20 AS BIGINT) AS num_frames, round(CAST(embedding[c * 20 + 1] AS DOUBLE), 6) AS first, round(CAST(embedding[c * 20 + 20] AS DOUBLE), 6) AS last FROM (SELECT key, embedding, unnest(range(0, 3)) AS c FROM emb)",
    "batch_fixed": f"""WITH {UTT}, b AS (SELECT key, CAST(doc_id // 256 AS BIGINT) AS shard_idx FROM utt), r AS (SELECT key, shard_idx, (row_number() OVER (PARTITION BY shard_idx ORDER BY key) - 1) // 16 AS batch_id, count(*) OVER (PARTITION BY shard_idx) AS n FROM b)
SELECT key, shard_idx, CAST(batch_id AS BIGINT) AS batch_id FROM r WHERE (batch_id + 1) * 16 <= n""",
    "batch_padded": f"""WITH {EMB}, s AS (SELECT key, vec_id % 4 AS shard_idx, least(len(embedding), 5 + len(embedding) % 7 + vec_id % 4) AS n, label FROM emb),
b AS (SELECT *, CAST((row_number() OVER (PARTITION BY shard_idx ORDER BY key) - 1) // 8 AS BIGINT) AS batch_id FROM s)
SELECT shard_idx, batch_id, CAST(count(*) AS INTEGER) AS batch_size, string_agg(key, ',' ORDER BY key) AS keys, CAST(max(n) AS INTEGER) AS width, CAST(sum(label) AS BIGINT) AS label_sum FROM b GROUP BY ALL""",
    "zip_cycle": """WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
SELECT step, s_suppkey, p_partkey FROM (SELECT unnest(range(0, 2 * (SELECT count(*) FROM part))) AS step) s JOIN a ON a.i = step % a.n JOIN b ON b.i = step % b.n""",
    "call_sentences": f"""WITH {TOK} SELECT file_id, channel, sentence_no, start_s, end_s, text FROM sent WHERE start_s >= 0 AND end_s - start_s BETWEEN 3 AND 20 AND contains(trim(text), ' ') AND NOT contains(trim(text), '-')""",
    "call_min_sessions": f"""WITH {TOK}, s AS (SELECT DISTINCT file_id % 20 AS speaker_id, file_id AS recording_id FROM tok) SELECT * FROM s WHERE speaker_id IN (SELECT speaker_id FROM s GROUP BY 1 HAVING count(*) >= 3)""",
    "call_cleaning": f"SELECT conv_id, turn, {_clean_call('text')} AS clean FROM conversations",
    "hub5_normalise": f"SELECT conv_id, turn, sha1({_annotations('text')}) AS digest FROM conversations",
    "segment_spans": f"""WITH {TOK}, r AS (SELECT file_id, CAST(max(end_s) * 16000 - 4000 AS BIGINT) AS num_frames FROM sent GROUP BY 1), f AS (SELECT s.*, num_frames, CAST(floor(start_s * 16000) AS BIGINT) AS start_frame, CAST(ceil(end_s * 16000) AS BIGINT) AS end_frame FROM sent s JOIN r USING (file_id))
SELECT file_id, channel, sentence_no, start_frame, end_frame, start_frame >= 0 AND end_frame > start_frame AND end_frame <= num_frames AS inside FROM f""",
    "file_triplets": """SELECT p_partkey AS file_id, p_partkey || '.wav' AS wav, p_partkey || '.txt' AS txt, p_partkey || '.mrk' AS mrk FROM part WHERE p_size % 5 <> 0""",
    "cached_enrichment": "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'cached' ELSE md5(text) END AS text, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'und' END AS language FROM documents",
    "merged_transcripts": "SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 'later' ELSE md5(text) END AS text, lang AS language FROM documents",
    "checksums": "SELECT page_id AS name, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 11 = 0 THEN 'differs' ELSE 'ok' END AS status FROM pages",
    "step_rollup": f"WITH {TEL} SELECT run, metric, CAST(ceil(step / 1000) * 1000 AS BIGINT) AS at_step, round(avg(value), 6) AS mean, count(*) AS n FROM tel GROUP BY ALL",
    "agreement_rollup": f"""WITH {TEL}, v AS (SELECT run, metric, step, CASE WHEN step % 97 <> 0 THEN value - 50 END AS v FROM tel)
SELECT run, metric, CAST(ceil(step / 1000) * 1000 AS BIGINT) AS at_step, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(avg(CAST(v > 0 AS INTEGER)), 6) AS positive_share, count(*) FILTER (v IS NULL) AS n_nan FROM v GROUP BY ALL""",
    "magnitude_rollup": f"WITH {TEL} SELECT run, metric, CAST(ceil(step / 500) * 500 AS BIGINT) AS at_step, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM tel GROUP BY ALL",
    "loss_weight_replay": f"""WITH {TEL}, l AS (SELECT run, step, value + 1 AS a, abs(value - 30) + 1 AS b FROM tel),
w AS (SELECT *, count(*) OVER x AS n, avg(a) OVER y / avg(a) OVER z AS ra, avg(b) OVER y / avg(b) OVER z AS rb FROM l
  WINDOW x AS (PARTITION BY run ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY run ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), z AS (PARTITION BY run ORDER BY step ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING))
SELECT run, step, round(CASE WHEN n = 10 THEN 2 * exp(ra / 2) / (exp(ra / 2) + exp(rb / 2)) ELSE 1.0 END, 6) AS weight_a, round(CASE WHEN n = 10 THEN 2 * exp(rb / 2) / (exp(ra / 2) + exp(rb / 2)) ELSE 1.0 END, 6) AS weight_b, round(least(a, b) / a, 6) AS min_a, round(greatest(a, b) / b, 6) AS max_b FROM w""",
    "best_run": f"WITH {TEL} SELECT run, step, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, step) AS k FROM tel WHERE metric = 'purchase') WHERE k = 1",
    "stream_stats": f"""WITH {UTT} SELECT language_tag, count(*) AS samples, count(*) FILTER (gender = 'm') AS samples_m, count(*) FILTER (gender = 'f') AS samples_f,
  CAST(sum(num_frames) AS BIGINT) AS frames_total, min(num_frames) AS frames_min, max(num_frames) AS frames_max, round(avg(num_frames), 6) AS frames_avg, CAST(sum(length(transcription)) AS BIGINT) AS transcript_total,
  CAST(min(length(transcription)) AS BIGINT) AS transcript_min, CAST(max(length(transcription)) AS BIGINT) AS transcript_max, round(avg(length(transcription)), 6) AS transcript_avg FROM utt GROUP BY language_tag""",
    "stream_sketches": "SELECT DISTINCT lang AS language_tag, " + ", ".join(f"true AS {c}" for c in ("speakers", "speaker_sessions", *(f"{n}_q{q}" for n in ("frames", "transcript") for q in (10, 20, 80, 90)))) + " FROM documents",
    "stream_buckets": f"WITH RECURSIVE {UTT}, {_HEAP}",
    "batch_max_tokens": f"WITH RECURSIVE {UTT}, {_HEAP}",
    "stream_enrichment": "SELECT doc_id AS key, md5(text) AS digest FROM documents",
    "stream_shards": f"""WITH {UTT}, p AS (SELECT *, (row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 128 AS shard_idx, count(*) OVER () AS total FROM utt)
SELECT key, speaker_id AS speaker, 'train.' || lpad(CAST(shard_idx AS VARCHAR), 6, '0') || CASE WHEN total > 128 AND total % 128 <> 0 AND shard_idx = total // 128 THEN '.partial' ELSE '' END || '.tar' AS name, md5(transcription) AS content, num_frames FROM p""",
    "stream_char_counts": f"WITH {UTT}, {_CHARS} SELECT char, count(*) AS n FROM ch GROUP BY char",
    "stream_dedupe": f"""WITH {UTT} SELECT speaker_id, count(*) + count(*) FILTER (doc_id % 20 = 3) AS firsts, count(*) AS keys, count(*) FILTER (doc_id % 10 = 7) AS duplicates, 1200 * count(*) FILTER (doc_id % 10 = 7) AS seconds FROM utt GROUP BY speaker_id""",
    "stream_windows": f"WITH {TEL} SELECT strftime(ts, '%Y-%m-%d') AS day, metric, round(avg(value), 6) AS mean, count(*) AS n FROM tel GROUP BY ALL",
}


_TASK = """sam AS (
  SELECT key, vec_id // 256 AS shard_idx, 'vc1/id' || label AS speaker_id, label, gender, embedding, translate(substr(md5(key), 1, CAST(vec_id % 20 + 1 AS BIGINT)), '0123456789', 'ghijklmnop') AS transcription FROM emb
), ranked AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY shard_idx ORDER BY md5(key || '|0|1337'), key) - 1) // 8 AS BIGINT) AS batch_id FROM sam
)"""
_TASK_CODES = """chars AS (SELECT key, unnest(string_split(transcription, '')) AS char FROM sam),
voc AS (SELECT char, 4 + row_number() OVER (ORDER BY char) AS idx FROM (SELECT DISTINCT char FROM chars)),
code AS (SELECT key, sum(idx) AS codes FROM chars JOIN voc USING (char) GROUP BY key)"""
_TASK_LABELS = "lab AS (SELECT speaker_id, row_number() OVER (ORDER BY CAST(regexp_extract(speaker_id, '/(?:id)?(\\d+)$', 1) AS BIGINT), speaker_id) - 1 AS label_idx FROM (SELECT DISTINCT speaker_id FROM sam))"
_BATCH_HEAD = "shard_idx, batch_id, CAST(count(*) AS INTEGER) AS batch_size, md5(string_agg(key, ',' ORDER BY key)) AS keys"
_TEXT = "CAST(max(length(transcription)) AS INTEGER) AS text_width, CAST(sum(codes) AS BIGINT) AS code_sum"

ORACLE_SQL |= {
    "manifest_files": f"WITH {UTT} SELECT * EXCLUDE (doc_id) FROM utt",
    "manifest_required": f"WITH {UTT} SELECT 'required_gender' AS rule, key FROM utt WHERE num_frames % 3200 = 0",
    "clean_transcripts": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^ ''a-z]', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""",
    "shard_plan_file": ORACLE_SQL["shard_random"],
    "trials_file": f"""WITH {EMB}, {_both('emb', '(SELECT count(*) FROM emb)')} SELECT "left", "right", same_speaker FROM t""",
    "trials_file_bad_lines": "SELECT 'vc1/' || p_partkey || ' vc1/' || p_size || ' ' || (p_partkey % 3) AS value FROM part WHERE p_partkey % 3 = 2",
    "trials_converted": """SELECT 'vc1/id' || p_partkey || '/x' AS "left", 'vc1/id' || p_size || '/y' AS "right", p_partkey % 2 = 1 AS same_speaker FROM part
UNION ALL SELECT 'sre08/unk/unk/s' || p_partkey, 'sre08/unk/unk/s' || p_size, p_partkey % 2 = 1 FROM part""",
    "split_complement": f"WITH {UTT}, {_split('utt', 'speaker_id', '0.13', 1337)} SELECT key FROM utt JOIN flag ON speaker_id = g WHERE NOT is_split",
    "shard_samples": f"""WITH {UTT}, p AS (SELECT *, CAST((row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 128 AS BIGINT) AS shard_idx, count(*) OVER () AS total FROM utt)
SELECT key, shard_idx, total > 128 AND total % 128 <> 0 AND shard_idx = total // 128 AS partial_shard, num_frames, speaker_id, md5(transcription) AS content, transcription FROM p""",
    "shard_samples_of_speakers": f"""WITH {UTT}, p AS (SELECT *, (row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 128 AS shard_idx, count(*) OVER () AS total FROM utt)
SELECT key, gender FROM p WHERE gender = 'm' AND NOT (total > 128 AND total % 128 <> 0 AND shard_idx = total // 128)""",
    "shard_list": f"""WITH {UTT}, n AS (SELECT count(*) AS total FROM utt)
SELECT 'train.' || lpad(CAST(i AS VARCHAR), 6, '0') || CASE WHEN total > 128 AND total % 128 <> 0 AND i = total // 128 THEN '.partial' ELSE '' END || '.tar' AS name FROM (SELECT total, unnest(range(0, (total + 127) // 128)) AS i FROM n)""",
    "librispeech_speakers": """SELECT CAST(s_suppkey AS INTEGER) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 'train' AS subset, CAST(s_suppkey % 40 + 0.5 AS DOUBLE) AS minutes, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0""",
    "voxceleb_metadata": """SELECT 'id' || c_custkey AS voxceleb_id, c_name AS vggface_id, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender, CAST(c_nationkey AS VARCHAR) AS nationality, 'dev' AS "set", 'vox1' AS dataset FROM customer""",
    "caller_table": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS pin, " + ", ".join(f"'v{i}' AS {n}" for i, n in enumerate(("target", "sex", "birth_year", "dialect_area", "education", "ti", "payment_type", "amt_pd", "con", "remarks", "calls_deleted"))) + ", CAST(c_nationkey AS VARCHAR) AS speaker_partition FROM customer",
    "utterance_transcripts": f"WITH {UTT} SELECT split_part(key, '/', 2) || '-' || split_part(key, '/', 3) || '-' || split_part(key, '/', 4) AS utterance_id, transcription AS text FROM utt",
    "session_transcripts": r"SELECT 's' || (conv_id % 10) AS speaker, 'c' || conv_id AS session, lpad(CAST(turn AS VARCHAR), 6, '0') AS utterance, translate(text, chr(10) || chr(13) || chr(9), '   ') AS text FROM conversations",
    "single_transcripts": r"""SELECT 'en_' || conv_id AS recording, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS channel, lpad(CAST(turn AS VARCHAR), 4, '0') AS utterance, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text,
  'hub5/hub5_en_' || conv_id || CASE WHEN role = 'user' THEN '_A' ELSE '_B' END AS speaker_id FROM conversations""",
    "markup_files": r"""WITH w AS (
  SELECT conv_id, turn, role, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM (SELECT conv_id, turn, role, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations)
), l AS (
  SELECT CAST(conv_id AS VARCHAR) AS file_id, turn, i, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END || '.' || turn || ' ' || CAST(turn * 100 + i * CAST(0.5 AS DOUBLE) AS VARCHAR) || ' 0.5 ' || w AS value FROM w
)
SELECT file_id, count(*) AS lines, md5(string_agg(value, chr(10) ORDER BY turn, i)) AS digest FROM l GROUP BY file_id""",
    "call_headers": """WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations)
SELECT lpad(CAST(n AS VARCHAR), 4, '0') AS file_id, lpad(CAST(n + 1 AS VARCHAR), 4, '0') AS speaker_a, '1' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') AS speaker_b, NULL AS bad FROM c WHERE n % 7 <> 0
UNION ALL SELECT NULL, NULL, NULL, 'sw' || n || '.txt' FROM c WHERE n % 7 = 0""",
    "audio_inventory": "SELECT 'id' || label AS speaker, 'r' || (vec_id % 5) AS recording, CAST(vec_id AS VARCHAR) AS utterance, CAST(len(embedding) AS BIGINT) AS num_frames, CAST(16000 AS INTEGER) AS sample_rate, CAST(1 AS INTEGER) AS channels FROM embeddings WHERE label <> 3",
    "validation_dump": f"WITH {UTT} SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS index, md5(transcription) AS ref, substr(transcription, 1, 20) AS hyp FROM utt ORDER BY key LIMIT 32",
    "buffer_shuffle": f"""WITH RECURSIVE {UTT}, item AS (SELECT key, n // 256 AS g, row_number() OVER (PARTITION BY n // 256 ORDER BY key) - 1 AS i FROM (SELECT key, row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1 AS n FROM utt)), {_buffered('item', 100, 'sh')}
SELECT CAST(g AS BIGINT) AS shard_idx, key, place FROM sh""",
    "task_buffered_batches": f"""WITH RECURSIVE {EMB}, {_TASK.split('), ranked')[0]}), item AS (SELECT key, shard_idx AS g, row_number() OVER (PARTITION BY shard_idx ORDER BY key) - 1 AS i FROM sam), {_buffered('item', 50, 'sh')},
b AS (SELECT g, key, place // 8 AS batch_id FROM sh), b_item AS (SELECT DISTINCT g, CAST(batch_id AS VARCHAR) AS key, batch_id AS i FROM b), {_buffered('b_item', 5, 'bsh')}
SELECT CAST(b.g AS BIGINT) AS shard_idx, CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS batch_size, md5(string_agg(b.key, ',' ORDER BY b.key)) AS keys, min(bsh.place) AS batch_place
FROM b JOIN bsh ON b.g = bsh.g AND CAST(b.batch_id AS VARCHAR) = bsh.key GROUP BY b.g, batch_id""",
    "set_composition": """WITH c AS (SELECT c_mktsegment AS role, c_custkey AS place, c_name FROM customer), n AS (
  SELECT role, count(*) AS names, count(*) FILTER (role <> 'MACHINERY') AS paths, count(*) FILTER ((role = 'BUILDING' OR place % 3 > 0) AND role <> 'HOUSEHOLD') AS trials, role <> 'AUTOMOBILE' AS verified FROM c GROUP BY role
)
SELECT role, 'incomplete' AS rule FROM n WHERE paths < names UNION ALL SELECT role, 'name_and_path_differ' FROM n WHERE paths <> names
UNION ALL SELECT role, 'name_and_trials_differ' FROM n WHERE verified AND trials <> names UNION ALL SELECT role, 'trials_not_used' FROM n WHERE NOT verified AND trials > 0""",
    "set_evaluation": f"""WITH {EMB}, {UTT}, {_both('emb', '20 * (SELECT count(*) FROM emb)')}, {_SCORED}, sided AS (
  SELECT 'clean' AS g, * FROM scored UNION ALL SELECT 'both', * FROM scored WHERE md5("left") < '8' UNION ALL SELECT 'gap', * FROM scored WHERE md5("left") >= '8'
), {_rates('sided', 'g', '"left", "right"')}, {REC}, e AS (
  SELECT CASE WHEN language_tag = 'en' THEN 'other' ELSE 'both' END AS g, n, len(list_filter(range(0, n), lambda i: i % 60 IN (10, 30, 50))) AS d FROM rec WHERE language_tag IN ('en', 'fr')
), f AS (
  SELECT g, unnest([{{'k': 'eer', 'v': eer}}, {{'k': 'eer_threshold', 'v': eer_threshold}}, {{'k': 'mdc', 'v': mdc}}, {{'k': 'mdc_threshold', 'v': mdc_threshold}}]) AS f FROM rates
)
SELECT 'test_' || f.k || '_' || g AS key, CASE WHEN g <> 'gap' THEN round(f.v, 9) END AS value, CASE WHEN g = 'gap' THEN 'missing_embeddings' ELSE 'ok' END AS status FROM f
UNION ALL SELECT 'test_wer_' || g, round(sum(d) / sum(n), 9), 'ok' FROM e GROUP BY g""",
    "reference_segments": """SELECT CAST(conv_id + 0.5 AS DOUBLE) AS start_s, CAST(conv_id + turn + 1.25 AS DOUBLE) AS end_s, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS channel, md5(text) || ': ' || turn AS text FROM conversations""",
    "id_list": "SELECT CAST(p_partkey AS INTEGER) AS file_id FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
    "transcript_json": f"WITH {UTT} SELECT key, transcription AS text, language_tag AS language FROM utt",
    "result_series": "SELECT CAST(n_nationkey / 32 AS DOUBLE) AS eer, n_name AS weights, CAST(n_regionkey AS INTEGER) AS layer FROM nation",
    "speaker_map_lines": f"WITH {UTT} SELECT {_SPEAKERS} AS idx, speaker_id, min(gender) AS gender FROM utt GROUP BY speaker_id",
    "text_defaults": """SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 THEN coalesce(text, 'none') ELSE 'none' END) AS digest, CASE WHEN doc_id >= 10000 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 5, '0') END AS padded,
CASE WHEN doc_id >= 100000 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 6, '0') END || '.wav' AS path, CASE WHEN doc_id >= 100000 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS name FROM documents""",
    "prediction_dump": f"""WITH {UTT}, b AS (SELECT key, transcription, CAST('0x' || substr(md5(key), 1, 3) AS BIGINT) AS batch FROM utt)
SELECT key, batch, row_number() OVER (PARTITION BY batch ORDER BY key) - 1 AS "index", md5(transcription) AS ref, substr(transcription, 1, 20) AS hyp FROM b WHERE batch % 50 = 0""",
    "paired_stems": """SELECT p_partkey AS stem, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey || '.wav' END AS left_path, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey || '.txt' END AS right_path
FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 7 <> 0""",
    "swapped_callers": """SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'b' ELSE 'a' END || file_id AS speaker_a, CASE WHEN file_id % 5 = 0 THEN 'a' ELSE 'b' END || file_id AS speaker_b FROM (SELECT DISTINCT conv_id AS file_id FROM conversations)""",
    "channel_split": f"""WITH {EMB} SELECT key || '-a' AS file_id, CAST(32 AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM emb UNION ALL SELECT key || '-b', CAST(32 AS INTEGER), round(CAST(embedding[33] AS DOUBLE), 6) FROM emb""",
    "call_segments": f"""WITH {EMB} SELECT vec_id AS file_id, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS channel, CAST(4 AS INTEGER) AS n, round(CAST(embedding[32 * (vec_id % 2) + vec_id % 40 + 1] AS DOUBLE), 6) AS first FROM emb WHERE vec_id % 40 + 4 <= 32""",
    "task_speech_batches": f"WITH {EMB}, {_TASK}, {_TASK_CODES} SELECT {_BATCH_HEAD}, {_TEXT} FROM ranked JOIN code USING (key) GROUP BY shard_idx, batch_id",
    "task_speaker_batches": f"WITH {EMB}, {_TASK}, {_TASK_LABELS} SELECT {_BATCH_HEAD}, CAST(20 AS INTEGER) AS width, CAST(sum(label_idx) AS BIGINT) AS label_sum FROM ranked JOIN lab USING (speaker_id) GROUP BY shard_idx, batch_id HAVING count(*) = 8",
    "task_gender_batches": f"WITH {EMB}, {_TASK} SELECT {_BATCH_HEAD}, CAST(sum(CAST(gender = 'f' AS INTEGER)) AS BIGINT) AS label_sum FROM ranked GROUP BY shard_idx, batch_id",
    "task_joint_batches": f"WITH {EMB}, {_TASK}, {_TASK_CODES}, {_TASK_LABELS} SELECT {_BATCH_HEAD}, {_TEXT}, CAST(sum(label_idx) AS BIGINT) AS label_sum FROM ranked JOIN code USING (key) JOIN lab USING (speaker_id) GROUP BY shard_idx, batch_id",
    "batch_rules": f"""WITH {EMB}, b AS (SELECT vec_id // 256 AS s, (row_number() OVER (PARTITION BY vec_id // 256 ORDER BY key) - 1) // 8 AS b FROM emb), k AS (SELECT DISTINCT s, b FROM b)
SELECT rule, count(*) AS n FROM (SELECT unnest(CASE WHEN b % 5 = 0 THEN ['audio_count', 'key_count', 'id_count', 'id_values'] ELSE ['id_values'] END) AS rule FROM k) GROUP BY rule""",
    "batch_token_budget": f"""WITH RECURSIVE {UTT}, p AS (SELECT key, num_frames, CAST((row_number() OVER (ORDER BY md5(key || '|1337'), key) - 1) // 256 AS BIGINT) AS shard_idx FROM utt
), r AS (
  SELECT key, shard_idx, num_frames AS n, row_number() OVER (PARTITION BY shard_idx ORDER BY num_frames, key) AS i FROM p WHERE num_frames BETWEEN 0 AND 400000
), walk AS (
  SELECT shard_idx, i, key, CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS place FROM r WHERE i = 1
  UNION ALL
  SELECT r.shard_idx, r.i, r.key, CASE WHEN (w.place + 2) * r.n > 1600000 THEN w.batch_id + 1 ELSE w.batch_id END, CASE WHEN (w.place + 2) * r.n > 1600000 THEN 0 ELSE w.place + 1 END
  FROM walk w JOIN r ON r.shard_idx = w.shard_idx AND r.i = w.i + 1
)
SELECT shard_idx, key, batch_id, place FROM walk""",
    "set_checks": """WITH s AS (SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'test' ELSE 'val' END AS role, 'set' || (n_nationkey % 9) AS name, CASE WHEN n_nationkey % 6 <> 0 THEN '/data/' || n_name END AS path FROM nation)
SELECT role, rule FROM (
  SELECT role, 'name_twice' AS rule FROM s GROUP BY role, name HAVING count(*) > 1 UNION SELECT role, 'path_twice' FROM s WHERE path IS NOT NULL GROUP BY role, path HAVING count(*) > 1
  UNION SELECT role, 'incomplete' FROM s WHERE path IS NULL UNION SELECT role, 'name_and_path_differ' FROM s GROUP BY role HAVING count(name) <> count(path)
)""",
}
