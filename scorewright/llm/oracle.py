"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

_MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))
             || ':' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source
), levels AS (
  -- every candidate for the number of sources that are cut off at twice their size
  SELECT k.source AS at_source, sum(CASE WHEN s.rank < k.rank THEN 0 ELSE s.weight END) AS open_weight,
         sum(CASE WHEN s.rank < k.rank THEN 2 * s.source_size ELSE 0 END) AS cut, k.rank,
         any_value(k.weight) AS weight, any_value(k.source_size) AS source_size
  FROM (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source IS NULL, source) AS rank FROM sources) k
  CROSS JOIN (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source IS NULL, source) AS rank FROM sources) s
  GROUP BY k.source, k.rank
), total AS (SELECT sum(source_size)::BIGINT AS s FROM sources),
first_open AS (
  SELECT open_weight, cut FROM levels, total
  WHERE 2 * source_size * 2 * open_weight > weight * (3 * s - 2 * cut)
  ORDER BY rank LIMIT 1
), targets AS (
  SELECT sources.source, source_size,
         CASE WHEN first_open.cut IS NULL THEN (2 * source_size)::DOUBLE
              ELSE least((2 * source_size)::DOUBLE,
                         (weight * (150 * s - 100 * cut))::DOUBLE / (100 * open_weight)::DOUBLE)
         END AS target
  FROM sources CROSS JOIN total LEFT JOIN first_open ON true
)
SELECT doc_id, size, source_size, target,
       (size * copies)::BIGINT AS taken, copies
FROM (
  SELECT docs.doc_id, size, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE
           floor(target / source_size)::BIGINT
           + (draw < target / source_size - floor(target / source_size))::BIGINT END AS copies
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
)
"""

_COPIES = r"""
WITH normalised AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS words FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       (doc_id = min(doc_id) OVER same) AS kept, sha256(words) AS text_sha256
FROM normalised
WINDOW same AS (PARTITION BY words)
"""

_LINES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), numbered AS (
  SELECT uid, doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM docs
), cut AS (
  SELECT uid, doc_id, text, nr, array_to_string(own, ' ') AS own,
         list_transform(own, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM (SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS own FROM numbered)
), quarters AS (
  SELECT uid, doc_id, text, nr, len(tokens) AS n, own,
         list_transform([0, 1, 2, 3], lambda k: len(list_filter(
           tokens[n * k // 4 + 1 : n * (k + 1) // 4], lambda t: regexp_matches(t, '\p{L}')))) AS c,
         array_to_string(tokens[1 : n // 4], ' ') AS q0,
         array_to_string(tokens[n // 4 + 1 : n * 2 // 4], ' ') AS q1,
         array_to_string(tokens[n * 2 // 4 + 1 : n * 3 // 4], ' ') AS q2,
         array_to_string(tokens[n * 3 // 4 + 1 : n], ' ') AS q3
  FROM cut WHERE len(tokens) > 0
), keyed AS (
  -- a third of a template's tokens must be constant and hold a letter
  SELECT uid, doc_id, text, nr,
         CASE WHEN 3 * list_sum(c) >= n THEN (0, n, q0, q1, q2, q3) ELSE (4, n, own, '', '', '') END AS key
  FROM quarters
  UNION ALL SELECT uid, doc_id, text, nr, (1, n, q0, '', q2, q3)
  FROM quarters WHERE n >= 8 AND 3 * (list_sum(c) - c[2]) >= n
  UNION ALL SELECT uid, doc_id, text, nr, (2, n, q0, q1, '', q3)
  FROM quarters WHERE n >= 8 AND 3 * (list_sum(c) - c[3]) >= n
  UNION ALL SELECT uid, doc_id, text, nr, (3, n, q0, q1, q2, '')
  FROM quarters WHERE n >= 8 AND 3 * (list_sum(c) - c[4]) >= n
), recurring AS (
  SELECT key, min(doc_id) AS first FROM keyed GROUP BY key HAVING count(DISTINCT text) >= 5
), dropped AS (
  SELECT DISTINCT uid, nr FROM keyed JOIN recurring USING (key) WHERE doc_id > first
), kept AS (
  SELECT uid, string_agg(line, chr(10) ORDER BY nr) AS words
  FROM numbered ANTI JOIN dropped USING (uid, nr) GROUP BY uid
)
SELECT doc_id, len(lines) AS n_lines, (SELECT count(*) FROM dropped WHERE dropped.uid = docs.uid) AS n_dropped,
       sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (uid)
"""

_SPANS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), places AS (
  SELECT uid, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i,
         unnest(list_transform(range(1, len(words) + 1), lambda i:
           CASE WHEN i + 49 <= len(words) THEN array_to_string(words[i : i + 49], ' ') END)) AS passage
  FROM docs
), starts AS (
  SELECT uid, i, word,
         passage IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY passage) AS again
  FROM places
), covered AS (
  SELECT uid, i, word,
         bool_or(again) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM starts
), kept AS (
  SELECT uid, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS words
  FROM covered GROUP BY uid
)
SELECT doc_id, len(docs.words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (uid)
"""

#: What op7 puts a backslash into.
_CONTROLS = (
    "<|", "<s>", "</s>", "<SYS>", "</SYS>", "<<SYS>", "<</SYS>", "</<SYS>", "</</SYS>", "<//SYS>",
    "[INST]", "[/INST]",
)


def _escaped_length(x: str) -> str:
    parts = [f"(len({x}) - len(replace({x}, '{c}', ''))) // {len(c)}" for c in (*_CONTROLS, "\\")]
    return f"(len({x}) + {' + '.join(parts)})"


_CHATS = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nr
  FROM given
), costed AS (
  SELECT *, nr = 0 AND role = 'system' AS is_system,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS cost,
         {_escaped_length('role')} + {_escaped_length('text')} + 23 AS chars
  FROM numbered
), summed AS (
  SELECT *, sum(CASE WHEN is_system THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY nr) AS after,
         greatest(384 - max(CASE WHEN is_system THEN cost ELSE 0 END) OVER (PARTITION BY conv_id), 128) AS room
  FROM costed
), cells AS (
  SELECT *, after - CASE WHEN is_system THEN 0 ELSE cost END AS before,
         greatest(after - 1, 0) // room AS cell
  FROM summed
), crossed AS (
  SELECT *, before < cell * room AND NOT is_system AS crosses FROM cells
), started AS (
  SELECT *, nr = 0 OR crosses OR cell <> lag(cell) OVER w OR crosses <> lag(crosses) OVER w AS starts
  FROM crossed WINDOW w AS (PARTITION BY conv_id ORDER BY nr)
), repeated AS (
  SELECT s.conv_id, sum(t.chars) AS chars
  FROM started s JOIN started t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.nr < s.nr
    AND (t.is_system OR (t.after <= s.before AND t.before >= s.before - 128))
  WHERE s.starts GROUP BY s.conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr) AS turns,
         coalesce(string_agg(text, '' ORDER BY nr) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM costed GROUP BY conv_id
)
SELECT whole.conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, (whole.chars + coalesce(repeated.chars, 0))::BIGINT AS formatted_chars
FROM whole LEFT JOIN repeated ON whole.conv_id IS NOT DISTINCT FROM repeated.conv_id
"""

_DRAWN = r"""
WITH RECURSIVE bits AS (
  -- the table of crc32 for each byte: eight steps of shifting
  SELECT i::UBIGINT AS byte, i::UBIGINT AS c, 0 AS k FROM range(256) AS t(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1
  FROM bits WHERE k < 8
), crc AS (SELECT byte, c FROM bits WHERE k = 8),
given AS (
  SELECT true AS is_doc, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark
), cut AS (
  SELECT is_doc, r, doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM given
), runs AS (
  SELECT is_doc, r, unnest(w) AS f FROM cut
  UNION ALL
  SELECT is_doc, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
), counted AS (SELECT is_doc, r, f, count(*) AS n FROM runs GROUP BY ALL),
steps AS (
  SELECT f, hex(encode(f)) AS h, 4294967295::UBIGINT AS c, 0 AS k FROM (SELECT DISTINCT f FROM counted)
  UNION ALL
  SELECT f, h, xor(steps.c >> 8, crc.c), k + 1 FROM steps JOIN crc
    ON crc.byte = xor(steps.c & 255, ('0x' || substr(h, 2 * k + 1, 2))::UBIGINT)
  WHERE 2 * k < length(h)
), buckets AS (
  SELECT f, (xor(c, 4294967295::UBIGINT) % 10000)::BIGINT AS bucket FROM steps WHERE 2 * k = length(h)
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE is_doc), 0)::DOUBLE AS s,
         coalesce(sum(n) FILTER (WHERE NOT is_doc), 0)::DOUBLE AS t
  FROM counted JOIN buckets USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000))
                                 / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS gain FROM sums
), weighed AS (
  SELECT r, sum(n) AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE is_doc GROUP BY r
), scored AS (
  SELECT cut.r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut LEFT JOIN weighed ON weighed.r = cut.r WHERE is_doc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, r) AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible
  FROM scored
)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank
FROM ranked
"""

_NEGATIVES = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), pairs AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

SQL = {
    "op13_hard_negatives": _NEGATIVES,
    "op11_target_sample": _DRAWN,
    "op7_chat_windows": _CHATS,
    "op2_repeated_spans": _SPANS,
    "op1_line_templates": _LINES,
    "op3_mix_sources": _MIX,
    "op4_exact_duplicates": _COPIES,
}
