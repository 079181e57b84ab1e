"""DuckDB statements with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH RECURSIVE vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM named
"""

OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
       AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, len(s) AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
numbered AS (
  SELECT *, 15 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g'))
         AS chars,
         row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS stop FROM numbered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR n = turns THEN stop ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP7 = f"""
WITH docs AS (
  SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '{WORD}', 'w', 'g'))
         - length(regexp_replace(coalesce(text, ''), '{WORD}', '', 'g')) AS size,
         1.5 - (CASE WHEN text IS NULL THEN 0 ELSE length(regexp_replace(text, '[\\p{{L}}\\s]', '', 'g')) END)::DOUBLE
               / greatest(coalesce(length(text), 0), 1) AS quality,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS draw
  FROM documents),
keyed AS (SELECT *, -ln((draw::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / quality AS key FROM docs),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, source_size::DOUBLE * 2 AS cap,
         (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS weights,
         coalesce(sum(source_size::DOUBLE * 2) OVER before, 0) AS gone
  FROM sizes
  WINDOW before AS (ORDER BY source_size::DOUBLE * 2 / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, cap * weights <= (budget - gone) * weight AS full_up FROM ranked),
free AS (SELECT budget - gone AS rest, weights AS over FROM held WHERE NOT full_up ORDER BY cap / weight LIMIT 1),
aims AS (
  SELECT source, source_size, CASE WHEN full_up THEN cap ELSE (SELECT rest FROM free) * weight / (SELECT over FROM free) END
         AS target FROM held),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM aims),
summed AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

OP10 = """
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT n, doc_id, b, octet_length(b)::BIGINT AS size FROM docs),
windows AS (
  SELECT n, i, md5(b[i : i + 199]) AS h
  FROM (SELECT n, b, unnest(range(1, size - 198)) AS i FROM sized WHERE size >= 200)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (
  SELECT n, i, i > lag(i, 1, -1000) OVER (PARTITION BY n ORDER BY i) + 200 AS fresh
  FROM windows WHERE h IN (SELECT h FROM again)),
numbered AS (SELECT n, i, sum(fresh::INT) OVER (PARTITION BY n ORDER BY i) AS run FROM starts),
runs AS (SELECT n, min(i) AS lo, max(i) + 199 AS hi FROM numbered GROUP BY n, run),
pieces AS (
  SELECT n, lag(hi, 1, 0) OVER (PARTITION BY n ORDER BY lo) + 1 AS low, lo - 1 AS high FROM runs
  UNION ALL SELECT n, max(hi) + 1, 1000000000000 FROM runs GROUP BY n),
kept AS (
  SELECT pieces.n, unhex(string_agg(hex(b[low : least(high, size)]), '' ORDER BY low)) AS rest
  FROM pieces JOIN sized ON sized.n = pieces.n WHERE low <= least(high, size) GROUP BY pieces.n),
removed AS (SELECT n, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY n)
SELECT doc_id, size AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE coalesce(rest, ''::BLOB) END) AS kept_sha256
FROM sized LEFT JOIN removed ON removed.n = sized.n LEFT JOIN kept ON kept.n = sized.n
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS s(size)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS left_part, array_to_string(w[k + 1 : size], ' ') AS right_part
  FROM candidates, (VALUES (1), (2)) AS c(k) WHERE k < size),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = left_part JOIN counts y ON y.lang = cuts.lang AND y.phrase = right_part),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.phrase = lowest.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""

STATEMENTS = {"op1_cap_filters": OP1, "op2_ngram_jaccard": OP2, "op5_chat_examples": OP5, "op7_source_mix": OP7,
              "op10_suffix_dedup": OP10, "op13_collocations": OP13}
