"""DuckDB SQL of the operators that SQL can express."""

#: Texts equal after each run of white space became one space.
EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""

# CRC-32 of each different word, byte by byte: polynomial 0xEDB88320, as eight shifts for each byte.
_SHIFT = "CASE WHEN {x} % 2 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
_TABLE = "crc0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i)),\n" + ",\n".join(f"crc{k} AS (SELECT i, {_SHIFT.format(x='c')} AS c FROM crc{k - 1})" for k in range(1, 9)) + ",\ntab AS (SELECT list(c ORDER BY i) AS tab FROM crc8)"
_WORDS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w"

IMPORTANCE = f"""
WITH {_TABLE},
src AS (SELECT doc_id, {_WORDS} FROM documents),
tgt AS (SELECT {_WORDS} FROM benchmark),
vocab AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM src UNION SELECT w FROM tgt)),
codes AS (SELECT w, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT) AS bytes FROM vocab),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM codes, tab),
s AS (SELECT bucket, count(*) AS s FROM src JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tgt JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM src) AS ss, (SELECT count(*) FROM tgt) AS tt),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM src JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM lists, (VALUES (1), (2), (3)) v(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1 : k], ' ') AS tail FROM kept, (VALUES (1), (2)) v(j) WHERE j < k),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score,
  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a), j) AS nth
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM scored WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
