"""DuckDB SQL for the operators whose whole result SQL can state."""

from __future__ import annotations

from cartwise.llm import decontaminate, licenses

#: A one-row table ``crc`` with the byte table of CRC-32 as the list ``t``.
CRC_TABLE = """crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i))"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def crc32(text: str) -> str:
    """The CRC-32 of a string's bytes, where ``t`` of ``crc`` is at hand."""
    digit = "instr('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1"
    byte = f"16 * ({digit.format(text, '2 * i + 1')}) + {digit.format(text, '2 * i + 2')}"
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda i: {byte})), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


PREFIX_TRIE = f"""
WITH {CRC_TABLE},
turns AS (
    SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv, n, {crc32('conv::VARCHAR')} % 6 AS h
    FROM (SELECT conv, count(*) AS n FROM turns GROUP BY conv), crc),
built AS (
    SELECT c.conv, b.pos, b.role, b.text FROM convs c JOIN turns b ON b.conv = c.conv - c.conv % 100 AND b.pos <= c.h
    UNION ALL
    SELECT c.conv, o.pos + 1000000, o.role, o.text FROM convs c JOIN turns o ON o.conv = c.conv AND o.pos > c.h),
whole AS (
    SELECT c.conv, coalesce(any_value(w.said), []) AS said
    FROM convs c LEFT JOIN (SELECT conv, list({{'role': role, 'text': text}} ORDER BY pos) AS said FROM built GROUP BY conv) w USING (conv)
    GROUP BY c.conv),
path AS (
    SELECT conv, d, said[:d] AS prefix, d = len(said) AS ends, coalesce(length(said[d].text), 0) AS chars
    FROM (SELECT conv, said, unnest(range(len(said) + 1)) AS d FROM whole)),
owned AS (SELECT *, min(conv) OVER (PARTITION BY d, prefix) AS node FROM path),
nodes AS (
    SELECT node, d, count(*) AS n_convs, max(chars) AS chars,
           sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
    FROM owned GROUP BY node, d),
parents AS (
    SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN owned p ON p.conv = n.node AND p.d = n.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY 1, 2),
valued AS (
    SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (node, d)),
totals AS (
    SELECT a.node, a.d, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved
    FROM valued v JOIN owned a ON a.conv = v.node AND a.d <= v.d GROUP BY 1, 2)
SELECT v.node AS conv_id, v.d AS depth, v.parent AS parent_conv_id, v.n_convs, v.n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN totals t USING (node, d)
"""

RESAMPLING = f"""
WITH {CRC_TABLE},
said AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM documents),
corpus AS (SELECT row, unnest(words) AS word FROM said),
target AS (SELECT unnest(regexp_extract_all({LOWER}, '{WORD}')) AS word FROM benchmark),
distinct_words AS (SELECT word FROM corpus UNION SELECT word FROM target),
buckets AS (SELECT word, {crc32('word')} % 10000 AS bucket FROM distinct_words, crc),
s AS (SELECT bucket, count(*) AS n FROM corpus JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (word) GROUP BY 1),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM corpus) + 10000)::DOUBLE
           / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE))) AS gain
    FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, floor(sum(gain) / count(*))::BIGINT AS weight FROM corpus JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
    SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM said LEFT JOIN weights USING (row)),
ranks AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, row) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranks USING (row)
"""

JACCARD = rf"""
WITH RECURSIVE said AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM said WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY 1, 2
"""


def _templates() -> str:
    rows = [(t, la, True) for t, la in licenses.BASE] + [(t, la, False) for la, t in licenses.TEMPLATES]
    return ", ".join(f"({i}, '{la}', {base}, '{t}')" for i, (t, la, base) in enumerate(rows))


LICENSES = f"""
WITH templates AS (SELECT id, label, base, string_split(t, ' ') AS t FROM (VALUES {_templates()}) v(id, label, base, t)),
places AS (
    SELECT id, label, base, len(t) AS size, p, t[p] AS a, t[p + 1] AS b, t[p + 2] AS c
    FROM (SELECT *, unnest(range(1, len(t) - 1)) AS p FROM templates)),
said AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
grams AS (
    SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM said WHERE len(w) >= 3)),
votes AS (SELECT DISTINCT row, id, label, base, size, i - p AS diagonal, p FROM grams JOIN places USING (a, b, c)),
exact AS (
    SELECT row, label, diagonal AS start FROM votes WHERE base GROUP BY row, id, label, size, diagonal HAVING count(*) = size - 2),
steps AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, id ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS new
    FROM (SELECT DISTINCT row, id, label, size, diagonal FROM votes WHERE NOT base)),
bands AS (SELECT *, sum(new) OVER (PARTITION BY row, id ORDER BY diagonal) AS band FROM steps),
covered AS (
    SELECT row, id, label, size, band, count(DISTINCT p + k) AS words, min(diagonal + p) - 1 AS lo, max(diagonal + p) + 1 AS hi
    FROM bands b JOIN votes v USING (row, id, label, size, diagonal), range(3) r(k) GROUP BY row, id, label, size, band),
shares AS (SELECT *, words / least(size, 40 / 0.7::DOUBLE) AS share FROM covered),
along AS (
    SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY row ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   THEN 0 ELSE 1 END AS apart
    FROM shares WHERE share >= 0.7::DOUBLE),
placed AS (SELECT *, sum(apart) OVER (PARTITION BY row ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS place FROM along),
best AS (SELECT *, max(words) OVER (PARTITION BY row, place) AS most FROM placed),
found AS (
    SELECT row, label, start, 1.0::DOUBLE AS share FROM exact
    UNION ALL SELECT row, label, NULL, 0 FROM best WHERE words = most
    UNION ALL SELECT row, NULL, NULL, least(1, share) FROM shares),
summed AS (
    SELECT row, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, max(share) AS score,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE start IS NOT NULL) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM found GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM said LEFT JOIN summed USING (row)
"""


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{decontaminate.GAP}'), lambda x: x <> '')"


def _seeds(of: str, key: str, at: str) -> str:
    masks = ", ".join(f"({i}, {list(m)})" for i, m in enumerate(decontaminate.MASKS))
    return f"""SELECT {key}, m, {at}, list_transform(offsets, lambda o: w[{at} + o + 1]) AS seed
    FROM (SELECT {key}, w, m, offsets, unnest(range(len(w) - offsets[len(offsets)])) AS {at}
          FROM {of}, (VALUES {masks}) v(m, offsets) WHERE len(w) > offsets[len(offsets)])"""


LEAST = min(m[-1] for m in decontaminate.MASKS)
CONTAMINATED = f"""
WITH said AS (SELECT row_number() OVER () AS row, doc_id, {_tokens('text')} AS w FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, w FROM (
    SELECT DISTINCT item_id, {_tokens('text')} AS w FROM benchmark) WHERE len(w) > 0),
hits AS (
    SELECT DISTINCT row, item, d - i AS diagonal
    FROM ({_seeds('said', 'row', 'd')}) JOIN ({_seeds('items', 'item', 'i')}) USING (m, seed)
    UNION
    SELECT row, item, d FROM (SELECT row, w, unnest(range(len(w))) AS d FROM said) s
    JOIN (SELECT item, w AS t FROM items WHERE len(w) <= {LEAST}) i ON s.w[d + 1:d + len(t)] = t),
compared AS (
    SELECT row, item, doc_id, item_id, diagonal, len(t) AS n_item, list_transform(range(len(t)), lambda i:
           CASE WHEN diagonal + i >= 0 AND w[diagonal + i + 1] = t[i + 1] THEN 1 ELSE 0 END) AS equal
    FROM hits JOIN said USING (row) JOIN (SELECT item, item_id, w AS t FROM items) USING (item)),
scored AS (
    SELECT *, list_sum(equal) AS n_match, list_sum(equal)::DOUBLE / n_item AS similarity,
           CASE WHEN n_item >= 20 THEN list_max(list_transform(range(n_item - 19), lambda s: list_sum(equal[s + 1:s + 20]))) ELSE 0 END AS best_stretch
    FROM compared),
kept AS (SELECT * FROM scored WHERE similarity >= 0.7::DOUBLE OR best_stretch >= 16)
SELECT doc_id, item_id, b.n_match::BIGINT AS n_match, b.n_item::BIGINT AS n_item, b.similarity AS similarity,
       greatest(0, -b.back)::BIGINT AS first_word, n_places
FROM (SELECT doc_id, item_id, max({{'n_match': n_match, 'back': -diagonal, 'n_item': n_item, 'similarity': similarity}}) AS b,
             count(DISTINCT diagonal) AS n_places
      FROM kept GROUP BY doc_id, item_id)
"""
