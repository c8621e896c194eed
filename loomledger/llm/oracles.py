"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from .chat import ESCAPES, Template
from .mixing import WEIGHTS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([{", ".join(map(str, WEIGHTS))}])[rank % {len(WEIGHTS)} + 1] AS weight FROM sources
), filled AS (  -- sources in the order in which a rising level fills them: the level, if all before are full
  SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER before, 0)) / sum(weight) OVER rest AS level, 2.0 * source_size / weight AS ratio
  FROM weighted
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level < ratio), 'infinity'::DOUBLE) AS level FROM filled
), targets AS (
  SELECT source, source_size, least(source_size * 2.0, weight * level)::DOUBLE AS target FROM weighted, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || md5(concat_ws(':', '0', doc_id, sized.source))[1:13])::BIGINT / 4503599627370496.0 AS coin
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (coin < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
"""

OP5 = f"""
WITH RECURSIVE numbered AS MATERIALIZED (  -- rows by their ids' order, so that those without an id count, too
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, text FROM documents
), words AS (
  SELECT r, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM numbered
), shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), classes AS (  -- equal sets are linked to their smallest id, and only that one is compared with others
  SELECT r, min(r) OVER (PARTITION BY digest) AS class FROM (SELECT r, sha256(string_agg(s, '|' ORDER BY s)) AS digest FROM shingles GROUP BY r)
), pairs AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared
  FROM (SELECT * FROM shingles WHERE r IN (SELECT class FROM classes)) x JOIN (SELECT * FROM shingles WHERE r IN (SELECT class FROM classes)) y ON x.s = y.s AND x.r < y.r
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
  UNION SELECT class, r FROM classes WHERE class < r
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, first_.doc_id AS component_id
FROM numbered d LEFT JOIN sizes USING (r) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) smallest ON smallest.a = d.r JOIN numbered first_ ON first_.r = least(d.r, smallest.b)
"""

OP6 = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents
), items AS (
  SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL
), needed AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t FROM needed
), places AS (
  SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t, unnest(range(1, len(w) - n + 2)) AS p
  FROM docs, (SELECT DISTINCT n FROM needed) WHERE len(w) >= n
), found AS (
  SELECT r, item_id, p, n FROM places JOIN windows USING (n, t)
), hits AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

_t = Template()
_SPECIAL = "[" + "".join("\\" + char for char, _ in ESCAPES) + "]"


def _written(column: str) -> str:
    """Length of a text after escaping: each reserved character becomes two."""
    return f"length({column}) + len(regexp_extract_all({column}, '{_SPECIAL}'))"


OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles,
         sum({len(_t.open_ + _t.mid + _t.close)} + {_written("role")} + {_written("text")}) + {len(_t.begin + _t.end)} AS formatted
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(listed) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS in_order
FROM chats
"""

# CRC-32, a byte at a time, of the hexadecimal digits x of a text.
_CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: 16 * instr('123456789ABCDEF', x[2 * i + 1]) + instr('123456789ABCDEF', x[2 * i + 2]))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), own AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(concat(doc_id, ':', run))) AS x FROM runs GROUP BY ALL
), crc AS (
  SELECT run, k, CASE WHEN doc_id IS NOT NULL THEN {_CRC} END AS h FROM own, tab
), mended AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM crc
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM mended WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), holes AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes AS a JOIN holes AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes AS h JOIN words AS w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes AS h JOIN words AS w ON h.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk AS w JOIN formed AS f ON f.word = w.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN ends USING (word)
"""



def _with(edit: str, cost: int | str, x: str) -> str:
    """The way x, one edit further."""
    return f"{{cost: {x}.cost + {cost}, audit: {x}.audit || '{edit}'}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


# The least cost and audit by which the rows so far lead to each state: nothing (w0), system (w1), user (w2), assistant (w3).
_FAR = "{cost: 1000000000, audit: ''}"
_OTHERS = ("w0", "w1", "w3")
_INSERTED = f"w0, w1, {_least('w2', *(_with('I', 5, x) for x in _OTHERS))} AS w2, w3"
_SPACES = r"\x20\x09-\x0D"

OP13 = f"""
WITH RECURSIVE {_CRC_TABLE}, hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')))) AS x FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, {_CRC} % 20 AS h FROM hashed, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again
  FROM drawn WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS spot FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^{_SPACES}]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][{_SPACES}]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY spot) || left(role, 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0 AS spot, {{cost: 0, audit: ''}} AS w0, {_FAR} AS w1, {_FAR} AS w2, {_FAR} AS w3 FROM counted
  UNION ALL
  SELECT conv_id, spot, {_with("D", 2, "w0")} AS w0, CASE WHEN kept AND initial = 's' THEN {_least(_with("D", 2, "w1"), _with("K", "more", "w0"))} ELSE {_with("D", 2, "w1")} END AS w1,
         CASE WHEN kept AND initial = 'u' THEN {_least(_with("D", 2, "w2"), *(_with("K", "more", x) for x in _OTHERS))} WHEN kept THEN {_least(_with("D", 2, "w2"), *(_with("R", "1 + more", x) for x in _OTHERS))} ELSE {_with("D", 2, "w2")} END AS w2,
         CASE WHEN kept AND initial = 'a' THEN {_least(_with("D", 2, "w3"), _with("K", "more", "w2"))} WHEN kept THEN {_least(_with("D", 2, "w3"), _with("R", "1 + more", "w2"))} ELSE {_with("D", 2, "w3")} END AS w3
  FROM (
    SELECT conv_id, spot, initial, kept, more, w0, w1, w2, {_least("w3", _with("I", 5, "w2"))} AS w3 FROM (
      SELECT m.conv_id, m.spot, initial, fault NOT IN ('blank', 'duplicate') AS kept, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, {_INSERTED}
      FROM walk JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.spot = walk.spot + 1))
), ended AS (
  SELECT conv_id, {_least("w0", "w3")} AS way FROM (SELECT conv_id, w0, {_least("w3", _with("I", 5, "w2"))} AS w3 FROM (SELECT conv_id, {_INSERTED} FROM walk JOIN counted USING (conv_id) WHERE spot = n_rows UNION ALL SELECT conv_id, {_INSERTED} FROM walk WHERE conv_id IS NULL AND spot = (SELECT n_rows FROM counted WHERE conv_id IS NULL)))
), edits AS (
  SELECT conv_id, step, way.audit[step] AS edit, step - length(replace(left(way.audit, step), 'I', '')) AS inserted FROM (SELECT conv_id, way, unnest(range(1, length(way.audit) + 1)) AS step FROM ended)
), output AS (
  SELECT e.conv_id, e.step, edit, role, text, initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY step) - 1 AS place
  FROM edits AS e LEFT JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.spot = e.step - inserted AND edit <> 'I' WHERE edit <> 'D'
), told AS (
  SELECT *, place - first_value(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place) AS pair_place FROM output
), written AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN pair_place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole FROM told GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted AS n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN written AS w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE: dict[str, str] = {"op1_mix_sources": OP1, "op5_ngram_jaccard": OP5, "op6_decontaminate": OP6, "op7_chat_format": OP7, "op12_spelling_variants": OP12, "op13_conversation_repair": OP13}
