"""DuckDB texts for the rows of queries that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"

_SHARED = rf"""
base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT t, min(doc_id) AS id, regexp_extract_all(t, {_WORDS}) AS w FROM base GROUP BY t),
runs AS (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
bags AS (SELECT id, s, count(*) AS n FROM runs GROUP BY id, s),
sizes AS (SELECT id, sum(n) AS n FROM bags GROUP BY id),
pairs AS (SELECT a.id AS x, b.id AS y, sum(least(a.n, b.n)) AS common FROM bags a JOIN bags b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE 5 * common >= 4 * (p.n + q.n - common)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links)"""

NEAR_COPIES = rf"""WITH RECURSIVE {_SHARED},
reach(id, there) AS (SELECT id, id FROM texts UNION SELECT r.id, e.y FROM reach r JOIN ways e ON e.x = r.there),
classes AS (SELECT id, min(there) AS class_id FROM reach GROUP BY id)
SELECT doc_id, class_id, texts.id AS text_id FROM base JOIN texts USING (t) JOIN classes USING (id)"""

MIXTURE = rf"""WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weights AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
   ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM totals),
filled AS (SELECT cap / weight AS ratio, sum(cap) OVER w AS caps, sum(weight) OVER () - sum(weight) OVER w AS rest, row_number() OVER w AS k
  FROM weights WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
steps AS (SELECT 0 AS k, 0.0::DOUBLE AS caps, sum(weight) AS rest FROM weights UNION ALL SELECT k, caps, rest FROM filled WHERE rest > 0),
budget AS (SELECT 1.5::DOUBLE * sum(source_size) AS words FROM totals),
level AS (SELECT (words - s.caps) / s.rest AS level FROM steps s CROSS JOIN budget
  WHERE (words - s.caps) / s.rest < (SELECT ratio FROM filled f WHERE f.k = s.k + 1) ORDER BY s.k LIMIT 1),
targets AS (SELECT source, source_size, least(cap, level * weight) AS target FROM weights CROSS JOIN level),
rated AS (SELECT sized.doc_id, sized.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
drawn AS (SELECT *, rate - floor(rate) AS part, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::BIGINT AS level,
   ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), 'draw')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw,
   ('0x' || substr(md5(coalesce(source, 'null') || ':start'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS start FROM rated),
keys AS (SELECT DISTINCT source, level, draw, part, start FROM drawn),
places AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY level) - 1 AS ahead, count(*) OVER (PARTITION BY source, level) AS n,
   row_number() OVER (PARTITION BY source, level ORDER BY draw) AS place FROM keys),
chosen AS (SELECT source, level, draw, place <= floor((ahead + n) * part + start) - floor(ahead * part + start) AS more FROM places)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.level = c.level AND d.draw = c.draw"""

_CONTROL = r"'([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'"

CHATS = rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(role, {_CONTROL})) + length(regexp_replace(text, {_CONTROL})) + 23)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

EXACT_COPIES = r"""WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
marked AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS place
  FROM plain WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM marked"""

def _crc32(s: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: xor with a character, then eight shifts."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({s}) + 1),
   lambda i: [ascii(substr({s}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"""


def _field(name: str, value: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


_ROW = " || ".join(_field(c, c) for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE = rf"""WITH RECURSIVE coded AS (SELECT *, {_crc32('(doc_id::VARCHAR)')} AS crc FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_ROW} || {_field("text", "text")}) AS leaf,
  CASE WHEN crc % 3 = 0 THEN sha256({_ROW} || {_field("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS now FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS members FROM leaves),
nodes(tree, level, members, pos, digest) AS (
  SELECT tree, 0, members, pos, leaf FROM placed
  UNION ALL SELECT tree, level + 1, (members + 7) // 8, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE members > 1
  GROUP BY tree, level, members, pos // 8),
subroots AS (SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS members FROM nodes WHERE members = 1),
tops(level, members, pos, digest) AS (
  SELECT 0, members, pos, digest FROM subroots
  UNION ALL SELECT level + 1, (members + 7) // 8, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE members > 1
  GROUP BY level, members, pos // 8),
steps AS (SELECT doc_id, level, string_agg(digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.pos // (8 ** level)::BIGINT) AS before,
    string_agg(digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.pos // (8 ** level)::BIGINT) AS behind
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.members > 1 AND n.pos // 8 = p.pos // (8 ** (level + 1))::BIGINT GROUP BY doc_id, level, p.pos
  UNION ALL SELECT doc_id, height + level, string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < s.pos // (8 ** level)::BIGINT),
    string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > s.pos // (8 ** level)::BIGINT)
  FROM placed p JOIN subroots s ON s.tree = p.tree JOIN tops n ON n.members > 1 AND n.pos // 8 = s.pos // (8 ** (level + 1))::BIGINT GROUP BY doc_id, height, level, s.pos),
folds(doc_id, level, digest) AS (
  SELECT doc_id, 0, coalesce(now, leaf) FROM placed
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(coalesce(before, '') || digest || coalesce(behind, '')) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level),
proofs AS (SELECT doc_id, string_agg(coalesce(before, '') || coalesce(behind, ''), '' ORDER BY level) AS proof FROM steps GROUP BY doc_id)
SELECT p.doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN tops t ON t.members = 1
JOIN (SELECT doc_id, max_by(digest, level) AS digest FROM folds GROUP BY doc_id) f ON f.doc_id = p.doc_id LEFT JOIN proofs q ON q.doc_id = p.doc_id"""


def _state(cost: str, audit: str, text: str) -> str:
    return f"{{'cost': {cost}, 'audit': {audit}, 'said': {text}}}"


def _edited(state: str, cost: str, edit: str, line: str | None = None) -> str:
    said = f"{state}.said" if line is None else f"{state}.said || chr(10) || {line}"
    return _state(f"({state}.cost + {cost})::BIGINT", f"{state}.audit || '{edit}'", said)


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _row(state: str, role: str, more: bool = True) -> str:
    """The row kept if its initial is that of the role, else given the role; too dear if it must go."""
    kept = f"CASE WHEN initial = '{role[0]}' THEN 0 ELSE {3 if more else 1000000000} END"
    cost = f"CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE {kept} + CASE WHEN fault = 3 THEN 3 ELSE 0 END END"
    edit = f"CASE WHEN initial = '{role[0]}' THEN 'K' ELSE 'R' END"
    line = f"CASE WHEN initial = '{role[0]}' THEN role ELSE '{role}' END || ':' || text"
    return _state(f"({state}.cost + {cost})::BIGINT", f"{state}.audit || {edit}", f"{state}.said || chr(10) || {line}")


_NEVER = _state("1000000000::BIGINT", "'~'", "''")
_BARE = r"[\x20\x09-\x0D]"

CHAT_REPAIR = rf"""WITH RECURSIVE coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
harmed AS (SELECT *, {_crc32("name")} % 20 AS harm FROM coded),
ones AS (SELECT conv_id, turn, harm, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
   CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM harmed WHERE harm <> 0),
rows_ AS (SELECT * FROM ones UNION ALL SELECT * FROM ones WHERE harm = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM rows_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
   WHEN NOT regexp_matches(text, '[.!?]{_BARE}*$') THEN 3 ELSE 0 END AS fault, substr(role, 1, 1) AS initial,
   coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1), 'ua') NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
best(conv_id, i, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {_state("0::BIGINT", "''", "''")}, {_NEVER}, {_state("3::BIGINT", "'I'", "chr(10) || 'user:'")},
    {_state("6::BIGINT", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")} FROM faults
  UNION ALL SELECT conv_id, i, q0, q1, q2, {_least("b3", _edited("q2", "3", "I", "'assistant:'"))} FROM (
    SELECT conv_id, i, b0 AS q0, b1 AS q1, b3,
      {_least("b2", _edited("b0", "3", "I", "'user:'"), _edited("b1", "3", "I", "'user:'"), _edited("b3", "3", "I", "'user:'"))} AS q2 FROM (
      SELECT best.conv_id, f.i, {_edited("q0", "4", "D")} AS b0,
        {_least(_edited("q1", "4", "D"), _row("q0", "system", False))} AS b1,
        {_least(_edited("q2", "4", "D"), _row("q0", "user"), _row("q1", "user"), _row("q3", "user"))} AS b2,
        {_least(_edited("q3", "4", "D"), _row("q2", "assistant"))} AS b3
      FROM best JOIN faults f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1))),
ends AS (SELECT conv_id, max_by({_least("q0", "q3")}, i) AS final FROM best GROUP BY conv_id),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
   count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(final.cost, 0)::BIGINT AS cost,
  coalesce(final.audit, '') AS audit, sha256(substr(coalesce(final.said, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id"""
