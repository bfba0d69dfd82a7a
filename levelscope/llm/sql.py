"""SQL that gives the same rows as the queries, where SQL can."""

ORACLES = {
    "op1_token_counts_words": r"""
WITH counts AS (
  SELECT d.doc_id, lang, length(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]+', 'w', 'g')) AS gaps,
         CASE WHEN source = 'src1' AND d.doc_id % 3 = 0 THEN 'src2' ELSE source END AS source, source = 'src0' AS revised
  FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, CAST(sum((gaps + 1) // 2 + CAST(revised AS INT)) AS BIGINT) AS n_tokens
FROM counts GROUP BY source, lang
""",
    "op2_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 24 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (  -- crc32 of the key, bit by bit
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 20 AS kind FROM keyed
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_
), numbered AS (
  SELECT *, i > min(i) OVER (PARTITION BY conv_id, role, text) AS again, trim(text, E' \t\n\x0B\x0C\r') AS bare FROM ordered
), faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), before(state, letters, mid, added) AS (
  VALUES (0, '', 0, []::VARCHAR[]), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (3, 'I', 2, ['user:']),
         (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:']), (2, 'II', 2, ['assistant:', 'user:']), (3, 'II', 3, ['user:', 'assistant:'])
), keeps(mid, initial, state) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), edits AS (
  SELECT mid, NULL::VARCHAR AS initial, mid AS state, 'D' AS letter, NULL::VARCHAR AS role FROM (VALUES (0), (1), (2), (3)) v(mid)
  UNION ALL SELECT mid, initial, state, 'K', NULL FROM keeps
  UNION ALL SELECT mid, NULL, state, 'R', role FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) v(mid, state, role)
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'out': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.state, min({
    'cost': p.best.cost + 5 * length(b.letters) + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND f.truncated THEN 5 ELSE 0 END,
    'audit': p.best.audit || b.letters || e.letter,
    'out': list_concat(p.best.out, b.added, CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)})
  FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN before b ON b.state = p.state JOIN edits e ON e.mid = b.mid
  WHERE (e.initial IS NULL OR e.initial = f.initial) AND (e.letter = 'D' OR NOT (f.blank OR f.duplicate))
  GROUP BY p.conv_id, p.i, e.state
), ends AS (
  SELECT p.conv_id, min({'cost': p.best.cost + 5 * length(b.letters), 'audit': p.best.audit || b.letters, 'out': list_concat(p.best.out, b.added)}) AS best
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN before b ON b.state = p.state
  WHERE b.mid = 3 OR b.mid = 0 GROUP BY p.conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.out, chr(10)), '')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
""",
}
