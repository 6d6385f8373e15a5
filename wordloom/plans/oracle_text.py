"""DuckDB oracle SQL for the text/tokenisation queries (independent of Spark:
same rules written as plain SQL; the WordPiece walk is a recursive CTE)."""

# Regex classes written out for RE2 (same code-point ranges as constants.py).
ISO = r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}!-/:-@\[-`{-~])"
SPACES = r"[ \t\n\r\x{3000}]+"

CHUNKS_ALL = (f"list_filter(regexp_split_to_array(regexp_replace(text, '{ISO}', "
              f"' \\1 ', 'g'), '{SPACES}'), lambda x: x <> '')")

VOCAB_CTE = f"""
words0 AS (
  SELECT unnest({CHUNKS_ALL}) AS w FROM documents
), fw AS (
  SELECT w AS token FROM words0 GROUP BY w HAVING count(*) >= 30
), ch AS (
  SELECT c FROM (SELECT unnest(list_transform(range(1, length(w) + 1), lambda i: substring(w, i, 1))) AS c
                 FROM words0)
  GROUP BY c
), toks AS (
  SELECT token FROM fw UNION SELECT c FROM ch UNION SELECT '##' || c FROM ch
), vocab AS (
  SELECT 0 AS id, '[PAD]' AS token
  UNION ALL SELECT CAST(i AS INTEGER), '[unused' || i || ']' FROM range(1, 100) t(i)
  UNION ALL SELECT 100, '[UNK]' UNION ALL SELECT 101, '[CLS]' UNION ALL SELECT 102, '[SEP]'
  UNION ALL
  SELECT CAST(102 + row_number() OVER (ORDER BY token) AS INTEGER) AS id, token FROM toks
), vinfo AS (
  SELECT max(length(token)) AS L,
         coalesce(min(id) FILTER (WHERE token = '[UNK]'), 100) AS unk,
         coalesce(min(id) FILTER (WHERE token = '[CLS]'), 101) AS cls,
         coalesce(min(id) FILTER (WHERE token = '[SEP]'), 102) AS sep,
         max(id) AS max_id
  FROM vocab
)"""

DOC_TEXTS = "SELECT doc_id AS tid, lang, text FROM documents"


def seg_cte(texts_sql: str = DOC_TEXTS, cap: str = "[1:512]") -> str:
    """Vocabulary + WordPiece + encode over ``texts_sql`` -> (tid, lang, text);
    ``cap`` is the chunk cap of the reference's tokeniser ('' for none)."""
    return VOCAB_CTE + f""",
texts AS ({texts_sql}
), dchunks AS (
  SELECT tid, lang, ({CHUNKS_ALL}){cap} AS chunks FROM texts
), occ AS (
  SELECT tid, lang, unnest(chunks) AS word, unnest(generate_series(1, len(chunks))) AS pos FROM dchunks
), words AS (
  SELECT DISTINCT word FROM occ
), starts AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS s FROM words
), cands AS (
  SELECT word, s, unnest(range(1, least((SELECT L FROM vinfo) - CASE WHEN s > 1 THEN 2 ELSE 0 END,
                                        length(word) - s + 1) + 1)) AS l
  FROM starts
), hits AS (
  SELECT c.word, c.s, c.l, v.id, v.token
  FROM cands c JOIN vocab v
    ON v.token = (CASE WHEN c.s > 1 THEN '##' ELSE '' END) || substring(c.word, c.s, c.l)
), best AS (
  SELECT h.* FROM hits h JOIN (SELECT word, s, max(l) AS l FROM hits GROUP BY word, s) b USING (word, s, l)
), walk(word, nxt, ids, toks) AS (
  SELECT word, 1, []::INTEGER[], []::VARCHAR[] FROM words
  UNION ALL
  SELECT w.word, w.nxt + b.l, list_append(w.ids, b.id), list_append(w.toks, b.token)
  FROM walk w JOIN best b ON b.word = w.word AND b.s = w.nxt
), seg AS (
  SELECT wd.word,
         coalesce(k.ids, [(SELECT unk FROM vinfo)]) AS piece_ids,
         coalesce(k.toks, ['[UNK]']) AS pieces
  FROM words wd LEFT JOIN (SELECT word, ids, toks FROM walk WHERE nxt = length(word) + 1) k USING (word)
), body AS (
  SELECT o.tid, o.lang,
         flatten(list(s.piece_ids ORDER BY o.pos)) AS body_ids,
         flatten(list(s.pieces ORDER BY o.pos)) AS body_toks
  FROM occ o JOIN seg s USING (word)
  GROUP BY o.tid, o.lang
), enc AS (
  SELECT tid, tid AS doc_id, lang, len(body_ids) AS n_body, len(body_ids) > 510 AS truncated,
         [(SELECT cls FROM vinfo)] || body_ids[1:510] || [(SELECT sep FROM vinfo)] AS ids,
         ['[CLS]'] || body_toks[1:510] || ['[SEP]'] AS toks
  FROM body
)"""


SEG_CTE = seg_cte()
SEG_ALL = seg_cte(cap="")

SQL = {
    "flagship_tokens_per_lang": f"""
WITH RECURSIVE {SEG_ALL}
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN truncated THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated,
       CAST(max(n_body) AS BIGINT) AS max_body
FROM enc GROUP BY lang""",

    "a1_corpus_read": """
SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS text_chars FROM documents""",

    "a3_fixture_vocab": f"WITH {VOCAB_CTE} SELECT id, token FROM vocab",

    "b2_char_clip": """
SELECT doc_id, CAST(length(left(text, 2048)) AS BIGINT) AS clipped_chars,
       length(text) > 2048 AS was_clipped FROM documents""",

    "b3_nul_cut": """
SELECT doc_id, CAST(length(split_part(text, chr(0), 1)) AS BIGINT) AS chars_before_nul FROM documents""",

    "b5_char_classes": r"""
SELECT doc_id,
  CAST(length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]', '', 'g')) AS BIGINT) AS n_cjk,
  CAST(length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS BIGINT) AS n_punct,
  CAST(length(text) - length(regexp_replace(text, '[ \t\n\r\x{3000}]', '', 'g')) AS BIGINT) AS n_space
FROM documents""",

    "c1_basic_tokenize": f"""
SELECT doc_id, CAST(len(c) AS BIGINT) AS n_chunks_all, CAST(len(c[1:512]) AS BIGINT) AS n_chunks,
       array_to_string(c[1:512], ' ') AS chunks
FROM (SELECT doc_id, {CHUNKS_ALL} AS c FROM documents)""",

    "c2_wordpiece": f"""
WITH RECURSIVE {SEG_ALL}
SELECT word, array_to_string(pieces, ' ') AS pieces, array_to_string(piece_ids, ',') AS piece_ids,
       CAST(len(pieces) AS BIGINT) AS n_pieces
FROM seg""",

    "c3_tokenize": f"""
WITH RECURSIVE {SEG_CTE}
SELECT tid AS doc_id, CAST(len(body_toks) AS BIGINT) AS n_body, array_to_string(body_toks, ' ') AS body FROM body""",

    "c4_token_table": f"""
WITH RECURSIVE {SEG_CTE}
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, token, CAST(token_id AS BIGINT) AS token_id
FROM (SELECT doc_id, unnest(toks) AS token, unnest(ids) AS token_id,
             unnest(generate_series(1, len(ids))) AS pos FROM enc)""",

    "c5_encode": f"""
WITH RECURSIVE {SEG_CTE}
SELECT doc_id, array_to_string(ids, ',') AS ids, truncated FROM enc""",

    "c6_token_count": f"""
WITH RECURSIVE {SEG_CTE}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens FROM enc""",

    "b6_over_length_reject": f"""
WITH RECURSIVE {SEG_CTE}
SELECT doc_id, CASE WHEN n_body > 510 THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN n_body > 510 THEN 'over_length' END AS reason,
       CAST(CASE WHEN n_body > 510 THEN 0 ELSE n_body + 2 END AS BIGINT) AS n_tokens
FROM enc""",

    "b8_validate_ids": f"""
WITH RECURSIVE {SEG_CTE}
SELECT doc_id,
  CASE WHEN len(ids) < 1 OR len(ids) > 512 OR NOT list_bool_and(list_transform(given, lambda x: x >= 0 AND x <= mx))
       THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN len(ids) < 1 OR len(ids) > 512 THEN 'bad_length'
       WHEN NOT list_bool_and(list_transform(given, lambda x: x >= 0 AND x <= mx)) THEN 'id_out_of_range' END AS reason
FROM (SELECT doc_id, ids, mx, CASE WHEN doc_id % 10 = 0 THEN [mx + 1] || ids[2:] ELSE ids END AS given
      FROM enc CROSS JOIN (SELECT max_id AS mx FROM vinfo))""",

    "j1_vocab_lookup": f"""
WITH RECURSIVE {SEG_ALL}
SELECT w.word, CAST(coalesce(v.id, (SELECT unk FROM vinfo)) AS BIGINT) AS token_id
FROM words w LEFT JOIN vocab v ON v.token = w.word""",
}

CLIPPED = seg_cte("SELECT doc_id AS tid, lang, left(text, 2048) AS text FROM documents")
SQL["h1_stream_tokenize"] = f"""
WITH RECURSIVE {CLIPPED}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens FROM enc"""

# the bytes of a text with others put in after (doc_id * 7919 + 13) mod (bytes + 1) of them, as
# characters U+0000..U+00FF; bytes that belong to a character become 'a'
SQL["b4_invalid_utf8"] = r"""
WITH cut AS (
  SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN hex(encode(text)) END AS h,
         CAST((doc_id * 7919 + 13) % (octet_length(encode(text)) + 1) AS BIGINT) AS spot,
         list_extract(['', 'C3', 'FF', 'E4B8', '8080'], CAST(doc_id % 5 + 1 AS BIGINT)) AS more
  FROM documents
), bytes AS (
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all(
           substr(h, 1, 2 * spot) || more || substr(h, 2 * spot + 1), '..'), lambda x: chr(CAST('0x' || x AS INTEGER))), '') AS b
  FROM cut
), judged AS (
  SELECT doc_id, b, regexp_replace(regexp_replace(regexp_replace(b, '[\x{F0}-\x{F7}][\x{80}-\x{BF}]{3}', 'aaaa', 'g'),
    '[\x{E0}-\x{EF}][\x{80}-\x{BF}]{2}', 'aaa', 'g'), '[\x{C0}-\x{DF}][\x{80}-\x{BF}]', 'aa', 'g') AS m
  FROM bytes
), counted AS (
  SELECT doc_id, b, CAST(length(regexp_replace(m, '[^\x{80}-\x{FF}]', '', 'g')) AS BIGINT) AS n_bad,
         CAST(length(regexp_extract(m, '^[^\x{80}-\x{FF}]*')) AS BIGINT) AS clean
  FROM judged
)
SELECT doc_id, CASE WHEN b IS NULL OR n_bad > 0 THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN b IS NULL THEN 'null_text' WHEN n_bad > 0 THEN 'invalid_utf8' END AS reason,
       CASE WHEN n_bad > 0 THEN clean END AS first_bad, n_bad
FROM counted"""

SQL["h4_dead_letters"] = f"""
WITH RECURSIVE {CLIPPED}
SELECT doc_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason
FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN 'null_text'
                            WHEN d.doc_id % 9 = 1 THEN 'invalid_utf8'
                            WHEN d.doc_id % 9 > 1 AND e.n_body > 510 THEN 'over_length' END AS reason
      FROM documents d LEFT JOIN enc e ON e.doc_id = d.doc_id)"""

SQL["h3_admission"] = """
SELECT CAST(count(*) AS HUGEINT) AS n_docs, CAST(1 AS BIGINT) AS most_files_at_once FROM documents"""

SQL["u3_token_rows"] = SQL["c4_token_table"]
