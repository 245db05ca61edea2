"""DuckDB SQL with the results of the registered queries, written the direct way."""

BLANKS = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
LINES = """
    SELECT doc_id, source, text, line, pos, translate(trim(line, {blanks}), {lower}) AS key
    FROM (SELECT doc_id, source, coalesce(text, '') AS text,
                 unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents)
""".format(blanks=BLANKS, lower=LOWER)

OP3 = f"""
WITH lines AS ({LINES}),
frequent AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT l.*, f.keeper IS NOT NULL AND l.doc_id <> f.keeper AS dropped
    FROM lines l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = rf"""
WITH lines AS ({LINES}),
hosted AS (SELECT doc_id, coalesce(source, '') AS host, text, line, pos, key FROM lines),
hosts AS (
    SELECT coalesce(source, '') AS host, count(DISTINCT coalesce(text, '')) AS host_docs
    FROM documents GROUP BY 1),
counts AS (
    SELECT host, key, count(DISTINCT text) AS n_docs, min(doc_id) AS first_id
    FROM hosted WHERE key <> '' GROUP BY host, key),
frequent AS (
    SELECT host, key, first_id FROM counts JOIN hosts USING (host)
    WHERE n_docs >= 20 AND n_docs > host_docs * 0.01),
marked AS (
    SELECT h.*, f.first_id IS NOT NULL AND f.first_id <> h.doc_id AS gone
    FROM hosted h LEFT JOIN frequent f ON h.host = f.host AND h.key = f.key),
lost AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed_lines,
           coalesce(sum(length(key)) FILTER (gone), 0) > 0.5 * sum(length(key)) AS depleted,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_text_sha256
    FROM marked GROUP BY doc_id),
words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n
    FROM (SELECT doc_id, pos, word, lead(word) OVER d AS second, lead(word, 2) OVER d AS third
          FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
    WHERE third IS NOT NULL),
repeats AS (
    SELECT doc_id, count(DISTINCT pos + shift) AS n FROM windows, (VALUES (0), (1), (2)) s(shift)
    WHERE n > 1 GROUP BY doc_id),
dups AS (
    SELECT doc_id, sum(n - 1) AS n FROM (
        SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        GROUP BY doc_id, line) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY doc_id),
base AS (
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.chars, 0)::BIGINT AS word_chars,
           length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN repeats r USING (doc_id)
    LEFT JOIN dups u USING (doc_id))
SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR depleted) AS kept,
       n_removed_lines, kept_text_sha256
FROM base JOIN lost USING (doc_id)
"""

CONTROL = r"(\||/?s>|/?INST\])"
OP8 = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|says|><|end|>')
           + length(regexp_replace(role, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g'))
           + length(regexp_replace(text, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), {lower}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(lower=LOWER)
OP9 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, w[i : i + 9] AS win FROM (
        SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
slices AS (
    SELECT doc_id, i, size, w[i : i + size - 1] AS win FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, i, size, item_id FROM slices JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
owners AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
       coalesce(o.n, 0)::BIGINT AS n_items, sha256(coalesce(o.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""

OP11 = rf"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
    FROM documents),
ranked AS (
    SELECT *, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
           row_number() OVER best AS rank
    FROM rows WINDOW best AS (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, sha256(content) AS text_sha256 FROM ranked
"""

OP12 = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
drawn AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a,
           ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
           CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50
                THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM units),
parts AS (
    SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix,
           array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
           array_to_string(u[greatest(a, b) + 1:], '') AS suffix
    FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

# crc32 of a decimal number: each digit is mixed in and then shifted out bit by bit
CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1), "
    "lambda i: [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: CASE WHEN x >= 0 "
    "THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295)"
).format("(conv_id::VARCHAR)")
OP13 = f"""
WITH own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS t
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL)
    GROUP BY conv_id),
drawn AS (SELECT conv_id, t, {CRC} % 9 AS h FROM own),
rebuilt AS (
    SELECT d.conv_id, list_concat(coalesce(s.t, [])[1:d.h], d.t[d.h + 1:]) AS t
    FROM drawn d LEFT JOIN own s ON s.conv_id = d.conv_id - d.conv_id % 5),
starts AS (
    SELECT conv_id, len(t) AS length, d AS depth, t[1:d] AS start, t[1:d - 1] AS above, strlen(t[d].text) AS n_bytes
    FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT depth, start, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(any_value(n_bytes), 0) AS n_bytes,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
    FROM starts GROUP BY depth, start),
children AS (SELECT above AS start, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
inside AS (
    SELECT n.start[1:d] AS start, count(*) FILTER (c.n IS NULL) AS n_leaves,
           sum((n.n_convs - 1) * n.n_bytes)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON n.start = c.start
    GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       i.n_leaves, i.saved_tokens, n.ends_sha256
FROM nodes n JOIN inside i USING (start) LEFT JOIN children c USING (start)
LEFT JOIN nodes p ON n.depth > 0 AND p.start = n.above
"""

QUERIES = {
    "op3_line_dedup": OP3,
    "op4_quality_rules": OP4,
    "op8_chat_formatting": OP8,
    "op9_decontamination": OP9,
    "op11_exact_dedup": OP11,
    "op12_fill_in_middle": OP12,
    "op13_prefix_trie": OP13,
}
