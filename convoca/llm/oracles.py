"""DuckDB statements of the queries SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split
), keyed AS (
  SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(first_doc <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (
    SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i
    FROM (SELECT *, least(13, len(w)) AS size FROM items WHERE len(w) > 0)
  )
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (
    SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
    FROM docs, sizes WHERE len(w) >= size
  )
), hits AS (
  SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, words)
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits)
  GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

# CRC-32 by its byte table, which a rule gives; one state for each byte of the text
_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(
  list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda r, x: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""

# DuckDB's levenshtein counts bytes: letters beyond ASCII get one byte each
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "".join(chr(c) for c in [*range(35, 97), *range(123, 127)] if chr(c) != "'")[: len(_BEYOND)]

SPELLING = f"""
WITH RECURSIVE crc AS (
  SELECT {_CRC_TABLE} AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), once AS (
  SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x, count(*) AS n
  FROM runs GROUP BY doc_id, run
), summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(length(x) // 2),
      lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda r, b: xor(r // 256, t[1 + xor(r % 256, b)]))) AS h
  FROM once, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n) AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), plain AS (
  SELECT word, n, translate(word, '{_BEYOND}', '{_ONE_BYTE}') AS p FROM words
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM plain a, (VALUES (-1), (0), (1)) AS d(more), plain b
  WHERE length(b.p) = length(a.p) + more AND levenshtein(a.p, b.p) = 1
), best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM near GROUP BY word, n
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 5 * words.n THEN other END AS form, CASE WHEN other_n >= 5 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chains AS (
  SELECT word, form, word AS root FROM forms
  UNION ALL
  SELECT chains.word, forms.form, forms.word FROM chains JOIN forms ON forms.word = chains.form
)
SELECT forms.word, forms.form, root, CAST(forms.n AS BIGINT) AS n, n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN chains ON chains.word = forms.word AND chains.form IS NULL
"""
