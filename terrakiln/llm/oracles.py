"""DuckDB SQL of the corpus operators' queries that SQL can express."""

from __future__ import annotations

_KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_VENDOR = "gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Kind, pattern as an SQL literal's inside, group with the secret, its least length.
_SECRETS = (
    ("assign", rf"""({_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("vendor", _VENDOR, 0, 10),
)
_FOUND = "\n  UNION ALL\n".join(
    f"""  SELECT row, owner, repository, {k} AS kind, '{name}' AS name, v[i] AS secret, length(m[i]) AS width,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
                     string_split_regex(text, '{pattern}') AS p FROM docs))
  WHERE length(v[i]) >= {least}"""
    for k, (name, pattern, group, least) in enumerate(_SECRETS)
)

SECRET_SCAN = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner,
         coalesce(concat_ws('/', source, lang), '') AS repository, coalesce(text, '') AS text
  FROM documents
),
found AS (
{_FOUND}
),
spread AS (SELECT secret, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, repository)) <= 4 AS live FROM found GROUP BY 1),
marked AS (
  SELECT row, kind, live, stop - width AS start, name || ':' || (stop - width)::BIGINT || ':' || stop::BIGINT AS span
  FROM found JOIN spread USING (secret)
),
listed AS (
  SELECT row,
         count(*) FILTER (WHERE kind = 0) AS n_assign,
         count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
         string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live) AS spans,
         count(*) FILTER (WHERE live) AS n_live,
         count(*) FILTER (WHERE NOT live) AS n_example
  FROM marked GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN listed USING (row)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_WORD}'), []) AS w FROM documents
),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_FOLDED}, '{_WORD}') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL
),
in_items AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: w[s : s + 9])) AS win
  FROM items WHERE len(w) > 0
),
tokens AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM docs),
counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1),
matches AS (
  SELECT d.row, i.item, d.start, d.n
  FROM (SELECT row, start, n, w[start + 1 : start + n] AS win
        FROM (SELECT row, w, n, unnest(range(0, len(w) - n + 1)) AS start FROM docs, (SELECT DISTINCT n FROM in_items))) d
  JOIN in_items i ON d.win = i.win
),
hits AS (
  SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(start, start + n)) AS pos FROM (SELECT DISTINCT row, start, n FROM matches)) GROUP BY 1
),
named AS (SELECT row, count(DISTINCT item) AS n_items, list_aggregate(list_sort(list(DISTINCT item)), 'string_agg', ',') AS ids FROM matches GROUP BY 1),
terms AS (
  SELECT win, word, pos, c.n AS n, count(c.n) OVER (PARTITION BY win) AS known, len(win) AS size
  FROM (SELECT win, unnest(win) AS word, unnest(range(0, len(win))) AS pos FROM (SELECT DISTINCT win FROM in_items)) LEFT JOIN counts c USING (word)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY n, word, pos) AS rank,
         first_value(word) OVER (PARTITION BY win ORDER BY n, word, pos) AS rarest
  FROM terms WHERE known = size
),
second AS (SELECT win, word, pos FROM ranked WHERE word <> rarest QUALIFY row_number() OVER (PARTITION BY win ORDER BY rank) = 1),
near_windows AS (
  SELECT DISTINCT a.row, a.win
  FROM (SELECT t.row, r.win, t.pos - r.pos AS start FROM tokens t JOIN ranked r ON t.word = r.word WHERE r.rank = 1) a
  JOIN (SELECT t.row, s.win, t.pos - s.pos AS start FROM tokens t JOIN second s ON t.word = s.word) b
    ON a.row = b.row AND a.win = b.win AND abs(a.start - b.start) <= 3
),
near AS (
  SELECT row, count(DISTINCT item) AS n_near_items
  FROM (SELECT row, item FROM near_windows JOIN in_items USING (win) UNION SELECT row, item FROM matches) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM docs LEFT JOIN hits USING (row) LEFT JOIN named USING (row) LEFT JOIN near USING (row)
"""
