"""SQL oracles of the queries that SQL can express, written from the definitions."""

from __future__ import annotations

from lapsewise.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))

OP7 = rf"""
WITH body AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), word AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM body
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM word WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), counts AS (
  SELECT word.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM word LEFT JOIN covered ON word.doc_id IS NOT DISTINCT FROM covered.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 2000 * n_words
            OR 100 * n_symbols > 20 * n_words OR 100 * n_stop_words < 8 * n_words
            OR 100 * n_dup_lines > 60 * n_lines) AS kept
FROM judged
"""



def _merkle_levels(name: str, nodes: str, levels: int) -> str:
    """CTEs {name}0.. of a tree's nodes (g, r, n, d) and {name}_run of the child runs, up
    to 16^levels nodes; {name}_top has the last node of every group."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(levels):
        out.append(f"""{name}_run{k} AS (
  SELECT g, r // 16 AS r, any_value(n) AS n, list(d ORDER BY r) AS kids FROM {name}{k} WHERE n > 1 GROUP BY g, r // 16
), {name}{k + 1} AS (
  SELECT g, r, (n + 15) // 16 AS n, sha256(array_to_string(kids, '')) AS d FROM {name}_run{k})""")
    tops = " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*out, f"{name}_top AS ({tops})"])


def _merkle_way(name: str, start: str, levels: int) -> str:
    """CTEs that take rows (key, g, r, acc, sib) of {start} up a tree."""
    out, at = [], start
    for k in range(levels):
        out.append(f"""{name}_way{k} AS (
  SELECT w.key, w.g, w.r // 16 AS r,
         CASE WHEN u.kids IS NULL THEN w.acc ELSE sha256(
           array_to_string(u.kids[:w.r % 16], '') || w.acc || array_to_string(u.kids[w.r % 16 + 2:], '')) END AS acc,
         CASE WHEN u.kids IS NULL THEN w.sib ELSE w.sib
           || array_to_string(u.kids[:w.r % 16], '') || array_to_string(u.kids[w.r % 16 + 2:], '') END AS sib
  FROM {at} w LEFT JOIN {name}_run{k} u ON u.g = w.g AND u.r = w.r // 16)""")
        at = f"{name}_way{k}"
    return ", ".join(out)


def _encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || {value} END"


_FIELDS = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32_cte(source: str, key: str) -> str:
    """CTE crc (key, crc): unsigned crc32 of the decimal text of every distinct key, from
    the usual table of 256 remainders, since DuckDB has no such function."""
    step = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""crc_table AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, _: {step}) AS row FROM (SELECT unnest(range(256)) AS i)
), crc_rows AS (SELECT list(row ORDER BY i) AS t FROM crc_table
), crc AS (
  SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT {key} AS key FROM {source} WHERE {key} IS NOT NULL), crc_rows)"""


# Up to 16^4 rows of a source and 16^3 sources.
OP12 = f"""
WITH {_crc32_cte("documents", "doc_id")}, leaf AS (
  SELECT row_number() OVER () AS key, doc_id, source,
         sha256({_FIELDS} || {_encoded("text")}) AS leaf,
         sha256({_FIELDS} || CASE WHEN crc % 5 = 0 THEN {_encoded(_LOWER)} ELSE {_encoded("text")} END) AS claimed
  FROM documents LEFT JOIN crc ON documents.doc_id = crc.key
), src AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS n
  FROM (SELECT DISTINCT source FROM documents)
), placed AS (
  SELECT leaf.*, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
         count(*) OVER (PARTITION BY s) AS n
  FROM leaf JOIN src ON leaf.source IS NOT DISTINCT FROM src.source
), {_merkle_levels("t", "SELECT s AS g, r, n, leaf AS d FROM placed", 4)},
{_merkle_levels("u", "SELECT 0 AS g, s AS r, src.n AS n, d FROM src JOIN t_top ON t_top.g = s", 3)},
start AS (SELECT key, s AS g, r, claimed AS acc, '' AS sib FROM placed),
{_merkle_way("t", "start", 4)}, middle AS (SELECT key, 0 AS g, g AS r, acc, sib FROM t_way3),
{_merkle_way("u", "middle", 3)}
SELECT doc_id, leaf, t_top.d AS subroot, u_top.d AS root, sha256(sib) AS proof_sha256,
       acc AS folded_root, acc = u_top.d AS verified
FROM placed JOIN u_way2 USING (key) JOIN t_top ON t_top.g = placed.s CROSS JOIN u_top
"""

_P = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * {v})"
_F = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

OP13 = rf"""
WITH body AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), word AS (
  SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM body
), vocabulary AS (
  SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT d) >= 10
), size AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM vocabulary GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM body
), seen AS (
  SELECT lang, source, term, count(*) AS n FROM word JOIN vocabulary USING (lang, term) GROUP BY ALL
), total AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM grp LEFT JOIN seen USING (lang, source) GROUP BY ALL
), share AS (
  SELECT g.lang, g.source, w.term, coalesce(s.n, 0) AS c,
         {_P.format(c="coalesce(s.n, 0)", n="g.n", v="z.v")} AS p,
         {_P.format(c="w.n", n="z.n", v="z.v")} AS q
  FROM total g JOIN vocabulary w USING (lang) JOIN size z USING (lang)
       LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = w.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {_F.format(p="p", q="q")} FROM share WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {
    "op7_quality_rules": OP7, "op12_merkle_manifest": OP12, "op13_source_divergence": OP13,
}
