"""SQL twins of the queries of this package that SQL can express."""

from __future__ import annotations

from beaconry.llm import codebooks, divergence, quality

#: The given pages have one article element each; character references may lack their semicolon at a cut.
ARTICLES = r"""
SELECT page_id, url, text, cast(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, coalesce(trim(regexp_replace(
    replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
        split_part(split_part(html, '<article>', 2), '</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
        '&quot;', '"'), '&quot', '"'), '&amp;', chr(1)), '&amp', '&'), chr(1), '&'), '\s+', ' ', 'g')), '') AS text FROM pages)
"""

#: One row per document and measure; the bucket drops all but the six leading bits of a value.
_MEASURES = " UNION ALL ".join(
    f"SELECT row_no, lang, source, '{m.name}' AS measure, {m.scale} * {m.part} // greatest({m.whole}, 1) AS v, "
    f"{m.least_spread} AS least_spread, {m.below} AS below FROM counted WHERE NOT base_failed"
    for m in quality.MEASURES
)
_SKETCH = """SELECT {keys} measure, bucket, sum(count(*)) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto,
    sum(count(*)) OVER (PARTITION BY {keys} measure) AS total FROM bucketed GROUP BY {keys} measure, bucket"""
_ENDS = """SELECT {keys} measure, max(total) AS docs, min(CASE WHEN 4 * upto >= total THEN bucket END) AS low,
    min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS high FROM ({sketch}) GROUP BY {keys} measure"""


def _ends(keys: str) -> str:
    return _ENDS.format(keys=keys, sketch=_SKETCH.format(keys=keys))


QUALITY = rf"""
WITH split AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
windows AS (
    SELECT row_no, i, words[i:i + 2] AS w FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
repeated AS (
    SELECT row_no, count(DISTINCT i + k) AS n FROM (
        SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, w) AS times FROM windows) WHERE times > 1),
        (SELECT unnest(range(3)) AS k) GROUP BY row_no),
counted AS (
    SELECT s.row_no, doc_id, lang, source, cast(len(words) AS BIGINT) AS n_words,
        cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        cast(len(lines) AS BIGINT) AS n_lines, cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        len(words) < {quality.LEAST_WORDS} OR 100 * coalesce(n, 0) > {quality.MOST_REPEATED} * len(words) AS base_failed
    FROM split s LEFT JOIN repeated r ON s.row_no = r.row_no),
measured AS ({_MEASURES}),
bucketed AS (SELECT *, CASE WHEN v < {quality.EXACT} THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket FROM measured),
own AS ({_ends("lang, source,")}), by_lang AS ({_ends("lang,")}), overall AS ({_ends("")}),
chosen AS (
    SELECT m.row_no, m.v, m.below, m.least_spread,
        CASE WHEN o.docs >= {quality.LEAST_DOCS} THEN o.low WHEN b.docs >= {quality.LEAST_DOCS} THEN b.low ELSE a.low END AS low,
        CASE WHEN o.docs >= {quality.LEAST_DOCS} THEN o.high WHEN b.docs >= {quality.LEAST_DOCS} THEN b.high ELSE a.high END AS high
    FROM measured m JOIN own o USING (lang, source, measure) JOIN by_lang b USING (lang, measure) JOIN overall a USING (measure)),
inside AS (
    SELECT row_no, bool_and(v <= high + {quality.SPREADS} * greatest(high - low, least_spread)
        AND (NOT below OR v >= low - {quality.SPREADS} * greatest(high - low, least_spread))) AS fine FROM chosen GROUP BY row_no)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(fine, FALSE) AS kept
FROM counted LEFT JOIN inside USING (row_no)
"""


def _round(k: int, last: bool) -> str:
    """Parts assigned to codebook k and, unless it is the last round, codebook k + 1."""
    nearest = f"""a{k} AS MATERIALIZED (
        SELECT part, row_no, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM (
            SELECT x.part, x.row_no, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
            FROM comps x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) GROUP BY part, row_no)"""
    moved = f""", c{k + 1} AS MATERIALIZED (
        SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
            SELECT x.part, a.entry, x.pos, cast(floor(sum(x.v)::DOUBLE / count(*)) AS BIGINT) AS v
            FROM comps x JOIN a{k} a ON x.part = a.part AND x.row_no = a.row_no GROUP BY ALL) m
        ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)"""
    return nearest if last else nearest + moved


#: Lists are 1-based in SQL; sums of a given table's components are exact in doubles, so is their division's floor.
CODEBOOKS = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, vec_id, label, len(embedding) // {codebooks.PARTS} AS width,
        [cast(floor({codebooks.SCALE}::DOUBLE * x) AS BIGINT) FOR x IN embedding] AS v
    FROM documents_of_vectors),
comps AS MATERIALIZED (
    SELECT row_no, (i - 1) // width AS part, (i - 1) % width AS pos, v[i] AS v
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, row_no AS entry, pos, v FROM comps WHERE row_no < {codebooks.ENTRIES}),
{", ".join(_round(k, k == codebooks.ROUNDS) for k in range(codebooks.ROUNDS + 1))},
coded AS (
    SELECT row_no, string_agg(lpad(lower(printf('%x', entry)), 2, '0'), '' ORDER BY part) AS code,
        cast(sum(d) AS BIGINT) AS error FROM a{codebooks.ROUNDS} GROUP BY row_no),
hashed AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{codebooks.ROUNDS})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_no), hashed
""".replace(
    "documents_of_vectors",
    "(SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
)


def _share(count: str, total: str, terms: str) -> str:
    return (
        f"1 + {divergence.UNIT}::HUGEINT * ({count} + {divergence.PRIOR}) // ({total} + {divergence.PRIOR} * {terms})"
    )


DIVERGENCE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT * FROM (
    SELECT row_no, lang, source, unnest(regexp_split_to_array(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs) WHERE term <> ''),
terms AS MATERIALIZED (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM terms GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts JOIN terms USING (lang, term) GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS MATERIALIZED (
    SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c, {_share("coalesce(c.c, 0)", "coalesce(n.n, 0)", "l.v")} AS p,
        {_share("t.total", "l.n", "l.v")} AS q
    FROM groups g JOIN terms t USING (lang) JOIN langs l USING (lang)
    LEFT JOIN totals n ON n.lang = g.lang AND n.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term
    GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, cast(p - q AS BIGINT) FROM shares WHERE c > 0 AND p > q)
SELECT * FROM (
    SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= {divergence.LISTED}
"""

ORACLES = {
    "op4_articles": ARTICLES,
    "op11_quality": QUALITY,
    "op12_codes": CODEBOOKS,
    "op13_divergence": DIVERGENCE,
}
