"""SQL that must give the same rows as a query, for the queries that SQL can express."""

from __future__ import annotations

from tenc.llm import licenses, mixing, quality


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def quality_sql() -> str:
    """The measures and verdicts of ``quality``, with the rules compiled from the same table."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def broken(rule: quality.Rule) -> str:
        ratio = f"{rule.numerator}::DOUBLE" + (f" / greatest({rule.denominator}, 1)" if rule.denominator else "")
        bounds = [f"{ratio} < {rule.low}" if rule.low is not None else "", f"{ratio} > {rule.high}" if rule.high is not None else ""]
        either = " OR ".join(b for b in bounds if b)
        return f"CASE WHEN n_words >= {rule.from_words} AND ({either}) THEN '{rule.name}' END"

    return rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT r, doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM base),
runs AS (
  SELECT r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS run
  FROM (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM cut WHERE len(w) > {quality.WINDOW})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM again) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(translate(t, {spaces}, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_listed(quality.STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM cut LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         concat_ws(',', {", ".join(broken(r) for r in quality.RULES)}) AS failed_rules
  FROM measured)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged"""


def licenses_sql() -> str:
    """Scores of all lines, with an anchor or not, and inheritance by comparing all paths."""
    rows, idf, unseen, _ = licenses.template_weights()
    vectors = ", ".join(f"({n}, '{name}', '{word}', {weight!r}::DOUBLE)" for n, name, word, weight in rows)
    rarity = ", ".join(f"('{word}', {value!r}::DOUBLE)" for word, value in sorted(idf.items()))
    return rf"""
WITH vectors(template, license, word, weight) AS (VALUES {vectors}),
rarity(word, idf) AS (VALUES {rarity}),
files AS (
  SELECT row_number() OVER () AS r, page_id,
         nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^?#]+)', 1), '/+$', ''), '') AS path,
         string_split(lower(coalesce(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '')), chr(10)) AS l
  FROM pages),
lines AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM files),
words AS (SELECT r, i, unnest(regexp_extract_all(line, '[\p{{L}}\p{{N}}]+')) AS word FROM lines),
counted AS (
  SELECT r, i, word, count(*) AS tf FROM words WHERE word NOT IN ({_listed(licenses.STOP_WORDS)}) GROUP BY ALL),
weighed AS (
  SELECT r, i, word, tf * coalesce(idf, {unseen!r}::DOUBLE) AS x FROM counted LEFT JOIN rarity USING (word)),
norms AS (SELECT r, i, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
scores AS (
  SELECT r, i, template, license, least(round(sum(x * weight) / any_value(norm), 9), 1.0::DOUBLE) AS score
  FROM weighed JOIN vectors USING (word) JOIN norms USING (r, i) GROUP BY r, i, template, license),
notices AS (
  SELECT r, license, score FROM scores WHERE score >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY score DESC, template) = 1),
own AS (
  SELECT r, n AS n_notices, license, score
  FROM (SELECT *, count(*) OVER (PARTITION BY r) AS n FROM notices)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license DESC) = 1),
judged AS (SELECT * FROM files LEFT JOIN own USING (r)),
directories AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS directory, license FROM judged
  WHERE license IS NOT NULL AND contains(path, '/')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, license DESC) = 1),
inherited AS (
  SELECT r, d.directory, d.license AS above FROM judged j JOIN directories d
  ON j.license IS NULL AND starts_with(j.path, d.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(d.directory) DESC) = 1)
SELECT page_id, path, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(license, above) AS license, score,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN above IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
       directory AS inherited_from
FROM judged LEFT JOIN inherited USING (r)"""


def mixing_sql() -> str:
    """One period by a recursive query, and running totals by one window a source."""
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(length(text), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
weights AS (SELECT source, pow(greatest(sum(size), 1), {mixing.TEMPERATURE}) AS weight, ceil(sum(size) / {mixing.BLOCK_CHARS})::BIGINT AS blocks FROM docs GROUP BY source),
shares AS (
  SELECT source, blocks, greatest(round(weight / sum(weight) OVER () * {mixing.PERIOD}), 1)::BIGINT AS slots FROM weights),
listed AS (SELECT list(source ORDER BY source) AS names, list(slots ORDER BY source) AS slots, sum(slots)::BIGINT AS period FROM shares),
edf AS (
  SELECT -1::BIGINT AS t, list_transform(slots, lambda s: 0::BIGINT) AS done, NULL::BIGINT AS pick, names, slots, period FROM listed
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, names, slots, period
  FROM (
    SELECT *, list_sort(list_filter(list_transform(range(1, len(slots) + 1), lambda k: {{
        'deadline': ceil((done[k] + 1) * period / slots[k]), 'k': k,
        'ready': done[k] < slots[k] AND floor(done[k] * period / slots[k]) <= t + 1}}), lambda c: c.ready))[1].k AS p
    FROM edf WHERE t + 1 < period)),
turns AS (
  SELECT names[pick] AS source, slots[pick] AS slots, period, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
  FROM edf WHERE t >= 0),
lasts AS (
  SELECT min(floor(s.blocks / t.slots)::BIGINT * t.period + t.slot) AS last FROM shares s JOIN turns t ON s.source = t.source AND t.turn = s.blocks % t.slots),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM docs),
cut AS (SELECT *, floor(before / {mixing.BLOCK_CHARS})::BIGINT AS block FROM placed)
SELECT doc_id, c.source, size, before, block, floor(block * t.period / t.slots)::BIGINT AS release,
       ceil((block + 1) * t.period / t.slots)::BIGINT AS deadline,
       floor(block / t.slots)::BIGINT * t.period + t.slot AS slot,
       floor(block / t.slots)::BIGINT * t.period + t.slot < last AS balanced
FROM cut c JOIN turns t ON c.source = t.source AND t.turn = c.block % t.slots CROSS JOIN lasts"""


def phrases_sql() -> str:
    """All phrases of one to three words counted, cut and compared with each longer phrase."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
cut AS (
  SELECT lang, w FROM (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)
  WHERE len(w) > 0),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut CROSS JOIN (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM grams GROUP BY lang, k, 3),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k >= 2 AND a >= 10),
inside AS (
  SELECT lang, array_to_string(unnest([g[1:2], g[2:3]]), ' ') AS phrase, a FROM candidates WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(g[1:cut], ' ') AS head, array_to_string(g[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, h.a AS l, t.a AS r,
         ((1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def negatives_sql() -> str:
    """All rows ranked for every anchor."""
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10"""


def embedding_dedup_sql() -> str:
    """All pairs compared, and classes by following links."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reached AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
classes AS (SELECT u AS vec_id, min(v) AS component_id FROM reached GROUP BY u),
counts AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN counts USING (vec_id)"""


ORACLES = {
    "op6_quality": quality_sql(), "op7_mixing": mixing_sql(), "op9_licenses": licenses_sql(), "op11_phrases": phrases_sql(),
    "op12_hard_negatives": negatives_sql(), "op13_embedding_dedup": embedding_dedup_sql(),
}
