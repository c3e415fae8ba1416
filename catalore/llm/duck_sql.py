"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# White space is deleted character by character, as the contract lists it.
EQUAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

EXACT_DEDUP = f"""
WITH hashed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256({EQUAL}) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, row_number() OVER same AS place, first_value(doc_id) OVER same AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM hashed WINDOW same AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

def count_of(column: str, marks: str) -> str:
    """How often the characters of ``marks`` occur."""
    return " + ".join(
        f"length({column}) - length(replace({column}, '{mark}', ''))" for mark in marks
    )


def any_of(column: str, marks: str) -> str:
    return " OR ".join(f"contains({column}, '{mark}')" for mark in marks)


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

QUALITY = f"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS words
  FROM documents
), lines AS (
  SELECT doc_id, line, len({WORDS.format('line')}) AS n, lower(line) AS low FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM given)
), judged AS (
  SELECT doc_id, line, n,
    3 * ({count_of('line', '!')}) > n + 5 OR 3 * ({count_of('line', '#*$%&<>')}) > n + 5
    OR NOT ({any_of('line', '.!?…。！？')})
    OR 4 * ({count_of('line', '|>»›•·')}) > n
    OR (n <= 30 AND regexp_matches(low, 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|lorem ipsum|click here|sign up for|subscribe to|log in to|read more|share this|skip to content|back to top|page not found|advertisement')) AS failed
  FROM lines WHERE n > 0
), by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (failed) AS n_removed_lines,
    coalesce(sum(n) FILTER (failed), 0)::BIGINT AS n_removed_words
  FROM judged GROUP BY doc_id
), placed AS (
  SELECT doc_id, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS three
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM given)
), again AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, three) AS times FROM placed)
  WHERE times > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM again) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(words) AS n_words, length(list_aggregate(words, 'string_agg', '')) AS chars,
    {count_of('text', '#*$%&|<>')} AS n_symbols
  FROM given
), whole AS (
  SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
  FROM counted LEFT JOIN by_line USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, NOT base_failed AND 100 * n_removed_words <= 40 * n_words AS kept FROM whole
"""

CHAT = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), running AS (
  SELECT *, string_agg(role || chr(31) || text || chr(30), '') OVER (
    PARTITION BY conv_id ORDER BY place) AS prefix
  FROM placed
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id FROM running WHERE place = n GROUP BY prefix
), kept AS (
  SELECT conv_id FROM whole
  WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.prefix = whole.prefix AND r.place < r.n)
)
SELECT conv_id, (place - 1) // 512 AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place)
    AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part
"""


def raking(rounds: int) -> str:
    """CTEs of so many rounds of raking the cells to all three dimensions."""
    parts, last = [], "rake_0"
    for number in range(rounds):
        for at, name in enumerate(("source", "lang", "topic")):
            new = f"rake_{3 * number + at + 1}"
            parts.append(
                f"{new} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {name}) > 0"
                f" THEN weight * {name}_share / sum(weight) OVER (PARTITION BY {name}) ELSE 0 END"
                f" AS weight) FROM {last})"
            )
            last = new
    return ",\n".join(parts) + f", raked AS (SELECT *, weight / tokens AS ratio FROM {last})"


def scaling(steps: int) -> str:
    """CTEs of the scale: cells at one leave their excess to the others."""
    parts = ["scale_0 AS (SELECT 0.7 * sum(tokens) / sum(weight) AS s FROM raked)"]
    for number in range(steps):
        parts.append(
            f"scale_{number + 1} AS (SELECT greatest(0, 0.7 * sum(tokens)"
            " - coalesce(sum(tokens) FILTER (ratio * s >= 1), 0))"
            f" / sum(weight) FILTER (ratio * s < 1) AS s FROM raked, scale_{number})"
        )
    return ",\n".join(parts)


MIXING = f"""
WITH weighed AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(text, ' | ') THEN 'listing' WHEN contains(text, 'icense') THEN 'notice'
      WHEN regexp_matches(text, '[0-9]') THEN 'records' ELSE 'prose' END AS topic,
    greatest(len({WORDS.format("coalesce(text, '')")}), 1)::BIGINT AS tokens
  FROM documents
), cells AS (
  SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM weighed GROUP BY ALL
), sources AS (SELECT source, pow(sum(tokens), 0.7) AS share FROM cells GROUP BY ALL
), langs AS (SELECT lang, pow(sum(tokens), 0.7) AS share FROM cells GROUP BY ALL
), topics AS (SELECT topic, pow(sum(tokens), 0.7) AS share FROM cells GROUP BY ALL
), rake_0 AS (
  SELECT source, lang, topic, tokens, tokens / (SELECT sum(tokens) FROM cells) AS weight,
    s.share / (SELECT sum(share) FROM sources) AS source_share,
    l.share / (SELECT sum(share) FROM langs) AS lang_share,
    t.share / (SELECT sum(share) FROM topics) AS topic_share
  FROM cells JOIN sources s USING (source) JOIN langs l USING (lang) JOIN topics t USING (topic)
), {raking(60)}, {scaling(8)}
SELECT doc_id, source, lang, topic, weighed.tokens, round(least(1, ratio * s), 6) AS probability,
  ('0x' || substr(md5('mixing:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 2.0 ** 48
    < least(1, ratio * s) AS kept
FROM weighed JOIN raked USING (source, lang, topic), scale_8
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = rf"""
WITH RECURSIVE given AS (
  SELECT doc_id, row_number() OVER () AS id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS shingle
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM given WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n, md5(string_agg(md5(shingle), '' ORDER BY md5(shingle))) AS digest FROM shingles GROUP BY id
), classes AS (SELECT digest, min(id) AS class, any_value(n) AS n FROM sizes GROUP BY digest
), rare AS (
  SELECT class, shingle FROM shingles JOIN classes ON id = class
), links AS (
  SELECT x.class AS u, y.class AS v FROM rare x JOIN rare y ON x.shingle = y.shingle AND x.class <> y.class
  JOIN classes c ON c.class = x.class JOIN classes d ON d.class = y.class
  GROUP BY x.class, y.class, c.n, d.n HAVING 100 * count(*) >= 80 * (c.n + d.n - count(*))
), reach AS (
  SELECT class AS u, class AS v FROM classes
  UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), named AS (
  SELECT reach.u AS class, min(doc_id) AS component_id FROM reach
  JOIN classes ON classes.class = reach.v JOIN sizes USING (digest) JOIN given USING (id) GROUP BY reach.u
)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles,
  CASE WHEN sizes.n IS NULL THEN doc_id ELSE component_id END AS component_id,
  sizes.n IS NULL OR doc_id IS NOT DISTINCT FROM component_id AS kept
FROM given LEFT JOIN sizes USING (id) LEFT JOIN classes USING (digest) LEFT JOIN named USING (class)
"""

# crc32 of the decimal doc_id, bit by bit: a byte, then eight shifts.
CRC32 = """xor(list_reduce(
    [4294967295] || flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
      lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

RUNS = rf"""
WITH given AS (
  SELECT doc_id, row_number() OVER () AS id, {CRC32} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given
), words AS MATERIALIZED (
  SELECT id, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word, n
  FROM (SELECT *, unnest(range(0, n)) AS i FROM placed)
), same AS (
  SELECT x.id, x.i, y.i - x.i AS p FROM words x JOIN words y
  ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n AND x.n >= 24
), stretches AS (
  SELECT id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS island FROM same)
  GROUP BY id, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), runs AS (
  SELECT id, start, length, min(p) AS period FROM stretches GROUP BY id, start, length
), best AS (
  SELECT id, start, length, period FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.id = r.id AND (o.length * r.period > r.length * o.period
      OR o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period)))
), listed AS (
  SELECT id, count(*) AS n_runs,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest
  FROM runs GROUP BY id
), dropped AS (
  SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs
), left_over AS (
  SELECT id, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM words ANTI JOIN dropped USING (id, i) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start, best.length, best.period,
  (1000 * best.length) // best.period AS exponent_milli,
  coalesce(listed.digest, sha256('')) AS runs_sha256, coalesce(left_over.digest, sha256('')) AS collapsed_sha256
FROM placed LEFT JOIN best USING (id) LEFT JOIN listed USING (id) LEFT JOIN left_over USING (id)
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM starts)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
), inner_phrases AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2))
  GROUP BY ALL
), cuts AS (
  SELECT f.lang, f.phrase, f.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * f.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) f JOIN totals USING (lang)
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1:k], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1:], ' ')
), least_cuts AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT c.* FROM least_cuts c LEFT JOIN inner_phrases i USING (lang, phrase) WHERE longer IS NULL OR longer < a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": MIXING,
        "op5_line_quality": QUALITY,
        "op7_chat": CHAT,
        "op10_exact_dedup": EXACT_DEDUP,
        "op11_minhash": MINHASH,
        "op12_periodic_runs": RUNS,
        "op13_collocations": COLLOCATIONS,
    }
