"""DuckDB SQL with the same rows as the queries, for those that SQL can express."""

from __future__ import annotations

from veritab.llm import sharding
from veritab.llm.licences import TEMPLATES

#: Bytes that a document takes besides its text.
ROW_BYTES = 16

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ODDS = "ln(prior / (1 - prior)) + " + " + ".join(
    f"CASE v[{j}] WHEN 1 THEN ln(good[{j}] / (1 - bad[{j}])) WHEN -1 THEN ln((1 - good[{j}]) / bad[{j}]) ELSE 0 END"
    for j in range(1, 8)
)


def _accuracies(vote: int, of_class: str) -> str:
    return ", ".join(
        f"(sum(n * CASE WHEN v[{j}] = {vote} THEN {of_class} ELSE 0 END) + 2)"
        f" / (sum(n * CASE WHEN v[{j}] = 0 THEN 0 ELSE {of_class} END) + 4)"
        for j in range(1, 8)
    )


OP1 = rf"""
WITH RECURSIVE split AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents
), windows AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
    SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM split
), facts AS (
    SELECT doc_id, r, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(l)::BIGINT AS n_lines,
        length(regexp_replace(text, '\P{{Lu}}', '', 'g'))::BIGINT AS n_capitals,
        length(regexp_replace(text, '\P{{L}}', '', 'g'))::BIGINT AS n_letters
    FROM split JOIN lines USING (r) LEFT JOIN covered USING (r)
), voted AS (
    SELECT *, [
        CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END,
        CASE WHEN 20 * n_symbols > n_words THEN -1 WHEN n_words > 0 AND 100 * n_symbols <= n_words THEN 1 ELSE 0 END,
        CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1
             WHEN n_words > 0 AND 10 * n_repeat_words <= n_words THEN 1 ELSE 0 END,
        CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1
             WHEN n_lines > 1 AND 10 * n_dup_lines <= n_lines THEN 1 ELSE 0 END,
        CASE WHEN 10 * n_capitals > 3 * word_chars THEN -1
             WHEN word_chars > 0 AND 10 * n_capitals <= word_chars THEN 1 ELSE 0 END,
        CASE WHEN word_chars > 8 * n_words THEN -1
             WHEN n_words > 0 AND word_chars >= 3 * n_words AND 10 * word_chars <= 65 * n_words THEN 1 ELSE 0 END,
        CASE WHEN 100 * n_letters < 87 * word_chars THEN -1
             WHEN word_chars > 0 AND 100 * n_letters >= 92 * word_chars THEN 1 ELSE 0 END
    ] AS v FROM facts
), patterns AS (
    SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v
), em AS (
    SELECT 0 AS step, 0.7::DOUBLE AS prior, [0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.95]::DOUBLE[] AS good,
        [0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4]::DOUBLE[] AS bad
    UNION ALL
    SELECT step + 1, (sum(n * q) + 1) / (sum(n) + 2), [{_accuracies(1, "q")}], [{_accuracies(-1, "(1 - q)")}]
    FROM (SELECT step, v, n, 1 / (1 + exp(-({ODDS}))) AS q FROM em, patterns WHERE step < 20)
    GROUP BY step
), quality AS (
    SELECT v, 1 / (1 + exp(-({ODDS}))) AS q FROM em, patterns WHERE step = 20
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND q >= 0.5 AS kept,
    round(q, 6) AS quality
FROM voted JOIN quality USING (v)
"""

OP3 = rf"""
WITH sized AS (
    SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents
), by_source AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
        2.0::DOUBLE * source_size AS cap
    FROM by_source
), filled AS (
    SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM by_source) - (sum(cap) OVER o - cap))
        / ((SELECT sum(w) FROM ranked) - sum(w) OVER o + w) AS level
    FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
    SELECT source, source_size, least(cap, w * (SELECT max(level) FROM filled)) AS target FROM filled
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
    size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM rated
"""

NOTICES = ", ".join(
    "({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES)
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKED = (
    "(?i)licen[sc]|copyright|warrant|permission is hereby|hereby granted|redistribution|public domain|"
    "written permission|without fee"
)
SIGNS = r"^[\x20\x09-\x0D#*/;%!<>-]+|[\x20\x09-\x0D*/#>-]+$"


def _terms(text: str) -> str:
    lowered = f"translate({text}, '{UPPER}', '{UPPER.lower()}')"
    return f"list_filter(string_split_regex({lowered}, '[^a-z0-9]+'), lambda x: x <> '')"


OP9 = rf"""
WITH files AS (
    SELECT doc_id, coalesce(text, '') AS t, source || '/' || (doc_id // 1000) || '/' || CASE
        WHEN doc_id % 1000 = 0 THEN 'LICENSE'
        WHEN doc_id % 50 = 0 THEN (doc_id // 50) || '/LICENSE'
        ELSE (doc_id // 50) || '/' || doc_id || '.txt' END AS path
    FROM documents
), named AS (
    SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder, coalesce(path LIKE '%/LICENSE', false) AS is_licence
    FROM files
), texts AS (
    SELECT DISTINCT md5(t) AS key, t, is_licence,
        list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{SIGNS}', '', 'g')) AS ls
    FROM named WHERE is_licence OR regexp_matches(t, '{MARKED}')
), marks AS (
    SELECT * FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS line FROM texts WHERE regexp_matches(t, '{MARKED}'))
    WHERE regexp_matches(ls[line], '{MARKED}')
), units AS (
    SELECT * FROM (
        SELECT DISTINCT key, is_licence, line - b AS first, line + n - 1 AS last, array_to_string(ls[line - b : line + n - 1], ' ') AS unit
        FROM marks, unnest(range(4)) AS x(b), unnest([1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24]) AS y(n)
        WHERE line - b >= 1 AND (n = 1 OR line + n - 1 <= len(ls)))
    WHERE first = last OR length(unit) <= 4000
    UNION ALL SELECT key, is_licence, 0, 0, t FROM texts WHERE is_licence
), notices AS (
    SELECT * FROM (VALUES {NOTICES}) AS x(template, licence, notice)
), notice_terms AS (
    SELECT template, licence, term, count(*) AS n
    FROM (SELECT template, licence, unnest({_terms("notice")}) AS term FROM notices) GROUP BY ALL
), weights AS (
    SELECT term, ln((1 + (SELECT count(*) FROM notices)) / (1 + count(*))::DOUBLE) + 1 AS weight
    FROM notice_terms GROUP BY term
), shares AS (
    SELECT template, licence, term, n * weight / sqrt(sum(n * weight * n * weight) OVER (PARTITION BY template)) AS share
    FROM notice_terms JOIN weights USING (term)
), unit_terms AS (
    SELECT unit, term, count(*) * coalesce(any_value(weight), ln(1 + (SELECT count(*) FROM notices)) + 1) AS value
    FROM (SELECT unit, unnest({_terms("unit")}) AS term FROM (SELECT DISTINCT unit FROM units))
    LEFT JOIN weights USING (term) GROUP BY unit, term
), norms AS (
    SELECT unit, sqrt(sum(value * value)) AS norm FROM unit_terms GROUP BY unit
), scored AS (
    SELECT unit, licence, round(sum(value * share) / any_value(norm), 6) AS cosine
    FROM unit_terms JOIN shares USING (term) JOIN norms USING (unit) GROUP BY unit, template, licence
), best AS (
    SELECT unit, licence, cosine FROM scored WHERE cosine >= 0.7
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, licence) = 1
), told AS (
    SELECT m.key, m.is_licence, m.line, licence, cosine FROM marks AS m
    JOIN units AS u ON u.key = m.key AND u.is_licence = m.is_licence AND m.line BETWEEN u.first AND u.last JOIN best USING (unit)
    UNION ALL SELECT key, is_licence, 0, licence, cosine FROM units JOIN best USING (unit) WHERE first = 0
), of_text AS (
    SELECT key, is_licence, list_sort(list(DISTINCT licence)) AS own, max(cosine) AS cosine FROM (
        SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY key, is_licence, line ORDER BY cosine DESC, licence) = 1)
    GROUP BY key, is_licence
), given AS (
    SELECT folder AS above, list_sort(list_distinct(flatten(list(own)))) AS own
    FROM named JOIN of_text ON key = md5(t) AND of_text.is_licence = named.is_licence
    WHERE named.is_licence AND path IS NOT NULL GROUP BY folder
), nearest AS (
    SELECT folder, above, own AS given
    FROM (SELECT DISTINCT folder FROM named WHERE folder IS NOT NULL)
    JOIN given ON folder = above OR starts_with(folder, above || '/') OR above = ''
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1
)
SELECT doc_id, path, array_to_string(own, ',') AS own, cosine, array_to_string(coalesce(own, given), ',') AS licences,
    CASE WHEN own IS NULL THEN above END AS inherited_from
FROM named LEFT JOIN of_text ON key = md5(t) AND of_text.is_licence = named.is_licence
LEFT JOIN nearest USING (folder)
"""

def _round_hash(x: str, key: str) -> str:
    """The hash of a Feistel round, as SQL."""
    first = f"(({x}::HUGEINT * {sharding.FIRST} + {key}) % 4294967296)::BIGINT"
    mixed = f"((xor({first}, {first} >> 15)::HUGEINT * {sharding.SECOND}) % 4294967296)::BIGINT"
    return f"xor({mixed}, {mixed} >> 13)"


OP11 = rf"""
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(b))
), given AS (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS row,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
    FROM documents
), bounds AS (
    SELECT n, half, (1::BIGINT << half) - 1 AS mask,
        list_transform(range({sharding.ROUNDS}), lambda r:
            ({sharding.SEED} * {sharding.FIRST} + r * {sharding.SECOND} + 1) % 4294967296) AS keys
    FROM (SELECT count(*) AS n, greatest(1, (length(bin(greatest(count(*) - 1, 0))) + 1) // 2) AS half FROM documents)
), walk AS (
    SELECT row, row >> half AS l, row & mask AS r, 0 AS k FROM given, bounds
    UNION ALL
    SELECT row, CASE WHEN k < {sharding.ROUNDS} THEN r ELSE l END,
        CASE WHEN k < {sharding.ROUNDS} THEN xor(l, {_round_hash("r", "keys[k + 1]")} & mask) ELSE r END,
        CASE WHEN k < {sharding.ROUNDS} THEN k + 1 ELSE 0 END
    FROM walk, bounds WHERE k < {sharding.ROUNDS} OR ((l << half) | r) >= n
), permuted AS (
    SELECT row, (l << half) | r AS p FROM walk, bounds WHERE k = {sharding.ROUNDS} AND ((l << half) | r) < n
)
SELECT doc_id, len(bytes) + {ROW_BYTES} AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])),
        4294967295) AS text_crc32,
    'rows' AS law, (p % {sharding.SHARDS})::INTEGER AS shard, p // {sharding.SHARDS} AS slot,
    NULL::INTEGER AS grown_shard, row AS row_number
FROM given JOIN permuted USING (row), crc_table
"""

ORACLE: dict[str, str] = {"op1_quality_rules": OP1, "op3_source_mixing": OP3, "op9_license_scans": OP9, "op11_sharding": OP11}
