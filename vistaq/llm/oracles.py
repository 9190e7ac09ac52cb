"""SQL for the queries that SQL can express."""

from __future__ import annotations

from . import decontam, neardup, rules, substrings

#: Fixed rules and the list of op2, and its canonical form.
OP2 = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), judged AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS query
  FROM parts
), named AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
  FROM judged
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM named JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|[.-])(casino|poker|bet|win|pills|xxx)([.-]|$)') AND canonical IS NOT NULL
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.r_verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fits f USING (page_id) LEFT JOIN listed l ON n.canonical = l.canonical
"""


_LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_VISIBLE = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


#: Windows meet by the hash of their words joined by a space, which is in no word.
OP1 = f"""
WITH d AS (
  SELECT doc_id, {_words(_LOWER.format(text="text"), _ALNUM)} AS w FROM documents
), b AS (
  SELECT item_id, {_words(_LOWER.format(text="text"), _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), {decontam.WIDTH}) AS n, unnest(list_transform(range(1, greatest(len(w) - {decontam.WIDTH} + 1, 1) + 1), lambda i: md5(array_to_string(w[i:i + {decontam.WIDTH} - 1], ' ')))) AS h FROM b WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: md5(array_to_string(w[i:i + n - 1], ' ')))) AS h
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.h = bw.h AND dw.n = bw.n
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN covered USING (doc_id)
"""

OP7 = f"""
WITH d AS (
  SELECT doc_id, {_words("coalesce(text, '')", _VISIBLE)} AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - {substrings.WIDTH} + 2)) AS i, unnest(list_transform(range(1, len(w) - {substrings.WIDTH} + 2), lambda i: md5(array_to_string(w[i:i + {substrings.WIDTH} - 1], ' ')))) AS h
  FROM d WHERE len(w) >= {substrings.WIDTH}
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.WIDTH})) AS pos FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _rules() -> str:
    """op8: bins of characters are counts of bytes; the divergence is a sum over the bins of the language's reference."""
    plain = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r"\x20\x09\x0B\x0C\x0D", "newline": r"\x0A", "period_comma": ".,", "quote_dash": r"\x27\x22:;()?\-", "symbol": r"#*$%&|<>!~\^_=+@{}\[\]\\/`", "control": r"\x00-\x08\x0E-\x1F\x7F"}
    counted = {name: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))" for name, chars in plain.items()}
    counted["letter_above_ascii"] = r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"
    counted["continuation"] = "strlen(t) - length(t)"
    limits = rules.Limits()
    listed = ", ".join(f"('{w}')" for w in rules.VOCABULARY)
    langs = ", ".join(f"'{x}'" for x in rules.COMMON_WORDS)

    def divergence(name: str, source: str) -> str:
        """Jensen-Shannon divergence of ``source`` (doc_id, lang, bin, n) to its sums by language."""
        return f"""{name}_ref AS (SELECT lang, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM {source} GROUP BY lang, bin),
        {name}_own AS (SELECT doc_id, lang, sum(n) AS total FROM {source} GROUP BY doc_id, lang),
        {name}_terms AS (SELECT o.doc_id, coalesce(s.n, 0) / o.total AS p, r.n / r.total AS q FROM {name}_own o JOIN {name}_ref r ON o.lang = r.lang AND r.n > 0 LEFT JOIN {source} s ON s.doc_id = o.doc_id AND s.bin = r.bin WHERE o.total > 0),
        {name} AS (SELECT doc_id, greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0) AS js FROM {name}_terms GROUP BY doc_id)"""

    classes = " UNION ALL ".join(f"SELECT doc_id, lang, '{name}' AS bin, ({sql})::DOUBLE AS n FROM d" for name, sql in counted.items())
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE '{rules.OTHER}' END AS lang, {_words("coalesce(text, '')", _VISIBLE)} AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 2
), again AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM grams JOIN (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_VISIBLE}') GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)
), some_classes AS ({classes}
), classes AS (
  SELECT * FROM some_classes UNION ALL SELECT doc_id, lang, 'other_mark', strlen(t) - (SELECT sum(n) FROM some_classes s WHERE s.doc_id = d.doc_id) FROM d
), folded AS (
  SELECT doc_id, lang, unnest({_words(_LOWER.format(text="t"), _ALNUM)}) AS word FROM d
), words AS (
  SELECT doc_id, lang, coalesce(v.word, '') AS bin, count(*)::DOUBLE AS n FROM folded f LEFT JOIN (VALUES {listed}) v(word) ON f.word = v.word GROUP BY ALL
), common AS (
  SELECT doc_id, lang, bin <> '' AS bin, sum(n) AS n FROM words GROUP BY ALL
), n_folded AS (
  SELECT doc_id, sum(n) AS n FROM words GROUP BY doc_id
), {divergence("of_chars", "classes")}, {divergence("of_words", "words")}, {divergence("of_common", "common")}, judged AS (
  SELECT b.*, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed, sqrt(coalesce(c.js, 0)) AS char_distance,
         sqrt(coalesce(o.js, 0) + {rules.AMONG_COMMON} * greatest(coalesce(x.js, 0) - coalesce(o.js, 0), 0)) AS word_distance, coalesce(f.n, 0) AS n_folded
  FROM base b LEFT JOIN of_chars c USING (doc_id) LEFT JOIN of_words x USING (doc_id) LEFT JOIN of_common o USING (doc_id) LEFT JOIN n_folded f USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND NOT (n_words >= {limits.judged_words} AND word_chars >= {limits.judged_chars}
         AND (char_distance > {limits.char_distance} + {limits.slack} / sqrt(greatest(word_chars, 1)) OR word_distance > {limits.word_distance} + {limits.word_slack} / sqrt(greatest(n_folded, 1)))) AS kept
FROM judged
"""


OP8 = _rules()

#: Pairs meet in the shingles they share; components by the rows that each can reach.
OP9 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_words(_LOWER.format(text="text"), _VISIBLE)} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {neardup.SHINGLE} + 1, 1) + 1), lambda i: md5(array_to_string(w[i:i + {neardup.SHINGLE} - 1], ' ')))) AS g FROM d WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), edges AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), least_of AS (
  SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op2_url_filter": OP2, "op7_substring_dedup": OP7, "op8_quality_rules": OP8, "op9_near_dedup": OP9}
