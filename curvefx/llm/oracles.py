"""DuckDB SQL for the text queries that SQL can express: 1, 5, 6 and 9.

The k-d tree (2), BPE (3), the 64 majority bits with components (4), the trained models (7, 10) and tree scoring (8) are
tested against brute force, round trips or held-out labels instead.
"""

from .quality_rules import ALPHA, DELTA, RULES
from .url_filter import ADDRESS, DOUBT, MOST_BAD, STRONGEST, SUFFIX, WEAKEST

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"list_filter(string_split_regex(coalesce({_LOW}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '')"

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, (len(w) - least(13, len(w)) + 2)::BIGINT)) AS s FROM i WHERE len(w) > 0)),
sz AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS s FROM d JOIN sz ON len(w) >= n)),
hit AS (SELECT r, s, dw.n, item FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, (len(w) - 18)::BIGINT)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w)::BIGINT + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _values(rule: str) -> str:
    return {"symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines * 8 / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "shouting": "n_loud / greatest(word_chars, 1)", "word_length": "word_chars / greatest(n_words, 1)"}[rule]


_TESTS = [(r, c) for r, grid in RULES.items() for c in grid]
_GRID = ", ".join(f"('{r}', {c}::DOUBLE)" for r, c in _TESTS)
OP6 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, (len(w) - 1)::BIGINT)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
f AS (SELECT d.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z!]', '', 'g')))::BIGINT AS n_loud FROM d LEFT JOIN rep ON rep.r = d.r),
v AS (SELECT r, stratum, doc_id, unnest([{", ".join(f"{{'rule': '{r}', 'v': {_values(r)}::DOUBLE}}" for r in RULES)}], recursive := true) FROM f),
m AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT stratum, rule, v FROM v JOIN m USING (doc_id)),
k AS (SELECT stratum, g.rule, cutoff, count(*) AS n, count(*) FILTER (v >= cutoff) AS k FROM good g JOIN (VALUES {_GRID}) c(rule, cutoff) ON c.rule = g.rule GROUP BY ALL),
tail AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}::DOUBLE) + (n - i) * ln(1 - {ALPHA}::DOUBLE))) AS p FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k WHERE k <= {ALPHA}::DOUBLE * n) GROUP BY ALL),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE p <= {DELTA}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM good) * {len(_TESTS)}) GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM v JOIN cut USING (stratum, rule) WHERE v >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r NOT IN (SELECT r FROM bad) AS kept FROM f"""


def _strength(level: str, source: str) -> str:
    raw = "(p * (1 - p) - s) / (s - p * (1 - p) * inv / m)"
    return f"{level}_s AS (SELECT p, greatest({WEAKEST}, least({STRONGEST}, CASE WHEN m > 1 AND s - p * (1 - p) * inv / m > 1e-9 THEN {raw} ELSE {STRONGEST} END)) AS str FROM (SELECT coalesce(tb / tn, 0) AS p, m, inv, (sq - tn * (tb / tn) * (tb / tn)) * m / ((m - 1) * tn) AS s FROM (SELECT sum(n)::DOUBLE AS tn, sum(bad)::DOUBLE AS tb, count(*)::DOUBLE AS m, sum(1::DOUBLE / n) AS inv, sum(bad * bad / n::DOUBLE) AS sq FROM {source})))"


_TAIL = "substr(url, nullif(strpos(url, '://'), 0) + 3)"
_NAME = "regexp_replace(regexp_replace(host, '^[^@]*@', ''), '\\.?(:[0-9]*)?$', '')"


def _part(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name ELSE regexp_extract(name, '{pattern}', 1) END"


#: The beta posterior's distribution function at MOST_BAD, as its power series.
_CDF = f"(SELECT sum(exp((a + n) * ln({MOST_BAD}) + b * ln(1 - {MOST_BAD}) + lgamma(a + b + n) - lgamma(b) - lgamma(a + 1 + n))) FROM (SELECT unnest(range(0, 4 * ceil(a + b)::BIGINT + 200)) AS n))"
OP9 = f"""WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract({_TAIL}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(substr({_TAIL}, length(regexp_extract({_TAIL}, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM pages),
n AS (SELECT {_NAME} AS name, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html?)?/?$', 1) AS BIGINT) AS doc_id FROM u),
o AS (SELECT name, (bad)::DOUBLE AS bad FROM n JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE name <> ''),
h AS (SELECT name, count(*) AS n, sum(bad) AS bad, {_part(f"(?:^|\\.)((?:[^.]+\\.)?{SUFFIX})$")} AS domain, {_part(f"(?:^|\\.)({SUFFIX})$")} AS suffix FROM o GROUP BY ALL),
dm AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad) AS bad FROM h GROUP BY ALL), sf AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad) AS bad FROM dm GROUP BY ALL),
{_strength("a", "sf")}, {_strength("b", "dm")}, {_strength("c", "h")},
every AS (SELECT name, coalesce(h.n, 0) AS n, coalesce(h.bad, 0) AS bad, {_part(f"(?:^|\\.)((?:[^.]+\\.)?{SUFFIX})$")} AS domain, {_part(f"(?:^|\\.)({SUFFIX})$")} AS suffix FROM (SELECT DISTINCT name FROM n WHERE name <> '') LEFT JOIN h USING (name)),
tot AS (SELECT coalesce(sum(n), 0) AS tn, coalesce(sum(bad), 0) AS tb FROM sf),
own AS (SELECT every.*, coalesce(x.n, 0) AS dn, coalesce(x.bad, 0) AS db, coalesce(y.n, 0) AS sn, coalesce(y.bad, 0) AS sb FROM every LEFT JOIN dm x ON x.domain = every.domain LEFT JOIN sf y ON y.suffix = every.suffix),
m1 AS (SELECT own.*, CASE WHEN tn > sn THEN (tb - sb) / (tn - sn) ELSE a_s.p END AS top FROM own, tot, a_s),
m2 AS (SELECT m1.*, (a_s.str * top + (sb - db)) / (a_s.str + (sn - dn)) AS sm FROM m1, a_s),
m3 AS (SELECT m2.*, (b_s.str * sm + (db - bad)) / (b_s.str + (dn - n)) AS mean FROM m2, b_s),
ab AS (SELECT name, c_s.str * mean + bad AS a, c_s.str * (1 - mean) + n - bad AS b FROM m3, c_s),
low AS (SELECT name, CASE WHEN a <= 0 THEN false WHEN b <= 0 THEN true ELSE {_CDF} < {DOUBT} END AS bad FROM ab),
rl AS (SELECT r, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM u JOIN (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(action, rh, rp) ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp), LATERAL (SELECT rh || rp AS rule) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN low.bad THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN rl USING (r) LEFT JOIN low ON low.name = {_NAME}"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1, "op5_substring_dedup": OP5, "op6_quality_rules": OP6, "op9_url_filter": OP9}
