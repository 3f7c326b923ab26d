"""The queries that SQL can express, in DuckDB SQL over the same tables."""

from __future__ import annotations

from dendra.llm import collocations, minhash, mixing, rules, secrets, substrings, suffixes

WORD = r"'[^\x20\x09-\x0D]+'"
WORDS = f"regexp_extract_all(coalesce(text, ''), {WORD})"
ROWS = "SELECT row_number() OVER () AS rid, * FROM documents"


def substring_dedup() -> str:
    n = substrings.WINDOW
    return f"""
WITH d AS (SELECT rid, doc_id, {WORDS} AS w FROM ({ROWS})),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE doc_id IS NOT NULL)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {n})) AS j FROM win JOIN least USING (h) WHERE doc_id > m),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
left_ AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM word ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (rid)"""


def near_dedup(k: int = 4, percent: int = 80) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH RECURSIVE d AS (SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), {WORD}) AS w FROM ({ROWS})),
sh AS MATERIALIZED (SELECT DISTINCT rid, doc_id, md5(array_to_string(w[i:least(i + {k - 1}, len(w))], ' ')) AS g FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM sh GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid < b.rid WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY ALL),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM both_ JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS x, a AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON a = y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(coalesce(c, d.doc_id) = d.doc_id, true) AS kept
FROM d LEFT JOIN size USING (rid) LEFT JOIN comp ON x = d.doc_id"""


def quality_rules() -> str:
    share = {r: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END" for r, ((a, b), _) in rules.RULES.items()}
    cut = lambda r, names, step: f"{rules.RULES[r][1][rules.cutoff_at(r, step)]!r}::DOUBLE" if r in names else "NULL"  # noqa: E731
    settings = ", ".join(f"({i}, {len(names)}, {step}, {', '.join(cut(r, names, step) for r in rules.RULES)})" for i, names in enumerate(rules.SETS) for step in range(1, rules.STEPS + 1))
    over = lambda r: f"coalesce({share[r]} > {r}, false)"  # noqa: E731
    return f"""
WITH t AS (SELECT rid, doc_id, lang, coalesce(text, '') AS t FROM ({ROWS})),
w AS (SELECT rid, doc_id, lang, t, regexp_extract_all(t, {WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM t),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY rid),
s AS MATERIALIZED (SELECT rid, doc_id, coalesce('=' || lang, 'null') AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals FROM w LEFT JOIN rep USING (rid)),
base AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM s),
marked AS (SELECT base.*, good FROM base JOIN (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
setting(i, size, step, {", ".join(rules.RULES)}) AS (VALUES {settings}),
tally AS (SELECT stratum, i, size, step, count(*) FILTER (good AND hit) AS k, count(*) FILTER (good) AS n, count(*) FILTER (NOT good AND hit) AS bad FROM (SELECT stratum, good, i, size, step, {" OR ".join(map(over, rules.RULES))} AS hit FROM marked, setting) GROUP BY ALL),
proof AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({rules.ALPHA!r}) + (n - x) * ln(1 - {rules.ALPHA!r}))) FROM range(0, k + 1) r(x)) END AS p FROM tally),
sequence_ AS (SELECT *, bool_and(p <= {rules.DELTA!r} / (SELECT count(DISTINCT stratum) FROM marked) / {len(rules.SETS)}) OVER (PARTITION BY stratum, i ORDER BY step) AS proven FROM proof),
best AS (SELECT stratum, i, step FROM sequence_ WHERE proven AND bad > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, k, size, step DESC, i) = 1),
broken AS (SELECT rid, concat_ws(',', {", ".join(f"CASE WHEN {over(r)} THEN '{r}' END" for r in rules.RULES)}) AS r FROM base JOIN best USING (stratum) JOIN setting USING (i, step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(r, '') = '' AS kept, coalesce(r, '') AS broken_rules FROM base LEFT JOIN broken USING (rid)"""


def secret_scan() -> str:
    found, scope = [], secrets.SCOPE
    for k, p in enumerate(secrets.PARTS):
        pattern = "'" + p.pattern.replace("'", "''") + "'"
        value = f"regexp_extract(m, {pattern}, {p.group})" if p.group else "m"
        more = " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')" if p.extra else ""
        lists = f"SELECT rid, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS gs FROM t WHERE regexp_matches(t, {pattern})"
        flat = f"SELECT rid, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, length(unnest(gs[1:len(ms)])) AS gap FROM ({lists})"
        place = f"SELECT rid, m, CAST(sum(gap + length(m)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM ({flat})"
        found.append(f"SELECT rid, {k} AS kind, '{p.name}' AS name, {p.role} AS role, {str(p.strong).lower()} AS strong, e - length(m) AS s, e FROM ({place}) WHERE length({value}) >= {p.shortest}{more}")

    def has(role: int, strong: str) -> str:
        return f"coalesce(bool_or(y.role = {role} AND {strong}), false)"

    weak = " OR ".join(f"(any_value(x.role) = {r} AND ({has(a, 'y.strong')} OR {has(b, 'y.strong')} OR ({has(a, 'true')} AND {has(b, 'true')})))" for r, a, b in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
    return f"""
WITH t AS (SELECT rid, doc_id, coalesce(text, '') AS t FROM ({ROWS})),
p AS MATERIALIZED ({" UNION ALL ".join(found)}),
near AS (SELECT x.rid, x.kind, x.s, x.e, any_value(x.name) AS name, {weak} AS supported FROM p x JOIN p y ON x.rid = y.rid AND NOT x.strong AND y.s < x.e + {scope} AND y.e > x.s - {scope} AND NOT (y.s < x.e AND y.e > x.s) GROUP BY x.rid, x.kind, x.s, x.e),
kept AS (SELECT rid, kind, name, s, e, true AS strong FROM p WHERE strong UNION ALL
  SELECT rid, kind, name, s, e, false FROM near n WHERE supported AND NOT EXISTS (SELECT 1 FROM p y WHERE y.strong AND y.rid = n.rid AND y.s < n.e AND y.e > n.s)),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg(concat(name, ':', s, ':', e), ',' ORDER BY s, kind) FILTER (strong) AS base, string_agg(concat(name, ':', s, ':', e), ',' ORDER BY s, kind) AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN agg USING (rid)"""


def source_mixing() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    r = mixing.REPEATS
    return f"""
WITH d AS (SELECT rid, doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{mixing.SEED}'), 1, 15) AS BIGINT) AS h FROM ({ROWS})),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
wt AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END::DOUBLE AS w FROM src),
tot AS (SELECT least({mixing.SHARE} * sum(source_size), {r}.0 * sum(source_size)) AS total FROM src),
-- sources fill up in the order of size per weight: the level at which the rest shares what is left
ord AS (SELECT *, (total - coalesce(sum({r}.0 * source_size) OVER below, 0)) / (sum(w) OVER (ORDER BY {r}.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM wt, tot
  WINDOW below AS (ORDER BY {r}.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min(level, {r}.0 * source_size / w) FILTER (level * w < {r}.0 * source_size) AS level FROM ord),
tgt AS (SELECT source, source_size, CASE WHEN level IS NULL THEN {r}.0 * source_size ELSE least({r}.0 * source_size, level * w) END AS target FROM (SELECT o.source, o.source_size, o.w, l.level FROM ord o, lvl l)),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least({r}, floor(target / source_size + 1e-12)) AS BIGINT) ELSE 0 END AS passes FROM tgt),
run AS (SELECT d.*, source_size, target, passes, CASE WHEN passes < {r} THEN target - passes * source_size ELSE 0 END AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
fin AS (SELECT *, CAST(passes + CASE WHEN rest > 0 AND before_ + size / 2.0 <= rest THEN 1 ELSE 0 END AS INTEGER) AS times FROM run)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * times AS BIGINT) AS taken, times FROM fin"""


def suffix_dedup() -> str:
    n = suffixes.LENGTH
    return f"""
WITH d AS (SELECT rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM ({ROWS})),
win AS (SELECT rid, doc_id, b, md5(substr(x, 2 * b + 1, {2 * n})) AS h FROM (SELECT rid, doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - {n - 1})) AS b FROM d WHERE doc_id IS NOT NULL)),
least AS (SELECT h, min({{'d': doc_id, 'b': b}}) AS m FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT rid, b FROM win JOIN least USING (h) WHERE {{'d': doc_id, 'b': b}} > m),
isle AS (SELECT rid, b, sum(CASE WHEN b > prev + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY b) AS g FROM (SELECT rid, b, lag(b, 1, -{10 * n}) OVER (PARTITION BY rid ORDER BY b) AS prev FROM gone)),
span AS (SELECT rid, min(b) AS s, max(b) + {n} AS e FROM isle GROUP BY rid, g),
sums AS (SELECT rid, CAST(sum(e - s) AS BIGINT) AS gone, count(*) AS spans FROM span GROUP BY rid),
keep AS (SELECT rid, e AS s, lead(s, 1, NULL) OVER (PARTITION BY rid ORDER BY s) AS e FROM span UNION ALL SELECT rid, 0, min(s) FROM span GROUP BY rid),
text_ AS (SELECT rid, string_agg(substr(x, 2 * s + 1, CASE WHEN e IS NULL THEN length(x) ELSE 2 * (e - s) END), '' ORDER BY s) AS k FROM keep JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN text_ USING (rid)"""


def collocations_() -> str:
    c = collocations
    joined = lambda w: f"array_to_string({w}, ' ')"  # noqa: E731
    return rf"""
WITH p AS (SELECT coalesce(lang, '{c.NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
tot AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, {joined("w[i:i + k - 1]")} AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {c.MOST_WORDS + 1})) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= {c.LEAST_COUNT}),
cut AS (SELECT lang, phrase, w, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score, cut FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = {joined("cut.w[:cut]")}
  JOIN f y ON y.lang = cut.lang AND y.phrase = {joined("cut.w[cut + 1:]")} JOIN tot ON tot.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, f, {joined("w[i:i + m - 1]")} AS phrase FROM (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, f, w, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
longer AS (SELECT lang, phrase, max(f) AS f FROM held GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN longer USING (lang, phrase) WHERE NOT coalesce(100 * f >= {c.ABSORBED} * a, false) QUALIFY rank <= {c.PER_LANG}"""


ORACLES = {
    "op1_substring_dedup": substring_dedup(),
    "op2_minhash_near_dedup": near_dedup(),
    "op4_quality_rules": quality_rules(),
    "op6_secret_scan": secret_scan(),
    "op8_source_mixing": source_mixing(),
    "op10_suffix_array_dedup": suffix_dedup(),
    "op11_collocations": collocations_(),
}
