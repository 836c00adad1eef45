"""SQL for the corpus operators that SQL can express; each text stands by itself."""

from __future__ import annotations

from . import license_scan, line_dedup, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{_WORD}')"


def license_sql() -> str:
    phrases = ", ".join(f"(string_split({_quoted(p)}, ' '), {_quoted(label)})" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({i}, {_quoted(label)}, {_words(_quoted(t))})" for i, (label, t) in enumerate(license_scan.TEMPLATES))
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, {_words('text')} AS w FROM docs),
p(p, label) AS (VALUES {phrases}),
places AS MATERIALIZED (SELECT r, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(p) - 1] = p)) - 1 AS spot
  FROM (SELECT r, w FROM w), p),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM places GROUP BY r),
t(t, label, tl) AS MATERIALIZED (SELECT * FROM (VALUES {templates})),
tw AS MATERIALIZED (SELECT t, label, list_distinct(tl) AS tw, len(tl) AS size, greatest(1, ceil({license_scan.THRESHOLD}::DOUBLE * len(list_distinct(tl)) - 1e-9)) AS need FROM t),
lines AS MATERIALIZED (SELECT r, {_words('line')} AS lw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
whole AS MATERIALIZED (SELECT r, t, label, w, tw, size, need FROM w, tw WHERE len(list_intersect(w, tw)) >= need),
runs AS MATERIALIZED (SELECT r, label, tw, need, list_max(list_transform(range(1, greatest(1, len(w) - size + 1) + 1), lambda i: len(list_intersect(w[i : i + size - 1], tw)))) AS shared FROM whole),
met AS MATERIALIZED (SELECT r, label, shared / CAST(len(tw) AS DOUBLE) AS share FROM
  (SELECT r, label, tw, need, len(list_intersect(lw, tw)) AS shared FROM lines JOIN whole USING (r) UNION ALL SELECT r, label, tw, need, shared FROM runs) WHERE shared >= need),
best AS (SELECT r, max(share) AS share FROM met GROUP BY r),
labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r),
base_labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM places) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN labels USING (r) LEFT JOIN base_labels USING (r)"""


#: Concentration steps that the SQL has room for; an estimate that stopped earlier stays as it is.
ROUNDS = 16


def _ldl(rows: str, keep: str, n: int) -> str:
    """``rows`` (keep, a00, a10, a11, ..) with unit lower factor e10, .. and pivots p0, .., by elimination without roots."""
    left = {(i, j): f"a{i}{j}" for i in range(n) for j in range(i + 1)}
    for k in range(n):
        items = [f"greatest({left[k, k]}, 1.0::DOUBLE) AS p{k}"]
        rows = f"(SELECT *, {', '.join(items)} FROM {rows})"
        items = [f"{left[i, k]} / p{k} AS e{i}{k}" for i in range(k + 1, n)]
        items += [f"{left[i, j]} - {left[i, k]} * {left[j, k]} / p{k} AS a{i}{j}_{k}" for i in range(k + 1, n) for j in range(k + 1, i + 1)]
        if items:
            rows = f"(SELECT *, {', '.join(items)} FROM {rows})"
        left |= {(i, j): f"a{i}{j}_{k}" for i in range(k + 1, n) for j in range(k + 1, i + 1)}
    factor = [f"e{i}{j}" for i in range(n) for j in range(i)] + [f"p{i}" for i in range(n)]
    return f"(SELECT {keep}, {', '.join(factor)}, {' + '.join(f'ln(p{i})' for i in range(n))} AS logdet FROM {rows})"


def _far(rows: str, keep: str, n: int) -> str:
    """``rows`` (keep, x0.., mu0.., e10.., p0..) with their squared distance d2, by forward elimination."""
    for i in range(n):
        rows = f"(SELECT *, x{i} - mu{i}{''.join(f' - e{i}{j} * r{j}' for j in range(i))} AS r{i} FROM {rows})"
    return f"(SELECT {keep}, {' + '.join(f'r{i} * r{i} / p{i}' for i in range(n))} AS d2 FROM {rows})"


def quality_sql() -> str:
    """Statistics and estimates worked out anew: an elimination without roots, weights instead of picked bins."""
    q, n = quality, quality.P
    tri = [(i, j) for i in range(n) for j in range(i + 1)]
    xs, mus = ", ".join(f"x{i}" for i in range(n)), ", ".join(f"mu{i}" for i in range(n))
    factor = ", ".join([f"e{i}{j}" for i in range(n) for j in range(i)] + [f"p{i}" for i in range(n)])
    cov = ", ".join(f"a{i}{j}" for i, j in tri)
    ridge = {(i, i): f" + pow({q.FLOORS[i]}::DOUBLE * {q.UNIT}, 2)" for i in range(n)}
    wide = ", ".join(f"sqrt(pow(1.4826::DOUBLE * quantile_cont(abs(x{i} - mu{i}), 0.5), 2){ridge[i, i]}) AS s{i}" for i in range(n))
    unit = ", ".join(f"(x{i} - mu{i}) / s{i} AS t{i}" for i in range(n))
    clip = ", ".join(f"round(least({q.CLIP}, greatest(-{q.CLIP}, t{i})) * {q.GRAIN}) AS u{i}" for i in range(n))
    norm = f"sqrt({' + '.join(f't{i} * t{i}' for i in range(n))})"
    sign = ", ".join(f"CASE WHEN {norm} = 0 THEN 0 ELSE round(t{i} / {norm} * {q.GRAIN}) END AS v{i}" for i in range(n))
    first = [
        ", ".join((f"any_value(s{i}) * any_value(s{i})" if i == j else "0.0::DOUBLE") + f" AS a{i}{j}" for i, j in tri),
        ", ".join(f"any_value(s{i}) * any_value(s{j}) * CAST(sum(CAST(u{i} * u{j} AS BIGINT)) AS DOUBLE) / count(*) / {q.GRAIN * q.GRAIN}{ridge.get((i, j), '')} AS a{i}{j}" for i, j in tri),
        ", ".join(f"{n} * any_value(s{i}) * any_value(s{j}) * CAST(sum(CAST(v{i} * v{j} AS BIGINT)) AS DOUBLE) / count(*) / {q.GRAIN * q.GRAIN}{ridge.get((i, j), '')} AS a{i}{j}" for i, j in tri),
    ]
    center = ", ".join(f"any_value(mu{i}) AS mu{i}" for i in range(n))
    steps = [
        f"c0 AS MATERIALIZED (SELECT g, count(*) AS n, {', '.join(f'quantile_cont(x{i}, 0.5) AS mu{i}' for i in range(n))} FROM pts GROUP BY g)",
        f"c1 AS MATERIALIZED (SELECT g, any_value(n) AS n, {center}, {wide} FROM pts JOIN c0 USING (g) GROUP BY g)",
        f"dirs AS MATERIALIZED (SELECT g, n, {mus}, {', '.join(f's{i}' for i in range(n))}, {clip}, {sign} FROM (SELECT *, {unit} FROM pts JOIN c1 USING (g)))",
        "s0 AS (" + " UNION ALL ".join(f"SELECT g, {k} AS k, any_value(n) AS n, {center}, {x} FROM dirs GROUP BY g" for k, x in enumerate(first)) + ")",
        f"est0 AS MATERIALIZED (SELECT *, 1e300::DOUBLE AS best, true AS live FROM {_ldl('s0', f'g, k, n, {mus}, {cov}', n)})",
    ]
    for r in range(ROUNDS):
        near = _far(f"(SELECT * FROM pts JOIN (SELECT g, k, n, {mus}, {factor} FROM est{r} WHERE live) USING (g))", f"g, k, n, {xs}", n)
        steps.append(f"near{r} AS MATERIALIZED (SELECT *, CAST(floor(ln(1 + d2) * {q.BINS}) AS BIGINT) AS bin FROM {near})")
        need = f"ceil({q.CORE}::DOUBLE * any_value(n))"
        steps.append(f"bins{r} AS (SELECT g, k, bin, {need} AS h, count(*) AS c, sum(count(*)) OVER (PARTITION BY g, k ORDER BY bin) AS upto FROM near{r} GROUP BY g, k, bin)")
        steps.append(f"w{r} AS (SELECT g, k, bin, h, greatest(0, least(c, h - (upto - c))) / CAST(c AS DOUBLE) AS w FROM bins{r})")
        weighted = ", ".join([f"sum(w * x{i}) / any_value(h) AS mu{i}" for i in range(n)] + [f"sum(w * x{i} * x{j}) / any_value(h) AS b{i}{j}" for i, j in tri])
        moved = f"(SELECT g, k, any_value(n) AS n, {weighted} FROM near{r} JOIN w{r} USING (g, k, bin) GROUP BY g, k)"
        cov_of = ", ".join(f"(b{i}{j} - mu{i} * mu{j}) * {q.CONSISTENCY}::DOUBLE{ridge.get((i, j), '')} AS a{i}{j}" for i, j in tri)
        steps.append(f"new{r} AS MATERIALIZED {_ldl(f'(SELECT g, k, n, {mus}, {cov_of} FROM {moved})', f'g, k, n, {mus}, {cov}', n)}")
        better = ", ".join(f"CASE WHEN new.logdet < old.best THEN new.{x} ELSE old.{x} END AS {x}" for x in [*mus.split(", "), *cov.split(", "), *factor.split(", ")])
        steps.append(
            f"est{r + 1} AS MATERIALIZED (SELECT old.g, old.k, old.n, {better}, CASE WHEN new.logdet < old.best THEN new.logdet ELSE old.best END AS best, "
            f"coalesce(new.logdet < old.best - {q.FALL}, false) AS live FROM est{r} old LEFT JOIN new{r} new ON old.g = new.g AND old.k = new.k)"
        )
    numbers = [*mus.split(", "), *cov.split(", ")]
    mix = lambda own, wider, k: ", ".join(f"({own}.n * {own}.{x} + {k} * {wider}.{x}) / ({own}.n + {k}) AS {x}" for x in numbers)
    vector = [
        "ln(n_words)", "4 * ln(word_chars::DOUBLE / n_words)", "ln(1 + 1000::DOUBLE * n_symbols / n_words)",
        "ln(1 + 1000::DOUBLE * n_dup_lines / n_words)", "ln(1 + 100::DOUBLE * n_repeat_words / n_words)",
    ]
    steps += [
        f"top AS MATERIALIZED (SELECT * FROM est{ROUNDS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY best, k) = 1)",
        f"tongue AS (SELECT l.g, {mix('l', 'a', q.PRIOR_ROWS)} FROM top l, top a WHERE a.g = 'all' AND l.g LIKE 'lang%')",
        f"own AS (SELECT s.g, {mix('s', 't', q.PRIOR_ROWS)} FROM top s JOIN (SELECT DISTINCT a, b FROM p) x ON s.g = 'src' || a || chr(1) || b JOIN tongue t ON t.g = 'lang' || a)",
        f"final AS MATERIALIZED {_ldl('own', f'g, {mus}', n)}",
        f"far AS {_far(f'(SELECT r, {xs}, final.* FROM p JOIN final ON final.g = ' + chr(39) + 'src' + chr(39) + ' || a || chr(1) || b)', 'r', n)}",
    ]
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, chr(0)) AS a, coalesce(source, chr(0)) AS b FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
grams AS MATERIALIZED (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
s AS MATERIALIZED (SELECT docs.r, doc_id, a, b, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM docs JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
j AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
p AS MATERIALIZED (SELECT r, a, b, {', '.join(f'CAST(round(({x}) * {q.UNIT}) AS BIGINT) AS x{i}' for i, x in enumerate(vector))} FROM j WHERE NOT base_failed),
pts AS MATERIALIZED (SELECT 'all' AS g, {xs} FROM p UNION ALL SELECT 'lang' || a, {xs} FROM p UNION ALL SELECT 'src' || a || chr(1) || b, {xs} FROM p),
{', '.join(steps)}
SELECT doc_id, {', '.join(q.STATS)}, base_failed, NOT base_failed AND d2 <= {q.CUTOFF} AS kept FROM j LEFT JOIN far USING (r)"""


#: The marked letters of the tables' languages; DuckDB's edit distance counts bytes, so each becomes a control character.
_MARKED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CONTROL = [c for c in range(1, 32) if c not in (9, 10, 13)]


def _one_byte(text: str) -> str:
    controls = " || ".join(f"chr({c})" for c in _CONTROL[: len(_MARKED)])
    return f"translate({text}, '{_MARKED}', {controls})"


def line_dedup_sql() -> str:
    return f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS MATERIALIZED (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM docs),
said AS MATERIALIZED (SELECT * FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
d AS MATERIALIZED (SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM said GROUP BY line),
pairs AS (SELECT a.line AS a, b.line AS b, least(a.n, b.n) AS n FROM d a JOIN d b ON b.n BETWEEN a.n - {line_dedup.EDITS} AND a.n + {line_dedup.EDITS} AND b.first < a.first AND (a.n >= {line_dedup.MIN_CHARS}) = (b.n >= {line_dedup.MIN_CHARS})),
near AS (SELECT DISTINCT a AS line FROM pairs WHERE n >= {line_dedup.MIN_CHARS // 2}
  AND levenshtein({_one_byte('a')}, {_one_byte('b')}) <= CASE WHEN n >= {line_dedup.MIN_CHARS} THEN {line_dedup.EDITS} ELSE 1 END),
gone AS (SELECT doc_id, pos FROM said JOIN d USING (line) LEFT JOIN near ON near.line = said.line
  WHERE near.line IS NOT NULL OR d.first <> struct_pack(doc_id := said.doc_id, pos := said.pos)),
per AS (SELECT doc_id, count(*) AS n_dropped, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS dropped_lines FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines
FROM docs LEFT JOIN per USING (doc_id)"""


def url_sql() -> str:
    return """
WITH p AS MATERIALIZED (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host FROM pages),
labels AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL),
suffixes AS MATERIALIZED (SELECT host, array_to_string(l[i:], '.') AS entry FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM labels)),
x AS (SELECT DISTINCT entry, ascii(substr(md5(entry), 1, 1)) AS d0, ascii(substr(md5(entry), 2, 1)) AS d1,
  ascii(substr(md5(entry), 3, 1)) AS d2, ascii(substr(md5(entry), 4, 1)) AS d3 FROM suffixes WHERE entry LIKE '%.%'),
spans AS (SELECT entry, CASE d0 % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS category,
  DATE '2024-01-01' + CAST((d1 * 7 + d2 * 3) % 300 AS INTEGER) AS a, CAST(20 + d3 % 90 AS INTEGER) AS n FROM x WHERE d0 % 2 = 0),
m AS (SELECT p.page_id, p.url, p.fetched, spans.entry, category FROM p JOIN suffixes USING (host) JOIN spans USING (entry)
  WHERE fetched >= a AND fetched < a + n OR fetched >= a + n + 30),
e AS (SELECT page_id, url, fetched, count(*) AS n_active, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries,
  string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM m GROUP BY ALL)
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, n_active IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active,
  coalesce(entries, '') AS entries, coalesce(categories, '') AS categories
FROM p LEFT JOIN e ON e.page_id = p.page_id AND e.url = p.url AND e.fetched = p.fetched"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_sql(), "op5_robust_quality": quality_sql(), "op8_line_dedup": line_dedup_sql(), "op9_url_filter": url_sql()}
