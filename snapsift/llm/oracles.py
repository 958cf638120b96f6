"""The operations that SQL expresses, as DuckDB SQL over the same tables, by the plainest way and not by the method named."""

from __future__ import annotations

from . import quality, url_filter, vector_codes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), x AS (SELECT sh.doc_id, s, n FROM sh JOIN n USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.root < links.b),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def _quality() -> str:
    low = 1 << quality.PRECISION
    top = lambda b: f"({floor(f'({b} + 1)')} - 1)"
    floor = lambda b: f"(CASE WHEN {b} < {low} THEN {b} ELSE ({b} - ({b} // {low} - 1) * {low}) << ({b} // {low} - 1) END)"

    def own(name: str, table: str, keys: str) -> str:
        part = ", ".join(x for x in (keys, "metric") if x)
        return f"""{name}r AS (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS total FROM {table}),
{name}q AS (SELECT {part}, min(bucket) FILTER (100 * upto >= 50 * total) AS b, min(bucket) FILTER (100 * upto >= {round(100 * quality.UPPER)} * total) AS c, max(total) AS total FROM {name}r GROUP BY {part}),
{name} AS (SELECT {part}, CAST(total AS BIGINT) AS total, {top('b')} + {quality.SPREADS} * ({top('c')} - {top('b')}) AS t FROM {name}q)"""

    shrink = lambda rows, t, wider: f"({rows} * {t} + {quality.PRIOR} * {wider}) // ({rows} + {quality.PRIOR})"
    bucket = f"CASE WHEN v < {low} THEN v ELSE (length(bin(v)) - {1 + quality.PRECISION}) * {low} + (v >> (length(bin(v)) - {1 + quality.PRECISION})) END"
    names = ", ".join(f"'{m}'" for m in quality.METRICS)
    ratios = ", ".join(f"({c} + {one}) * {quality.SCALE} // greatest({of} + {more}, 1) AS {m}" for m, (c, of, one, more) in quality.SEEN.items())
    return f"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines FROM documents),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t),
three AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS s FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM three WHERE s IS NOT NULL) z WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT pos + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) d(d) GROUP BY 1),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM c),
v AS (SELECT doc_id, lang, source, unnest([{names}]) AS metric, unnest([{', '.join(quality.METRICS)}]) AS v FROM m),
s AS (SELECT lang, source, metric, {bucket} AS bucket, count(*) AS n FROM v GROUP BY ALL), sl AS (SELECT lang, metric, bucket, sum(n) AS n FROM s GROUP BY ALL), sa AS (SELECT metric, bucket, sum(n) AS n FROM sl GROUP BY ALL),
{own('og', 's', 'lang, source')}, {own('ol', 'sl', 'lang')}, {own('oa', 'sa', '')},
lw AS (SELECT ol.lang, ol.metric, {shrink('ol.total', 'ol.t', 'oa.t')} AS t FROM ol JOIN oa USING (metric)),
g AS (SELECT og.lang, og.source, og.metric, {shrink('og.total', 'og.t', 'lw.t')} AS t FROM og JOIN lw ON og.metric = lw.metric AND og.lang IS NOT DISTINCT FROM lw.lang),
f AS (SELECT v.doc_id, string_agg(v.metric, ',' ORDER BY list_position([{names}], v.metric)) AS failed FROM v JOIN g ON v.metric = g.metric AND v.lang IS NOT DISTINCT FROM g.lang AND v.source IS NOT DISTINCT FROM g.source WHERE v.v > g.t GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM m LEFT JOIN f USING (doc_id)"""


def _urls() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in url_filter.RULES)
    hosts = ", ".join(f"('{h}', '', 'block', false)" for h in url_filter.listed_hosts())
    return rf"""WITH e(h, p, v, is_rule) AS (VALUES {rules}, {hosts}), r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
b AS (SELECT page_id, arg_max({{'entry': h || p, 'v': v, 'is_rule': is_rule}}, is_rule::INT * 1000000 + length(h || p)) AS best FROM u JOIN e ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, CASE WHEN best.is_rule THEN best.entry END AS rule, coalesce(best.v, 'allow') AS verdict, best.entry AS entry FROM u LEFT JOIN b USING (page_id)"""


SUBSTRINGS = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents), k AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t),
n AS (SELECT doc_id, pos, unnest([array_to_string(w[pos + 1:pos + 13], ' ')]) AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS pos FROM t) z),
f AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM n) z WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM f, range(13) r(d)), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM k ANTI JOIN gone USING (doc_id, pos) GROUP BY 1), m AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM t LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)"""

LINES = """WITH t AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM t),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM l), n AS (SELECT s FROM k WHERE s <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
o AS (SELECT k.*, n.s IS NOT NULL AND row_number() OVER (PARTITION BY k.s ORDER BY doc_id, place) > 1 AS gone FROM k LEFT JOIN n USING (s)),
d AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS kept FROM o GROUP BY 1)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN d USING (doc_id)"""

_CLEAN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""WITH t AS (SELECT doc_id, {_CLEAN} AS w FROM documents), i AS (SELECT DISTINCT item_id, {_CLEAN} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[place:place + size - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS place FROM i WHERE len(w) > 0) z),
dw AS (SELECT doc_id, place, size, array_to_string(w[place:place + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS place FROM t, (SELECT DISTINCT size FROM iw) z) y),
hit AS (SELECT dw.doc_id, dw.place, dw.size, iw.item_id FROM dw JOIN iw USING (size, s)), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS p FROM hit) z GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) z GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM t LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: CRC-32 by its table of 256 remainders, byte by byte.
SPELLING = f"""WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8), r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w) AS x FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM d, tab),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1), voc AS (SELECT * FROM v WHERE length(word) >= 7 AND n >= 2),
g AS (SELECT word, n, unnest(range(length(word))) AS i FROM voc), g2 AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM g),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM g2 a JOIN g2 b USING (i, rest) WHERE a.word <> b.word UNION SELECT a.word, b.word, b.n FROM g2 a JOIN voc b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM g2 a JOIN voc b ON a.rest = b.word),
s AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, encode(b))) AS form, max(n) AS form_n FROM p GROUP BY 1),
f AS (SELECT voc.word, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * voc.n THEN form END AS form, CASE WHEN form_n >= 10 * voc.n THEN form_n END AS form_n FROM voc LEFT JOIN s USING (word)),
w AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT w.word, f.form, k + 1 FROM w JOIN f ON w.here = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, k) AS root FROM w GROUP BY 1) z ON z.word = f.word"""


def _vector_codes() -> str:
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    nearest = lambda books: f"SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, part, entry, {square} AS d FROM p JOIN {books} USING (part)) z GROUP BY r, part"
    rounds = [
        f"""a{k} AS MATERIALIZED ({nearest(f'c{k}')}),
s{k} AS (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN p USING (r, part)) z GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{k} GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.e, c{k}.e) AS e FROM c{k} LEFT JOIN m{k} USING (part, entry))"""
        for k in range(vector_codes.ROUNDS)
    ]
    last = f"c{vector_codes.ROUNDS}"
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x FROM k, range(8) t(part)), c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= {vector_codes.ENTRIES}),
{', '.join(rounds)},
f AS ({nearest(last)}), o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), b"""


EXACT = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": NEAR_DEDUP,
        "op2_quality_rules": _quality(),
        "op3_url_filters": _urls(),
        "op5_substring_dedup": SUBSTRINGS,
        "op8_line_dedup": LINES,
        "op9_decontamination": DECONTAMINATION,
        "op11_spelling_variants": SPELLING,
        "op12_vector_codes": _vector_codes(),
        "op13_exact_dedup": EXACT,
    }
