"""SQL twins of the queries for DuckDB: brute-force forms (containment by LIKE, joins on all regions of a document)."""

from __future__ import annotations

from folioscan.functions import checksum
from folioscan.operators import evaluate, extras
from folioscan.plans import dims
from folioscan.plans import fixtures as X

AS_OF = "DATE '2024-06-01'"
SQL: dict[str, str] = {}


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper({c}), '&', ' AND ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"


def quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns}))"


CARDS = f"regions AS MATERIALIZED ({X.regions_sql('duck')})"
PASSPORTS = f"regions AS MATERIALIZED ({X.passports_sql('duck')})"
LINES = f"lines AS MATERIALIZED ({X.LINES_SQL})"
lines = lambda body: f"WITH {LINES} {body}"
cards = lambda body: f"WITH {CARDS} {body}"
COLUMNS = 'doc_id, page_no, seq, text, "left", top, "right", bottom, confidence'

SQL["read_regions"] = lines('SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INT) AS seq, trim(regexp_replace(text, \'^\\s+|\\s+$\', \'\', \'g\')) AS text, "left", top, "right", bottom, confidence FROM lines')
SQL["trusted_regions"] = lines(f"SELECT {COLUMNS} FROM lines WHERE confidence >= 0.5")
SQL["targeted_crop"] = lines(f"SELECT {COLUMNS} FROM (SELECT *, max(bottom) OVER (PARTITION BY doc_id) AS h FROM lines) WHERE top >= floor(0.45 * h)")
SQL["offset_regions"] = lines('SELECT doc_id, page_no, seq, text, "left" + 5 AS "left", top - 3 AS top, "right" + 5 AS "right", bottom - 3 AS bottom, confidence FROM lines')
SQL["non_latin_page"] = lines("SELECT doc_id, page_no, round_even(s, 6) AS share, coalesce(s > 0.4, false) AS non_latin FROM (SELECT doc_id, page_no, sum(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / nullif(CAST(sum(length(text)) AS DOUBLE), 0) AS s FROM lines GROUP BY 1, 2)")
_letters = "regexp_replace(text, '[^\\p{L}]', '', 'g')"
SQL["letter_shares"] = lines(f"SELECT doc_id, page_no, seq, coalesce(round_even(length(regexp_replace({_letters}, '[^\\x{{900}}-\\x{{97F}}]', '', 'g')) / nullif(CAST(length({_letters}) AS DOUBLE), 0), 6), 0) AS devanagari, coalesce(round_even(length(regexp_replace({_letters}, '[^\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) / nullif(CAST(length({_letters}) AS DOUBLE), 0), 6), 0) AS non_ascii FROM lines")
SQL["joined_text"] = lines("SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS joined FROM lines GROUP BY doc_id")
SQL["probe_text"] = lines("SELECT doc_id, string_agg(text, '|' ORDER BY seq) AS probe FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM lines) WHERE n <= 12 GROUP BY doc_id")
SQL["row_band"] = lines("SELECT doc_id, seq, CAST(floor(top / 12.0) AS BIGINT) AS band12, CAST(round_even(top / 20.0, 0) AS BIGINT) AS band20 FROM lines")
_key = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_box = 'doc_id, page_no, "left", top, "right", bottom'


def _dedup(source: str) -> str:
    return f'SELECT doc_id, page_no, f AS seq, text, "left", top, "right", bottom, confidence FROM (SELECT *, row_number() OVER (PARTITION BY {_box}, {_key} ORDER BY confidence DESC, seq) AS n, min(seq) OVER (PARTITION BY {_box}, {_key}) AS f FROM {source}) WHERE n = 1'


SQL["dedup_regions"] = cards(_dedup("regions"))
SQL["union_passes"] = f"WITH {CARDS}, passes AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pass, seq) - 1 AS INT) AS seq) FROM (SELECT *, 0 AS pass FROM regions UNION ALL SELECT * REPLACE (confidence - 0.1 AS confidence), 1 AS pass FROM regions)) {_dedup('passes')}"
_geometry = f"SELECT doc_id, avg(c) AS mean_confidence, min(c) AS min_confidence FROM (SELECT {_box}, max(greatest(0, least(1, confidence))) AS c FROM regions GROUP BY ALL) GROUP BY doc_id"
SQL["geometry_confidence"] = cards(_geometry)
SQL["ocr_confidence"] = cards("SELECT doc_id, avg(confidence) AS ocr_confidence FROM regions GROUP BY doc_id")
SQL["reading_order"] = cards("SELECT doc_id, string_agg(text, '|' ORDER BY page_no, top, \"left\", seq) AS reading FROM regions GROUP BY doc_id")
_like = "(" + " OR ".join(f"(' ' || {norm('text')} || ' ') LIKE '% {h} %'" for h in dims.LABEL_HINTS) + ")"
SQL["label_like"] = cards(f"SELECT doc_id, seq, {_like} AS label_like FROM regions")

LAYOUT = f"""{CARDS}, sound AS MATERIALIZED (SELECT *, {norm('text')} AS norm, {_like} AS label_like FROM {{source}}),
label_dim AS {values(dims.label_rows(), 'doc_type, field, label, priority')},
scored AS (SELECT s.*, doc_type, field, CASE WHEN norm = label THEN 10000 - priority ELSE 100 * length(label) - priority END AS score
    FROM sound s JOIN label_dim ON (' ' || norm || ' ') LIKE '% ' || label || ' %'),
labels AS MATERIALIZED (SELECT doc_id, page_no, doc_type, field, score, seq AS label_seq, "left" AS label_left, top AS label_top, "right" AS label_right, bottom AS label_bottom, text AS label_text
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, doc_type, field ORDER BY score DESC, confidence DESC, seq) AS n FROM scored) WHERE n = 1),
places AS (SELECT DISTINCT doc_id, label_seq, label_left, label_top, label_right, label_bottom FROM labels),
row_left AS MATERIALIZED (SELECT p.*, least(label_left, coalesce((SELECT min(o."left") FROM sound o WHERE o.doc_id = p.doc_id AND o.seq <> p.label_seq
        AND least(o.bottom, label_bottom) - greatest(o.top, label_top) >= 0.5 * greatest(label_bottom - label_top, 1)
        AND length(regexp_replace(o.text, '[^A-Za-z0-9]', '', 'g')) <= 5), label_left)) AS row_left FROM places p),
below AS (SELECT doc_id, label_seq, text AS below FROM (SELECT p.doc_id, p.label_seq, o.text, row_number() OVER (PARTITION BY p.doc_id, p.label_seq
        ORDER BY greatest(o.top - label_bottom, 0) + abs(o."left" - row_left) * 0.3 + CASE WHEN label_like THEN 500 ELSE 0 END, o.seq) AS n
    FROM row_left p JOIN sound o USING (doc_id) WHERE o.top - label_bottom >= -10 AND o.top - label_bottom < 80 AND abs(o."left" - row_left) < 200) WHERE n = 1),
rights AS (SELECT doc_id, label_seq, text AS r FROM (SELECT p.doc_id, p.label_seq, o.text, row_number() OVER (PARTITION BY p.doc_id, p.label_seq ORDER BY o."left" - label_right, o.seq) AS n
    FROM places p JOIN sound o USING (doc_id) WHERE NOT label_like AND o.seq <> p.label_seq AND o."left" - label_right >= 0 AND o."left" - label_right < 450
        AND least(o.bottom, label_bottom) - greatest(o.top, label_top) >= 0.4 * greatest(label_bottom - label_top, 1)) WHERE n = 1),
label_values AS MATERIALIZED (SELECT l.*, nullif(trim(coalesce(r, below)), '') AS value FROM labels l LEFT JOIN rights USING (doc_id, label_seq) LEFT JOIN below USING (doc_id, label_seq))"""
ALL = LAYOUT.replace("{source}", "regions")
layout = lambda body: f"WITH {ALL} {body}"
SQL["label_match"] = layout("SELECT doc_id, page_no, doc_type, field, score, label_seq, label_left, label_top, label_right, label_bottom, label_text FROM labels")
SQL["label_row_left"] = layout("SELECT doc_id, label_seq, row_left FROM row_left")
SQL["value_below"] = layout("SELECT doc_id, label_seq, below FROM below")
SQL["value_right"] = layout('SELECT doc_id, label_seq, r AS "right" FROM rights')
SQL["label_value"] = layout("SELECT doc_id, doc_type, field, label_seq, value FROM label_values")

_compact = "regexp_replace(upper(text), '[^A-Z0-9]', '', 'g')"
_pan = f"nullif(regexp_extract({_compact}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]'), '')"
_pan_ok = f"coalesce(substr({_pan}, 4, 1) IN ('A','B','C','F','G','H','L','J','P','T','K'), false)"
_epic = f"nullif(regexp_extract({_compact}, '[A-Z]{{3}}[0-9]{{7}}'), '')"
_dl = f"nullif(regexp_extract({_compact}, '[A-Z]{{2}}[0-9]{{2}}[0-9]{{11}}'), '')"
_job_text = "regexp_replace(upper(text), '\\s+', '', 'g')"
_job = f"CASE WHEN regexp_full_match({_job_text}, '[A-Z]{{2}}-[0-9]{{1,10}}([-/][0-9]{{1,10}}){{2,7}}') THEN {_job_text} END"
_digits = "regexp_replace(nullif(regexp_extract({t}, '\\b[0-9]{{4}}\\s?[0-9]{{4}}\\s?[0-9]{{4}}\\b'), ''), '\\s', '', 'g')"
_date = "nullif(regexp_extract(text, '\\b([0-9]{1,2}[/\\-.][0-9]{1,2}[/\\-.][0-9]{2,4})\\b', 1), '')"


def _uid(t: str) -> str:
    d = _digits.format(t=t)
    return f"(substr({d}, 1, 4) || ' ' || substr({d}, 5, 4) || ' ' || substr({d}, 9, 4))"


def _uid_ok(t: str) -> str:
    """Verhoeff over twelve digits, unrolled."""
    d = _digits.format(t=t)
    table = "".join(str(x) for row in checksum.dihedral() for x in row)
    power = "".join(str(x) for row in checksum.permutations() for x in row)
    c = "0"
    for i in range(12):
        c = f"CAST(substr('{table}', ({c}) * 10 + CAST(substr('{power}', {i % 8 * 10 + 1} + CAST(substr(dd, {12 - i}, 1) AS INT), 1) AS INT) + 1, 1) AS INT)"
    return f"coalesce((SELECT substr(dd, 1, 1) NOT IN ('0', '1') AND {c} = 0 FROM (SELECT {d} AS dd)), false)"


SQL["identifiers"] = cards(f"SELECT doc_id, seq, {_pan} AS pan, {_pan_ok} AS pan_ok, {_epic} AS epic, {_dl} AS dl, {_job} AS job, {_uid('text')} AS uid, {_uid_ok('text')} AS uid_ok, nullif(regexp_extract(text, '\\b[0-9]{{6}}\\b'), '') AS pin, nullif(regexp_extract(text, '[A-Z][0-9]{{7}}'), '') AS old FROM regions")
SQL["norm_text"] = cards(f"SELECT doc_id, seq, {norm('text')} AS label, trim(regexp_replace(upper(text), '[^A-Z0-9]+', ' ', 'g')) AS plain, {_key} AS folded, replace(upper(text), ' ', '') AS mrz, rpad(text, 44, '<') AS padded, nullif(trim(regexp_replace(trim(text), '^:+', '')), '') AS value, nullif(regexp_replace(string_split(text, ':')[-1], '^[ :,\\-]+|[ :,\\-]+$', '', 'g'), '') AS tail FROM regions")
SQL["icao_check_digit"] = cards(f"SELECT doc_id, seq, d AS data, {X.icao_sql('d', 9)} AS digit FROM (SELECT *, substr({_compact}, 1, 9) AS d FROM regions) WHERE length(d) = 9")
_parsed = f"coalesce(try_strptime(replace({_date}, '-', '/'), '%d/%m/%Y'))"
SQL["printed_dates"] = cards(f"SELECT doc_id, seq, p AS printed, strftime(t, '%Y-%m-%d') AS parsed, coalesce(CAST(t AS DATE) < {AS_OF}, false) AS past, coalesce(CAST(t AS DATE) <= {AS_OF}, false) AS not_future FROM (SELECT doc_id, seq, {_date} AS p, {_parsed} AS t FROM regions) WHERE p IS NOT NULL")

EVIDENCE = f"""keyword_dim AS {values(dims.keyword_rows(), 'doc_type, evidence, keyword')},
nesting AS {values(dims.nesting_rows(), 'doc_type, evidence, short, long')},
matches AS MATERIALIZED (SELECT DISTINCT doc_id, doc_type, evidence, keyword FROM (SELECT doc_id, {norm('text')} AS norm FROM regions) r JOIN keyword_dim ON (' ' || norm || ' ') LIKE '% ' || keyword || ' %'),
counts AS MATERIALIZED (SELECT doc_id, doc_type, evidence, count(*) AS n FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches o JOIN nesting g ON o.keyword = g.long AND o.doc_type = g.doc_type AND o.evidence = g.evidence
    WHERE o.doc_id = m.doc_id AND g.short = m.keyword AND o.doc_type = m.doc_type AND o.evidence = m.evidence) GROUP BY ALL)"""
_hindi = lambda words: " OR ".join(f"contains(j, '{w}')" for w in words)
SCORES = f"""{EVIDENCE}, titles AS {values([(t, k) for t, e, k in dims.keyword_rows() if e == 'title'], 'doc_type, title')},
joined AS (SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS j FROM regions GROUP BY doc_id),
strong AS (SELECT doc_id, doc_type, max(CASE WHEN evidence = 'title' THEN n ELSE 0 END) AS t, max(CASE WHEN evidence = 'card' THEN n ELSE 0 END) AS c, max(CASE WHEN evidence = 'context' THEN n ELSE 0 END) AS x, max(CASE WHEN evidence = 'acronym' THEN n ELSE 0 END) AS a, max(CASE WHEN evidence = 'issuer' THEN n ELSE 0 END) AS i, max(CASE WHEN evidence = 'hindi' THEN n ELSE 0 END) AS h, max(CASE WHEN evidence = 'hindi_card' THEN n ELSE 0 END) AS hc
    FROM (FROM counts UNION ALL SELECT doc_id, doc_type, 'title', count(*) FROM joined JOIN titles ON (' ' || {norm('j')} || ' ') LIKE '% ' || title || ' %' GROUP BY ALL
        UNION ALL SELECT doc_id, 'npr_letter', 'title', 1 FROM joined WHERE contains(j, '{dims.NPR_TITLE_HINDI}')
        UNION ALL SELECT doc_id, 'nrega_job_card', 'hindi', 1 FROM joined WHERE {_hindi(dims.NREGA_TITLES_HINDI)}
        UNION ALL SELECT doc_id, 'nrega_job_card', 'hindi_card', 1 FROM joined WHERE contains(j, '{dims.NREGA_CARD_HINDI}') AND ({_hindi(dims.NREGA_CONTEXT_HINDI)})) GROUP BY ALL),
parts AS (SELECT doc_id, doc_type, 2 * n AS score FROM counts WHERE evidence = 'keyword'
    UNION ALL SELECT doc_id, doc_type, CASE WHEN t > 0 OR h > 0 THEN 9 + least(t, 2) ELSE 8 END FROM strong WHERE doc_type = 'nrega_job_card' AND (t > 0 OR h > 0 OR hc > 0 OR (a > 0 AND c + x > 0) OR (c > 0 AND x > 0))
    UNION ALL SELECT doc_id, doc_type, CASE WHEN t > 0 THEN 9 ELSE 8 END FROM strong WHERE doc_type = 'npr_letter' AND (t > 0 OR (a > 0 AND i > 0))
    UNION ALL SELECT doc_id, 'pan', 3 FROM regions WHERE {_pan} IS NOT NULL GROUP BY doc_id
    UNION ALL SELECT doc_id, 'driving_licence', 3 FROM regions WHERE {_dl} IS NOT NULL GROUP BY doc_id
    UNION ALL SELECT doc_id, 'voter_id', 3 FROM regions WHERE {_epic} IS NOT NULL GROUP BY doc_id
    UNION ALL SELECT doc_id, 'aadhaar', 3 + CASE WHEN {_uid_ok('j')} THEN 2 ELSE 0 END FROM joined WHERE {_digits.format(t='j')} IS NOT NULL),
scores AS MATERIALIZED (SELECT doc_id, doc_type, CAST(sum(score) AS INT) AS score FROM parts GROUP BY ALL),
classes AS MATERIALIZED (SELECT d.doc_id, CASE WHEN score >= 2 THEN doc_type ELSE 'unknown' END AS document_type, CASE WHEN score IS NULL THEN 0.2 WHEN score < 2 THEN 0.3 ELSE round_even(least(0.5 + 0.12 * score, 0.98), 3) END AS confidence
    FROM (SELECT DISTINCT doc_id FROM regions) d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, list_position({dims.TYPES!r}, doc_type)) AS n FROM scores) s ON s.doc_id = d.doc_id AND s.n = 1)"""
SQL["keyword_evidence"] = f"WITH {CARDS}, {EVIDENCE} SELECT doc_id, doc_type, evidence, keyword FROM matches"
SQL["evidence_count"] = f"WITH {CARDS}, {EVIDENCE} SELECT doc_id, doc_type, evidence, n FROM counts"
SQL["doc_score"] = f"WITH {CARDS}, {SCORES} SELECT doc_id, doc_type, score FROM scores"
SQL["classify_documents"] = f"WITH {CARDS}, {SCORES} SELECT doc_id, document_type, confidence FROM classes"

_clean = "replace(replace(upper(text), '>', '<'), ' ', '')"
_mrz = f"SELECT doc_id, page_no, count(*) FILTER (WHERE bottom >= 0.6 * h AND regexp_full_match({_clean}, '[A-Z0-9<]{{40,44}}') AND length({_clean}) - length(replace({_clean}, '<', '')) >= 5) >= 2 AS has_mrz FROM (SELECT *, max(bottom) OVER (PARTITION BY doc_id, page_no) AS h FROM regions) GROUP BY doc_id, page_no"
SQL["mrz_like_page"] = f"WITH {PASSPORTS} {_mrz}"
SQL["classify_pages"] = f"""WITH {PASSPORTS}, m AS ({_mrz}), hints AS {values(dims.hint_rows(), 'kind, hint')},
    h AS (SELECT doc_id, page_no, count(DISTINCT CASE WHEN kind = 'biodata' THEN hint END) AS biodata, count(DISTINCT CASE WHEN kind = 'non_biodata' THEN hint END) AS non_biodata FROM regions JOIN hints ON (' ' || {norm('text')} || ' ') LIKE '% ' || hint || ' %' GROUP BY ALL),
    p AS (SELECT m.doc_id, m.page_no, coalesce(biodata, 0) AS biodata, coalesce(non_biodata, 0) AS non_biodata, has_mrz, CASE WHEN has_mrz OR coalesce(biodata, 0) >= 2 THEN 'biodata' WHEN non_biodata >= 2 THEN 'non_biodata' WHEN coalesce(biodata, 0) + coalesce(non_biodata, 0) > 0 THEN 'weak' ELSE 'unknown' END AS page_type FROM m LEFT JOIN h USING (doc_id, page_no))
    SELECT *, round_even(CASE page_type WHEN 'biodata' THEN least(0.55 + 0.12 * least(biodata, 3) + CASE WHEN has_mrz THEN 0.18 ELSE 0 END, 0.99) WHEN 'non_biodata' THEN least(0.62 + 0.1 * least(non_biodata, 3), 0.98) WHEN 'weak' THEN 0.45 ELSE 0.2 END, 3) AS confidence FROM p"""
_fix = lambda c: f"translate({c}, 'OoDdQqILlZzAaSsGgBb', '0000001112244556688')"
_line2 = f"substr(l, 1, 9) || {_fix('substr(l, 10, 1)')} || substr(l, 11, 3) || {_fix('substr(l, 14, 7)')} || substr(l, 21, 1) || {_fix('substr(l, 22, 7)')} || substr(l, 29, 14) || {_fix('substr(l, 43, 2)')}"
_two = f"SELECT doc_id, rpad(max(CASE WHEN n = 2 THEN line END), 44, '<') AS line1, rpad(max(CASE WHEN n = 1 THEN line END), 44, '<') AS l FROM (SELECT doc_id, {_clean} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY bottom DESC, seq DESC) AS n FROM regions WHERE regexp_full_match({_clean}, '[A-Z0-9<]{{40,44}}')) WHERE n <= 2 GROUP BY doc_id HAVING count(*) = 2"
SQL["mrz_lines"] = f"WITH {PASSPORTS} SELECT doc_id, line1, {_line2} AS line2 FROM ({_two})"


def _ok(data: str, n: int, digit: str) -> str:
    return f"coalesce({X.icao_sql(data, n)} = TRY_CAST({digit} AS INT), false)"


def _mrz_date(c: str) -> str:
    yy, mm, dd = (f"TRY_CAST(substr({c}, {k}, 2) AS INT)" for k in (1, 3, 5))
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{6}}') AND {mm} BETWEEN 1 AND 12 AND {dd} BETWEEN 1 AND 31 THEN CASE WHEN {yy} >= 30 THEN '19' ELSE '20' END || substr({c}, 1, 2) || '-' || substr({c}, 3, 2) || '-' || substr({c}, 5, 2) END"


SQL["mrz_text"] = f"WITH {PASSPORTS} SELECT doc_id, line, {_mrz_date('substr(line, 14, 6)')} AS born, {_ok('substr(line, 1, 9)', 9, 'substr(line, 10, 1)')} AS number_ok FROM (SELECT doc_id, {_line2} AS line FROM (SELECT doc_id, rpad({_clean}, 44, '<') AS l FROM regions WHERE seq = 4))"
SQL["parse_mrz"] = f"""WITH {PASSPORTS}, two AS (SELECT doc_id, line1, {_line2} AS l FROM ({_two})),
    v AS (SELECT *, substr(line1, 6, 39) AS nm, {_ok('substr(l, 1, 9)', 9, 'substr(l, 10, 1)')} AS number_ok, {_ok('substr(l, 14, 6)', 6, 'substr(l, 20, 1)')} AS birth_ok, {_ok('substr(l, 22, 6)', 6, 'substr(l, 28, 1)')} AS expiry_ok, {_ok('(substr(l, 1, 10) || substr(l, 14, 7) || substr(l, 22, 22))', 39, 'substr(l, 44, 1)')} AS whole_ok FROM two)
    SELECT doc_id, coalesce(nullif(replace(substr(line1, 1, 2), '<', ''), ''), 'P') AS document_code, replace(substr(line1, 3, 3), '<', '') AS country,
        trim(replace(CASE WHEN strpos(nm, '<<') > 0 THEN substr(nm, 1, strpos(nm, '<<') - 1) ELSE nm END, '<', ' ')) AS surname,
        trim(replace(CASE WHEN strpos(nm, '<<') > 0 THEN substr(nm, strpos(nm, '<<') + 2) ELSE '' END, '<', ' ')) AS given_names,
        replace(substr(l, 1, 9), '<', '') AS passport_number, replace(substr(l, 11, 3), '<', '') AS nationality, {_mrz_date('substr(l, 14, 6)')} AS date_of_birth,
        CASE WHEN substr(l, 21, 1) IN ('M', 'F') THEN substr(l, 21, 1) WHEN substr(l, 21, 1) IN ('<', 'X') THEN 'X' END AS sex, {_mrz_date('substr(l, 22, 6)')} AS expiry_date,
        nullif(replace(substr(l, 29, 14), '<', ''), '') AS personal_number, number_ok, birth_ok, expiry_ok, whole_ok AND number_ok AND birth_ok AND expiry_ok AS overall_ok,
        concat_ws(',', CASE WHEN NOT number_ok THEN 'PASSPORT_NUMBER_CHECKSUM_FAILED' END, CASE WHEN NOT birth_ok THEN 'DOB_CHECKSUM_FAILED' END, CASE WHEN NOT expiry_ok THEN 'EXPIRY_CHECKSUM_FAILED' END, CASE WHEN NOT whole_ok THEN 'OVERALL_CHECKSUM_FAILED' END) AS errors FROM v"""


def _wide(doc_type: str, fields: list[str]) -> str:
    return f"(SELECT doc_id, {', '.join(x for f in fields for x in (f'max(CASE WHEN field = {quoted(f)} THEN value END) AS {f}', f'max(CASE WHEN field = {quoted(f)} THEN label_seq END) AS {f}_seq', f'max(CASE WHEN field = {quoted(f)} THEN label_text END) AS {f}_label'))} FROM label_values WHERE doc_type = '{doc_type}' GROUP BY doc_id)"


def _first(value: str, name: str, order: str = "seq") -> str:
    return f"(SELECT doc_id, arg_min({value}, {order}) AS {name} FROM sound WHERE {value} IS NOT NULL GROUP BY doc_id)"


def _of(value: str, c: str) -> str:
    return value.replace("text", c)


_docs = "(SELECT DISTINCT doc_id FROM sound) d"
_strip = lambda c: f"nullif(trim(regexp_replace(trim({c}), '^:+', '')), '')"
_tail = lambda c: f"nullif(regexp_replace(string_split(trim({c}), ':')[-1], '^[ :,\\-]+|[ :,\\-]+$', '', 'g'), '')"
_related = lambda c: f"coalesce(regexp_matches(regexp_replace(upper({c}), '[^A-Z]', '', 'g'), 'FATHER|HUSBAND|MOTHER'), false)"
PAN = f"""SELECT d.doc_id, CASE WHEN {_of(_pan_ok, 'pan_number')} THEN {_of(_pan, 'pan_number')} ELSE any_pan END AS pan_number,
    CASE WHEN NOT coalesce({_strip('name')} = {_strip('father_name')} AND name_seq = father_name_seq, false) THEN {_strip('name')} END AS name, {_strip('father_name')} AS father_name, coalesce({_of(_date, 'date_of_birth')}, any_date) AS date_of_birth
    FROM {_docs} LEFT JOIN {_wide('pan', ['name', 'father_name', 'date_of_birth', 'pan_number'])} USING (doc_id) LEFT JOIN {_first(_pan, 'any_pan', f'CASE WHEN {_pan_ok} THEN 0 ELSE 1000 END + seq')} USING (doc_id) LEFT JOIN {_first(_date, 'any_date')} USING (doc_id)"""
_father = f"CASE WHEN {_related('father_label')} THEN {_tail('father')} END"
_husband = f"CASE WHEN {_related('husband_label')} THEN {_tail('husband')} END"
VOTER = f"""SELECT d.doc_id, epic_number, CASE WHEN NOT {_related('name_label')} AND NOT {_related('name')} THEN {_tail('name')} END AS name, coalesce({_father}, {_husband}) AS relation_name,
    CASE WHEN {_father} IS NOT NULL THEN 'father' WHEN {_husband} IS NOT NULL THEN 'husband' END AS relation_type, {_of(_date, 'date_of_birth')} AS date_of_birth,
    CASE WHEN upper(gender) LIKE '%FEMALE%' THEN 'FEMALE' WHEN upper(gender) LIKE '%MALE%' THEN 'MALE' WHEN upper(gender) LIKE '%TRANSGENDER%' OR upper(gender) LIKE '%OTHER%' THEN 'TRANSGENDER' WHEN upper(gender) = 'F' THEN 'FEMALE' WHEN upper(gender) = 'M' THEN 'MALE' END AS gender, CAST(NULL AS VARCHAR) AS age
    FROM {_docs} LEFT JOIN {_wide('voter_id', ['name', 'father', 'husband', 'date_of_birth', 'gender'])} USING (doc_id) LEFT JOIN {_first(_epic, 'epic_number')} USING (doc_id)"""
_dated = lambda c: f"coalesce({_of(_date, c + '_label')}, {_of(_date, c)}) AS {c}"
LICENCE = f"SELECT d.doc_id, dl_number, {_strip('name')} AS name, {_dated('date_of_birth')}, {_dated('issue_date')}, {_dated('validity_date')} FROM {_docs} LEFT JOIN {_wide('driving_licence', ['name', 'date_of_birth', 'issue_date', 'validity_date'])} USING (doc_id) LEFT JOIN {_first(_dl, 'dl_number')} USING (doc_id)"
NREGA = f"SELECT d.doc_id, coalesce({_of(_job, 'job_card_number')}, any_card) AS job_card_number, head_of_household, village, gram_panchayat, district FROM {_docs} LEFT JOIN {_wide('nrega_job_card', ['job_card_number', 'head_of_household', 'village', 'gram_panchayat', 'district'])} USING (doc_id) LEFT JOIN {_first(_job, 'any_card')} USING (doc_id)"
_head = "upper(trim(string_split_regex(text, '[:：]')[1]))"
_rest = "nullif(trim(regexp_replace(regexp_extract(text, '[:：](.*)$'), '^[:：]', '')), '')"
_labelled = lambda n, name: f"(SELECT doc_id, arg_min({_rest}, seq) AS {name} FROM sound WHERE {_head} = '{n}' AND {_rest} IS NOT NULL GROUP BY doc_id)"
NPR = f"SELECT d.doc_id, name, address, {_of(_date, 'dated')} AS issue_date, nullif(regexp_extract(address, '\\b([1-9][0-9]{{5}})\\b', 1), '') AS pincode FROM (SELECT doc_id FROM sound GROUP BY doc_id HAVING bool_or(norm LIKE '%NATIONAL POPULATION REGISTER%')) d LEFT JOIN {_labelled('NAME', 'name')} USING (doc_id) LEFT JOIN {_labelled('ADDRESS', 'address')} USING (doc_id) LEFT JOIN {_labelled('DATE', 'dated')} USING (doc_id)"
_sex = "CASE WHEN regexp_matches(upper(text), '\\bFEMALE\\b') THEN 'FEMALE' WHEN regexp_matches(upper(text), '\\bMALE\\b') THEN 'MALE' WHEN regexp_matches(upper(text), '\\bTRANSGENDER\\b') THEN 'TRANSGENDER' END"
_dob_rank = f"CASE WHEN regexp_matches(upper(text), 'DOB|BIRTH') AND {_date} IS NOT NULL THEN 0 WHEN regexp_matches(upper(text), 'DOB|BIRTH') THEN 1000 WHEN {_date} IS NOT NULL THEN 2000 END"
_words = "string_split_regex(trim(regexp_replace(upper(text), '[^A-Z ]', ' ', 'g')), ' +')"
_name_like = f"(length(trim(text)) >= 3 AND NOT regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '\\b[SCDWscdw]\\s*/\\s*[Oo]\\b') AND NOT list_has_any({_words}, {extras.NOT_NAMES!r}))"
AADHAAR = f"""SELECT d.doc_id, aadhaar_number, CAST(NULL AS VARCHAR) AS masked_last4, nm.name, b.date_of_birth, CAST(NULL AS VARCHAR) AS year_of_birth, gender, address, pincode, CAST(NULL AS VARCHAR) AS vid FROM {_docs} LEFT JOIN {_wide('aadhaar', ['address'])} USING (doc_id)
    LEFT JOIN {_first(_uid('text'), 'aadhaar_number')} USING (doc_id) LEFT JOIN {_first(_sex, 'gender')} USING (doc_id) LEFT JOIN {_first("nullif(regexp_extract(text, '\\b[0-9]{6}\\b'), '')", 'pincode')} USING (doc_id)
    LEFT JOIN (SELECT doc_id, top AS d_top, "left" AS d_left, {_date} AS date_of_birth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_dob_rank} + seq) AS n FROM sound WHERE {_dob_rank} IS NOT NULL) WHERE n = 1) b USING (doc_id)
    LEFT JOIN (SELECT doc_id, text AS name FROM (SELECT s.doc_id, s.text, row_number() OVER (PARTITION BY s.doc_id ORDER BY d_top - s.bottom, abs(s."left" - d_left), s.seq) AS n FROM (SELECT * FROM sound WHERE {_name_like}) s
        JOIN (SELECT doc_id, top AS d_top, "left" AS d_left FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_dob_rank} + seq) AS n FROM sound WHERE {_dob_rank} IS NOT NULL) WHERE n = 1) USING (doc_id) WHERE s.bottom <= d_top + 5) WHERE n = 1) nm USING (doc_id)"""
for _name, _body in (("pan", PAN), ("voter_id", VOTER), ("driving_licence", LICENCE), ("nrega", NREGA), ("npr_letter", NPR), ("aadhaar", AADHAAR)):
    SQL[f"extract_{_name}"] = layout(_body)

_day = lambda c: f"CAST(try_strptime(replace({c}, '-', '/'), '%d/%m/%Y') AS DATE)"
_fields = sorted({f for of in dims.REQUIRED.values() for fs in of.values() for f in fs} | {"issue_date", "validity_date", "pincode"})


def _branch(doc_type: str, body: str, have: list[str]) -> str:
    return f"SELECT doc_id, '{doc_type}' AS document_type, {', '.join((f if f in have else 'CAST(NULL AS VARCHAR)') + f' AS {f}' for f in _fields)} FROM ({body}) WHERE doc_id IN (SELECT doc_id FROM classes WHERE document_type = '{doc_type}')"


_branches = " UNION ALL ".join(_branch(*b) for b in (
    ("pan", PAN, ["pan_number", "name", "date_of_birth"]), ("aadhaar", AADHAAR, ["aadhaar_number", "masked_last4", "name", "date_of_birth", "year_of_birth", "gender", "address", "pincode"]), ("driving_licence", LICENCE, ["dl_number", "name", "date_of_birth", "issue_date", "validity_date"]),
    ("voter_id", VOTER, ["epic_number", "name", "date_of_birth", "age"]), ("nrega_job_card", NREGA, ["job_card_number", "head_of_household", "village", "gram_panchayat", "district"]), ("npr_letter", NPR, ["name", "address", "issue_date"])))
_given = lambda fs: "(" + " OR ".join(f"trim(coalesce({f}, '')) <> ''" for f in fs) + ")"
_back = f"(document_type = 'aadhaar' AND {_given(['address', 'pincode'])} AND NOT {_given(dims.AADHAAR_FRONT)})"
_lacks = [(n, f"document_type = '{t}' AND NOT {_back} AND NOT {_given(fs)}") for t, of in dims.REQUIRED.items() for n, fs in of.items()] + [(n, f"{_back} AND NOT {_given(fs)}") for n, fs in dims.AADHAAR_BACK.items()]
_missing = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _lacks) + ")"
_n_missing = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in _lacks)
_n_required = f"CASE WHEN {_back} THEN 3 " + " ".join(f"WHEN document_type = '{t}' THEN {len(fs)}" for t, fs in dims.REQUIRED.items()) + " END"
_valid = f"CASE document_type WHEN 'pan' THEN {_of(_pan_ok, 'pan_number')} WHEN 'aadhaar' THEN {_uid_ok('aadhaar_number')} WHEN 'driving_licence' THEN dl_number IS NOT NULL WHEN 'voter_id' THEN epic_number IS NOT NULL WHEN 'nrega_job_card' THEN job_card_number IS NOT NULL END"
_bad = {
    "INVALID_DATE_OF_BIRTH": f"(document_type = 'pan' AND NOT coalesce({_day('date_of_birth')} < {AS_OF}, false)) OR (document_type IN ('aadhaar', 'voter_id') AND date_of_birth IS NOT NULL AND NOT coalesce({_day('date_of_birth')} < {AS_OF}, false)) OR (document_type = 'driving_licence' AND {_day('date_of_birth')} IS NULL)",
    "INVALID_ISSUE_DATE": f"(document_type = 'driving_licence' AND ({_day('issue_date')} IS NULL OR {_day('issue_date')} > {AS_OF})) OR (document_type = 'npr_letter' AND issue_date IS NOT NULL AND NOT coalesce({_day('issue_date')} <= {AS_OF}, false))",
    "INVALID_VALIDITY_DATE": f"document_type = 'driving_licence' AND {_day('validity_date')} IS NULL",
    "INVALID_DL_DATE_CHRONOLOGY": f"document_type = 'driving_licence' AND coalesce({_day('date_of_birth')} >= {_day('issue_date')} OR {_day('issue_date')} >= {_day('validity_date')}, false)",
}
_semantic = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _bad.values())
ASSESSED = f"""{LAYOUT.replace("{source}", "(SELECT * FROM regions WHERE confidence >= 0.5)")}, {SCORES}, typed AS MATERIALIZED ({_branches}),
judged AS (SELECT t.*, coalesce(g.mean_confidence, 0) AS mean_c, coalesce(g.min_confidence, 0) AS min_c, {_n_missing} AS n_missing, {_missing} AS missing, {_valid} AS valid, {_semantic} AS n_semantic,
    concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _bad.items())}) AS semantic
    FROM (SELECT c.doc_id, c.document_type, {', '.join(_fields)} FROM classes c LEFT JOIN typed USING (doc_id) WHERE c.document_type NOT IN ('unknown', 'passport')) t LEFT JOIN ({_geometry.replace('FROM regions', 'FROM sound')}) g USING (doc_id)),
assessed AS MATERIALIZED (SELECT doc_id, document_type, n_missing = 0 AND coalesce(valid, true) AND min_c >= 0.5 AND n_semantic = 0 AS complete,
    CASE WHEN n_semantic > 0 THEN least(raw, 0.49) ELSE raw END AS confidence, valid AS identifier_valid, missing,
    concat_ws(',', CASE WHEN NOT valid THEN 'INVALID_OR_MISSING_DOCUMENT_IDENTIFIER' END, CASE WHEN n_missing > 0 THEN 'MISSING_REQUIRED_FIELDS' END, CASE WHEN min_c < 0.5 THEN 'LOW_OCR_CONFIDENCE' END, nullif(semantic, '')) AS errors,
    CASE WHEN document_type = 'npr_letter' THEN 'IDENTIFIER_NOT_OFFLINE_VERIFIABLE' WHEN document_type = 'nrega_job_card' AND valid THEN 'IDENTIFIER_FORMAT_ONLY_NOT_AUTHENTICITY' ELSE '' END AS warnings
    FROM (SELECT *, round_even(least(1.0, 0.5 * (({_n_required}) - n_missing) / CAST({_n_required} AS DOUBLE) + 0.3 * CASE WHEN valid IS NULL THEN 0.6 WHEN valid THEN 1.0 ELSE 0.0 END + 0.2 * mean_c,
        CASE WHEN NOT valid THEN 0.39 ELSE 1.0 END, CASE WHEN n_missing > 0 THEN 0.69 ELSE 1.0 END, CASE WHEN min_c < 0.5 THEN 0.49 ELSE 1.0 END), 3) AS raw FROM judged))"""
SQL["assess_extraction"] = f"WITH {ASSESSED} SELECT * REPLACE (CAST(identifier_valid AS VARCHAR) AS identifier_valid) FROM assessed"
SQL["scan_results"] = f"""WITH {ASSESSED} SELECT c.doc_id, c.document_type, CASE WHEN a.doc_id IS NULL THEN 'unsupported_page' WHEN complete THEN 'success' ELSE 'failure' END AS status,
    round_even(CASE WHEN a.doc_id IS NULL THEN c.confidence WHEN complete THEN round_even(0.4 * c.confidence + 0.6 * a.confidence, 3) ELSE least(round_even(0.4 * c.confidence + 0.6 * a.confidence, 3), 0.69) END, 3) AS confidence,
    CASE WHEN a.doc_id IS NULL THEN 'UNSUPPORTED_DOCUMENT' ELSE errors END AS errors FROM classes c LEFT JOIN assessed a USING (doc_id)"""

#: Why a document has its class, in the order of the evidence.
_words = lambda t, prefix: f"SELECT doc_id, doc_type, 0 AS k, '{prefix}_KEYWORDS_' || n AS reason FROM counts WHERE doc_type = '{t}' AND evidence = 'keyword'"
_shape = lambda t, found, reason: f"SELECT DISTINCT doc_id, '{t}', 1, '{reason}' FROM regions WHERE {found} IS NOT NULL"
_why = " UNION ALL ".join([
    _words("pan", "PAN"), _shape("pan", _pan, "PAN_FORMAT"), _words("driving_licence", "DL"), _shape("driving_licence", _dl, "DL_FORMAT"), _words("voter_id", "VOTER"), _shape("voter_id", _epic, "EPIC_FORMAT"), _words("aadhaar", "AADHAAR"), _words("passport", "PASSPORT"),
    f"SELECT doc_id, 'aadhaar', 1, 'AADHAAR_NUMBER' FROM joined WHERE {_digits.format(t='j')} IS NOT NULL", f"SELECT doc_id, 'aadhaar', 2, 'AADHAAR_CHECKSUM_VALID' FROM joined WHERE {_uid_ok('j')}",
    "SELECT doc_id, doc_type, 0, CASE WHEN t > 0 OR h > 0 THEN 'NREGA_EXPLICIT_TITLE' ELSE 'NREGA_JOB_CARD_CONTEXT' END FROM strong WHERE doc_type = 'nrega_job_card'", "SELECT doc_id, doc_type, 0, CASE WHEN t > 0 THEN 'NPR_EXPLICIT_TITLE' ELSE 'NPR_ISSUER_CONTEXT' END FROM strong WHERE doc_type = 'npr_letter'",
])
_blocks = {"pan": (PAN, ["pan_number", "name", "father_name", "date_of_birth"]), "aadhaar": (AADHAAR, ["aadhaar_number", "masked_last4", "name", "date_of_birth", "year_of_birth", "gender", "address", "pincode", "vid"]), "driving_licence": (LICENCE, ["dl_number", "name", "date_of_birth", "issue_date", "validity_date"]),
    "voter_id": (VOTER, ["epic_number", "name", "relation_name", "relation_type", "date_of_birth", "age", "gender"]), "nrega_job_card": (NREGA, ["job_card_number", "head_of_household", "village", "gram_panchayat", "district"]), "npr_letter": (NPR, ["name", "address", "issue_date", "pincode"])}
_camel = lambda n: n.split("_")[0] + "".join(w.title() for w in n.split("_")[1:])
_block = lambda t, fields: f"CASE WHEN r.document_type = '{t}' AND {t}.doc_id IS NOT NULL THEN {{{', '.join(f"'{_camel(f)}': {t}.{f}" for f in fields)}}} END"
_list = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, ',') END"
_unread = "r.status = 'unsupported_page'"
_whole = {
    "status": "r.status", "documentType": "r.document_type", "pageType": f"CASE WHEN {_unread} THEN 'unknown' ELSE r.document_type END", "confidence": "CAST(r.confidence AS DOUBLE)", "fields": "NULL", "backPageFields": "NULL",
    **{_camel(f"{t}_fields"): _block(t, fields) for t, (_, fields) in _blocks.items()},
    "mrzRaw": "NULL", "mrzValid": "false", "lowConfidence": f"NOT {_unread} AND r.confidence >= 0.3 AND r.confidence < 0.7", "unsupportedReason": f"CASE WHEN {_unread} THEN 'UNSUPPORTED_DOCUMENT' END", "identifierValid": "a.identifier_valid", "missingRequiredFields": _list("a.missing"),
    "probeText": "CAST([] AS VARCHAR[])", "errors": _list("a.errors"), "warnings": _list("concat_ws(',', CASE WHEN r.document_type <> 'unknown' THEN w.reasons WHEN s.doc_id IS NULL THEN 'NO_DOCUMENT_HINTS' ELSE 'WEAK_DOCUMENT_HINTS' END, nullif(a.warnings, ''))"), "processingMs": "0",
}
SQL["results_to_json"] = f"""WITH {ASSESSED}, why AS ({_why}), reasons AS MATERIALIZED (SELECT doc_id, doc_type, string_agg(reason, ',' ORDER BY k) AS reasons FROM why GROUP BY ALL), {', '.join(f'{t} AS MATERIALIZED ({body})' for t, (body, _) in _blocks.items())}
    SELECT r.doc_id, CAST(to_json({{{', '.join(f"'{n}': {c}" for n, c in _whole.items())}}}) AS VARCHAR) AS json FROM ({SQL['scan_results'].partition(f'WITH {ASSESSED} ')[2]}) r LEFT JOIN assessed a USING (doc_id)
    LEFT JOIN reasons w ON w.doc_id = r.doc_id AND w.doc_type = r.document_type LEFT JOIN (SELECT DISTINCT doc_id FROM scores) s ON s.doc_id = r.doc_id {' '.join(f'LEFT JOIN {t} ON {t}.doc_id = r.doc_id' for t in _blocks)}"""

SQL["admit_assets"] = f"SELECT doc_id, CASE WHEN NOT (content_type LIKE 'image/%' OR content_type = 'application/pdf') THEN 'INVALID_CONTENT_TYPE' WHEN length > 10485760 THEN 'FILE_TOO_LARGE' WHEN length = 0 THEN 'EMPTY_FILE' END AS error FROM ({X.ASSETS_SQL})"
SQL["quality_gate"] = f"SELECT doc_id, CASE WHEN least(width, height) < 600 THEN 'RESOLUTION_TOO_LOW' WHEN blur_variance < 80 THEN 'IMAGE_TOO_BLURRY' END AS quality_error, CASE WHEN glare_ratio > 0.15 THEN 'GLARE_DETECTED' END AS warning FROM ({X.ASSETS_SQL})"
SQL["decode_payloads"] = "SELECT page_id AS request_id, CASE WHEN page_id % 7 IN (0, 2) THEN 'MISSING_IMAGE' WHEN page_id % 7 = 1 THEN 'INVALID_BASE64' END AS error, CASE WHEN page_id % 7 > 2 THEN CAST(strlen(url) AS INT) END AS size FROM pages"

_kind = X.KIND_SQL
EVAL = f"""samples AS MATERIALIZED ({X.SAMPLES_SQL.format(kind=_kind, div='//', orders='orders')}), results AS MATERIALIZED ({X.RESULTS_SQL.format(kind=_kind, orders='orders')}),
outcomes AS MATERIALIZED (SELECT sample_id, document_type, field, actual IS NOT NULL AS present, expected IS NOT DISTINCT FROM actual AS exact, regexp_replace(lower(expected), '[^\\p{{L}}\\p{{N}}]', '', 'g') IS NOT DISTINCT FROM regexp_replace(lower(actual), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS normalized
    FROM (SELECT s.sample_id, s.document_type, 'name' AS field, s.holder AS expected, CASE WHEN r.document_type = s.document_type THEN r.holder END AS actual FROM samples s LEFT JOIN results r USING (sample_id)
        UNION ALL SELECT s.sample_id, s.document_type, 'number', s.number, CASE WHEN r.document_type = s.document_type THEN r.number END FROM samples s LEFT JOIN results r USING (sample_id))),
observed AS MATERIALIZED (SELECT s.sample_id, s.document_type, {', '.join(evaluate.DIMENSIONS)}, coalesce(r.document_type = s.document_type, false) AS classified, s.accepted AS expected_accepted, coalesce(r.accepted, false) AS actual_accepted,
    coalesce(r.accepted, false) AND s.accepted AS accepted_right, NOT s.accepted AS expected_rejected, coalesce(field_expected, 0) AS field_expected, coalesce(field_exact, 0) AS field_exact, coalesce(field_normalized, 0) AS field_normalized, coalesce(r.accepted, false) AND NOT s.accepted AS false_success, s.accepted AND NOT coalesce(r.accepted, false) AS false_rejection, r.sample_id IS NULL AS runtime_errors,
    s.accepted AND coalesce(r.accepted, false) AND coalesce(r.document_type = s.document_type, false) AND all_exact AS complete_exact, s.accepted AND coalesce(r.accepted, false) AND coalesce(r.document_type = s.document_type, false) AND all_normalized AS complete_normalized
    FROM samples s LEFT JOIN results r USING (sample_id) LEFT JOIN (SELECT sample_id, bool_and(exact) AS all_exact, bool_and(normalized) AS all_normalized, count(*) AS field_expected, count(*) FILTER (WHERE exact) AS field_exact, count(*) FILTER (WHERE normalized) AS field_normalized FROM outcomes GROUP BY 1) USING (sample_id))"""
_counters = "count(*) AS samples, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in evaluate.COUNTERS[1:]) + "".join(f", CAST(sum({c}) AS BIGINT) AS {c}" for c in evaluate.FIELD_COUNTS)
_ratios = ", ".join(f"round_even({a} / nullif(CAST({b} AS DOUBLE), 0), 6) AS {n}" for n, a, b in (("classification_accuracy", "classified", "samples"), ("acceptance_rate", "accepted_right", "expected_accepted"), ("actual_acceptance_rate", "actual_accepted", "samples"), ("false_rejection_rate", "false_rejection", "expected_accepted"), ("exact_field_accuracy", "field_exact", "field_expected"), ("normalized_field_accuracy", "field_normalized", "field_expected"), ("false_success_rate", "false_success", "expected_rejected"), ("runtime_error_rate", "runtime_errors", "samples"), ("complete_accuracy", "complete_exact", "expected_accepted"), ("normalized_complete_accuracy", "complete_normalized", "expected_accepted")))
_metrics = f"SELECT *, {_ratios} FROM (SELECT coalesce(document_type, '*') AS document_type, {_counters} FROM observed GROUP BY ROLLUP (document_type))"
SQL["expected_vs_actual"] = f"WITH {EVAL} SELECT * FROM outcomes"
SQL["observation_flags"] = f"WITH {EVAL} SELECT * FROM observed"
SQL["metrics"] = f"WITH {EVAL} {_metrics}"
_value = lambda d: f"unnest(string_split({d}, ','))" if d in evaluate.MULTIPLE else d
_long = " UNION ALL ".join(f"SELECT * EXCLUDE ({', '.join(evaluate.DIMENSIONS)}), '{d}' AS dimension, {_value(d)} AS value FROM observed" for d in evaluate.DIMENSIONS)
SQL["sliced_metrics"] = f"WITH {EVAL}, long AS ({_long}) SELECT *, {_ratios} FROM (SELECT dimension, value, '*' AS document_type, {_counters} FROM long GROUP BY dimension, value UNION ALL BY NAME SELECT dimension, value, document_type, {_counters} FROM long GROUP BY document_type, dimension, value)"
SQL["field_metrics"] = f"WITH {EVAL} SELECT document_type, field, count(*) AS expected, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE normalized) AS normalized FROM outcomes GROUP BY ALL"
_checks = f"""{EVAL}, m AS ({_metrics}), rules AS {values(evaluate.THRESHOLDS, 'scope, metric, direction, threshold')},
    long AS ({' UNION ALL '.join(f"SELECT document_type, '{n}' AS metric, {n} AS actual FROM m WHERE document_type <> '*'" for n in sorted({t[1] for t in evaluate.THRESHOLDS}))}),
    checked AS (SELECT document_type, metric, actual, CAST(threshold AS DOUBLE) AS threshold, coalesce(CASE direction WHEN 'min' THEN actual >= threshold ELSE actual <= threshold END, false) AS passed
        FROM (SELECT l.*, direction, threshold, row_number() OVER (PARTITION BY l.document_type, l.metric ORDER BY scope = '*') AS n FROM long l JOIN rules r ON r.metric = l.metric AND r.scope IN ('*', l.document_type)) WHERE n = 1)"""
SQL["threshold_checks"] = f"WITH {_checks} SELECT * FROM checked"
SQL["gate"] = f"WITH {_checks} SELECT bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM checked"
SQL["coverage_anti"] = f"WITH {EVAL} SELECT DISTINCT 'capture' AS dimension, capture || CASE WHEN sample_id % 2 = 0 THEN '' ELSE ' NIGHT' END AS value FROM samples WHERE capture || CASE WHEN sample_id % 2 = 0 THEN '' ELSE ' NIGHT' END NOT IN (SELECT capture FROM samples WHERE accepted)"
SQL["check_manifest"] = f"""WITH {EVAL}, doubled AS (SELECT sample_id, accepted FROM samples UNION ALL SELECT sample_id, accepted FROM samples WHERE sample_id % 101 = 0)
    SELECT sample_id, 'DUPLICATE_SAMPLE_ID' AS violation FROM doubled GROUP BY sample_id HAVING count(*) > 1
    UNION ALL SELECT sample_id, 'NO_EXPECTED_FIELDS' FROM doubled WHERE accepted AND sample_id % 13 = 0
    UNION ALL SELECT sample_id, 'NULL_REQUIRED_FIELD' FROM doubled WHERE accepted AND sample_id % 13 <> 0 AND sample_id % 17 = 0"""
LOG = "log AS (SELECT event_id AS doc_id, ts, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'unsupported_page' ELSE 'success' END AS status, CAST(trunc(value * 10) AS INT) AS processing_ms FROM events)"
SQL["latency_report"] = f"WITH {LOG} SELECT status, count(*) AS scans, round_even(avg(processing_ms), 4) AS mean_ms, median(processing_ms) AS median_ms FROM log GROUP BY status"
SQL["stream_quality"] = f"WITH {LOG} SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, status, count(*) AS scans, CAST(sum(processing_ms) AS BIGINT) AS total_ms FROM log GROUP BY ALL"
SQL["stream_quality_sliding"] = f"WITH {LOG} SELECT start, status, count(*) AS scans, CAST(sum(processing_ms) AS BIGINT) AS total_ms FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - CAST(k * 30 AS INT) * INTERVAL '1 minute' AS start, status, processing_ms FROM log, (VALUES (0), (1)) AS v(k)) GROUP BY ALL"
SQL["stream_sessions"] = f"WITH {LOG}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY status ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM log) SELECT min(ts) AS start, status, count(*) AS scans FROM (SELECT *, sum(fresh) OVER (PARTITION BY status ORDER BY ts, doc_id) AS g FROM marked) GROUP BY status, g"
SQL["plausible_quad"] = f"""SELECT doc_id, ok AS plausible, CASE WHEN NOT ok THEN 'NO_DOCUMENT_BOUNDARY_DETECTED' WHEN width * height * (doc_id % 10) / 10.0 < 0.5 * width * height THEN 'PERSPECTIVE_CORRECTION_DISCARDED' END AS boundary_warning
    FROM (SELECT *, w > 0 AND h > 0 AND doc_id % 13 <> 0 AND w * h >= 0.3 * width * height AND w / CAST(h AS DOUBLE) BETWEEN 0.5 AND 3.0 AS ok FROM (SELECT *, width - doc_id % 7 * 60 AS w, height - doc_id % 11 * 30 AS h FROM ({X.ASSETS_SQL})))"""
SQL["printed_vocabulary"] = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 1 THEN 'B-' WHEN 2 THEN 'AB+' WHEN 4 THEN 'A-' END AS blood, CASE o_orderkey % 4 WHEN 0 THEN 'MCWG, LMV-NT' WHEN 1 THEN 'LMV' WHEN 2 THEN 'TRANS, MC' ELSE '' END AS vehicles FROM orders"
SQL["name_like"] = cards(f"SELECT doc_id, seq, {_name_like} AS name_like FROM regions")
SQL["split_licence"] = cards(f"SELECT doc_id, {_of(_dl, 'substr(text, 8)')} AS dl_number FROM regions WHERE text LIKE 'DL No.%' AND {_of(_dl, 'substr(text, 8)')} IS NOT NULL AND doc_id % 5 <> 0")
SQL["compact_members"] = """SELECT doc_id, seq, serial, name, gender, age FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, serial, name ORDER BY seq) AS n FROM (
    SELECT o_orderkey // 8 AS doc_id, CAST(o_orderkey % 8 AS INT) AS seq, CAST(o_orderkey % 4 AS INT) AS serial, CASE WHEN o_orderkey % 2 = 0 THEN 'PERSON A' ELSE 'PERSON B' END AS name, CASE o_orderkey % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' END AS gender,
        CASE WHEN o_orderkey % 90 + 10 >= 18 THEN CAST(o_orderkey % 90 + 10 AS INT) END AS age FROM orders) WHERE gender IS NOT NULL OR age IS NOT NULL) WHERE n = 1"""
_score = lambda m, c: f"round_even({c} / 100.0 + CASE WHEN o_orderkey % 2 = {m} THEN 0.15 ELSE 0 END + CASE WHEN o_orderkey % 3 = {m} THEN 0.2 ELSE 0 END + CASE WHEN o_orderkey % 5 = {m} THEN 0.1 ELSE 0 END + CASE WHEN o_orderkey % 7 = {m} THEN 0.1 ELSE 0 END + CASE WHEN o_orderkey % 11 = {m} THEN 0.05 ELSE 0 END, 6)"
SQL["best_candidate"] = f"SELECT doc_id, CASE WHEN b > a THEN 'full' ELSE 'targeted' END AS pass, CAST(greatest(a, b) AS DOUBLE) AS score FROM (SELECT o_orderkey AS doc_id, {_score(0, 'o_orderkey % 100')} AS a, {_score(1, '(o_orderkey * 7 % 100)')} AS b FROM orders)"
SQL["country_check"] = f"SELECT doc_id, 'UNKNOWN_COUNTRY_CODE_' || c AS warning FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UTO' ELSE country END AS c FROM ({SQL['parse_mrz']})) WHERE c NOT IN (SELECT upper(substr(n_name, 1, 3)) FROM nation)"
SQL["passport_confidence"] = f"WITH {PASSPORTS} SELECT r.doc_id, round_even(least(1.0, 0.4 * coalesce(CASE WHEN overall_ok THEN 1.0 ELSE 0.7 * (CAST(number_ok AS INT) + CAST(birth_ok AS INT) + CAST(expiry_ok AS INT)) / 3 END, 0) + 0.15 + 0.3 * ocr), 3) AS confidence FROM (SELECT doc_id, avg(confidence) AS ocr FROM regions GROUP BY doc_id) r LEFT JOIN ({SQL['parse_mrz']}) z USING (doc_id)"
SQL["legacy_benchmark"] = f"WITH {EVAL} SELECT status_match, field_exact, status_match >= 0.95 AS status_gate, field_exact >= 0.97 AS field_gate FROM (SELECT round_even(avg(CAST(expected_accepted = actual_accepted AS INT)), 6) AS status_match, round_even(avg(CAST(complete_exact AS INT)), 6) AS field_exact FROM observed)"
SQL["release_gate"] = f"""SELECT bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM (SELECT passed FROM ({SQL['threshold_checks']}) UNION ALL SELECT samples >= {evaluate.SLICE_MINIMUM} FROM ({SQL['sliced_metrics']}) WHERE document_type = '*'
    UNION ALL SELECT false FROM ({SQL['coverage_anti']}) UNION ALL SELECT false FROM ({SQL['metrics']}) WHERE document_type = '*' AND runtime_errors > 0)"""
_page = lambda t: f"CASE s.side WHEN 'front' THEN 'passport_biodata' WHEN 'back' THEN 'passport_non_biodata' ELSE {t}.document_type END"
_share = lambda a, b: f"round_even(coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 1.0), 6)"
SQL["scan_benchmark"] = f"""WITH {EVAL}, {LOG}, both_ AS (
        SELECT s.accepted AS e_ok, r.accepted AS a_ok, s.document_type AS e_type, r.document_type AS a_type, {_page('s')} AS e_page, {_page('r')} AS a_page, s.side = 'front' AS front, r.holder IS NOT NULL AS zone_read,
               CAST(s.holder IS NOT DISTINCT FROM r.holder AS INT) + CAST(s.number IS NOT DISTINCT FROM r.number AS INT) AS exact, l.processing_ms AS ms
        FROM samples s JOIN results r USING (sample_id) JOIN log l ON l.doc_id = s.sample_id
    ), rates AS (
        SELECT round_even(avg(CAST(e_ok = a_ok AND e_type = a_type AND e_page = a_page AS INT)), 6) AS status_rate, {_share('sum(exact)', '2 * count(*)')} AS field_rate, {_share('count(*) FILTER (WHERE front AND zone_read)', 'count(*) FILTER (WHERE front)')} AS mrz_rate,
               {_share("count(*) FILTER (WHERE e_page = 'passport_non_biodata' AND a_ok AND a_page = 'passport_non_biodata')", "count(*) FILTER (WHERE e_page = 'passport_non_biodata')")} AS non_biodata_rate,
               round_even(avg(ms % 100 / 100.0), 6) AS mean_confidence, round_even(avg(ms), 6) AS mean_ms, CAST(sum(ms) AS BIGINT) AS total_ms, coalesce(median(ms) FILTER (WHERE e_ok AND e_page = 'passport_biodata'), 0.0) AS biodata_median_ms
        FROM both_)
    SELECT *, status_rate >= 0.95 AS status_rate_ok, field_rate >= 0.97 AS field_rate_ok, mrz_rate >= 0.99 AS mrz_rate_ok, non_biodata_rate >= 0.95 AS non_biodata_rate_ok, biodata_median_ms <= 5000 AS biodata_median_ok FROM rates"""
for _name in ("classify_documents", "classify_pages", "assess_extraction", "scan_results", "passport_confidence"):  # decimal literals to doubles, as in Spark
    SQL[_name] = f"SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({SQL[_name]})"
