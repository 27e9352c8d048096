"""Derived inputs: cards and passport pages as regions, text lines, assets, samples, results, scan log.

The same derivation is given as Spark expressions here and as SQL in ``oracles``; both are arithmetic on keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import checksum
from folioscan.operators import regions as R

NAMES = ["TARUN KULKARNI", "MEGHA PILLAI", "ANJALI VERMA", "VIKRAM PATEL", "DEEPAK MEHTA", "SUNITA RAO", "ARJUN SINGH", "KAVITA JOSHI", "MANOJ GUPTA", "NEHA KAPOOR"]


def _name(k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} % 10 = {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


def _verhoeff_digit(number: str, digits: int) -> str:
    """SQL for the check digit of the last ``digits`` digits of a text, one table look-up a digit."""
    table = "".join(str(x) for row in checksum.dihedral() for x in row)
    power = "".join(str(x) for row in checksum.permutations() for x in row)
    inverse = "".join(str(row.index(0)) for row in checksum.dihedral())
    c = "0"
    for i in range(1, digits + 1):
        digit = f"CAST(substr({number}, {digits + 1 - i}, 1) AS INT)"
        p = f"CAST(substr('{power}', {i % 8 * 10 + 1} + {digit}, 1) AS INT)"
        c = f"CAST(substr('{table}', ({c}) * 10 + {p} + 1, 1) AS INT)"
    return f"substr('{inverse}', ({c}) + 1, 1)"


#: SQL of the values, valid in both engines; {div} is integer division, {date} a printed date of a date and an offset.
VALUES = """
    SELECT o_orderkey AS k, CAST(o_orderkey % 6 AS INT) AS kind, {name} AS holder, {father} AS father,
        {birth} AS birth, {issue} AS issue, {valid} AS valid,
        CASE WHEN o_orderkey % 11 = 0 THEN 'ABCD' ELSE 'ABCP' END || chr(CAST(65 + o_orderkey % 26 AS INT)) || lpad(CAST(o_orderkey % 10000 AS VARCHAR(20)), 4, '0') || chr(CAST(65 + (o_orderkey {div} 26) % 26 AS INT)) AS pan,
        CASE WHEN o_orderkey % 11 = 0 THEN 'AB-' ELSE 'ABC' END || lpad(CAST(o_orderkey AS VARCHAR(20)), 7, '0') AS epic,
        CASE WHEN o_orderkey % 11 = 0 THEN 'M' ELSE 'MH' END || lpad(CAST(o_orderkey % 100 AS VARCHAR(20)), 2, '0') || ' 2011 ' || lpad(CAST(o_orderkey AS VARCHAR(20)), 7, '0') AS dl,
        CASE WHEN o_orderkey % 11 = 0 THEN 'RJ' ELSE 'RJ-' || lpad(CAST(o_orderkey % 33 + 1 AS VARCHAR(20)), 2, '0') || '-001-002-' || lpad(CAST(o_orderkey AS VARCHAR(20)), 7, '0') END AS job,
        CAST(20000000000 + o_orderkey AS VARCHAR(20)) AS base
    FROM {orders}
"""
CARDS = """
    SELECT *, substr(base, 1, 4) || ' ' || substr(base, 5, 4) || ' ' || substr(base, 9, 3) ||
        CASE WHEN k % 11 = 0 THEN CASE WHEN {digit} = '9' THEN '0' ELSE '9' END ELSE {digit} END AS aadhaar
    FROM ({values})
"""
#: (kind, is_value of the label before, text): k % 7 drops the holder's row, k % 19 replaces the card by free text.
TEMPLATES = {
    0: ["'INCOME TAX DEPARTMENT'", "'GOVT. OF INDIA'", ("'Name'", "holder"), ("'Father''s Name'", "father"), ("'Date of Birth'", "birth"), ("'Permanent Account Number'", "pan")],
    1: ["'Government of India'", "holder", "'DOB: ' || birth", "CASE WHEN k % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END", "aadhaar", "'Unique Identification Authority of India'"],
    2: ["'DRIVING LICENCE'", "'TRANSPORT DEPARTMENT'", "'DL No. ' || dl", ("'Name'", "holder"), ("'Date of Birth'", "birth"), ("'Date of Issue'", "issue"), ("'Valid Till'", "valid")],
    3: ["'ELECTION COMMISSION OF INDIA'", "'IDENTITY CARD'", "epic", ("'Elector''s Name'", "holder"), ("'Father''s Name'", "father"), ("'Date of Birth'", "birth"), ("'Sex'", "CASE WHEN k % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END")],
    4: ["'MAHATMA GANDHI NATIONAL RURAL EMPLOYMENT GUARANTEE ACT'", "'JOB CARD'", ("'Job Card No.'", "job"), ("'Name of Head of Household'", "holder"), ("'Village'", "'RAMPUR'")],
    5: ["'NATIONAL POPULATION REGISTER'", "'Registrar General & Census Commissioner'", "'Name: ' || holder", "'Address: 12 MG ROAD, PUNE 411001'", "'Date: ' || issue"],
}


def _regions(kind: int) -> list[tuple[str, str, str, str, str, str, str]]:
    """(text, left, top, right, bottom, confidence, kept when) as SQL, in reading order."""
    out, y = [], 20
    for item in TEMPLATES[kind]:
        for is_value, text in enumerate(item if isinstance(item, tuple) else (item,)):
            confidence = "CASE WHEN k % 13 = 0 THEN 0.45 ELSE 0.95 END" if is_value else "0.97"
            when = "k % 7 <> 0" if text == "holder" else "1 = 1"
            if is_value:  # below the label for even keys, to its right for odd ones
                out.append((text, "CASE WHEN k % 2 = 0 THEN 40 ELSE 240 END", f"CASE WHEN k % 2 = 0 THEN {y + 28} ELSE {y} END", "CASE WHEN k % 2 = 0 THEN 300 ELSE 500 END", f"CASE WHEN k % 2 = 0 THEN {y + 56} ELSE {y + 25} END", confidence, when))
            else:
                out.append((text, "40", f"{y}", "220", f"{y + 25}", confidence, when))
        y += 70
    if kind == 0:  # a second, weaker reading of the first box
        out.append(("'INCOME TAX  department'", "40", "20", "220", "45", "0.60", "k % 23 = 0"))
    return out


def regions_sql(dialect: str) -> str:
    """doc_id, page_no, seq, text, left, top, right, bottom, confidence of every card's regions."""
    spark = dialect == "spark"
    day = lambda days: f"date_format(date_add(o_orderdate, {days}), 'dd/MM/yyyy')" if spark else f"strftime(CAST(o_orderdate AS DATE) + {days}, '%d/%m/%Y')"
    birth = f"CASE WHEN o_orderkey % 17 = 0 THEN {day(365 * 60)} ELSE {day(-365 * 30)} END"
    values = VALUES.format(name=_name("o_orderkey"), father=_name("(o_orderkey + 3)"), birth=birth, issue=day(0), valid=day(365 * 20), div="div" if spark else "//", orders="{orders}" if spark else "orders")
    cards = CARDS.format(digit=_verhoeff_digit("base", 11), values=values)
    cells = lambda rows, seq0=0: ", ".join(_cell(seq0 + k, r, spark) for k, r in enumerate(rows))
    array = (lambda x: f"array({x})") if spark else (lambda x: f"[{x}]")
    free = array(cells([("'just a receipt'", "40", "20", "220", "45", "0.9", "1 = 1"), ("'total ' || CAST(k AS VARCHAR(20))", "40", "90", "220", "115", "0.9", "1 = 1")]))
    choose = f"CASE WHEN k % 19 = 0 THEN {free} " + " ".join(f"WHEN kind = {t} THEN {array(cells(_regions(t)))}" for t in TEMPLATES) + " END"
    fields = "r.seq, r.text, r.\"left\", r.top, r.\"right\", r.bottom, r.confidence" if not spark else "r.seq, r.text, r.left, r.top, r.right, r.bottom, r.confidence"
    exploded = f"SELECT k AS doc_id, explode({choose}) AS r FROM ({cards})" if spark else f"SELECT k AS doc_id, unnest({choose}) AS r FROM ({cards})"
    return f"SELECT doc_id, 0 AS page_no, {fields} FROM ({exploded}) WHERE r.kept"


def _cell(seq: int, row: tuple, spark: bool) -> str:
    text, left, top, right, bottom, confidence, kept = row
    pairs = (("seq", f"{seq}"), ("text", text), ("left", f"CAST({left} AS INT)"), ("top", f"CAST({top} AS INT)"), ("right", f"CAST({right} AS INT)"), ("bottom", f"CAST({bottom} AS INT)"), ("confidence", f"CAST({confidence} AS DOUBLE)"), ("kept", kept))
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in pairs) + ")" if spark else "{" + ", ".join(f"'{n}': {v}" for n, v in pairs) + "}"


def _digit_by_key(number: str, digits: int) -> str:
    """Spark SQL for ``_verhoeff_digit`` of a positive number, by arithmetic and constant arrays."""
    at = lambda table, place: f"get(array({', '.join(map(str, table))}), CAST({place} AS INT))"
    dihedral, c = checksum.dihedral(), "0"
    for i, power in enumerate((checksum.permutations() * 2)[1 : digits + 1]):
        c = at([x for row in dihedral for x in row], f"{c} * 10 + {at(power, f'{number} div {10**i} % 10')}")
    return f"CAST({at([row.index(0) for row in dihedral], c)} AS STRING)"


def _spark_values() -> dict[str, str]:
    """The values of ``VALUES`` and ``CARDS`` as Spark SQL over (o_orderkey, o_orderdate), names and digits by look-up."""
    day = lambda days: f"date_format(date_add(o_orderdate, {days}), 'dd/MM/yyyy')"
    name = lambda k: f"get(array({', '.join(map(repr, NAMES))}), CAST({k} % 10 AS INT))"
    key, base = "CAST(k AS STRING)", "CAST(20000000000 + k AS STRING)"
    return {
        "holder": name("k"),
        "father": name("(k + 3)"),
        "birth": day("CASE WHEN k % 17 = 0 THEN 21900 ELSE -10950 END"),
        "issue": day(0),
        "valid": day(7300),
        "pan": f"(CASE WHEN k % 11 = 0 THEN 'ABCD' ELSE 'ABCP' END || chr(65 + k % 26) || lpad(CAST(k % 10000 AS STRING), 4, '0') || chr(65 + (k div 26) % 26))",
        "epic": f"(CASE WHEN k % 11 = 0 THEN 'AB-' ELSE 'ABC' END || lpad({key}, 7, '0'))",
        "dl": f"(CASE WHEN k % 11 = 0 THEN 'M' ELSE 'MH' END || lpad(CAST(k % 100 AS STRING), 2, '0') || ' 2011 ' || lpad({key}, 7, '0'))",
        "job": f"CASE WHEN k % 11 = 0 THEN 'RJ' ELSE 'RJ-' || lpad(CAST(k % 33 + 1 AS STRING), 2, '0') || '-001-002-' || lpad({key}, 7, '0') END",
        "aadhaar": f"(substr({base}, 1, 4) || ' ' || substr({base}, 5, 4) || ' ' || substr({base}, 9, 3) || translate({_digit_by_key('(20000000000 + k)', 11)}, '0123456789', CASE WHEN k % 11 = 0 THEN '9999999990' ELSE '0123456789' END))",
    }


def spark_regions_sql() -> str:
    """The rows of ``regions_sql`` in steps that the JVM compiles: it interprets methods of over 8,000 bytecodes for good, and one
    array of all cells is such a method. Cells are constants by kind here; a text is made for its own cell only, a few kinds of text in a
    step, and what reads it twice doesn't make it twice."""
    values = _spark_values()
    sql = lambda t: re.sub(rf"\b({'|'.join(values)})\b", lambda m: values[m[0]], t)
    fixed = lambda t: t.startswith("'") and "||" not in t
    cell = lambda n, text, what, y, is_value, confidence: f"named_struct('seq', {n}, 'fixed', {text}, 'what', {what}, 'y', {y}, 'is_value', {is_value}, 'confidence', {confidence}D)"
    whats, arrays, none = {}, {}, "CAST(NULL AS STRING)"
    for kind, items in TEMPLATES.items():
        cells = []
        for row, item in enumerate(items):
            for is_value, text in enumerate(item if isinstance(item, tuple) else (item,)):
                what = 0 if fixed(text) else whats.setdefault(text, len(whats) + 1)
                cells.append(cell(len(cells), none if what else text, what, 20 + 70 * row, bool(is_value), 0.97))
        if kind == 0:
            cells.append(cell(len(cells), "'INCOME TAX  department'", -1, 20, False, 0.6))
        arrays[kind] = f"array({', '.join(cells)})"
    free = f"array({cell(0, repr('just a receipt'), 0, 20, False, 0.9)}, {cell(1, none, len(whats) + 1, 90, False, 0.9)})"
    chosen = f"CASE WHEN o_orderkey % 19 = 0 THEN {free} " + " ".join(f"WHEN CAST(o_orderkey % 6 AS INT) = {t} THEN {a}" for t, a in arrays.items()) + " END"
    cells = f"SELECT o_orderkey AS k, o_orderdate, c.* FROM (SELECT o_orderkey, o_orderdate, explode({chosen}) AS c FROM {{orders}})"
    kept = f"(what <> {whats['holder']} OR k % 7 <> 0) AND (what <> -1 OR k % 23 = 0)"
    made, rows = list(whats.items()), f"SELECT * FROM ({cells}) WHERE {kept}"
    for step in range(0, len(made), 5):
        some = " ".join(f"WHEN what = {n} THEN {sql(t)}" for t, n in made[step : step + 5])
        rows = f"SELECT *, explode(array(CASE {some} END)) AS text{step} FROM ({rows})"
    last = f"CASE WHEN what = {len(made) + 1} THEN 'total ' || CAST(k AS STRING) ELSE coalesce(fixed, {', '.join(f'text{step}' for step in range(0, len(made), 5))}) END"
    rows = f"SELECT *, explode(array({last})) AS text FROM ({rows})"
    even = lambda a, b: f"CAST(CASE WHEN NOT is_value THEN {b[0]} WHEN k % 2 = 0 THEN {a} ELSE {b[1]} END AS INT)"
    return f"""
        SELECT k AS doc_id, 0 AS page_no, seq, text, {even("40", ("40", "240"))} AS left, {even("y + 28", ("y", "y"))} AS top, {even("300", ("220", "500"))} AS right,
            {even("y + 56", ("y + 25", "y + 25"))} AS bottom, CASE WHEN NOT is_value THEN confidence WHEN k % 13 = 0 THEN 0.45D ELSE 0.95D END AS confidence
        FROM ({rows})
    """


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all six types as regions. Orders are dealt by key before they grow, so that documents lie whole in a
    partition and what groups by doc_id needs no exchange."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return spark.sql(spark_regions_sql(), orders=R.dealt(orders, "o_orderkey"))


LINES_SQL = """
    SELECT doc_id, 0 AS page_no, seq, trim(body) AS text, 40 AS "left", CAST(20 + 40 * seq AS INT) AS top,
        CAST(40 + 10 * length(trim(body)) AS INT) AS "right", CAST(50 + 40 * seq AS INT) AS bottom,
        CAST((doc_id * 31 + seq * 17) % 61 + 40 AS DOUBLE) / 100 AS confidence
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS seq FROM documents)
    WHERE trim(body) <> ''
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of documents as regions, one under the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "body")).filter(F.trim("body") != "")
    text = F.trim("body")
    return rows.select("doc_id", F.lit(0).alias("page_no"), "seq", text.alias("text"), F.lit(40).alias("left"), (20 + 40 * F.col("seq")).alias("top"), (40 + 10 * F.length(text)).alias("right"), (50 + 40 * F.col("seq")).alias("bottom"), (((F.col("doc_id") * 31 + F.col("seq") * 17) % 61 + 40).cast("double") / 100).alias("confidence"))


ASSETS_SQL = """
    SELECT p_partkey AS doc_id, CAST(400 + p_partkey % 5 * 100 AS INT) AS width, CAST(500 + p_size * 10 AS INT) AS height,
        CAST(60 + p_partkey % 50 AS DOUBLE) AS blur_variance, CAST(p_partkey % 31 AS DOUBLE) / 100 AS glare_ratio,
        CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' ELSE 'text/html' END AS content_type,
        CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE CAST(10485760 - 50 + p_partkey % 100 AS BIGINT) END AS length
    FROM part
"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of page images around every threshold."""
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    kind = F.when(key % 4 == 0, "image/png").when(key % 4 == 1, "application/pdf").when(key % 4 == 2, "image/jpeg").otherwise("text/html")
    return part.select(key.alias("doc_id"), (400 + key % 5 * 100).cast("int").alias("width"), (500 + F.col("p_size") * 10).cast("int").alias("height"), (60 + key % 50).cast("double").alias("blur_variance"), ((key % 31).cast("double") / 100).alias("glare_ratio"), kind.alias("content_type"), F.when(key % 9 == 0, F.lit(0)).otherwise(10485760 - 50 + key % 100).cast("long").alias("length"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan events: time, status, latency."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    status = F.when(kind == "error", "failure").when(kind == "signup", "unsupported_page").otherwise("success")
    return events.select(F.col("event_id").alias("doc_id"), F.col("ts"), status.alias("status"), (F.col("value") * 10).cast("int").alias("processing_ms"))


def icao_sql(text: str, length: int) -> str:
    """SQL for the check digit of a text of fixed length, valid in both engines."""
    terms = [f"greatest(instr('{checksum.ALPHABET}', substr({text}, {k + 1}, 1)) - 1, 0) * {(7, 3, 1)[k % 3]}" for k in range(length)]
    return f"(({' + '.join(terms)}) % 10)"


def passports_sql(dialect: str) -> str:
    """Biodata pages: labels and a two-line zone per customer; some digits broken, some letters for digits."""
    text = "CAST(c_custkey AS VARCHAR(20))"
    base = f"SELECT c_custkey AS k, 'L' || lpad({text}, 8, '0') AS num, lpad(CAST(c_custkey % 100 AS VARCHAR(20)), 2, '0') || lpad(CAST(c_custkey % 13 AS VARCHAR(20)), 2, '0') || lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0') AS born, lpad(CAST((c_custkey * 7) % 100 AS VARCHAR(20)), 2, '0') || '0415' AS ends, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '<' END AS sex, {_name('c_custkey')} AS holder FROM {'{customer}' if dialect == 'spark' else 'customer'}"
    with_digits = f"SELECT *, num || CAST({icao_sql('num', 9)} AS VARCHAR(20)) || 'IND' || born || CAST({icao_sql('born', 6)} AS VARCHAR(20)) || sex || ends || CAST(({icao_sql('ends', 6)} + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR(20)) || '<<<<<<<<<<<<<<0' AS body FROM ({base})"
    whole = "substr(body, 1, 10) || substr(body, 14, 7) || substr(body, 22, 22)"
    line1 = "rpad('P<IND' || replace(replace(holder, ' ', '<<'), '-', '<'), 44, '<')"
    line2 = f"body || CAST({icao_sql('whole', 39)} AS VARCHAR(20))"
    fixed = "CASE WHEN k % 5 = 0 THEN substr(line2, 1, 13) || replace(substr(line2, 14, 6), '0', 'O') || substr(line2, 20, 25) WHEN k % 7 = 0 THEN replace(line2, '<', '>') ELSE line2 END"
    zone = f"SELECT k, holder, line1, {fixed} AS line2 FROM (SELECT k, holder, {line1} AS line1, {line2} AS line2 FROM (SELECT *, {whole} AS whole FROM ({with_digits})))"
    rows = [("'Surname'", "40", "20", "220", "45"), ("'Given Name(s)'", "40", "90", "220", "115"), ("'Date of Birth'", "40", "160", "220", "185"), ("line1", "10", "400", "600", "430"), ("CASE WHEN k % 17 = 0 THEN 'SMUDGED' ELSE line2 END", "10", "440", "600", "470")]
    cells = ", ".join(_cell(k, (*r, "0.9", "1 = 1"), dialect == "spark") for k, r in enumerate(rows))
    exploded = f"SELECT k AS doc_id, explode(array({cells})) AS r FROM ({zone})" if dialect == "spark" else f"SELECT k AS doc_id, unnest([{cells}]) AS r FROM ({zone})"
    q = "" if dialect == "spark" else '"'
    return f"SELECT doc_id, 0 AS page_no, r.seq, r.text, r.{q}left{q}, r.top, r.{q}right{q}, r.bottom, r.confidence FROM ({exploded})"


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(passports_sql("spark"), customer=R.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey"))


def back_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back pages of passports from suppliers: names, an address of two to four lines ending in a state, file and old passport numbers."""
    k, name = F.col("s_suppkey"), F.upper(F.translate("s_name", "#0123456789", ""))
    states = F.array(*[F.lit(s) for s in ("KA", "DELHI", "Maharashtra", "TN")])
    state = F.element_at(states, (k % 4 + 1).cast("int"))
    cell = lambda seq, text, left, top: F.struct(F.lit(seq).alias("seq"), text.alias("text"), F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(left + 200).alias("right"), F.lit(top + 22).alias("bottom"))
    lit = F.lit
    cells = F.array(
        cell(0, lit("Name of Father / Legal Guardian"), 40, 20), cell(1, F.concat(name, lit(" SENIOR")), 40, 50), cell(2, lit("Name of Mother"), 40, 90), cell(3, name, 40, 120),
        cell(4, lit("Address"), 40, 160), cell(5, F.concat((k % 90).cast("string"), lit(" "), name, lit(" STREET")), 40, 190),
        cell(6, F.when(k % 3 == 0, lit("MARKET ROAD")).otherwise(lit("x")), 40, 215), cell(7, F.concat(lit("BENGALURU,"), state, lit(",PIN:"), (560001 + k % 99).cast("string")), 40, 240),
        cell(8, lit("File No."), 40, 300), cell(9, F.concat(lit("BN"), F.lpad(k.cast("string"), 10, "0")), 40, 330), cell(10, lit("Old Passport No. with Date and Place of Issue"), 40, 380),
        cell(11, F.concat(lit("K"), F.lpad(k.cast("string"), 7, "0")), 40, 410), cell(12, lit("12/03/2011"), 260, 410), cell(13, lit("BENGALURU"), 480, 410),
    )
    rows = R.dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), "s_suppkey")
    return rows.select(k.alias("doc_id"), F.explode(cells).alias("c")).select("doc_id", F.lit(0).alias("page_no"), "c.*", F.lit(0.9).alias("confidence"))


def _choice(name: str, by: int, *values: str) -> str:
    """SQL that takes one of ``values`` by the key."""
    return "CASE " + " ".join(f"WHEN o_orderkey % {by} = {k} THEN '{v}'" for k, v in enumerate(values[1:], 1)) + f" ELSE '{values[0]}' END AS {name}"


SAMPLES_SQL = f"""
    SELECT o_orderkey AS sample_id, {{kind}} AS document_type, CAST(o_orderkey % 4 AS VARCHAR(20)) AS design_family,
        CAST(year(o_orderdate) {{div}} 5 * 5 AS VARCHAR(20)) AS year_band, o_orderpriority AS capture, o_orderstatus AS resolution,
        {_choice("issuer", 3, "central", "state", "district")}, {_choice("state", 5, "KL", "TN", "KA", "MH", "DL")}, {_choice("side", 7, "front", "back", "both", "single_page", "multi_page")},
        {_choice("blur", 11, "none", "mild", "severe")}, {_choice("glare", 13, "none", "mild", "severe")}, {_choice("rotation", 17, "upright", "minor_skew", "quarter_turn", "upside_down")},
        {_choice("crop", 19, "full", "tight", "partial")}, {_choice("perspective", 23, "flat", "mild", "severe")}, {_choice("compression", 29, "none", "mild", "severe")},
        {_choice("language", 31, "english", "english,hindi", "english,tamil,hindi")}, {_choice("script", 37, "latin", "latin,devanagari")},
        o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AS accepted, {_name("o_orderkey")} AS holder, 'ID' || CAST(o_orderkey AS VARCHAR(20)) AS number
    FROM {{orders}}
"""
RESULTS_SQL = f"""
    SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE {{kind}} END AS document_type,
        (o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 41 <> 0) OR o_orderkey % 43 = 0 AS accepted,
        CASE WHEN o_orderkey % 31 = 0 THEN replace({_name("o_orderkey")}, ' ', '-') WHEN o_orderkey % 47 = 0 THEN NULL ELSE {_name("o_orderkey")} END AS holder,
        'ID' || CAST(o_orderkey AS VARCHAR(20)) AS number
    FROM {{orders}} WHERE o_orderkey % 37 <> 0
"""
KIND_SQL = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'driving_licence' WHEN 3 THEN 'voter_id' WHEN 4 THEN 'nrega_job_card' ELSE 'npr_letter' END"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected records: two fields each, slices from the order's columns."""
    rows = spark.sql(SAMPLES_SQL.format(kind=KIND_SQL, div="div", orders="{orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return rows.withColumn("fields", F.create_map(F.lit("name"), "holder", F.lit("number"), "number")).drop("holder", "number")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to be judged: some of the wrong type, some with other punctuation, some missing."""
    rows = spark.sql(RESULTS_SQL.format(kind=KIND_SQL, orders="{orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return rows.withColumn("fields", F.create_map(F.lit("name"), "holder", F.lit("number"), "number")).drop("holder", "number")
