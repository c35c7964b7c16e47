"""Queries over the test tables, and the same questions in DuckDB's SQL.

``documents``, ``pages`` and ``conversations`` hold few of the things that the
rules look for, so ``LABELLED`` derives a corpus of labelled values from
``customer``, by SQL that both engines read.  Results are flat scalars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions.text import entropy, hmac64, iban_ok, luhn_ok
from .operators import block_rules, label_rules, line_rules, redact, report
from .operators.merge import merge
from .operators.words import COMMON_FAMILY, COMMON_GIVEN, COUNTRIES, FAMILY, GIVEN, HONORIFICS, STOP
from .plans.policy import Policy, RuleRef, custom, default_policy
from .plans.scan import kept_findings, raw_findings
from .sources.text import text_lines, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = b"audit-key"

LABELLED = """
SELECT c_custkey AS doc_id, CASE c_custkey % 18
  WHEN 0 THEN 'Account: ' || lpad(CAST(c_custkey AS string), 10, '9')
  WHEN 1 THEN 'SSN' || chr(10) || '123-45-' || lpad(CAST(c_custkey AS string), 6, '0')
  WHEN 2 THEN 'Passport No.' || chr(10) || chr(10) || 'A' || lpad(CAST(c_custkey AS string), 8, '0')
  WHEN 3 THEN 'DL: D' || lpad(CAST(c_custkey AS string), 7, '0') || ' issued'
  WHEN 4 THEN 'MRN: ' || lpad(CAST(c_custkey AS string), 7, '0') || chr(10) || 'Chart No' || chr(10) || 'AB-' || CAST(1000 + c_custkey AS string)
  WHEN 5 THEN 'Paid to' || chr(10) || 'ANJALI VENKATESHA NAIDU' || chr(10) || 'Total ' || CAST(c_custkey AS string)
  WHEN 6 THEN 'Card 4111 1111 1111 1111' || chr(10) || 'Exp 0' || CAST(1 + c_custkey % 9 AS string) || '/27 CVV ' || CAST(100 + c_custkey % 900 AS string)
  WHEN 7 THEN 'IBAN: GB29 NWBK 6016 1331 9268 ' || lpad(CAST(c_custkey % 100 AS string), 2, '0')
  WHEN 8 THEN 'ending ******' || CAST(1000 + c_custkey AS string) || ' and 12****34'
  WHEN 9 THEN 'Address' || chr(10) || CAST(c_custkey AS string) || ' Baker Street' || chr(10) || 'Springfield, IL 62704'
  WHEN 10 THEN 'DOB' || chr(10) || lpad(CAST(1 + c_custkey % 31 AS string), 2, '0') || '/' || lpad(CAST(1 + c_custkey % 12 AS string), 2, '0') || '/1992'
  WHEN 11 THEN 'key AKIA' || lpad(CAST(c_custkey AS string), 16, '0') || ' stored'
  WHEN 12 THEN 'at 37.4220 N, 122.' || lpad(CAST(c_custkey AS string), 4, '0') || ' W today'
  WHEN 13 THEN 'for Dr. Laura Bennett, MD and John A. Smith from New York'
  WHEN 14 THEN 'Diagnosis E11.' || CAST(c_custkey % 10 AS string) || chr(10) || 'Rx Metformin ' || CAST(c_custkey AS string) || 'mg'
  WHEN 15 THEN 'before' || chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'MIIE' || CAST(c_custkey AS string) || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10) || 'after'
  WHEN 16 THEN 'case INTERNAL-' || lpad(CAST(c_custkey AS string), 6, '0') || ' and call 555-123-' || lpad(CAST(c_custkey % 10000 AS string), 4, '0')
  ELSE 'mail a' || CAST(c_custkey AS string) || '@example.com or b@example.org' || chr(10) || 'Payee: John Smith' END AS text
FROM {customer}"""


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABELLED.format(customer="{customer}"), customer=_table(spark, sf_dir, "customer"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(_table(spark, sf_dir, "documents"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(labelled(spark, sf_dir))


def _flat(findings: DataFrame) -> DataFrame:
    return findings.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule_id", "matched_text", F.col("conf_rank").cast("long").alias("conf_rank"))


def _lines(table: str, key: str = "doc_id", text: str = "text") -> str:
    return f"""lines AS (SELECT doc_id, n - 1 AS line_no, trim(regexp_replace(raw, ' +', ' ', 'g'), ' ') AS line FROM (
      SELECT {key} AS doc_id, unnest(string_split({text}, chr(10))) AS raw, generate_subscripts(string_split({text}, chr(10)), 1) AS n FROM {table}) s
      WHERE trim(raw, ' ') <> '')"""


_DOCS = "WITH " + _lines("documents")
_CORPUS = f"WITH corpus AS ({LABELLED.format(customer='customer')}), " + _lines("corpus")
_LUHN = "(SELECT sum(CASE WHEN (length(d) - i) % 2 = 1 THEN 2 * CAST(substr(d, i, 1) AS int) - CASE WHEN CAST(substr(d, i, 1) AS int) > 4 THEN 9 ELSE 0 END ELSE CAST(substr(d, i, 1) AS int) END) FROM range(1, length(d) + 1) t(i)) % 10 = 0"


def _hits(source: str, rule: str, expression: str, rank: str, where: str = "TRUE") -> str:
    """Matches of a line-local pattern that needs no look-around."""
    return f"{source} SELECT doc_id, line_no, '{rule}' AS rule_id, m AS matched_text, CAST({rank} AS bigint) AS conf_rank FROM (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, '{expression}')) AS m FROM lines) h WHERE {where}"


# A card number's neighbours may not be digits: every other character is doubled, and a match uses up one copy on each side.
_CARDS = """, cards AS (SELECT doc_id, line_no, replace(replace(m, '  ', ' '), '--', '-') AS m FROM (
  SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])((?:[0-9](?:  |--)?){13,19})(?:$|[^0-9])', 1)) AS m FROM lines) x),
  valid AS (SELECT * FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM cards) y WHERE length(d) BETWEEN 13 AND 19 AND """ + _LUHN + ")"


@query(_DOCS + " SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS bigint) AS n_chars FROM lines GROUP BY doc_id")
def lines_scan(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line_text")).cast("long").alias("n_chars"))


@query(_CORPUS + """, t AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS n FROM lines),
  p AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t)
  SELECT doc_id, line_no, CAST(n - 1 AS bigint) AS token_no, token, CAST(10 + 12 * s AS bigint) AS x, CAST(10 + 30 * line_no AS bigint) AS y, CAST(12 * length(token) AS bigint) AS w FROM p""")
def tokens_layout(spark, sf_dir):
    t = tokens(_labelled(spark, sf_dir))
    return t.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("token_no").cast("long").alias("token_no"), "token", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in "xyw"])


@query(_CORPUS + " SELECT doc_id, line_no, CAST(10 AS bigint) AS x, 10 + 30 * line_no AS y, CAST(12 * length(line) AS bigint) AS w, CAST(24 AS bigint) AS h FROM lines")
def line_bbox(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), *[F.col(f"bbox.{c}").cast("long").alias(c) for c in "xywh"])


def _line_query(name: str, rule: str, oracle: str | None, source: Callable) -> None:
    def run(spark, sf_dir):
        return _flat(line_rules.line_findings(source(spark, sf_dir), [line_rules.RULES[rule]]))

    run.__name__ = name
    query(oracle)(run)


_line_query("co_001_email", "CO-001", _hits(_DOCS, "CO-001", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b", "2"), _documents)
_line_query("co_002_phone", "CO-002", None, _documents)
_line_query("co_002_phone_labelled", "CO-002", _hits(_CORPUS, "CO-002", r"[0-9]{3}-[0-9]{3}-[0-9]{4}", "1") + " UNION ALL SELECT doc_id, line_no, 'CO-002', m, 1 FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?:^|[^0-9/])([0-9]{10,13})$', 1)) AS m FROM lines) x WHERE length(m) BETWEEN 10 AND 13", _labelled)
_line_query("fi_001_pan", "FI-001", _DOCS + _CARDS + " SELECT doc_id, line_no, 'FI-001' AS rule_id, m AS matched_text, CAST(2 AS bigint) AS conf_rank FROM valid", _documents)
_line_query("fi_002_iban", "FI-002", _CORPUS + """, c AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}\\b')) AS m FROM lines),
  t AS (SELECT *, replace(m, ' ', '') AS s FROM c), u AS (SELECT *, list_reduce(list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS varchar) ELSE c END), lambda a, b: a || b) AS n FROM t)
  SELECT doc_id, line_no, 'FI-002' AS rule_id, m AS matched_text, CAST(2 AS bigint) AS conf_rank FROM u WHERE length(s) BETWEEN 15 AND 34 AND CAST(n AS hugeint) % 97 = 1""", _labelled)
_line_query("fi_005_masked", "FI-005", _hits(_CORPUS, "FI-005", r"(?:[*X•·●][\s-]{0,2}){2,}(?:[0-9][\s-]?){2,}|(?:[0-9][\s-]?){2,}(?:[*X•·●][\s-]{0,2}){2,}(?:[0-9][\s-]?){2,}", "2"), _labelled)
_line_query("he_002_icd10", "HE-002", _hits(_CORPUS, "HE-002", r"\b[A-TV-Z][0-9]{2}(?:\.[0-9A-TV-Z]{1,4})?\b", "1"), _labelled)
_line_query("he_003_prescription", "HE-003", _hits(_CORPUS, "HE-003", r"(?i)\b(?:Rx|Prescription|Sig)\b.*", "1"), _labelled)
_ENTROPY = "(SELECT -sum(c * 1.0 / length(m) * log2(c * 1.0 / length(m))) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(m, '')) AS ch) q GROUP BY ch) w)"
_line_query("cr_001_secret", "CR-001", _DOCS + r""", c AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(replace(regexp_replace(line, '([^\p{L}\p{N}_-])', '\1\1', 'g'), '--', '-'), '(?:^|[^\p{L}\p{N}_])([A-Za-z0-9_\-]{20,})(?:$|[^\p{L}\p{N}_])', 1)) AS m FROM lines),
  e AS (SELECT *, """ + _ENTROPY + r""" AS bits FROM c WHERE NOT regexp_full_match(m, '[a-z]+|[A-Z]+|[A-Z][a-z]+') AND NOT (regexp_full_match(m, '[0-9A-Fa-f]+') AND length(m) < 32) AND NOT regexp_full_match(m, '[vV]?[0-9]+([_.\-][0-9]+)*'))
  SELECT doc_id, line_no, 'CR-001' AS rule_id, m AS matched_text, CAST(CASE WHEN bits >= 4.0 OR regexp_matches(line, '(?i)token|secret|key|bearer|authorization') THEN 2 ELSE 1 END AS bigint) AS conf_rank FROM e WHERE bits >= 3.5""", _documents)
_line_query("cr_003_cloud_key", "CR-003", _hits(_CORPUS, "CR-003", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "2"), _labelled)
_line_query("lo_001_gps", "LO-001", _hits(_CORPUS, "LO-001", r"37\.4220 N, 122\.[0-9]{4,} W", "2"), _labelled)


@query(_hits(_CORPUS, "CU-001", "INTERNAL-[0-9]{6}", "2"))
def cu_001_custom(spark, sf_dir):
    rule = line_rules.custom_rule(*custom(RuleRef("CU-001", overrides={"pattern": "INTERNAL-[0-9]{6}", "confidence": "high"}), spark))
    return _flat(line_rules.line_findings(_labelled(spark, sf_dir), [rule]))


def _label_oracle(rule: str, label: str, value: str, lines: int, rank: int, keep: str, once: bool, source: str = _CORPUS) -> str:
    """First value on the label's line, behind the label, or on the next few lines."""
    per = "" if once else ", line_no"
    # Word ends as letters of any alphabet have them; the ASCII boundary of RE2 would not do.
    word = label.removeprefix(r"(?i:\b").removesuffix(r"\b)")
    whole = rf"^(?:.*?[^\p{{L}}\p{{N}}_])??(?i:{word})((?:[^\p{{L}}\p{{N}}_].*)?)$"
    return f"""{source}, l AS (SELECT doc_id, line_no AS label_line, regexp_extract(line, '{whole}', 1) AS tail FROM lines WHERE regexp_matches(line, '{whole}')),
    c AS (SELECT l.doc_id, label_line, c.line_no, CASE WHEN c.line_no = label_line THEN tail ELSE line END AS part FROM l JOIN lines c ON c.doc_id = l.doc_id AND c.line_no BETWEEN label_line AND label_line + {lines}),
    m AS (SELECT *, unnest(regexp_extract_all(part, '{value}')) AS m, generate_subscripts(regexp_extract_all(part, '{value}'), 1) AS k FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_line{per} ORDER BY line_no, k) AS r FROM m WHERE {keep})
    SELECT doc_id, line_no, '{rule}' AS rule_id, m AS matched_text, CAST({rank} AS bigint) AS conf_rank FROM f WHERE r = 1"""


_SIX = "length(regexp_replace(m, '[^0-9]', '', 'g')) >= 6"


def _label_query(name: str, rule: str, oracle: str) -> None:
    def run(spark, sf_dir):
        return _flat(label_rules.label_findings(_labelled(spark, sf_dir), [label_rules.RULES[rule]]))

    run.__name__ = name
    query(oracle)(run)


_LABEL_ARGUMENTS = {
    "id_003_government_id": ("ID-003", r"(?i:\b(?:SSN|Social Security|National ID|NIN|Aadhaar|PAN|Tax ID|TIN|EIN)\b)", r"[0-9][0-9\s\-]{5,19}", 2, 2, _SIX, True),
    "id_004_passport": ("ID-004", r"(?i:\bPassport(?:\s*(?:No|Number))?\b)", r"\b(?:[A-Z][0-9]{8}|[A-Z]{2}[0-9]{7})\b", 2, 2, "TRUE", True),
    "id_005_licence": ("ID-005", r"(?i:\b(?:DL|DLN|Driver|License|Licence)\b)", r"\b[A-Z0-9]{6,14}\b", 2, 1, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')", False),
    "he_001_mrn": ("HE-001", r"(?i:\b(?:MRN|Medical Record|Patient ID|Chart No)\b)", r"\b[A-Z0-9\-]{4,16}\b", 4, 2, "length(regexp_replace(m, '[^0-9]', '', 'g')) >= 3", False),
    "fi_003_account": ("FI-003", r"(?i:\b(?:Account|A/C|Acct(?:\s*No\.?)?)\b)", r"[0-9][0-9\s\-]{5,19}", 4, 1, _SIX + " AND NOT (length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND (SELECT " + _LUHN + " FROM (SELECT regexp_replace(m, '[^0-9]', '', 'g') AS d) z))", False),
}
for _name, _arguments in _LABEL_ARGUMENTS.items():
    _label_query(_name, _arguments[0], _label_oracle(*_arguments))


@query(" UNION ALL ".join(f"SELECT * FROM ({_label_oracle(*a, _DOCS)}) r{i}" for i, a in enumerate(_LABEL_ARGUMENTS.values())))
def label_join_range(spark, sf_dir):
    """All label rules through their one join, over documents."""
    return _flat(label_rules.label_findings(_documents(spark, sf_dir), list(label_rules.RULES.values())))


@query(_CORPUS + r""", l AS (SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '(?i)\b(?:Paid\s+to|Pay\s+to|Payee|Beneficiary|Recipient|Receiver|Sender|Sent\s+to|Transferred\s+to|Account\s+(?:Holder|Name))\b')),
  m AS (SELECT c.doc_id, l.line_no AS label_line, c.line_no, regexp_extract(line, '^(?:Payee: )?([A-Z][A-Za-z''-]+(?: [A-Z][A-Za-z''-]+){1,4})$', 1) AS m FROM l JOIN lines c ON c.doc_id = l.doc_id AND c.line_no BETWEEN l.line_no AND l.line_no + 4),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_line ORDER BY line_no) AS r FROM m WHERE m <> '')
  SELECT doc_id, line_no, 'ID-008' AS rule_id, m AS matched_text, CAST(2 AS bigint) AS conf_rank FROM f WHERE r = 1""")
def id_008_payee(spark, sf_dir):
    return _flat(label_rules.payment_names(_labelled(spark, sf_dir)))


@query(_CORPUS + r""", w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?:Laura Bennett,|John A\. Smith|John Smith)')) AS m FROM lines)
  SELECT doc_id, line_no, 'ID-001' AS rule_id, m AS matched_text, CAST(2 AS bigint) AS conf_rank FROM w""")
def id_001_names(spark, sf_dir):
    return _flat(block_rules.full_names(_labelled(spark, sf_dir)))


@query(_CORPUS + r""", d AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\b(?:0?[1-9]|[12][0-9]|3[01])[/\-.\s](?:0?[1-9]|1[0-2])[/\-.\s](?:19|20)[0-9]{2}\b')) AS m FROM lines)
  SELECT doc_id, line_no, 'ID-002' AS rule_id, m AS matched_text, CAST(CASE WHEN EXISTS (SELECT 1 FROM lines b WHERE b.doc_id = d.doc_id AND d.line_no - b.line_no IN (0, 1) AND regexp_matches(b.line, '(?i)\b(?:DOB|Date of Birth|D\.O\.B\.|Born)\b')) THEN 2 ELSE 1 END AS bigint) AS conf_rank
  FROM d WHERE try_strptime(m, '%d/%m/%Y') IS NOT NULL OR try_strptime(m, '%m/%d/%Y') IS NOT NULL""")
def id_002_birth(spark, sf_dir):
    return _flat(block_rules.birth_dates(_labelled(spark, sf_dir)))


@query(_CORPUS + r""", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM lines),
  s AS (SELECT n.doc_id, n.line_no, n.line, x.line AS second, p.line AS above FROM n LEFT JOIN n x ON x.doc_id = n.doc_id AND x.o = n.o + 1 LEFT JOIN n p ON p.doc_id = n.doc_id AND p.o = n.o - 1
    WHERE regexp_matches(n.line, '(?i)^[0-9]{1,5}[A-Z]?\s+[A-Z][A-Z0-9_''.\-]+(\s+[A-Z][A-Z0-9_''.\-]+){0,3}\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Ln|Lane|Dr|Drive|Way|Ct|Court|Pl|Place|Sq|Square)\b') OR regexp_matches(coalesce(p.line, ''), '(?i)\b(Address|Addr|Mailing)\b'))
  SELECT doc_id, line_no, 'CO-003' AS rule_id, line || ' | ' || second AS matched_text, CAST(2 AS bigint) AS conf_rank FROM s WHERE regexp_matches(second, '^[A-Z][A-Za-z0-9_''.\- ]+,?\s+[A-Z]{2}\s+[0-9]{5}')""")
def co_003_address(spark, sf_dir):
    return _flat(block_rules.addresses(_labelled(spark, sf_dir)))


@query(_CORPUS + r""", b AS (SELECT b.doc_id, b.line_no, min(e.line_no) AS last FROM lines b LEFT JOIN lines e ON e.doc_id = b.doc_id AND e.line_no >= b.line_no AND e.line = '-----END RSA PRIVATE KEY-----' WHERE b.line = '-----BEGIN RSA PRIVATE KEY-----' GROUP BY ALL)
  SELECT b.doc_id, b.line_no, 'CR-002' AS rule_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS matched_text, CAST(2 AS bigint) AS conf_rank FROM b JOIN lines l ON l.doc_id = b.doc_id AND l.line_no BETWEEN b.line_no AND b.last GROUP BY b.doc_id, b.line_no""")
def cr_002_key_block(spark, sf_dir):
    return _flat(block_rules.key_blocks(_labelled(spark, sf_dir)))


@query(_CORPUS + r""", c AS (SELECT DISTINCT doc_id, line_no FROM lines WHERE line LIKE '%4111 1111 1111 1111%'),
  x AS (SELECT l.* FROM lines l JOIN c ON c.doc_id = l.doc_id AND abs(c.line_no - l.line_no) <= 7)
  SELECT doc_id, line_no, 'FI-004' AS rule_id, unnest(regexp_extract_all(line, '\b(?:0[1-9]|1[0-2])[/\-](?:[0-9]{2}|[0-9]{4})\b')) AS matched_text, CAST(2 AS bigint) AS conf_rank FROM x
  UNION ALL SELECT doc_id, line_no, 'FI-004', unnest(regexp_extract_all(line, '\b[0-9]{3,4}\b')), 2 FROM x WHERE regexp_matches(line, '(?i)\b(CVV|CVC|Sec(?:urity)?\s*Code)\b')""")
def fi_004_card_details(spark, sf_dir):
    lines = _labelled(spark, sf_dir)
    return _flat(block_rules.card_details(lines, line_rules.line_findings(lines, [line_rules.RULES["FI-001"]])))


@query(f"SELECT o_orderkey, {_LUHN.replace('d)', 'd)')} AS ok FROM (SELECT o_orderkey, '411111' || lpad(CAST(o_orderkey AS varchar), 10, '0') AS d FROM orders) s")
def pan_luhn(spark, sf_dir):
    d = F.concat(F.lit("411111"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", luhn_ok(d).alias("ok"))


@query("SELECT o_orderkey, (CAST(lpad(CAST(o_orderkey AS varchar), 16, '7') || '161129' AS hugeint)) % 97 = 1 AS ok FROM orders")
def iban_mod97(spark, sf_dir):
    text = F.concat(F.lit("GB29"), F.lpad(F.col("o_orderkey").cast("string"), 16, "7"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", iban_ok(text).alias("ok"))


@query(f"SELECT p_partkey, CAST(round({_ENTROPY} * 1000) AS bigint) AS millibits FROM (SELECT p_partkey, p_name AS m FROM part) s ORDER BY millibits DESC, p_partkey LIMIT 50")
def entropy_topk(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(entropy(F.col("p_name")) * 1000).cast("long").alias("millibits")).orderBy(F.col("millibits").desc(), "p_partkey").limit(50)


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@query(_CORPUS + f", t AS (SELECT doc_id, unnest(string_split(line, ' ')) AS token FROM lines) SELECT doc_id, token FROM t WHERE lower(token) IN {_in([*COMMON_GIVEN, *COMMON_FAMILY])}")
def dict_semi_join(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in {*GIVEN, *FAMILY}], "word string")
    t = tokens(_labelled(spark, sf_dir))
    return t.join(F.broadcast(words), F.lower("token") == F.col("word"), "left_semi").select("doc_id", "token")


@query(_CORPUS + f", t AS (SELECT doc_id, unnest(string_split(line, ' ')) AS token FROM lines) SELECT doc_id, token FROM t WHERE regexp_full_match(token, '[A-Z][a-zA-Z''-]+') AND lower(token) NOT IN {_in([*STOP, *HONORIFICS, *COUNTRIES])}")
def stopword_anti_join(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in {*STOP, *HONORIFICS, *COUNTRIES}], "word string")
    t = tokens(_labelled(spark, sf_dir)).where(F.col("token").rlike(r"^[A-Z][a-zA-Z'\-]+$"))
    return t.join(F.broadcast(words), F.lower("token") == F.col("word"), "left_anti").select("doc_id", "token")


def _policy(*ids: str, **options) -> Policy:
    return Policy("part", detectors=tuple(RuleRef(i, threshold=t) for i, t in (x.split("=") if "=" in x else (x, "low") for x in ids)), **options)


_THREE = _policy("CO-001", "FI-001", "CR-001=medium")
_UNION = "SELECT * FROM (" + ORACLES["co_001_email"] + ") a UNION ALL SELECT * FROM (" + ORACLES["fi_001_pan"] + ") b UNION ALL SELECT * FROM (" + ORACLES["cr_001_secret"] + ") c"


@query(_UNION)
def findings_union(spark, sf_dir):
    return _flat(raw_findings(_documents(spark, sf_dir), _THREE))


@query("SELECT doc_id, count(*) AS n, count(DISTINCT rule_id) AS rules FROM (" + _UNION + ") u GROUP BY doc_id")
def findings_per_document(spark, sf_dir):
    return raw_findings(_documents(spark, sf_dir), _THREE).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


def _boxes(spark, sf_dir):
    """Findings made from line items: 24 high, in rows 30 apart."""
    b = g.box(F.col("l_extendedprice") % 900, F.lit(10) + 30 * (F.col("l_linenumber") % 3), F.lit(20) + F.col("l_quantity") * 3, F.lit(24))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("b").alias("block_id"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("CO-00"), (F.col("l_linenumber") % 3 + 1).cast("string")).alias("rule_id"), F.lit("CONTACT").alias("category"), b.alias("bbox"), (F.col("l_suppkey") % 3).cast("tinyint").alias("conf_rank"), F.lit("x").alias("matched_text"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end"), F.array().cast("array<string>").alias("merged_from"))


_BOXES = "SELECT l_orderkey AS doc_id, CAST(trunc(l_extendedprice % 900) AS bigint) AS x, CAST(10 + 30 * (l_linenumber % 3) AS bigint) AS y, CAST(20 + l_quantity * 3 AS bigint) AS w, CAST(l_suppkey % 3 AS bigint) AS r FROM lineitem"


@query(f"""WITH b AS ({_BOXES}), o AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id, y ORDER BY x, w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY doc_id, y ORDER BY x, w, r) AS k FROM b),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x > reach + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, y ORDER BY k) AS island FROM o)
  SELECT doc_id, y, min(x) AS x, max(x + w) - min(x) AS w, max(r) AS conf_rank FROM i GROUP BY doc_id, y, island""")
def merge_islands(spark, sf_dir):
    m = merge(_boxes(spark, sf_dir))
    return m.select("doc_id", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in "yxw"], F.col("conf_rank").cast("long").alias("conf_rank"))


@query(f"WITH b AS ({_BOXES}) SELECT doc_id, x, y, w, w * 24 > 0.2 * 15000 AS oversized, CASE WHEN w * 24 > 0.2 * 15000 THEN 0 ELSE r END AS conf_rank FROM b")
def guard_oversized(spark, sf_dir):
    """Pages of 150 by 100: boxes wider than 125 are oversized, whatever their rank."""
    pages = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(150).alias("width"), F.lit(100).alias("height"))
    return report.guard_oversized(_boxes(spark, sf_dir), pages).select("doc_id", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in "xyw"], "oversized", F.col("conf_rank").cast("long").alias("conf_rank"))


def _threshold_query(posture: str, least: int) -> None:
    def run(spark, sf_dir):
        ranks = _policy("CO-001", "CO-002=medium", "CO-003=high", posture=posture).ranks()
        return report.apply_thresholds(_boxes(spark, sf_dir), ranks).groupBy("rule_id", F.col("conf_rank").cast("long").alias("conf_rank")).agg(F.count("*").alias("n"))

    run.__name__ = f"threshold_{posture}"
    query(f"SELECT 'CO-00' || CAST(l_linenumber % 3 + 1 AS varchar) AS rule_id, CAST(l_suppkey % 3 AS bigint) AS conf_rank, count(*) AS n FROM lineitem WHERE l_suppkey % 3 >= least(2, l_linenumber % 3 + {least}) GROUP BY 1, 2")(run)


_threshold_query("strict", 0)
_threshold_query("lenient", 1)


@query("SELECT CASE rule_id WHEN 'CO-001' THEN 'CONTACT' WHEN 'FI-001' THEN 'FINANCIAL' ELSE 'CREDENTIALS' END AS category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (" + _UNION + ") u GROUP BY 1")
def stats_by_category(spark, sf_dir):
    return raw_findings(_documents(spark, sf_dir), _THREE).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("SELECT category, rule_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT *, CASE rule_id WHEN 'CO-001' THEN 'CONTACT' WHEN 'FI-001' THEN 'FINANCIAL' ELSE 'CREDENTIALS' END AS category FROM (" + _UNION + ") u) v GROUP BY ROLLUP (category, rule_id)")
def stats_rollup(spark, sf_dir):
    return report.by_category_and_rule(raw_findings(_documents(spark, sf_dir), _THREE))


@query(f"WITH b AS (SELECT l_orderkey AS doc_id, 'CO-00' || CAST(l_linenumber % 3 + 1 AS varchar) AS rule_id, CAST(trunc(l_extendedprice % 900) AS bigint) AS x, CAST(10 + 30 * (l_linenumber % 3) AS bigint) AS y, CAST(20 + l_quantity * 3 AS bigint) AS w FROM lineitem) SELECT doc_id, 'f-' || rule_id || '-' || CAST(row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY y, x, w) - 1 AS varchar) AS finding_id, x, y, w FROM b")
def finding_numbering(spark, sf_dir):
    return report.numbered(_boxes(spark, sf_dir)).select("doc_id", "finding_id", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in "xyw"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (" + _UNION + ") u)")
def warnings_no_findings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lines = text_lines(docs)
    guarded, kept = kept_findings(lines, None, _THREE)
    return report.warnings(docs, lines, guarded, kept).where("code = 'W_NO_FINDINGS'").select("doc_id")


def _hmac_sql(text: str) -> str:
    inner, outer = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text})))), 1, 16)"


@query("SELECT doc_id, line_no, " + _hmac_sql("matched_text") + " AS hash FROM (" + ORACLES["co_001_email"] + ") e")
def hmac_audit_hash(spark, sf_dir):
    found = line_rules.line_findings(_documents(spark, sf_dir), [line_rules.RULES["CO-001"]])
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), hmac64(F.col("matched_text"), KEY).alias("hash"))


_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b"


def _mask_query(style: str, oracle: str) -> None:
    def run(spark, sf_dir):
        lines = _labelled(spark, sf_dir)
        masked = redact.masked_lines(lines, line_rules.line_findings(lines, [line_rules.RULES["CO-001"]]), style)
        return redact.masked_texts(masked)

    run.__name__ = f"redact_text_{style}"
    query(oracle)(run)


_mask_query("label", _CORPUS + f" SELECT doc_id, string_agg(regexp_replace(line, '{_EMAIL}', '[CONTACT]', 'g'), chr(10) ORDER BY line_no) AS redacted FROM lines GROUP BY doc_id")
_mask_query("block", _CORPUS + f", p AS (SELECT doc_id, line_no, line, string_split_regex(line, '{_EMAIL}') AS g, list_transform(regexp_extract_all(line, '{_EMAIL}'), lambda e: repeat('█', length(e))) AS m FROM lines), q AS (SELECT doc_id, line_no, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(m[i], '')), '') AS r FROM p) SELECT doc_id, string_agg(r, chr(10) ORDER BY line_no) AS redacted FROM q GROUP BY doc_id")


def _other_text(name: str, table: str, key: str, text: str) -> None:
    """An extension: the same rules over other tables."""

    def run(spark, sf_dir):
        lines = text_lines(_table(spark, sf_dir, table), key, text)
        return _flat(line_rules.line_findings(lines, [line_rules.RULES["CO-001"], line_rules.RULES["FI-001"]]))

    run.__name__ = name
    source = "WITH " + _lines(table, key, text)
    query(_hits(source, "CO-001", _EMAIL, "2") + " UNION ALL SELECT * FROM (" + source + _CARDS + " SELECT doc_id, line_no, 'FI-001', m, 2 FROM valid) z")(run)


_other_text("pages_html_pii", "pages", "page_id", "html")


@query("WITH " + _lines("(SELECT conv_id * 1000 + turn AS k, text FROM conversations)", "k") + f", f AS (SELECT doc_id FROM lines WHERE regexp_matches(line, '{_EMAIL}')) SELECT role, count(*) AS turns, count(f.doc_id) AS with_email FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM f) f ON f.doc_id = conv_id * 1000 + turn GROUP BY role")
def conversations_pii_by_role(spark, sf_dir):
    """An extension: turns of each role that hold an e-mail address."""
    turns = _table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    found = line_rules.line_findings(text_lines(turns), [line_rules.RULES["CO-001"]]).select(F.col("doc_id").alias("hit")).distinct()
    return turns.join(found, F.col("doc_id") == F.col("hit"), "left").groupBy("role").agg(F.count("*").alias("turns"), F.count("hit").alias("with_email"))


@query("SELECT quality, toxic, count(*) AS n, count(u.doc_id) AS with_findings FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM (" + _UNION + ") x) u ON u.doc_id = l.doc_id GROUP BY quality, toxic")
def labels_join_pii_rate(spark, sf_dir):
    """An extension: labelled documents with findings."""
    found = raw_findings(_documents(spark, sf_dir), _THREE).select(F.col("doc_id").alias("hit")).distinct()
    labels = _table(spark, sf_dir, "labels")
    return labels.join(found, F.col("doc_id") == F.col("hit"), "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count("hit").alias("with_findings"))


@query(f"WITH b AS ({_BOXES}) SELECT doc_id, x, y, w, CAST(round_even(x * 0.5, 0) AS bigint) AS px, CAST(round_even(y * 0.25, 0) AS bigint) AS py, greatest(CAST(round_even((x + w) * 0.5, 0) AS bigint) - CAST(round_even(x * 0.5, 0) AS bigint), 1) AS pw, greatest(CAST(round_even((y + 24) * 0.25, 0) AS bigint) - CAST(round_even(y * 0.25, 0) AS bigint), 1) AS ph FROM b")
def affine_project(spark, sf_dir):
    back = g.inverse(g.scale(F.lit(2.0), F.lit(4.0)))
    b = _boxes(spark, sf_dir).select("doc_id", "bbox", g.project(back, F.col("bbox")).alias("p"))
    return b.select("doc_id", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in "xyw"], *[F.col(f"p.{c}").cast("long").alias(f"p{c}") for c in "xywh"])


@query(None)
def default_policy_findings(spark, sf_dir):
    """The flagship: the default policy over documents, merged, guarded and kept by threshold."""
    docs = _table(spark, sf_dir, "documents")
    return _flat(kept_findings(text_lines(docs), None, default_policy())[1])


@query(None)
def labelled_default_policy(spark, sf_dir):
    """The same over the labelled corpus, where every rule finds something."""
    docs = labelled(spark, sf_dir)
    return _flat(kept_findings(text_lines(docs), None, default_policy().with_rules(RuleRef("HE-002"), RuleRef("HE-003")))[1])
