"""Queries of the regulatory rules: roles are bound to columns of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import ordering as D
from tidewell.operators import regulatory as G
from tidewell.plans.registry import query, read

# role -> expression over a table, the same in both engines
LINE = {
    "amount": "l_extendedprice - 50000", "loan": "l_extendedprice * l_discount", "value": "l_extendedprice * l_tax", "repayment": "l_discount", "balance": "l_tax", "tier1": "l_discount", "exposure": "l_quantity",
    "hqla": "l_extendedprice", "outflows": "l_quantity * 1000", "available": "l_extendedprice", "required": "l_quantity * 1500", "revenue": "l_extendedprice - 60000", "credit_memo": "l_returnflag = 'R'", "rwa": "l_tax",
    "position": "l_quantity - 25", "max_long": "20", "max_short": "15", "margin": "l_discount", "maintenance": "l_tax + 0.01", "filing": "l_quantity", "filing_min": "2", "filing_max": "48", "level3": "l_discount", "total_assets": "l_tax + 0.1",
    "vital": "l_quantity * 4", "vital_min": "40", "vital_max": "180", "age": "l_quantity * 4 - 10", "phi": "CASE WHEN l_orderkey % 3 = 0 THEN 1 END", "consent": "l_returnflag = 'A'", "encrypted": "l_linestatus = 'F'", "pii": "CASE WHEN l_orderkey % 4 = 0 THEN 1 END",
    "modified_at": "CASE WHEN l_orderkey % 9 > 0 THEN l_shipdate END", "modified_by": "l_suppkey", "erasure_requested": "l_orderkey % 50 = 0", "breach": "l_orderkey % 500 = 0", "price": "l_extendedprice", "vwap": "50000", "is_algo": "l_returnflag = 'N'",
    "algo_id": "CASE WHEN l_orderkey % 2 = 0 THEN 1 END", "emissions": "l_extendedprice - 5000", "esg_score": "l_quantity", "provider": "CASE WHEN l_linestatus = 'F' THEN 'FTSE' ELSE 'other' END", "own_funds": "l_extendedprice", "scr": "40000",
    "claims": "l_quantity", "expenses": "5", "premium": "l_quantity - 1", "claim_open": "l_linestatus = 'O'", "claim_days": "l_quantity * 5", "ceded": "l_discount", "gross": "l_tax", "csm": "l_discount - 0.01", "sca": "CASE WHEN l_orderkey % 5 > 0 THEN 1 END",
    "refund_days": "l_quantity", "returned": "l_returnflag = 'R'", "return_reason": "CASE WHEN l_orderkey % 6 > 0 THEN 'x' END", "owner": "CASE WHEN l_orderkey % 7 > 0 THEN 1 END", "disclosed": "l_orderkey % 3 = 0", "state": "CASE WHEN l_returnflag = 'A' THEN 'CA' ELSE 'NY' END",
    "investor_category": "CASE WHEN l_returnflag = 'A' THEN 'Retail' ELSE l_returnflag END", "data_class": "CASE WHEN l_linestatus = 'F' THEN 'public' ELSE 'open' END", "icd_code": "CASE WHEN l_orderkey % 2 = 0 THEN 'A12.3' ELSE 'bad' END", "pan": "CASE WHEN l_orderkey % 2 = 0 THEN 'XXXX-XXXX-XXXX-1234' ELSE '1234' END",
}


def oracle(rule: G.Rule, bindings: dict[str, str], table: str) -> str:
    import re

    text = rule.predicate
    for role in sorted(rule.roles, key=len, reverse=True):
        text = re.sub(rf"(?<![\w'.]){role}(?![\w'])", f"({bindings[role]})", text)
    text = re.sub(r"try_divide\((.*?), (\([^()]*(?:\([^()]*\)[^()]*)*\))\)", r"((\1) / nullif(\2::DOUBLE, 0))", text)
    text = re.sub(r"\(([^()]*(?:\([^()]*\))?[^()]*)\) RLIKE '([^']*)'", lambda m: f"regexp_matches(({m[1]}), '{m[2].replace(chr(92) * 2, chr(92))}')", text)
    return f"SELECT '{rule.name}' AS rule, '{','.join(rule.roles)}' AS \"column\", '{rule.severity}' AS severity, count(*) FILTER (WHERE {text}) AS n_bad, '{rule.domain}' AS domain FROM {table}"


def register(rule: G.Rule, bindings: dict[str, str], table: str) -> None:
    sql = f"SELECT * FROM ({oracle(rule, bindings, table)}) WHERE n_bad > 0"

    def run(spark, sf):
        return G.evaluate(read(spark, sf, table), bindings, [rule])

    query(sql, rule.name)(run)


for _r in G.RULES:
    if all(x in LINE for x in _r.roles):
        register(_r, LINE, "lineitem")
_BY_NAME = {r.name: r for r in G.RULES}
DOCS = {"text": "text", "anonymous": "doc_id % 2 = 0"}
register(_BY_NAME["reg_phi_presence"], DOCS, "documents")
register(_BY_NAME["reg_deidentification"], DOCS, "documents")


@query("SELECT 'reg_gdpr_residency' AS rule, 'region,allowed_regions' AS \"column\", 'CRITICAL' AS severity, count(*) AS n_bad, 'gdpr' AS domain FROM region WHERE r_name NOT IN ('EUROPE', 'ASIA')")
def reg_gdpr_residency(spark, sf):
    return G.evaluate(read(spark, sf, "region"), {"region": "r_name", "allowed_regions": "array('EUROPE', 'ASIA')"})


@query("SELECT * FROM (" + " UNION ALL ".join(oracle(r, LINE, "lineitem") for r in G.RULES if all(x in LINE for x in r.roles)) + ") WHERE n_bad > 0")
def regulatory_engine(spark, sf):
    return G.evaluate(read(spark, sf, "lineitem"), LINE)


@query("SELECT 'reg_carbon_spikes' AS rule, 'v' AS \"column\", 'WARNING' AS severity, count(*) AS n_bad FROM events WHERE value * value > 10 * (SELECT median(value * value) FROM events) HAVING count(*) > 0")
def reg_carbon_spikes(spark, sf):
    return G.reg_carbon_spikes(read(spark, sf, "events").select(F.expr("value * value").alias("v")), "v")


@query("SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")
def reg_velocity(spark, sf):
    return G.reg_velocity(read(spark, sf, "events"), "user_id", "ts", 5)


@query("SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS share FROM orders GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM orders)::DOUBLE > 0.3")
def reg_currency_concentration(spark, sf):
    return G.reg_currency_concentration(read(spark, sf, "orders"), "o_orderstatus", 0.3)


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS imbalance FROM lineitem GROUP BY 1 HAVING abs(imbalance) > 0.01")
def reg_double_entry(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("a", F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")))
    return G.reg_double_entry(df, "l_orderkey", "a")


@query("SELECT avg((l_returnflag = 'R')::INT) AS rate FROM lineitem HAVING avg((l_returnflag = 'R')::INT) > 0.01")
def reg_chargeback(spark, sf):
    return G.reg_chargeback(read(spark, sf, "lineitem"), F.col("l_returnflag") == "R")


@query("""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{13,19}\\b')) AS pan FROM documents), d AS (SELECT doc_id, pan, list_sum(list_transform(range(1, length(pan) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(pan, length(pan) - i + 1, 1)::INT
  WHEN substr(pan, length(pan) - i + 1, 1)::INT > 4 THEN substr(pan, length(pan) - i + 1, 1)::INT * 2 - 9 ELSE substr(pan, length(pan) - i + 1, 1)::INT * 2 END)) AS s FROM n)
SELECT doc_id, count(*) AS n_pan FROM d WHERE s % 10 = 0 GROUP BY 1""")
def reg_pan_detection(spark, sf):
    return G.reg_pan_detection(read(spark, sf, "documents"), "doc_id", "text")


def catalog(spark, sf):
    return {t: read(spark, sf, t) for t in ("customer", "supplier", "part", "orders", "lineitem", "events")}


TOKENS = "SELECT DISTINCT table_name AS \"table\", column_name AS \"column\", unnest(string_split(lower(column_name), '_')) AS token FROM duckdb_columns() WHERE table_name IN ('customer', 'supplier', 'part', 'orders', 'lineitem', 'events')"
_TRIGGERS = ", ".join(f"('{r}', '{s}', '{t}')" for r, s, ts, _ in G.PRESENCE for t in ts)
_NEEDS = ", ".join(f"('{r}', '{t}')" for r, _, _, ts in G.PRESENCE for t in ts)


@query(f"""WITH k AS ({TOKENS}), o AS (SELECT DISTINCT "table", rule, severity FROM k JOIN (VALUES {_TRIGGERS}) v(rule, severity, token) USING (token)), m AS (SELECT DISTINCT "table", rule FROM k JOIN (VALUES {_NEEDS}) v(rule, token) USING (token))
SELECT o.* FROM o ANTI JOIN m USING ("table", rule)""")
def reg_required_columns(spark, sf):
    return G.reg_required_columns(G.column_tokens(catalog(spark, sf)))


@query(f"WITH c AS (SELECT \"table\", \"column\", max((token IN ('email', 'phone', 'ssn', 'name', 'address', 'dob', 'ip'))::INT) AS p FROM ({TOKENS}) GROUP BY 1, 2) SELECT \"table\", avg(p) AS share FROM c GROUP BY 1 HAVING avg(p) > 0.15")
def reg_gdpr_minimization(spark, sf):
    return G.reg_gdpr_minimization(G.column_tokens(catalog(spark, sf)), 0.15)


_FRAGMENTS = ", ".join(f"('{d}', '{k}')" for d, ks in G.DOMAINS.items() for k in ks)


@query(f"SELECT \"table\", domain, count(DISTINCT fragment) AS n_hits FROM (SELECT DISTINCT \"table\", \"column\" FROM ({TOKENS})) JOIN (VALUES {_FRAGMENTS}) v(domain, fragment) ON contains(lower(\"column\"), fragment) GROUP BY 1, 2")
def detect_domains(spark, sf):
    return G.detect_domains(G.column_tokens(catalog(spark, sf)).select("table", "column").distinct())


VIOLATIONS = "SELECT * FROM (" + " UNION ALL ".join(oracle(r, LINE, "lineitem") for r in G.RULES if all(x in LINE for x in r.roles)) + ") WHERE n_bad > 0"


@query(f"WITH v AS ({VIOLATIONS}) SELECT * FROM v QUALIFY rank() OVER (PARTITION BY \"column\" ORDER BY list_position(['CRITICAL', 'ERROR', 'WARNING'], severity)) = 1")
def resolve_conflicts(spark, sf):
    return D.conflict_resolution(G.evaluate(read(spark, sf, "lineitem"), LINE))


@query(f"WITH v AS ({VIOLATIONS}), n AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'WARNING') AS n_warning FROM v) SELECT *, greatest(-1.0, -(0.2 * n_critical + 0.1 * n_error + 0.02 * n_warning))::DOUBLE AS penalty, CASE WHEN n_critical + n_error > 0 THEN 'conditional' ELSE 'allowed' END AS decision FROM n")
def compliance_decision(spark, sf):
    return G.compliance_decision(G.evaluate(read(spark, sf, "lineitem"), LINE))
