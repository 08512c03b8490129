"""Queries of personal-data, gate and score operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.operators import governance as N
from tidewell.plans.cleaning import MESSY, messy
from tidewell.plans.registry import query, read
from tidewell.plans.regulatory import LINE, VIOLATIONS, G

PORTABLE = ["Email", "CreditCard", "IPAddress", "IBAN"]  # patterns without look-around


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'text' AS \"column\", '{t}' AS type, sum(regexp_matches(text, '{N.PII[t]}')::INT)::BIGINT AS n_rows FROM documents" for t in PORTABLE) + ") WHERE n_rows > 0")
def pii_detect(spark, sf):
    return N.pii_detect(read(spark, sf, "documents"), ["text"], PORTABLE)


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{N.PII['Email']}', '[REDACTED_EMAIL]', 'g'), '{N.PII['CreditCard']}', '[REDACTED_CC]', 'g') AS text FROM documents")
def pii_redact(spark, sf):
    return N.pii_redact(read(spark, sf, "documents").select("doc_id", "text"), ["text"], ["Email", "CreditCard"])


@query()
def governance_policy(spark, sf):
    return N.governance_policy(read(spark, sf, "documents").select("doc_id", "text"), ["text"], "gdpr")[0]


@query()
def row_checksum(spark, sf):
    return N.row_checksum(read(spark, sf, "orders"))


@query()
def dataset_checksum(spark, sf):
    return N.dataset_checksum(read(spark, sf, "lineitem"))


def violations(spark, sf):
    return G.evaluate(read(spark, sf, "lineitem"), LINE)


@query(f"WITH v AS ({VIOLATIONS}) SELECT count(*) FILTER (severity IN ('CRITICAL', 'ERROR')) AS n_failures, count(*) FILTER (severity = 'WARNING') AS n_warnings, CASE WHEN count(*) FILTER (severity IN ('CRITICAL', 'ERROR')) > 0 THEN 'REJECT' ELSE 'PASS' END AS decision FROM v")
def hard_gate(spark, sf):
    return N.hard_gate(violations(spark, sf))


RUNS = """SELECT o_orderkey AS run, CASE o_custkey % 4 WHEN 0 THEN 'banking' WHEN 1 THEN 'healthcare' WHEN 2 THEN 'finance' ELSE 'retail' END AS domain, 0.5 + (o_orderkey % 50) / 100.0::DOUBLE AS roc_auc, o_custkey % 3 AS n_critical, o_custkey % 5 AS n_error,
o_custkey % 40 = 1 AS phi_critical, o_custkey % 50 = 7 AS residency_critical FROM orders"""


def runs(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    domain = F.when(c % 4 == 0, "banking").when(c % 4 == 1, "healthcare").when(c % 4 == 2, "finance").otherwise("retail")
    return read(spark, sf, "orders").select(k.alias("run"), domain.alias("domain"), (0.5 + (k % 50) / 100).alias("roc_auc"), (c % 3).alias("n_critical"), (c % 5).alias("n_error"), (c % 40 == 1).alias("phi_critical"), (c % 50 == 7).alias("residency_critical"))


GATED = f"""WITH r AS ({RUNS}), b AS (SELECT *, CASE WHEN domain IN ('banking', 'finance') THEN 0.65 WHEN domain = 'healthcare' THEN 0.70 ELSE 0.50 END::DOUBLE AS base FROM r),
g AS (SELECT *, CASE WHEN n_critical > 0 THEN least(base + 0.15, 0.92) WHEN n_error > 0 THEN least(base + 0.07, 0.85) ELSE base END::DOUBLE AS min_auc FROM b)"""


@query(GATED + " SELECT run, round(min_auc, 4) AS min_auc, CASE WHEN domain = 'healthcare' AND phi_critical OR residency_critical OR roc_auc < min_auc - 1e-9 THEN 'REJECT' ELSE 'PASS' END AS decision FROM g")
def verification_gate(spark, sf):
    return N.verification_gate(runs(spark, sf).withColumn("roc_auc", F.col("roc_auc") + 1e-9)).select("run", F.round("min_auc", 4).alias("min_auc"), "decision")


SCORED = "SELECT o_orderkey AS run, (o_orderkey % 10) / 10.0::DOUBLE AS quality, (o_custkey % 10) / 10.0::DOUBLE AS compliance, 0.5::DOUBLE AS consistency, CASE WHEN o_orderkey % 2 = 0 THEN 0.8 END::DOUBLE AS roc_auc, o_custkey % 3 AS retries, -0.1::DOUBLE AS penalty, o_orderkey % 4 > 0 AS gate2_passed FROM orders"


def scored(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return N.confidence_score(read(spark, sf, "orders").select(k.alias("run"), ((k % 10) / 10).alias("quality"), ((c % 10) / 10).alias("compliance"), F.lit(0.5).alias("consistency"), F.when(k % 2 == 0, F.lit(0.8)).alias("roc_auc"), (c % 3).alias("retries"), F.lit(-0.1).alias("penalty"), (k % 4 > 0).alias("gate2_passed")))


CONFIDENCE = f"WITH r AS ({SCORED}), c AS (SELECT *, greatest(0, least(1, CASE WHEN roc_auc IS NOT NULL THEN 0.35 * quality + 0.2 * compliance + 0.1 * consistency + 0.4 * greatest(0, roc_auc - 0.5) ELSE 0.5 * quality + 0.35 * compliance + 0.15 * consistency END - 0.05 * retries + penalty))::DOUBLE AS b FROM r), d AS (SELECT run, round(CASE WHEN gate2_passed THEN b ELSE least(b, 0.49) END, 6) AS confidence FROM c)"


@query(CONFIDENCE + " SELECT * FROM d")
def confidence_score(spark, sf):
    return scored(spark, sf).select("run", F.round("confidence", 6).alias("confidence"))


@query(CONFIDENCE + " SELECT * FROM d WHERE confidence >= 0.5")
def approved_sink(spark, sf):
    return N.approved(scored(spark, sf).select("run", F.round("confidence", 6).alias("confidence"), F.lit("PASS").alias("decision"))).drop("decision")


@query(f"WITH m AS ({MESSY}) SELECT 'disc' AS \"column\", sum((disc IS NULL)::INT)::BIGINT AS n_missing, 100 * avg((disc IS NULL)::INT) AS pct_missing FROM m")
def feature_risk_rank(spark, sf):
    return N.feature_risk_rank(messy(spark, sf))


@query()
def qa_run(spark, sf):
    quality = A.quality_gate(read(spark, sf, "orders").select("o_custkey", "o_totalprice")).first()["quality_score"]
    return N.qa_run(violations(spark, sf), quality, 0.9)
