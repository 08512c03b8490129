"""Personal data, checksums, gates and confidence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stages import evenly

# Patterns of personal data and their masks.
PII = {
    "Email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "SSN": r"\b(?!000)(?!666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "CreditCard": r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{13,19}\b",
    "Phone": r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)",
    "IPAddress": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "ICD10": r"\b[A-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?\b",
    "IBAN": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]?){0,16}\b",
    "Swift": r"\b[A-Z]{6}[A-Z2-9][A-NP-Z0-9](?:[A-Z0-9]{3})?\b",
}
MASKS = {"Email": "[REDACTED_EMAIL]", "SSN": "[REDACTED_SSN]", "CreditCard": "[REDACTED_CC]", "Phone": "[REDACTED_PHONE]", "IPAddress": "[REDACTED_IP]", "ICD10": "[REDACTED_ICD10]", "IBAN": "[REDACTED_IBAN]", "Swift": "[REDACTED_SWIFT]"}
POLICY = {"gdpr": ["Email", "SSN", "Phone", "IPAddress"], "healthcare": ["Email", "SSN", "Phone", "ICD10"], "banking": ["Email", "CreditCard", "IBAN", "Swift"], "finance": ["Email", "CreditCard"], "sox": ["Email"], "hipaa": ["Email", "SSN", "Phone", "ICD10"], "generic": ["Email", "SSN", "CreditCard", "Phone"]}


def pii_detect(df: DataFrame, columns: list[str], types: list[str] | None = None) -> DataFrame:
    """column, type, n_rows for every pair with a hit, in one pass."""
    pairs = [(c, t) for c in columns for t in types or PII]
    wide = evenly(df.select(*columns)).agg(*[F.coalesce(F.sum(F.col(c).rlike(PII[t]).cast("long")), F.lit(0)).alias(f"{i}") for i, (c, t) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"{i}").alias("n_rows")) for i, (c, t) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").where("n_rows > 0")


def pii_redact(df: DataFrame, columns: list[str], types: list[str] | None = None) -> DataFrame:
    """Each type's matches become its mask, one type after the other."""
    def masked(c: str) -> Column:
        out = F.col(c)
        for t in types or PII:
            out = F.regexp_replace(out, PII[t], MASKS[t])
        return out

    return df.withColumns({c: masked(c) for c in columns})


def governance_policy(df: DataFrame, columns: list[str], domain: str, mode: str = "redact") -> tuple[DataFrame, DataFrame]:
    """(table, report) under off, flag, redact or reject; reject gives an empty table if anything is found."""
    types = POLICY.get(domain, POLICY["generic"])
    report = pii_detect(df, columns, types).withColumn("action", F.lit(mode))
    if mode == "redact":
        return pii_redact(df, columns, types), report
    if mode == "reject" and not report.isEmpty():
        return df.where("false"), report
    return df, report if mode != "off" else report.where("false")


def row_checksum(df: DataFrame) -> DataFrame:
    """``df`` with sha256 of the row's columns as JSON."""
    return df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))


def dataset_checksum(df: DataFrame) -> DataFrame:
    """n and an order-independent checksum of all rows."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))


def hard_gate(violations: DataFrame, mode: str = "strict") -> DataFrame:
    """n_failures, n_warnings, decision; strict rejects on CRITICAL or ERROR, adaptive on CRITICAL, advisory never."""
    out = violations.agg(F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("n_critical"), F.count(F.when(F.col("severity").isin("CRITICAL", "ERROR"), 1)).alias("n_failures"), F.count(F.when(F.col("severity") == "WARNING", 1)).alias("n_warnings"))
    bad = {"strict": F.col("n_failures") > 0, "adaptive": F.col("n_critical") > 0, "advisory": F.lit(False)}[mode]
    return out.select("n_failures", "n_warnings", F.when(bad, "REJECT").otherwise("PASS").alias("decision"))


def verification_gate(runs: DataFrame) -> DataFrame:
    """decision and min_auc for a table of runs (run, domain, roc_auc, n_critical, n_error, phi_critical, residency_critical)."""
    # Least AUC by domain, and how violations tighten it.
    base = F.when(F.col("domain").isin("banking", "finance"), 0.65).when(F.col("domain") == "healthcare", 0.70).otherwise(0.50)
    least = F.when(F.col("n_critical") > 0, F.least(base + 0.15, F.lit(0.92))).when(F.col("n_error") > 0, F.least(base + 0.07, F.lit(0.85))).otherwise(base)
    auto = (F.col("domain") == "healthcare") & F.col("phi_critical") | F.col("residency_critical")
    return runs.withColumns({"min_auc": least, "decision": F.when(auto | (F.col("roc_auc") < least), "REJECT").otherwise("PASS")})


def confidence_score(runs: DataFrame) -> DataFrame:
    """confidence of runs (quality, compliance, consistency, roc_auc or null, retries, penalty, gate2_passed)."""
    auc = 0.35 * F.col("quality") + 0.20 * F.col("compliance") + 0.10 * F.col("consistency") + 0.4 * F.greatest(F.lit(0.0), F.col("roc_auc") - 0.5)
    plain = 0.50 * F.col("quality") + 0.35 * F.col("compliance") + 0.15 * F.col("consistency")
    raw = F.when(F.col("roc_auc").isNotNull(), auc).otherwise(plain) - 0.05 * F.col("retries") + F.col("penalty")
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return runs.withColumn("confidence", F.when(F.col("gate2_passed"), bounded).otherwise(F.least(bounded, F.lit(0.49))))


def approved(runs: DataFrame, least: float = 0.5) -> DataFrame:
    return runs.where((F.col("decision") == "PASS") & (F.col("confidence") >= least))


def feature_risk_rank(df: DataFrame) -> DataFrame:
    """column, null_rate in order of risk."""
    from tidewell.operators.aggregates import eda_missing

    return eda_missing(df).orderBy(F.desc("pct_missing"), "column")


def qa_run(violations: DataFrame, quality: float, roc_auc: float | None) -> DataFrame:
    """Gate 1, gate 2 and confidence of one run's violations: one row."""
    gate = hard_gate(violations, "adaptive").select(F.col("decision").alias("gate1"), "n_failures")
    counts = violations.agg(F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("n_critical"), F.count(F.when(F.col("severity") == "ERROR", 1)).alias("n_error"))
    run = gate.crossJoin(counts).withColumns({"domain": F.lit("default"), "roc_auc": F.lit(roc_auc).cast("double"), "phi_critical": F.lit(False), "residency_critical": F.lit(False)})  # one row each
    run = verification_gate(run)
    run = run.withColumns({"quality": F.lit(quality), "compliance": 1 - F.least(F.lit(1.0), 0.1 * F.col("n_failures")), "consistency": F.lit(1.0), "retries": F.lit(0), "penalty": -F.least(F.lit(1.0), 0.2 * F.col("n_critical") + 0.1 * F.col("n_error")), "gate2_passed": F.col("decision") == "PASS"})
    return confidence_score(run).select("gate1", "decision", "min_auc", "confidence")
