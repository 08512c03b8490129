"""Regulatory rules as data, compiled by shape.

Shapes: C counts rows that meet a condition, R the same on the ratio of two columns, X on text patterns: all rules of these
three shapes run in one aggregate.  G rules group first.  S rules look at column names only: one join of a rule table with the
catalog's column metadata covers any number of tables.  A rule applies where the columns it names exist.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import luhn_valid
from tidewell.functions.quantiles import quantiles
from tidewell.operators.validators import counted


@dataclass(frozen=True)
class Rule:
    """``predicate`` is SQL over the roles in ``roles``; a table binds roles to its columns."""

    name: str
    domain: str
    severity: str
    roles: tuple[str, ...]
    predicate: str


def _rule(name: str, domain: str, severity: str, predicate: str, *roles: str) -> Rule:
    return Rule(name, domain, severity, roles, predicate)


# Thresholds and formats of the rules.
ICD10 = r"(?i)^[A-Z]\\d{2}(\\.[A-Z0-9]{1,4})?$"
SSN, DOB, EMAIL = r"\\b\\d{3}-\\d{2}-\\d{4}\\b", r"\\b\\d{2}[/-]\\d{2}[/-]\\d{4}\\b", r"\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"
PHI = f"(text RLIKE '{SSN}' OR text RLIKE '{DOB}' OR text RLIKE '{EMAIL}')"
MASKED = r"^(X{4}[- ]?){3}\\d{4}$"

RULES = [
    _rule("reg_positive_amount", "banking", "ERROR", "amount <= 0", "amount"),
    _rule("reg_aml_threshold", "banking", "WARNING", "amount >= 10000", "amount"),
    _rule("reg_loan_ltv", "banking", "ERROR", "try_divide(loan, value) > 0.90", "loan", "value"),
    _rule("reg_repayment_consistency", "banking", "ERROR", "repayment > balance", "repayment", "balance"),
    _rule("reg_leverage", "banking", "ERROR", "try_divide(tier1, exposure) < 0.03", "tier1", "exposure"),
    _rule("reg_lcr", "banking", "CRITICAL", "try_divide(hqla, outflows) < 1.0", "hqla", "outflows"),
    _rule("reg_nsfr", "banking", "ERROR", "try_divide(available, required) < 1.0", "available", "required"),
    _rule("reg_revenue_recognition", "finance", "ERROR", "revenue < 0 AND NOT coalesce(credit_memo, false)", "revenue", "credit_memo"),
    _rule("reg_capital_adequacy", "finance", "CRITICAL", "try_divide(tier1, rwa) < 0.08", "tier1", "rwa"),
    _rule("reg_net_position", "finance", "ERROR", "position > max_long OR position < -max_short", "position", "max_long", "max_short"),
    _rule("reg_margin_call", "finance", "WARNING", "margin < maintenance", "margin", "maintenance"),
    _rule("reg_filing_bounds", "finance", "ERROR", "filing < filing_min OR filing > filing_max", "filing", "filing_min", "filing_max"),
    _rule("reg_fair_value_l3", "finance", "WARNING", "try_divide(level3, total_assets) > 0.20", "level3", "total_assets"),
    _rule("reg_age_range", "healthcare", "ERROR", "age < 0 OR age > 150", "age"),
    _rule("reg_vitals", "healthcare", "ERROR", "vital < vital_min OR vital > vital_max", "vital", "vital_min", "vital_max"),
    _rule("reg_icd10_format", "healthcare", "ERROR", f"NOT (icd_code RLIKE '{ICD10}')", "icd_code"),
    _rule("reg_phi_presence", "healthcare", "CRITICAL", PHI, "text"),
    _rule("reg_deidentification", "healthcare", "CRITICAL", f"anonymous AND {PHI}", "text", "anonymous"),
    _rule("reg_consent_phi", "healthcare", "ERROR", "phi IS NOT NULL AND NOT coalesce(consent, false)", "phi", "consent"),
    _rule("reg_gdpr_residency", "gdpr", "CRITICAL", "NOT array_contains(allowed_regions, region)", "region", "allowed_regions"),
    _rule("reg_sox_audit_trail", "sox", "ERROR", "modified_at IS NULL OR modified_by IS NULL", "modified_at", "modified_by"),
    _rule("reg_hipaa_encryption", "hipaa", "CRITICAL", "phi IS NOT NULL AND NOT coalesce(encrypted, false)", "phi", "encrypted"),
    _rule("reg_gdpr_consent", "gdpr", "ERROR", "pii IS NOT NULL AND NOT coalesce(consent, false)", "pii", "consent"),
    _rule("reg_gdpr_erasure", "gdpr", "CRITICAL", "coalesce(erasure_requested, false)", "erasure_requested"),
    _rule("reg_gdpr_breach", "gdpr", "CRITICAL", "coalesce(breach, false)", "breach"),
    _rule("reg_structuring", "fatf", "CRITICAL", "amount >= 9500 AND amount < 10000", "amount"),
    _rule("reg_pan_masking", "pci_dss", "ERROR", f"NOT (pan RLIKE '{MASKED}')", "pan"),
    _rule("reg_best_execution", "mifid2", "WARNING", "try_divide(abs(price - vwap), vwap) > 0.02", "price", "vwap"),
    _rule("reg_algo_tag", "mifid2", "ERROR", "coalesce(is_algo, false) AND algo_id IS NULL", "is_algo", "algo_id"),
    _rule("reg_investor_category", "mifid2", "ERROR", "NOT (lower(investor_category) IN ('retail', 'professional', 'eligible_counterparty'))", "investor_category"),
    _rule("reg_carbon", "esg", "ERROR", "emissions < 0", "emissions"),
    _rule("reg_esg_range", "esg", "ERROR", "esg_score < 0 OR esg_score > CASE WHEN lower(provider) = 'ftse' THEN 5 ELSE 100 END", "esg_score", "provider"),
    _rule("reg_ca_residency", "ccpa", "WARNING", "upper(state) IN ('CA', 'CALIFORNIA') AND NOT coalesce(disclosed, false)", "state", "disclosed"),
    _rule("reg_classification_label", "cyber", "ERROR", "NOT (lower(data_class) IN ('public', 'internal', 'confidential', 'restricted'))", "data_class"),
    _rule("reg_scr", "insurance", "CRITICAL", "try_divide(own_funds, scr) < 1.0", "own_funds", "scr"),
    _rule("reg_combined_ratio", "insurance", "WARNING", "try_divide(claims + expenses, premium) > 1.0", "claims", "expenses", "premium"),
    _rule("reg_combined_ratio_fail", "insurance", "CRITICAL", "try_divide(claims + expenses, premium) > 1.15", "claims", "expenses", "premium"),
    _rule("reg_claim_age", "insurance", "WARNING", "claim_open AND claim_days > 180", "claim_open", "claim_days"),
    _rule("reg_reinsurance", "insurance", "WARNING", "try_divide(ceded, gross) > 0.90", "ceded", "gross"),
    _rule("reg_premium", "insurance", "ERROR", "premium <= 0", "premium"),
    _rule("reg_csm", "insurance", "ERROR", "csm < 0", "csm"),
    _rule("reg_sca_exemption", "ecommerce", "ERROR", "amount > 30 AND sca IS NULL", "amount", "sca"),
    _rule("reg_refund_window", "ecommerce", "WARNING", "refund_days > 14", "refund_days"),
    _rule("reg_return_reason", "ecommerce", "ERROR", "coalesce(returned, false) AND return_reason IS NULL", "returned", "return_reason"),
    _rule("reg_beneficial_owner", "fatf", "ERROR", "amount > 100000 AND owner IS NULL", "amount", "owner"),
]


def evaluate(df: DataFrame, bindings: dict[str, str], rules: list[Rule] = RULES) -> DataFrame:
    """Violations of all rules whose roles are bound; ``bindings``: role -> SQL expression over the table."""
    import re

    def bound(rule: Rule) -> Column:
        text = rule.predicate
        for role in sorted(rule.roles, key=len, reverse=True):
            text = re.sub(rf"(?<![\w'.]){role}(?![\w'])", f"({bindings[role]})", text)
        return F.expr(text)

    own = [(r.name, ",".join(r.roles), r.severity, bound(r)) for r in rules if all(x in bindings for x in r.roles)]
    domains = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.domain)])
    return counted(df, own).withColumn("domain", domains[F.col("rule")])


def reg_carbon_spikes(df: DataFrame, emissions: str) -> DataFrame:
    """Rows over ten times the median."""
    m = (quantiles(df, {"m": (F.col(emissions), [0.5])})["m"] or [None])[0]
    return counted(df, [("reg_carbon_spikes", emissions, "WARNING", F.col(emissions) > F.lit(None if m is None else 10 * m))])


def reg_velocity(df: DataFrame, entity: str, ts: str, limit: int = 50) -> DataFrame:
    """entity, day, n: entities with more than ``limit`` rows in a day."""
    return df.groupBy(entity, F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def reg_currency_concentration(df: DataFrame, currency: str, limit: float = 0.90) -> DataFrame:
    """currency, share of the currencies that hold over ``limit`` of rows."""
    counts = df.groupBy(currency).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(currency, (F.col("n") / F.col("total")).alias("share")).where(F.col("share") > limit)  # one row of totals


def reg_double_entry(df: DataFrame, transaction: str, amount: str, tolerance: float = 0.01) -> DataFrame:
    return df.groupBy(transaction).agg(F.sum(amount).alias("imbalance")).where(F.abs("imbalance") > tolerance)


def reg_chargeback(df: DataFrame, chargeback: Column, limit: float = 0.01) -> DataFrame:
    return df.agg(F.avg(chargeback.cast("int")).alias("rate")).where(F.col("rate") > limit)


def reg_pan_detection(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_pan: numbers of 13-19 digits in ``text`` that pass the Luhn check."""
    numbers = F.expr(rf"regexp_extract_all({text}, '\\b[0-9]{{13,19}}\\b', 0)")
    hits = df.where(F.col(text).rlike("[0-9]{13}")).select(key, F.explode(numbers).alias("pan")).where(luhn_valid(F.col("pan")))
    return hits.groupBy(key).agg(F.count("*").alias("n_pan"))


# Column-presence rules as (rule, severity, tokens that trigger it, tokens of which one is required).
PRESENCE = [
    ("reg_irrbb", "WARNING", ["interest", "rate", "loan"], ["sensitivity", "duration", "repricing"]),
    ("reg_hipaa_minimum", "ERROR", ["patient"], ["access"]),
    ("reg_fca_duty", "WARNING", ["product"], ["outcome"]),
    ("reg_rbi_kyc", "ERROR", ["account"], ["kyc", "pan", "aadhaar"]),
    ("reg_pep", "ERROR", ["transaction"], ["pep"]),
    ("reg_sanctions", "CRITICAL", ["transaction"], ["sanctions"]),
    ("reg_remittance_origin", "ERROR", ["remittance", "transfer"], ["origin", "originator"]),
    ("reg_cvv_storage", "CRITICAL", ["cvv", "cvc"], ["never"]),
    ("reg_cardholder_isolation", "WARNING", ["pan", "cardholder"], ["tokenized"]),
    ("reg_transaction_fields", "ERROR", ["price", "trade"], ["lei", "isin", "venue"]),
    ("reg_pay_gap", "WARNING", ["salary"], ["gender"]),
    ("reg_supply_chain", "WARNING", ["supplier"], ["risk"]),
    ("reg_deletion_fields", "ERROR", ["customer"], ["deletion"]),
    ("reg_data_sale", "ERROR", ["customer"], ["sale"]),
    ("reg_pii_inventory", "WARNING", ["email", "phone"], ["inventory"]),
    ("reg_sensitive_encryption", "CRITICAL", ["ssn", "pan"], ["encrypted"]),
    ("reg_access_log", "WARNING", ["user"], ["access"]),
    ("reg_ict_incident", "WARNING", ["system"], ["incident"]),
    ("reg_cookie_consent", "ERROR", ["session", "user"], ["consent"]),
    ("reg_p2b_ranking", "WARNING", ["listing"], ["ranking"]),
]


def column_tokens(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, token: the catalog's column names split at underscores."""
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "table string, column string")
    return rows.select("table", "column", F.explode(F.split(F.lower("column"), "_")).alias("token")).distinct()


def reg_required_columns(tokens: DataFrame) -> DataFrame:
    """table, rule, severity of PRESENCE rules that are triggered and whose requirement no column meets."""
    spark = tokens.sparkSession
    triggers = spark.createDataFrame([(r, s, t) for r, s, ts, _ in PRESENCE for t in ts], "rule string, severity string, token string")
    needs = spark.createDataFrame([(r, t) for r, _, _, ts in PRESENCE for t in ts], "rule string, token string")
    on = tokens.join(F.broadcast(triggers), "token").select("table", "rule", "severity").distinct()
    met = tokens.join(F.broadcast(needs), "token").select("table", "rule").distinct()
    return on.join(met, ["table", "rule"], "left_anti")


def reg_gdpr_minimization(tokens: DataFrame, limit: float = 0.3) -> DataFrame:
    """table, share: tables in which personal columns hold more than ``limit`` of all."""
    pii = ["email", "phone", "ssn", "name", "address", "dob", "ip"]
    per = tokens.groupBy("table", "column").agg(F.max(F.col("token").isin(pii).cast("int")).alias("pii"))
    return per.groupBy("table").agg(F.avg("pii").alias("share")).where(F.col("share") > limit)


# Column-name fragments of each domain.
DOMAINS = {
    "banking": ["transaction_amount", "loan_amount", "repayment", "interest_rate", "account_number", "credit_score", "debit", "credit", "overdraft", "mortgage", "collateral", "ltv", "tier1", "rwa", "aml"],
    "healthcare": ["patient", "diagnosis", "icd_code", "medication", "dob", "date_of_birth", "admission", "discharge", "provider_id", "clinical_note", "lab_result", "mrn", "health_record"],
    "gdpr": ["consent_given", "data_region", "gdpr", "eu_resident", "right_to_access", "erasure_request", "data_controller", "lawful_basis", "retention_period"],
    "pci_dss": ["pan", "card_number", "cardholder", "cvv", "cvc", "expiry_date", "payment_token", "card_type", "card_brand"],
    "ccpa": ["do_not_sell", "opt_out", "california", "ccpa", "deletion_request", "data_sale_consent", "ca_resident"],
    "fatf": ["pep_flag", "sanctions_flag", "aml_flag", "structuring", "remittance", "wire_transfer", "beneficial_owner", "ubo", "politically_exposed", "watchlist"],
    "mifid2": ["lei", "isin", "execution_venue", "algo_id", "trading_venue", "mic_code", "client_category", "best_execution", "rts22", "investor_type"],
    "esg": ["scope_1", "scope_2", "scope_3", "esg_score", "co2_emissions", "carbon_footprint", "sustainability", "supplier_risk", "gender_pay", "esg_rating", "ghg_emissions"],
    "cyber": ["access_log", "incident", "breach", "ict_event", "audit_log", "classification", "data_class", "encrypted", "key_management", "vulnerability", "penetration_test", "siem"],
    "sox": ["journal_entry", "modified_at", "modified_by", "audit_trail", "internal_control", "financial_statement", "sox", "itgc", "segregation_of_duties"],
    "insurance": ["policy_number", "premium", "claim_id", "loss_ratio", "underwriting", "insured", "reinsurance", "actuarial", "coverage_amount", "deductible"],
    "ecommerce": ["sku", "order_id", "product_id", "basket", "cart", "checkout", "fulfillment", "shipment", "inventory_level", "return_reason", "merchant_id"],
}


def detect_domains(columns: DataFrame, least: int = 1) -> DataFrame:
    """table, domain, n_hits from (table, column): domains of which at least ``least`` fragments occur in column names."""
    fragments = columns.sparkSession.createDataFrame([(d, k) for d, ks in DOMAINS.items() for k in ks], "domain string, fragment string")
    hits = columns.join(F.broadcast(fragments), F.contains(F.lower("column"), F.col("fragment")))
    return hits.groupBy("table", "domain").agg(F.count_distinct("fragment").alias("n_hits")).where(F.col("n_hits") >= least)


def compliance_decision(violations: DataFrame, weights: tuple[float, float, float] = (0.20, 0.10, 0.02), critical_blocks: bool = False) -> DataFrame:
    """n_critical, n_error, n_warning, penalty (-1 to 0), decision: blocked, conditional or allowed."""
    n = [F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s.lower()}") for s in ("CRITICAL", "ERROR", "WARNING")]
    out = violations.agg(*n)
    penalty = F.greatest(F.lit(-1.0), -(weights[0] * F.col("n_critical") + weights[1] * F.col("n_error") + weights[2] * F.col("n_warning")))
    decision = F.when((F.col("n_critical") > 0) & F.lit(critical_blocks), "blocked").when(F.col("n_critical") + F.col("n_error") > 0, "conditional").otherwise("allowed")
    return out.withColumns({"penalty": penalty, "decision": decision})
