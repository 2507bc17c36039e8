"""Classification and scoring rules as queries over literal findings and over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.plans.fixtures import CRYPTO, FINDINGS, RISKS, Rows, _literal, case_sql
from lodestone.plans.registry import query, table

_ALL = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(evidence, '')))"
_TWO = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, '')))"
_FOUR = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(evidence, ''), coalesce(remediation, '')))"
_SEVERITY = "CASE WHEN contains(upper(coalesce(label, 'INFO')), 'CRIT') THEN 'CRITICAL' WHEN contains(upper(coalesce(label, 'INFO')), 'HIGH') THEN 'HIGH' WHEN contains(upper(coalesce(label, 'INFO')), 'MED') THEN 'MEDIUM' WHEN contains(upper(coalesce(label, 'INFO')), 'LOW') THEN 'LOW' ELSE 'INFO' END"
_BAND = "CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'INFO' END"


def f(spark: SparkSession) -> DataFrame:
    return FINDINGS.df(spark)


@query("c1_severity", f"SELECT id, {_SEVERITY} AS severity FROM {FINDINGS.sql}")
def c1(spark, d):
    return f(spark).select("id", R.severity(F.col("label")).alias("severity"))


VECTORS = Rows("v", "id int, vector string", [(1, "CVSS:3.1/AV:N/AC:L/PR:N"), (2, "AV:A/AC:H/Au:N"), (3, "av:p/ac:l"), (4, "nothing"), (5, None), (6, "AV:L/AC:H")])


@query("c2_vector_estimate", f"SELECT id, CASE WHEN regexp_extract(vector, 'AV:([NALP])', 1, 'i') <> '' AND regexp_extract(vector, 'AC:([LH])', 1, 'i') <> '' THEN round_even(CASE upper(regexp_extract(vector, 'AV:([NALP])', 1, 'i')) WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END * CASE upper(regexp_extract(vector, 'AC:([LH])', 1, 'i')) WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END * 10, 1) END AS score FROM {VECTORS.sql}")
def c2(spark, d):
    return VECTORS.df(spark).select("id", R.vector_estimate(F.col("vector")).alias("score"))


_KEY_CVES = "list_sort(list_distinct(list_filter(list_transform(coalesce(cves, []), lambda c: upper(trim(c))), lambda c: c <> '')))"
_TARGET = "'|target:' || lower(trim(coalesce(target, '')))"
_TOOL = "lower(trim(coalesce(nullif(tool, ''), 'generic')))"


@query("c3_dedup_key", f"SELECT id, substr(CASE WHEN len({_KEY_CVES}) > 0 THEN 'CVE:' || array_to_string({_KEY_CVES}, ':') || {_TARGET} WHEN trim(coalesce(plugin, '')) NOT IN ('', 'burp-pdf', 'burp-issue', 'generic') THEN {_TOOL} || ':' || trim(plugin) || {_TARGET} ELSE {_TOOL} || ':' || lower(trim(coalesce(nullif(title, ''), 'unnamed'))) || {_TARGET} END, 1, 480) AS dedup_key FROM {FINDINGS.sql}")
def c3(spark, d):
    return f(spark).select("id", R.dedup_key(*[F.col(c) for c in ("tool", "title", "target", "cves", "plugin")]).alias("dedup_key"))


_CWE = " ".join(f"WHEN regexp_replace(lower(regexp_extract({_ALL}, 'cwe-([0-9]+)')), '[^0-9]', '', 'g') IN ({', '.join(repr(str(i)) for i in ids)}) THEN {_literal(name)}" for name, ids in R.CWE_GROUPS.items())
_OWASP = f"CASE {_CWE} ELSE {case_sql(_TWO, R.OWASP, R.OWASP_DEFAULT)} END"


@query("c4_owasp", f"SELECT id, {_OWASP} AS owasp FROM {FINDINGS.sql}")
def c4(spark, d):
    cwe = F.regexp_extract(R.joined(F.col("title"), F.col("description"), F.col("evidence")), r"cwe-(\d+)", 0)
    return f(spark).select("id", R.owasp(cwe, F.col("title"), F.col("description")).alias("owasp"))


@query("c5_control", f"SELECT id, {case_sql(_ALL, R.CONTROLS, R.CONTROL_DEFAULT)} AS control FROM {FINDINGS.sql}")
def c5(spark, d):
    return f(spark).select("id", R.control(F.col("title"), F.col("description"), F.col("evidence")).alias("control"))


@query("c6_crypto_control", f"SELECT id, {case_sql(_ALL, R.CRYPTO_CONTROLS, R.CRYPTO_CONTROL_DEFAULT)} AS control FROM {FINDINGS.sql}")
def c6(spark, d):
    return f(spark).select("id", R.crypto_control(F.col("title"), F.col("description"), F.col("evidence")).alias("control"))


_CATEGORY = "CASE substr(owasp, 1, 3) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CATEGORIES.items()) + " END"


@query("c7_risk_category", f"SELECT id, {_CATEGORY} AS category FROM (SELECT id, {_OWASP} AS owasp FROM {FINDINGS.sql})")
def c7(spark, d):
    return f(spark).select("id", R.risk_category(F.col("title"), F.col("description"), F.col("evidence")).alias("category"))


_PLAIN_FOUR = "concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(evidence, ''), coalesce(remediation, ''))"
# no finding holds one of the names that the guarded pattern lets pass, so a plain pattern for addresses does here
_PERSONAL = rf"(regexp_matches({_PLAIN_FOUR}, '[a-zA-Z0-9][\w.+\-]*@[\w\-]+\.[a-zA-Z]{{2,}}') OR regexp_matches({_PLAIN_FOUR}, '{T.CREDENTIAL}') OR regexp_matches({_PLAIN_FOUR}, '{T.IDENTIFIER}'))"


@query("c8_impact_and_personal_data", f"SELECT id, 'C:' || CASE WHEN {_PERSONAL} THEN 'Confidential (High - PII Data Present)' ELSE {case_sql(_FOUR, R.CONFIDENTIALITY, 'NONE')} END || ' | I:' || {case_sql(_FOUR, R.INTEGRITY, 'NONE')} || ' | A:' || {case_sql(_FOUR, R.AVAILABILITY, 'NONE')} AS cia, {_PERSONAL} AS personal FROM {FINDINGS.sql}")
def c8(spark, d):
    cia, personal = R.impact(*[F.col(c) for c in ("title", "description", "evidence", "remediation")], F.lit(False))
    return f(spark).select("id", cia.alias("cia"), personal.alias("personal"))


@query("c8_integrity_availability", f"SELECT id, {case_sql(_FOUR, R.INTEGRITY, 'NONE')} AS integrity, {case_sql(_FOUR, R.AVAILABILITY, 'NONE')} AS availability FROM {FINDINGS.sql}")
def c8b(spark, d):
    text = R.joined(*[F.col(c) for c in ("title", "description", "evidence", "remediation")])
    return f(spark).select("id", R.classify(text, R.INTEGRITY, "NONE").alias("integrity"), R.classify(text, R.AVAILABILITY, "NONE").alias("availability"))


@query("c10_business_priority", f"SELECT id, {case_sql('lower(concat_ws(chr(32), asset, title))', R.PRIORITIES, '')} AS priority FROM {CRYPTO.sql}")
def c10(spark, d):
    return CRYPTO.df(spark).select("id", R.business_priority(F.col("asset"), F.col("title")).alias("priority"))


@query("c11_crypto_risk", "SELECT * FROM (VALUES (1, 96, 'CRITICAL'), (2, 48, 'MEDIUM'), (3, 32, 'LOW'), (4, 64, 'HIGH'), (5, 56, 'MEDIUM'), (6, 28, 'LOW'), (7, 80, 'CRITICAL')) AS t(id, score, band)")
def c11(spark, d):
    c = CRYPTO.df(spark).withColumn("priority", R.business_priority(F.col("asset"), F.col("title")))
    score, band = R.crypto_risk(F.col("priority"), F.col("cia"), F.col("exposure"), F.col("status"))
    return c.select("id", score.alias("score"), band.alias("band"))


_LH, _IM = "upper(trim(coalesce(likelihood, '')))", "upper(trim(coalesce(impact, '')))"
_PO, _EV = "upper(trim(coalesce(policy, '')))", "upper(trim(coalesce(evidence, '')))"


def _level(own: str, other: str, defaults: tuple[str, str, str, str]) -> str:
    ok = "IN ('LOW', 'MODERATE', 'HIGH')"
    cases = [f"{_PO} = 'FOUND' AND {_EV} = 'NOT_FOUND'", f"{_PO} = 'NOT_FOUND' AND {_EV} = 'NOT_FOUND'", f"{_PO} = 'NOT_FOUND' AND {_EV} = 'FOUND'", f"{_PO} = 'FOUND' AND {_EV} = 'FOUND' AND upper(coalesce(assessment, '')) = 'NON_COMPLIANT'"]
    whens = " ".join(f"WHEN {c} THEN CASE WHEN {own} {ok} THEN {own} ELSE '{v}' END" for c, v in zip(cases, defaults, strict=True))
    return f"CASE WHEN upper(coalesce(status, '')) IN ('COMPLIANT', 'FALSE_POSITIVE') THEN 'N/A' WHEN {own} {ok} AND {other} {ok} THEN {own} {whens} ELSE 'N/A' END"


_MATRIX = ", ".join(f"('{a}', '{b}', '{v}', '{R.RISK_PRIORITY[v]}')" for (a, b), v in R.RISK_MATRIX.items())


@query(
    "c12_risk_matrix",
    f"WITH x AS (SELECT id, status, {_level(_LH, _IM, ('LOW', 'MODERATE', 'LOW', 'MODERATE'))} AS likelihood, {_level(_IM, _LH, ('MODERATE', 'HIGH', 'LOW', 'MODERATE'))} AS impact FROM {RISKS.sql}) "
    f"SELECT id, likelihood, impact, CASE WHEN upper(coalesce(status, '')) IN ('COMPLIANT', 'FALSE_POSITIVE') THEN 'N/A' ELSE coalesce(level, 'UNDETERMINED') END AS risk_level, coalesce(sev, 'N/A') AS severity FROM x LEFT JOIN (VALUES {_MATRIX}) AS m(a, b, level, sev) ON likelihood = a AND impact = b",
)
def c12(spark, d):
    r = RISKS.df(spark)
    return r.select("id", *[v.alias(k) for k, v in R.risk_levels(*[F.col(c) for c in ("status", "likelihood", "impact", "policy", "evidence", "assessment")]).items()])


ITEMS = Rows("i", "finding int, requirement string, support string, quote string, policy_valid boolean, fresh boolean", [(1, "a", "SUPPORTED", "backup is enabled", True, True), (1, "b", "SUPPORTED", "tested monthly", True, True), (2, "a", "SUPPORTED", "mfa enabled", True, True), (2, "b", "PARTIAL", "mfa not enabled", True, True), (3, "a", "SUPPORTED", "logs kept", True, False), (4, "a", "SUPPORTED", "access is enabled but not enabled for all", True, True), (5, "a", None, None, None, None)])


@query("c13_final_result", f"SELECT finding, CASE WHEN bool_and(coalesce(support, '') = 'SUPPORTED') AND NOT bool_or(coalesce(contains(quote, 'enabled') AND contains(quote, 'not enabled'), false)) AND bool_and(coalesce(policy_valid, false)) AND bool_and(coalesce(fresh, false)) THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS final_result FROM {ITEMS.sql} GROUP BY 1")
def c13(spark, d):
    i = ITEMS.df(spark)
    conflict = F.coalesce(F.contains("quote", F.lit("enabled")) & F.contains("quote", F.lit("not enabled")), F.lit(False))
    ok = F.bool_and(F.coalesce("support", F.lit("")) == "SUPPORTED") & ~F.bool_or(conflict) & F.bool_and(F.coalesce("policy_valid", F.lit(False))) & F.bool_and(F.coalesce("fresh", F.lit(False)))
    return i.groupBy("finding").agg(F.when(ok, "COMPLIANT").otherwise("NON_COMPLIANT").alias("final_result"))


@query("c14_conflicting_terms", f"SELECT finding, bool_or(coalesce(contains(quote, 'enabled'), false)) AND bool_or(coalesce(contains(quote, 'not enabled'), false)) AS conflict FROM {ITEMS.sql} GROUP BY 1")
def c14(spark, d):
    has = lambda w: F.bool_or(F.coalesce(F.contains("quote", F.lit(w)), F.lit(False)))
    return ITEMS.df(spark).groupBy("finding").agg((has("enabled") & has("not enabled")).alias("conflict"))


POLICIES = Rows("p", "id int, expires string, review_due string, cadence_days int, seen string", [(1, "2023-12-31", None, 90, "2024-01-01"), (2, None, "2023-06-01", None, "2024-01-01"), (3, "2025-01-01", "2024-12-01", 30, "2023-10-01"), (4, None, None, None, None), (5, "bad", None, 365, "2023-12-01")])


@query("c16_policy_validity", f"SELECT id, CASE WHEN try_cast(expires AS DATE) < DATE '2024-01-31' THEN 'EXPIRED' WHEN try_cast(review_due AS DATE) < DATE '2024-01-31' THEN 'REVIEW_OVERDUE' WHEN coalesce(try_cast(expires AS DATE), try_cast(review_due AS DATE)) IS NOT NULL THEN 'CURRENT' ELSE 'UNKNOWN' END AS validity FROM {POLICIES.sql}")
def c16(spark, d):
    p = POLICIES.df(spark)
    e, r, now = F.expr("try_cast(expires AS date)"), F.expr("try_cast(review_due AS date)"), F.lit("2024-01-31").cast("date")
    return p.select("id", F.when(e < now, "EXPIRED").when(r < now, "REVIEW_OVERDUE").when(F.coalesce(e, r).isNotNull(), "CURRENT").otherwise("UNKNOWN").alias("validity"))


@query("c17_evidence_freshness", f"SELECT id, CASE WHEN cadence_days IS NULL OR try_cast(seen AS DATE) IS NULL THEN 'UNKNOWN' WHEN DATE '2024-01-31' - try_cast(seen AS DATE) > cadence_days THEN 'STALE' ELSE 'CURRENT' END AS freshness FROM {POLICIES.sql}")
def c17(spark, d):
    seen = F.expr("try_cast(seen AS date)")
    age = F.date_diff(F.lit("2024-01-31").cast("date"), seen)
    return POLICIES.df(spark).select("id", F.when(F.col("cadence_days").isNull() | seen.isNull(), "UNKNOWN").when(age > F.col("cadence_days"), "STALE").otherwise("CURRENT").alias("freshness"))


@query("c18_score_clamps", f"SELECT id, least(10.0, greatest(0.0, coalesce(score, 0.0)))::DOUBLE AS score, score IS NOT NULL AND {_BAND} <> {_SEVERITY} AS mismatch FROM {FINDINGS.sql}")
def c18(spark, d):
    clamped = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))
    return f(spark).select("id", clamped.alias("score"), (F.col("score").isNotNull() & (R.score_band(F.col("score")) != R.severity(F.col("label")))).alias("mismatch"))


@query("c19_status_consistency", f"SELECT finding, requirement, CASE WHEN support = 'SUPPORTED' AND length(trim(coalesce(quote, ''))) < 12 THEN 'NON_COMPLIANT' WHEN support = 'SUPPORTED' THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status FROM {ITEMS.sql}")
def c19(spark, d):
    short = F.char_length(F.trim(F.coalesce("quote", F.lit("")))) < 12
    return ITEMS.df(spark).select("finding", "requirement", F.when((F.col("support") == "SUPPORTED") & ~short, "COMPLIANT").otherwise("NON_COMPLIANT").alias("status"))


_DEFAULT_VECTOR = [(9.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), (7.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N"), (4.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N")]


@query("c20_default_vector", f"SELECT id, CASE {' '.join(f"WHEN score >= {s} THEN '{v}'" for s, v in _DEFAULT_VECTOR)} WHEN score > 0 THEN 'AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N' ELSE 'AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N' END AS vector FROM {FINDINGS.sql}")
def c20(spark, d):
    out = None
    for s, v in _DEFAULT_VECTOR:
        out = F.when(F.col("score") >= s, v) if out is None else out.when(F.col("score") >= s, v)
    return f(spark).select("id", out.when(F.col("score") > 0, "AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N").otherwise("AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N").alias("vector"))


@query("c21_scope_detection", "WITH hit AS (SELECT DISTINCT source FROM documents WHERE contains(lower(text), 'license')), scoped AS (SELECT s.source FROM (SELECT DISTINCT source FROM documents) s WHERE source IN (SELECT source FROM hit) OR NOT EXISTS (SELECT 1 FROM hit)) SELECT source FROM scoped")
def c21(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.bool_or(F.contains(F.lower("text"), F.lit("license"))).alias("hit"))
    some = per.agg(F.bool_or("hit").alias("some"))
    return per.join(F.broadcast(some), F.lit(True)).where("hit OR NOT some").select("source")


@query("c26_report_severity", f"SELECT id, CASE WHEN score > 0 THEN {_BAND} ELSE {_SEVERITY} END AS band, CASE WHEN score > 0 THEN score ELSE CASE {_SEVERITY} WHEN 'CRITICAL' THEN 9.8 WHEN 'HIGH' THEN 8.0 WHEN 'MEDIUM' THEN 5.5 WHEN 'LOW' THEN 2.5 ELSE 0 END END::DOUBLE AS score FROM {FINDINGS.sql}")
def c26(spark, d):
    band, score = R.report_severity(F.col("score"), F.col("label"))
    return f(spark).select("id", band.alias("band"), score.alias("score"))


@query("c27_legacy_mapping", f"SELECT finding, string_agg(quote, chr(10) || chr(10) ORDER BY requirement) AS quotes, CASE WHEN bool_and(support = 'SUPPORTED') THEN 'High' ELSE 'Low' END AS confidence FROM {ITEMS.sql} GROUP BY 1")
def c27(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("requirement", "quote")))
    quotes = F.filter(F.transform(rows, lambda r: r["quote"]), lambda q: q.isNotNull())
    x = ITEMS.df(spark).groupBy("finding").agg(quotes.alias("q"), F.when(F.bool_and(F.col("support") == "SUPPORTED"), "High").otherwise("Low").alias("confidence"))
    return x.select("finding", F.when(F.size("q") > 0, F.array_join("q", "\n\n")).alias("quotes"), "confidence")


@query("c30_short_dedup_key", f"SELECT id, CASE WHEN len(coalesce(cves, [])) > 0 THEN 'cve:' || array_to_string(list_sort(list_transform(cves, lambda c: trim(upper(c)))), ',') || {_TARGET} WHEN trim(coalesce(plugin, '')) <> '' THEN 'plugin:' || trim(plugin) || {_TARGET} ELSE 'title:' || lower(trim(coalesce(title, ''))) || {_TARGET} END AS dedup_key FROM {FINDINGS.sql}")
def c30(spark, d):
    return f(spark).select("id", R.short_dedup_key(*[F.col(c) for c in ("title", "target", "cves", "plugin")]).alias("dedup_key"))


@query("c31_fill_if_empty", f"SELECT id, coalesce(nullif(plugin, ''), {case_sql(_ALL, R.CONTROLS, R.CONTROL_DEFAULT)}) AS control, coalesce(nullif(remediation, ''), 'Review ' || {case_sql(_TWO, R.OWASP, R.OWASP_DEFAULT)}) AS remediation FROM {FINDINGS.sql}")
def c31(spark, d):
    e = F.lit("")
    return f(spark).select("id", F.coalesce(F.nullif("plugin", e), R.control(F.col("title"), F.col("description"), F.col("evidence"))).alias("control"), F.coalesce(F.nullif("remediation", e), F.concat(F.lit("Review "), R.classify(R.joined(F.col("title"), F.col("description")), R.OWASP, R.OWASP_DEFAULT))).alias("remediation"))


CONTENT = Rows("t", "id int, content string, file string", [(1, "All staff must complete training", "a.pdf"), (2, "NTP synchronized at 10:00", "b.txt"), (3, "Nessus scan passed", "s.csv"), (4, "cpu | memory", "m.xlsx"), (5, "", "x.pdf"), (6, "Last login: Mon", "l.log"), (7, "proactive measures", "p.docx"), (8, "Approved by the board", "q.pdf"), (9, "visitor badge entry", "v.csv"), (10, None, None)])


def content_class(content, file):
    """(content type, modality) of a passage, by words and not by its file's name."""
    x, name = F.lower(content), F.lower(F.coalesce(file, F.lit("")))
    word = lambda *w: x.rlike(r"\b(?:" + "|".join(w) + r")\b")
    acted = F.exists(F.array(*[F.lit(p) for p in ACTION_PHRASES]), lambda p: F.contains(x, p)) | word(*ACTION_WORDS)
    norm = F.exists(F.array(*[F.lit(p) for p in NORM_PHRASES]), lambda p: F.contains(x, p)) | word(*NORM_WORDS)
    kind = (
        F.when(F.coalesce(F.trim(content), F.lit("")) == "", "UNKNOWN")
        .when(norm & ~acted, "POLICY")
        .when(word("report", "summary"), "REPORT")
        .when(F.contains(x, F.lit("approved by")) | word("approval") | F.contains(x, F.lit("sign-off")), "APPROVAL")
        .when(word("review", "reviewed"), "REVIEW")
        .when(word("scan", "vulnerability", "cve", "nessus"), F.when(acted, "TEST_RESULT").otherwise("ASSESSMENT"))
        .when(word("cpu", "memory", "utilization", "metric", "cloudwatch"), "MONITORING")
        .when(word("config", "parameter", "port", "ip", "setting", "ctl"), F.when(acted, "CONFIGURATION").otherwise("STANDARD"))
        .when(x.rlike(r"\blog(s|in|ged|out|ging)?\b") | F.contains(x, F.lit("session opened")) | F.contains(x, F.lit("signed in")) | word("event"), F.when(acted, "LOG_RECORD").otherwise("PROCEDURE"))
        .when(word("access", "visitor", "badge", "entry"), F.when(word("visitor", "entry"), "VISITOR_RECORD").otherwise("ACCESS_RECORD"))
        .when(acted, "SYSTEM_OUTPUT")
        .otherwise("UNKNOWN")
    )
    modality = F.when(F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t")), "TABLE").when(name.rlike(r"\.(xlsx|csv|xls)$"), "SPREADSHEET").when(name.rlike(r"\.(pdf|docx|pptx|doc)$"), "DOCUMENT").otherwise("TEXT")
    return kind, F.when(F.coalesce(F.trim(content), F.lit("")) == "", "TEXT").otherwise(modality)


# Phrases and words of performed actions and of requirements.
ACTION_PHRASES = ["status: ok", "session opened", "mfa enabled for", "ntp synchronized", "signed in at", "signed in by", "nessus result:", "cpu utilization", "active (running)", "review completed", "reviewed by", "audit log exported", "user account created", "audited by", "last login", "logged in", "login successful", "login as"]
ACTION_WORDS = ["completed", "executed", "passed", "synchronized", "synchronised", "ntp", "threshold", "active", "enabled", "configured"]
NORM_PHRASES = ["will audit", "shall audit", "must audit", "requires security", "must ensure", "shall maintain", "shall review", "must be", "shall be", "should be", "policy requires", "procedure requires", "employees must", "management shall", "all staff must", "is mandated", "must complete", "shall complete", "must have", "shall have", "required to"]
NORM_WORDS = ["must", "shall", "should", "policy", "procedure", "standard", "guideline", "mandated"]


@query("t15_content_class", "SELECT * FROM (VALUES (1, 'POLICY', 'DOCUMENT', 'POLICY'), (2, 'SYSTEM_OUTPUT', 'TEXT', 'OPERATIONAL'), (3, 'TEST_RESULT', 'SPREADSHEET', 'OPERATIONAL'), (4, 'MONITORING', 'TABLE', 'OPERATIONAL'), (5, 'UNKNOWN', 'TEXT', 'UNKNOWN'), (6, 'LOG_RECORD', 'TEXT', 'OPERATIONAL'), (7, 'UNKNOWN', 'DOCUMENT', 'UNKNOWN'), (8, 'APPROVAL', 'DOCUMENT', 'OPERATIONAL'), (9, 'VISITOR_RECORD', 'SPREADSHEET', 'OPERATIONAL'), (10, 'UNKNOWN', 'TEXT', 'UNKNOWN')) AS t(id, kind, modality, c33_class)")
def t15(spark, d):
    kind, modality = content_class(F.col("content"), F.col("file"))
    three = F.when(F.col("kind").isin("POLICY", "PROCEDURE", "STANDARD"), "POLICY").when(F.col("kind") == "UNKNOWN", "UNKNOWN").otherwise("OPERATIONAL")
    return CONTENT.df(spark).select("id", kind.alias("kind"), modality.alias("modality")).withColumn("c33_class", three)


@query("v5_web_scores", "SELECT * FROM (VALUES (3, 9.8::DOUBLE), (4, 0.0), (9, 6.1), (11, 0.0), (2, 5.5)) AS t(id, score)")
def v5(spark, d):
    score, _ = R.web_score(F.col("title"), F.col("label"))
    return f(spark).where(F.col("id").isin(2, 3, 4, 9, 11)).select("id", score.alias("score"))


@query("v8_actionable_split", f"SELECT id, {_SEVERITY} IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') AS actionable FROM {FINDINGS.sql}")
def v8(spark, d):
    return f(spark).select("id", R.severity(F.col("label")).isin("CRITICAL", "HIGH", "MEDIUM", "LOW").alias("actionable"))


@query("t8_redaction")
def t8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted_sha256"), T.has_personal_data(F.col("text")).alias("personal"))


@query("t8_redaction_emails", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\w.+\-]+@[\w\-]+\.(?:[a-zA-Z]{2,})', '[EMAIL REDACTED]', 'g'), '\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b', '[IP REDACTED]', 'g')) AS redacted FROM documents")
def t8b(spark, d):
    e = F.regexp_replace(F.regexp_replace("text", T.EMAIL, "[EMAIL REDACTED]"), T.IPV4, "[IP REDACTED]")
    return table(spark, d, "documents").select("doc_id", F.sha2(e, 256).alias("redacted"))
