"""Literal rows as a frame and as SQL, for rules whose words the tables don't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    parts = str(value).replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


class Rows:
    """A small table given twice: ``df(spark)`` and ``sql`` (a FROM item named ``name``)."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        columns = ", ".join(c.split()[0] for c in schema.split(", "))
        self.sql = "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS {name}({columns})"

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


def case_sql(text: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    """The ordered rules as a SQL CASE over the lower-case expression ``text``."""
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, {_literal(k)})" for k in keys) + f" THEN {_literal(value)}" for value, keys in rules)
    return f"CASE {whens} ELSE {_literal(default)} END"


FINDINGS = Rows(
    "f",
    "id int, tool string, title string, description string, evidence string, remediation string, target string, plugin string, label string, score double, cves array<string>",
    [
        (1, "Nessus", "WinRAR < 7.12 Directory Traversal", "A directory traversal flaw", "installed version 7.0", "Upgrade", "10.0.0.5", "242073", "Critical", 9.8, ["CVE-2025-6218", "cve-2025-6218 ", "CVE-2024-1"]),
        (2, "Nessus", "SSL Weak Cipher Suites Supported", "RC4 and 3DES ciphers", "CWE-327", "Disable", "10.0.0.6", "26928", "medium", None, []),
        (3, "Burp", "SQL injection", "CWE-89 in /login", "error message shown", None, "/login", "burp-issue", "High", None, None),
        (4, "Burp", "Cross-site scripting (reflected)", "Reflected XSS", "", "", "/q", "burp-pdf", "Information", 0.0, []),
        (5, "Nmap", "Open port 22", "service banner OpenSSH", "ssh open", None, "10.0.0.7", None, None, None, None),
        (6, None, None, None, None, None, None, None, "low", None, []),
        (7, "Qualys", "Outdated Apache", "end of life release", "patch missing", "Apply patch", "HOST-A ", " 38170 ", "4-HIGH", 7.5, ["CVE-2023-25690"]),
        (8, "Trivy", "Jackson deserialization", "remote code execution; memory corruption crash", "password = hunter2", "Update", "app.jar", "CVE-2019-12384", "UNKNOWN", None, ["CVE-2019-12384"]),
        (9, "Burp", "Open redirect", "open redirection found", "timeout slow", "", "/out", "", "Low", 3.1, []),
        (10, "Nessus", "SMTP open relay", "Missing SPF and DMARC records", "contact admin@corp.example", "", "mx1", "1", "MED", 4.0, []),
        (11, "Nessus", "Session cookie without flags", "credit card number in cookie", "CWE-200", "", "shop", "2", "none", -1.0, []),
        (12, "Nmap", "Firewall segmentation gap", "filtered port range", "", "", "fw1", "3", "Informational", 0.0, []),
    ],
)

RISKS = Rows(
    "r",
    "id int, status string, likelihood string, impact string, policy string, evidence string, assessment string",
    [(i * 3 + j, "NON_COMPLIANT", a, b, "FOUND", "FOUND", "") for i, a in enumerate(["low", "MODERATE", " High "]) for j, b in enumerate(["LOW", "Moderate", "HIGH"])]
    + [
        (10, "COMPLIANT", "HIGH", "HIGH", "FOUND", "FOUND", ""),
        (11, "NON_COMPLIANT", None, None, "FOUND", "NOT_FOUND", None),
        (12, "NON_COMPLIANT", "", "LOW", "NOT_FOUND", "NOT_FOUND", None),
        (13, "NON_COMPLIANT", "HIGH", None, "NOT_FOUND", "FOUND", None),
        (14, "NON_COMPLIANT", None, None, "FOUND", "FOUND", "non_compliant"),
        (15, "NON_COMPLIANT", "weird", None, "FOUND", "FOUND", "COMPLIANT"),
        (16, None, None, None, None, None, None),
        (17, "false_positive", "LOW", "LOW", None, None, None),
    ],
)

CRYPTO = Rows(
    "c",
    "id int, asset string, title string, cia string, exposure string, status string",
    [
        (1, "Internet Banking Portal", "RSA-2048", None, "EXTERNAL", "VULNERABLE"),
        (2, "Internal HR Portal", "SHA-1", None, "INTERNAL", "WEAK"),
        (3, "Archive Backup", "3DES", "C:HIGH | I:HIGH | A:NONE", "", "WEAK"),
        (4, "gateway-7", "TLS 1.0", "C:HIGH | I:MEDIUM | A:NONE", "EXTERNAL", "WEAK"),
        (5, "API Gateway", "AES-256", None, "EXTERNAL", "SAFE"),
        (6, None, None, None, None, None),
        (7, "x", "y", "C:Confidential (High - PII Data Present) | I:NONE | A:HIGH", "internal", "vulnerable"),
    ],
)
