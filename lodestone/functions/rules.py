"""Ordered keyword rules as data, and the classifications and scores that use them.

A rule list is [(value, keywords)]; the first rule with a keyword in the text
gives the value. ``classify`` compiles it to one CASE expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.predicates import any_contains

Rules = list[tuple[str, list[str]]]


def classify(text: Column, rules: Rules, default: str) -> Column:
    """The value of the first rule with a keyword in ``text`` (lower case)."""
    out = None
    for value, keywords in rules:
        hit = any_contains(text, keywords)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def joined(*columns: Column) -> Column:
    """Columns in lower case with spaces between, nulls as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


# Control, category and impact keywords.
CONTROLS: Rules = [
    ("VAPT-5", ["rce", "remote code execution", "directory traversal", "winrar", "buffer overflow"]),
    ("VAPT-7", ["privilege escalation", "privesc", "uac bypass", "sudo"]),
    ("VAPT-14", ["weak cipher", "ssl", "tls", "rc4", "3des", "cbc", "plaintext", "unencrypted", "default credentials", "default password"]),
    ("VAPT-4", ["web", "http", "https", "xss", "sqli", "csrf", "hsts", "cookie", "apache", "nginx", "iis", "owasp"]),
    ("VAPT-12", ["patch", "outdated", "update required", "installed version", "fixed version", "end of life", "eol"]),
    ("VAPT-10", ["api", "rest", "graphql", "jwt", "swagger", "openapi"]),
    ("VAPT-9", ["wireless", "wifi", "wpa", "802.11", "bluetooth"]),
    ("VAPT-8", ["phishing", "spf", "dkim", "dmarc", "social engineering"]),
    ("VAPT-2", ["reconnaissance", "osint", "whois", "dns zone"]),
    ("VAPT-13", ["firewall", "segmentation", "filtered port"]),
]
CONTROL_DEFAULT = "VAPT-3"
CRYPTO_CONTROLS: Rules = [
    ("PQC-3", ["ssh", "sshd", "openssh"]),
    ("PQC-4", ["ipsec", "vpn", " ike ", "ikev1", "ikev2", "phase 1", "phase 2", "phase1", "phase2"]),
    ("PQC-5", ["certificate", "x.509", "x509", "pki", "csr", "certificate authority", " ca "]),
    ("PQC-6", ["database", "tde", "transparent data encryption", "db encryption", "at-rest", "at rest", "data at rest"]),
    ("PQC-7", ["library", "dependency", "package", "sdk", "openssl version", "crypto library", "cryptographic library"]),
    ("PQC-8", ["hsm", "kms", "key management", "key vault", "keystore", "key store"]),
    ("PQC-9", ["code signing", "code-signing", "firmware signing", "firmware", "authenticode"]),
    ("PQC-2", ["tls", "ssl", "cipher suite", "https", "handshake"]),
]
CRYPTO_CONTROL_DEFAULT = "PQC-1"
CWE_GROUPS: dict[str, list[int]] = {
    "A01:2021 Broken Access Control": [22, 284, 285, 639, 862, 863],
    "A02:2021 Cryptographic Failures": [259, 326, 327, 331],
    "A03:2021 Injection": [79, 89, 77, 78, 94],
    "A04:2021 Insecure Design": [209, 522],
    "A05:2021 Security Misconfiguration": [16, 200, 693],
    "A06:2021 Vulnerable and Outdated Components": [937, 1104],
    "A07:2021 Identification & Auth Failures": [287, 384, 798],
    "A08:2021 Software and Data Integrity Failures": [502, 829],
    "A09:2021 Security Logging & Monitoring Failures": [778, 117],
    "A10:2021 Server-Side Request Forgery (SSRF)": [918],
}
OWASP: Rules = [
    ("A03:2021 Injection", ["xss", "sqli", "sql injection", "command injection", "ldap injection"]),
    ("A01:2021 Broken Access Control", ["access control", "privilege escalation", "directory traversal", "cors", "idor"]),
    ("A02:2021 Cryptographic Failures", ["weak cipher", "ssl", "tls", "plaintext", "unencrypted", "hsts"]),
    ("A06:2021 Vulnerable and Outdated Components", ["outdated", "end of life", "eol", "unpatched"]),
    ("A07:2021 Identification & Auth Failures", ["auth", "password", "session", "credential", "jwt"]),
    ("A10:2021 Server-Side Request Forgery (SSRF)", ["ssrf", "server-side request forgery"]),
]
OWASP_DEFAULT = "A05:2021 Security Misconfiguration"
CATEGORIES = {"A01": "Access Control", "A02": "Cryptographic Failures", "A03": "Injection", "A04": "Insecure Design", "A05": "Security Misconfiguration", "A06": "Vulnerable Components", "A07": "Authentication Failures", "A08": "Data Integrity Failures", "A09": "Logging & Monitoring", "A10": "SSRF"}
CONFIDENTIALITY: Rules = [
    ("HIGH", ["information disclosure", "data leak", "sensitive", "credential", "password", "token", "private key", "directory listing", "source code", "backup file", "database dump", "pii"]),
    ("MEDIUM", ["version disclosure", "banner", "stack trace", "error message", "server header", "configuration"]),
]
INTEGRITY: Rules = [
    ("HIGH", ["injection", "sqli", "xss", "csrf", "command injection", "code execution", "rce", "file upload", "deserialization"]),
    ("MEDIUM", ["open redirect", "clickjacking", "header injection"]),
]
AVAILABILITY: Rules = [
    ("HIGH", ["denial of service", "dos", "ddos", "buffer overflow", "resource exhaustion", "crash", "memory corruption"]),
    ("MEDIUM", ["rate limit", "timeout", "slow"]),
]
PRIORITIES: Rules = [
    ("CRITICAL", ["internet banking", "mobile banking", "core banking", "pki", "root ca", "vpn gateway", "payment switch", "payment", "swift", "atm"]),
    ("HIGH", ["api gateway", "api ", "load balancer", "firewall", "database", "oracle db", "customer data"]),
    ("MEDIUM", ["internal", "intranet", "hr portal", "employee", "erp"]),
    ("LOW", ["archive", "backup", "test environment", "sandbox", "staging"]),
]
PRIORITY_IMPACT = {"CRITICAL": (5, 5, 4), "HIGH": (4, 4, 3), "MEDIUM": (3, 2, 2), "LOW": (2, 1, 1)}
HARVEST = {("EXTERNAL", "VULNERABLE"): 5, ("EXTERNAL", "WEAK"): 4, ("INTERNAL", "VULNERABLE"): 3, ("EXTERNAL", "SAFE"): 2, ("INTERNAL", "WEAK"): 2}
LEVELS = ["LOW", "MODERATE", "HIGH"]
RISK_MATRIX = {("LOW", "LOW"): "LOW", ("LOW", "MODERATE"): "LOW", ("LOW", "HIGH"): "MEDIUM", ("MODERATE", "LOW"): "LOW", ("MODERATE", "MODERATE"): "MEDIUM", ("MODERATE", "HIGH"): "HIGH", ("HIGH", "LOW"): "MEDIUM", ("HIGH", "MODERATE"): "HIGH", ("HIGH", "HIGH"): "CRITICAL"}
RISK_PRIORITY = {"LOW": "P4 Low", "MEDIUM": "P3 Medium", "HIGH": "P2 High", "CRITICAL": "P1 Critical"}
#: (keywords, score, impact part of the vector) of web findings, in order.
WEB_SCORES = [
    (["sql injection"], 9.8, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    (["xml external entity", "xxe"], 9.1, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N"),
    (["template injection", "csti"], 8.5, "AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N"),
    (["external service interaction (http)", "ssrf"], 8.6, "AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:N/A:N"),
    (["cross-site scripting", "xss"], 7.2, "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    (["open redirection", "open redirect"], 6.1, "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    (["javascript dependency", "cve-2020-7676"], 5.3, "AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N"),
    (["autocomplete"], 3.5, "AV:P/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N"),
    (["strict transport security", "hsts"], 3.5, "AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N"),
]
BAND_SCORES = {"CRITICAL": 9.8, "HIGH": 8.0, "MEDIUM": 5.5, "LOW": 2.5}


def severity(label: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM, LOW or INFO by what the label contains."""
    up = F.upper(F.trim(F.coalesce(label, F.lit("INFO"))))
    return F.when(F.contains(up, F.lit("CRIT")), "CRITICAL").when(F.contains(up, F.lit("HIGH")), "HIGH").when(F.contains(up, F.lit("MED")), "MEDIUM").when(F.contains(up, F.lit("LOW")), "LOW").otherwise("INFO")


def score_band(score: Column) -> Column:
    """Bands of a base score: 9, 7, 4, above 0."""
    return F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").when(score > 0.0, "LOW").otherwise("INFO")


def vector_estimate(vector: Column) -> Column:
    """A rough base score from a vector's AV and AC parts: ten times their product, to one decimal."""
    av = F.create_map(*[F.lit(x) for kv in {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}.items() for x in kv])
    ac = F.create_map(*[F.lit(x) for kv in {"L": 0.77, "H": 0.44}.items() for x in kv])
    a, c = F.upper(F.regexp_extract(vector, r"(?i)AV:([NALP])", 1)), F.upper(F.regexp_extract(vector, r"(?i)AC:([LH])", 1))
    return F.when((a != "") & (c != ""), F.bround(F.element_at(av, a) * F.element_at(ac, c) * 10, 1))


def dedup_key(tool: Column, title: Column, target: Column, cves: Column, plugin: Column) -> Column:
    """CVEs, else tool and plugin, else tool and title, each with the target; 480 characters at most."""
    at = F.concat(F.lit("|target:"), F.lower(F.trim(F.coalesce(target, F.lit("")))))
    name = F.lower(F.trim(F.coalesce(F.nullif(tool, F.lit("")), F.lit("generic"))))
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(cves, F.array().cast("array<string>")), lambda c: F.upper(F.trim(c))), lambda c: c.isNotNull() & (c != ""))))
    plug = F.trim(F.coalesce(plugin, F.lit("")))
    own = (plug != "") & ~plug.isin("burp-pdf", "burp-issue", "generic")
    called = F.lower(F.trim(F.coalesce(F.nullif(title, F.lit("")), F.lit("unnamed"))))
    key = F.when(F.size(clean) > 0, F.concat(F.lit("CVE:"), F.array_join(clean, ":"), at)).when(own, F.concat(name, F.lit(":"), plug, at)).otherwise(F.concat(name, F.lit(":"), called, at))
    return F.substring(key, 1, 480)


def short_dedup_key(title: Column, target: Column, cves: Column, plugin: Column) -> Column:
    """The variant without a tool: cve:, plugin: or title: and the target."""
    at = F.concat(F.lit("|target:"), F.lower(F.trim(F.coalesce(target, F.lit("")))))
    clean = F.array_sort(F.filter(F.transform(F.coalesce(cves, F.array().cast("array<string>")), lambda c: F.trim(F.upper(c))), lambda c: c.isNotNull() & (c != "")))
    plug = F.trim(F.coalesce(plugin, F.lit("")))
    return F.when(F.size(clean) > 0, F.concat(F.lit("cve:"), F.array_join(clean, ","), at)).when(plug != "", F.concat(F.lit("plugin:"), plug, at)).otherwise(F.concat(F.lit("title:"), F.lower(F.trim(F.coalesce(title, F.lit("")))), at))


def control(*columns: Column) -> Column:
    return classify(joined(*columns), CONTROLS, CONTROL_DEFAULT)


def crypto_control(*columns: Column) -> Column:
    return classify(joined(*columns), CRYPTO_CONTROLS, CRYPTO_CONTROL_DEFAULT)


def owasp(cwe: Column, title: Column, description: Column) -> Column:
    """By the number in the weakness id, else by keywords."""
    table = F.create_map(*[F.lit(x) for name, ids in CWE_GROUPS.items() for i in ids for x in (str(i), name)])
    number = F.regexp_replace(F.coalesce(cwe, F.lit("")), "[^0-9]", "")
    return F.coalesce(F.element_at(table, number), classify(joined(title, description), OWASP, OWASP_DEFAULT))


def risk_category(title: Column, description: Column, evidence: Column) -> Column:
    """The readable category of the finding's OWASP class, with a weakness id taken from its text."""
    cwe = F.regexp_extract(joined(title, description, evidence), r"cwe-(\d+)", 0)
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.element_at(table, F.substring(owasp(cwe, title, description), 1, 3))


def impact(title: Column, description: Column, evidence: Column, remediation: Column, crypto: Column) -> tuple[Column, Column]:
    """("C:.. | I:.. | A:..", personal data shown) of a finding; ``crypto`` marks findings of the crypto scanner."""
    text = joined(title, description, evidence, remediation)
    personal = ~crypto & T.has_personal_data(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, description, evidence, remediation)]))
    c = F.when(crypto, "HIGH").when(personal, "Confidential (High - PII Data Present)").otherwise(classify(text, CONFIDENTIALITY, "NONE"))
    i = F.when(crypto, "HIGH").otherwise(classify(text, INTEGRITY, "NONE"))
    return F.concat(F.lit("C:"), c, F.lit(" | I:"), i, F.lit(" | A:"), classify(text, AVAILABILITY, "NONE")), personal


def business_priority(*columns: Column) -> Column:
    return classify(F.lower(F.concat_ws(" ", *columns)), PRIORITIES, "")


def crypto_risk(priority: Column, cia: Column, exposure: Column, status: Column) -> tuple[Column, Column]:
    """(score 0-100, band): impact by business priority (or the impact string), harvest exposure, quantum weakness, each 1-5."""

    def letter(name: str, floor: int) -> Column:
        part = F.upper(F.regexp_extract(F.coalesce(cia, F.lit("")), rf"(?i)(?:^|\|)\s*{name}:([^|]*)", 1))
        value = F.when(F.contains(part, F.lit("HIGH")), 5).when(F.contains(part, F.lit("MEDIUM")), 3).otherwise(1)
        return F.greatest(value, F.lit(floor))

    band = F.upper(F.trim(F.coalesce(priority, F.lit(""))))
    scores = []
    for i, (name, floor) in enumerate((("C", 2), ("I", 2), ("A", 1))):
        out = None
        for key, values in PRIORITY_IMPACT.items():
            out = F.when(band == key, values[i]) if out is None else out.when(band == key, values[i])
        scores.append(out.otherwise(letter(name, floor)))
    e, q = F.upper(F.trim(F.coalesce(exposure, F.lit("")))), F.upper(F.trim(F.coalesce(status, F.lit(""))))
    harvest = None
    for (a, b), value in HARVEST.items():
        hit = (e == a) & (q == b)
        harvest = F.when(hit, value) if harvest is None else harvest.when(hit, value)
    weak = F.when(q == "VULNERABLE", 5).when(q == "WEAK", 3).otherwise(1)
    total = scores[0] + scores[1] + scores[2] + harvest.otherwise(1) + weak
    score = F.bround(total / 25 * 100, 0).cast("int")
    return score, F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def web_score(title: Column, label: Column) -> tuple[Column, Column]:
    """(score, vector) of a web finding: an informational label first, then the title, then the label."""
    t, up = F.lower(F.coalesce(title, F.lit(""))), F.upper(F.trim(F.coalesce(label, F.lit(""))))
    rows = [(F.contains(up, F.lit("INFO")), 0.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N")]
    rows += [(any_contains(t, keys), score, vector) for keys, score, vector in WEB_SCORES]
    rows += [(F.contains(up, F.lit("HIGH")), 8.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N"), (F.contains(up, F.lit("MED")), 5.5, "AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N"), (F.contains(up, F.lit("LOW")), 2.5, "AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N")]
    score = vector = None
    for hit, s, v in rows:
        score = F.when(hit, s) if score is None else score.when(hit, s)
        vector = F.when(hit, v) if vector is None else vector.when(hit, v)
    return score.otherwise(0.0), F.concat(F.lit("CVSS:3.1/"), vector.otherwise(rows[0][2]))


def report_severity(score: Column, label: Column) -> tuple[Column, Column]:
    """(band, score): a positive score gives the band; otherwise the label gives band and default score."""
    named = severity(label)
    table = F.create_map(*[F.lit(x) for kv in BAND_SCORES.items() for x in kv])
    known = F.coalesce(score > 0, F.lit(False))
    return F.when(known, score_band(score)).otherwise(named), F.when(known, score).otherwise(F.coalesce(F.element_at(table, named), F.lit(0.0)))


def risk_levels(status: Column, likelihood: Column, impact_level: Column, policy: Column, evidence: Column, assessment: Column) -> dict[str, Column]:
    """likelihood, impact, risk_level and severity by the 3 x 3 matrix, with defaults by what was found."""

    def up(c: Column) -> Column:
        return F.upper(F.trim(F.coalesce(c, F.lit(""))))

    lh, im, pol, ev = up(likelihood), up(impact_level), up(policy), up(evidence)
    lh_ok, im_ok = lh.isin(LEVELS), im.isin(LEVELS)
    done = up(status).isin("COMPLIANT", "FALSE_POSITIVE")
    cases = [
        ((pol == "FOUND") & (ev == "NOT_FOUND"), "LOW", "MODERATE"),
        ((pol == "NOT_FOUND") & (ev == "NOT_FOUND"), "MODERATE", "HIGH"),
        ((pol == "NOT_FOUND") & (ev == "FOUND"), "LOW", "LOW"),
        ((pol == "FOUND") & (ev == "FOUND") & (up(assessment) == "NON_COMPLIANT"), "MODERATE", "MODERATE"),
    ]
    a, b = F.when(done, "N/A").when(lh_ok & im_ok, lh), F.when(done, "N/A").when(lh_ok & im_ok, im)
    for hit, d1, d2 in cases:
        a = a.when(hit, F.when(lh_ok, lh).otherwise(d1))
        b = b.when(hit, F.when(im_ok, im).otherwise(d2))
    a, b = a.otherwise("N/A"), b.otherwise("N/A")
    level = F.when(done, "N/A")
    for (x, y), value in RISK_MATRIX.items():
        level = level.when((a == x) & (b == y), value)
    level = level.otherwise("UNDETERMINED")
    table = F.create_map(*[F.lit(x) for kv in RISK_PRIORITY.items() for x in kv])
    return {"likelihood": a, "impact": b, "risk_level": level, "severity": F.coalesce(F.element_at(table, level), F.lit("N/A"))}
