"""Security-scanner exports to finding rows: XML, JSON, CSV and text, by Spark's own parsers and expressions.

Each parser takes a frame with (file, content), one whole export a row, and
returns rows of one schema, ``FINDING``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R

FINDING = ["file", "tool", "plugin", "title", "severity", "score", "vector", "cves", "target", "description", "remediation", "evidence"]
#: Severity numbers (fixed values of the formats).
NUMERIC = {"4": "CRITICAL", "3": "HIGH", "2": "MEDIUM", "1": "LOW", "0": "INFO"}
QUALYS_NUMERIC = {"5": "CRITICAL", "4": "HIGH", "3": "MEDIUM", "2": "LOW", "1": "INFO"}
#: CSV column names by meaning (fixed values).
COLUMN_ALIASES = {
    "plugin": ["qid"],
    "title": ["title", "vulnerability title"],
    "severity": ["severity"],
    "cve": ["cve id", "cve", "cve ids"],
    "solution": ["solution", "remediation"],
    "threat": ["threat", "impact", "description", "vulnerability description"],
    "ip": ["ip", "ip address"],
    "dns": ["dns", "fqdn", "netbios"],
    "port": ["port"],
    "protocol": ["protocol"],
    "score": ["cvss3.1", "cvss3", "cvss", "cvss base", "cvss3.1 base"],
}
CVE = r"(?i)CVE-\d{4}-\d{4,7}"

_ITEM = "struct<_port:string,_svc_name:string,_protocol:string,_severity:string,_pluginID:string,_pluginName:string,risk_factor:string,cvss3_base_score:string,cvss_base_score:string,cvss3_vector:string,cvss_vector:string,cve:array<string>,description:string,synopsis:string,solution:string,plugin_output:string>"
_NESSUS = f"Report struct<ReportHost:array<struct<_name:string,HostProperties:struct<tag:array<struct<_name:string,_VALUE:string>>>,ReportItem:array<{_ITEM}>>>>"
_NMAP = "host array<struct<address:array<struct<_addr:string,_addrtype:string>>,hostnames:struct<hostname:array<struct<_name:string>>>,ports:struct<port:array<struct<_portid:string,_protocol:string,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string>,script:array<struct<_id:string,_output:string>>>>>>>"
_TRIVY = "ArtifactName string, Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Title:string,Description:string,Severity:string,CVSS:map<string,struct<V3Score:double,V3Vector:string,V2Score:double,V2Vector:string>>>>,Misconfigurations:array<struct<ID:string,Title:string,Severity:string,Description:string,Resolution:string,Message:string>>>>"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _filled(*columns: Column) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def nessus_xml(files: DataFrame) -> DataFrame:
    """Hosts and their items; the risk factor names the severity, else the severity number."""
    hosts = files.select("file", F.explode(F.from_xml("content", _NESSUS, {"rowTag": "NessusClientData_v2"})["Report"]["ReportHost"]).alias("h"))
    ip = F.filter(F.col("h.HostProperties.tag"), lambda t: F.lower(t["_name"]) == "host-ip")
    rows = hosts.select("file", F.coalesce(_filled(F.get(ip, F.lit(0))["_VALUE"]), _filled(F.col("h._name")), F.lit("Unknown Host")).alias("host"), F.explode("h.ReportItem").alias("i"))
    factor = F.lower(F.trim(F.coalesce("i.risk_factor", F.lit(""))))
    label = F.when(~factor.isin("", "none"), F.when(factor == "informational", "INFO").otherwise(F.upper(factor))).otherwise(F.coalesce(F.element_at(_map(NUMERIC), F.trim("i._severity")), F.lit("INFO")))
    vector = _filled(F.col("i.cvss3_vector"), F.col("i.cvss_vector"))
    port, service = F.coalesce(F.trim("i._port"), F.lit("0")), F.coalesce(F.trim("i._svc_name"), F.lit(""))
    at = F.concat("host", F.lit(":"), port, F.lit("/"), F.coalesce("i._protocol", F.lit("tcp")), F.when(~service.isin("", "general"), F.concat(F.lit(" ("), service, F.lit(")"))).otherwise(""))
    text = _filled(F.col("i.description"), F.col("i.synopsis"))
    return rows.select(
        "file",
        F.lit("Nessus").alias("tool"),
        F.col("i._pluginID").alias("plugin"),
        F.coalesce(_filled(F.col("i._pluginName")), F.concat(F.lit("Nessus Plugin "), F.col("i._pluginID")), F.lit("Nessus Vulnerability Finding")).alias("title"),
        R.severity(label).alias("severity"),
        _filled(F.col("i.cvss3_base_score"), F.col("i.cvss_base_score")).try_cast("double").alias("score"),
        F.when(F.startswith(F.upper(vector), F.lit("CVSS:")), vector).otherwise(F.concat(F.lit("CVSS:3.0/"), vector)).alias("vector"),
        F.array_sort(F.array_distinct(F.coalesce("i.cve", F.array().cast("array<string>")))).alias("cves"),
        F.when(port.isin("", "0"), F.col("host")).otherwise(at).alias("target"),
        text.alias("description"),
        F.trim("i.solution").alias("remediation"),
        F.coalesce(_filled(F.col("i.plugin_output")), F.substring(text, 1, 500)).alias("evidence"),
    )


def nmap_ports(files: DataFrame) -> DataFrame:
    """(file, target, port, state, service, scripts) of the ports in XML output; the host label is "name (address)"."""
    h = files.select("file", F.explode(F.from_xml("content", _NMAP, {"rowTag": "nmaprun"})["host"]).alias("h"))
    v4 = F.get(F.filter("h.address", lambda a: a["_addrtype"] == "ipv4"), F.lit(0))["_addr"]
    ip = F.coalesce(v4, F.get("h.address", F.lit(0))["_addr"], F.lit(""))
    name = F.coalesce(F.get("h.hostnames.hostname", F.lit(0))["_name"], F.lit(""))
    label = F.when((name != "") & (ip != ""), F.concat(name, F.lit(" ("), ip, F.lit(")"))).otherwise(F.coalesce(F.nullif(ip, F.lit("")), F.nullif(name, F.lit("")), F.lit("Target Host")))
    p = h.select("file", label.alias("target"), F.explode("h.ports.port").alias("p"))
    service = F.concat_ws(" ", F.nullif("p.service._name", F.lit("")), F.nullif("p.service._product", F.lit("")), F.nullif("p.service._version", F.lit("")))
    return p.select("file", "target", F.concat_ws("/", "p._portid", F.coalesce("p._protocol", F.lit("tcp"))).alias("port"), F.col("p.state._state").alias("state"), service.alias("service"), F.col("p.script").alias("scripts"))


def nmap_scripts(files: DataFrame) -> DataFrame:
    """Findings of scripts that name CVEs or are vulnerability scripts; one of each evidence."""
    s = nmap_ports(files).select("file", "target", "port", F.explode("scripts").alias("s"))
    out, cves = F.col("s._output"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("s._output"), F.lit(CVE), F.lit(0))))
    evidence = F.trim(F.concat("s._id", F.lit(": "), out))
    hits = s.where((out != "") & (F.contains(F.lower("s._id"), F.lit("-vuln")) | (F.size(cves) > 0)))
    rows = hits.select(
        "file", F.lit("Nmap").alias("tool"), F.col("s._id").alias("plugin"),
        F.concat(F.lit("Nmap: Vuln Script Finding: "), F.substring(evidence, 1, 60), F.lit(" ("), F.col("port"), F.lit(")")).alias("title"),
        F.when(F.size(cves) > 0, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("vector"),
        cves.alias("cves"), "target", F.lit("Script result").alias("description"), F.lit("Investigate and patch").alias("remediation"), evidence.alias("evidence"),
    )
    return rows.dropDuplicates(["file", "evidence"])


def nmap_grepable(files: DataFrame) -> DataFrame:
    """(file, target, port, state, service) from one-line-a-host output."""
    lines = files.select("file", F.explode(F.split("content", "\n")).alias("line")).where(F.startswith("line", F.lit("Host:")))
    ip, name = F.regexp_extract("line", r"^Host:\s+(\S+)", 1), F.regexp_extract("line", r"^Host:\s+\S+\s*\(([^)]*)\)", 1)
    ports = F.regexp_extract("line", r"Ports:\s*(.+?)(?:\tIgnored State:|\t[A-Z][a-z]+:|$)", 1)
    rows = lines.select("file", F.when(F.trim(name) != "", F.concat(F.trim(name), F.lit(" ("), ip, F.lit(")"))).otherwise(ip).alias("target"), F.explode(F.split(ports, r",\s*(?=\d+/)")).alias("p"))
    part = F.split(F.trim("p"), "/")
    return rows.where("p <> ''").select("file", "target", F.concat_ws("/", part[0], part[2]).alias("port"), part[1].alias("state"), F.trim(F.concat_ws(" ", F.get(part, F.lit(4)), F.get(part, F.lit(6)))).alias("service"))


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column for each meaning: the first alias that the frame has (names compared in lower case), else null."""
    have = {c.strip().lower(): c for c in df.columns}
    return df.select(*[next((F.col(f"`{have[a]}`") for a in names if a in have), F.lit(None)).cast("string").alias(k) for k, names in aliases.items()])


def qualys_rows(df: DataFrame, file: str = "export.csv") -> DataFrame:
    """Findings of a CSV export read with a header; severities are numbers 1 to 5."""
    x = with_aliases(df, COLUMN_ALIASES)
    number = F.trim("severity")
    cves = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("cve", F.lit(""))), F.lit(CVE), F.lit(0))))
    host = F.coalesce(_filled(F.col("ip")), _filled(F.col("dns")), F.lit("Unknown Host"))
    return x.where(F.coalesce(F.trim("title"), F.lit("")) != "").select(
        F.lit(file).alias("file"), F.lit("Qualys").alias("tool"), "plugin", F.trim("title").alias("title"),
        R.severity(F.coalesce(F.element_at(_map(QUALYS_NUMERIC), number), number)).alias("severity"),
        F.regexp_extract("score", r"(\d+(?:\.\d+)?)", 1).try_cast("double").alias("score"), F.lit(None).cast("string").alias("vector"), cves.alias("cves"),
        F.concat(host, F.when(F.coalesce(F.trim("port"), F.lit("")) != "", F.concat(F.lit(":"), F.trim("port"))).otherwise("")).alias("target"),
        F.col("threat").alias("description"), F.col("solution").alias("remediation"), F.col("threat").alias("evidence"),
    )


def trivy_json(files: DataFrame) -> DataFrame:
    """Vulnerabilities and misconfigurations of each result."""
    r = files.select("file", F.from_json("content", _TRIVY).alias("j")).select("file", F.col("j.ArtifactName").alias("artifact"), F.explode("j.Results").alias("r"))
    at = F.coalesce(F.nullif("r.Target", F.lit("")), F.nullif("artifact", F.lit("")), F.col("file"))
    v = r.select("file", at.alias("target"), F.explode("r.Vulnerabilities").alias("v"))
    first = F.get(F.filter(F.map_values("v.CVSS"), lambda c: c["V3Score"].isNotNull()), F.lit(0))
    second = F.get(F.filter(F.map_values("v.CVSS"), lambda c: c["V2Score"].isNotNull()), F.lit(0))
    fixed = F.coalesce("v.FixedVersion", F.lit(""))
    title = F.coalesce(F.nullif("v.Title", F.lit("")), F.nullif("v.VulnerabilityID", F.lit("")), F.concat(F.lit("Vulnerable package: "), F.col("v.PkgName")))
    repair = F.when(fixed != "", F.concat(F.lit("Update "), F.col("v.PkgName"), F.lit(" from "), F.col("v.InstalledVersion"), F.lit(" to fixed version "), fixed, F.lit("."))).otherwise(F.concat(F.lit("No fixed version available yet for "), F.col("v.PkgName"), F.lit(" "), F.col("v.InstalledVersion"), F.lit("; monitor vendor advisory for "), F.col("v.VulnerabilityID"), F.lit(".")))
    none = F.array().cast("array<string>")
    a = v.select(
        "file", F.lit("Trivy").alias("tool"), F.col("v.VulnerabilityID").alias("plugin"), title.alias("title"), R.severity(F.col("v.Severity")).alias("severity"),
        F.coalesce(first["V3Score"], second["V2Score"]).alias("score"), F.coalesce(first["V3Vector"], second["V2Vector"]).alias("vector"),
        F.when(F.startswith(F.upper("v.VulnerabilityID"), F.lit("CVE-")), F.array("v.VulnerabilityID")).otherwise(none).alias("cves"), "target",
        F.coalesce(F.nullif("v.Description", F.lit("")), title).alias("description"), repair.alias("remediation"),
        F.concat(F.lit("Package: "), F.col("v.PkgName"), F.lit(" | Installed: "), F.col("v.InstalledVersion"), F.lit(" | Fixed: "), F.coalesce(F.nullif(fixed, F.lit("")), F.lit("N/A"))).alias("evidence"),
    )
    m = r.select("file", at.alias("target"), F.explode("r.Misconfigurations").alias("m"))
    title = F.coalesce(F.nullif("m.Title", F.lit("")), F.nullif("m.ID", F.lit("")), F.lit("Misconfiguration"))
    b = m.select(
        "file", F.lit("Trivy").alias("tool"), F.col("m.ID").alias("plugin"), title.alias("title"), R.severity(F.col("m.Severity")).alias("severity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("vector"), none.alias("cves"), "target",
        F.coalesce(F.nullif("m.Description", F.lit("")), title).alias("description"), F.coalesce("m.Resolution", F.lit("Review and remediate the misconfiguration.")).alias("remediation"), F.coalesce("m.Message", F.lit("")).alias("evidence"),
    )
    return a.unionByName(b)


def burp_xml(files: DataFrame) -> DataFrame:
    """Issues of a web scan, scored by title and label."""
    schema = "issue array<struct<name:string,host:struct<_VALUE:string,_ip:string>,path:string,severity:string,confidence:string,issueDetail:string,issueBackground:string,remediationBackground:string>>"
    i = files.select("file", F.explode(F.from_xml("content", schema, {"rowTag": "issues"})["issue"]).alias("i"))
    score, vector = R.web_score(F.col("i.name"), F.col("i.severity"))
    return i.select(
        "file", F.lit("Burp").alias("tool"), F.lit("burp-issue").alias("plugin"), F.col("i.name").alias("title"), R.severity(F.col("i.severity")).alias("severity"), score.alias("score"), vector.alias("vector"),
        F.array().cast("array<string>").alias("cves"), F.concat(F.coalesce("i.host._VALUE", F.lit("")), F.coalesce("i.path", F.lit(""))).alias("target"), F.coalesce("i.issueBackground", "i.issueDetail").alias("description"), F.col("i.remediationBackground").alias("remediation"), F.col("i.issueDetail").alias("evidence"),
    )


#: Signatures: (tool, structural marks, weak phrases); one mark or two phrases claim a file (fixed values).
SIGNATURES = [
    ("nessus", ["<nessusclientdata_v2", "<reporthost"], ["nessus", "plugin id", "tenable", "risk factor"]),
    ("nmap", ["<nmaprun", "nmap scan report for", "# nmap "], ["port state service", "host is up", "nmap done"]),
    ("burp", ["<issues burpversion", "<serialnumber>"], ["burp suite", "issue detail", "issue background"]),
    ("qualys", ["<host_list_vm_detection_output", "\"qid\""], ["qualys", "qid", "vulnerability title"]),
    ("trivy", ["\"schemaversion\"", "\"vulnerabilities\""], ["trivy", "installedversion", "fixedversion"]),
]


def route(content: Column) -> Column:
    """The first tool whose signature the content has; ``generic`` if none."""
    x = F.lower(F.coalesce(content, F.lit("")))
    out = None
    for tool, marks, phrases in SIGNATURES:
        strong = F.lit(False)
        for m in marks:
            strong = strong | F.contains(x, F.lit(m))
        weak = sum((F.contains(x, F.lit(p)).cast("int") for p in phrases), F.lit(0))
        out = F.when(strong | (weak >= 2), tool) if out is None else out.when(strong | (weak >= 2), tool)
    return out.otherwise("generic")


# Cryptographic algorithm patterns in order of precedence (id, pattern, status, category, severity).
ALGORITHMS = [
    ("rsa-small", r"\bRSA[\s\-_]?(?:512|1024|2048)\b|\bdefault[_\-]bits\s*=\s*(?:512|1024|2048)\b", "VULNERABLE", "Asymmetric Encryption (RSA)", "CRITICAL"),
    ("rsa-large", r"\bRSA[\s\-_]?(?:3072|4096)\b|\bdefault[_\-]bits\s*=\s*(?:3072|4096)\b", "VULNERABLE", "Asymmetric Encryption (RSA)", "HIGH"),
    ("rsa-generic", r"\bRSA\b(?!\s*[\d])", "VULNERABLE", "Asymmetric Encryption (RSA)", "CRITICAL"),
    ("dsa", r"\bDSA\b", "VULNERABLE", "Asymmetric Digital Signature (DSA)", "CRITICAL"),
    ("dh-small", r"\bDH\s*Group\s*(?:1[0-4]|[1-9])\b", "VULNERABLE", "Key Exchange (Diffie-Hellman)", "CRITICAL"),
    ("dh-large", r"\bDH\s*Group\s*1[5-8]\b", "VULNERABLE", "Key Exchange (Diffie-Hellman)", "HIGH"),
    ("dhe", r"\bDHE\b|\bDiffie[\s\-]?Hellman\b", "VULNERABLE", "Key Exchange (Diffie-Hellman)", "HIGH"),
    ("ecc-curve", r"\b(?:P-256|P-384|P-521|secp256r1|secp384r1|secp521r1|secp256k1|Curve25519|X25519|Ed25519)\b", "VULNERABLE", "Elliptic Curve Cryptography (ECC)", "HIGH"),
    ("ecc-generic", r"\b(?:ECDSA|ECDH|ECC)\b", "VULNERABLE", "Elliptic Curve Cryptography (ECC)", "HIGH"),
    ("md5", r"\bMD5\b", "WEAK", "Hash Function", "HIGH"),
    ("sha1", r"\bSHA[\s\-_]?1(?!\d)", "WEAK", "Hash Function", "HIGH"),
    ("3des", r"\b(?:3DES|Triple[\s\-]?DES|TripleDES)\b", "WEAK", "Symmetric Cipher", "CRITICAL"),
    ("des", r"\bDES\b", "WEAK", "Symmetric Cipher", "CRITICAL"),
    ("rc4", r"\bRC4\b", "WEAK", "Symmetric Cipher", "CRITICAL"),
    ("ssl", r"\bSSL\s?v?[23]\b", "WEAK", "Protocol Version", "CRITICAL"),
    ("tls10", r"\bTLS\s?v?1(?:\.0)?(?![\.\d])", "WEAK", "Protocol Version", "CRITICAL"),
    ("tls11", r"\bTLS\s?v?1\.1\b", "WEAK", "Protocol Version", "CRITICAL"),
    ("cbc-mode", r"\bCBC\b", "WEAK", "Cipher Mode", "MEDIUM"),
    ("aes256-gcm", r"\bAES[\s\-_]?256[\s\-_]?GCM\b|TLS_AES_256_GCM", "SAFE", "Symmetric Cipher (AEAD)", "INFO"),
    ("aes", r"\bAES[\s\-_]?(?:128|256)\b", "SAFE", "Symmetric Cipher", "INFO"),
    ("sha2", r"\bSHA[\s\-_]?(?:256|384|512)\b", "SAFE", "Hash Function", "INFO"),
    ("sha3", r"\bSHA[\s\-_]?3\b", "SAFE", "Hash Function", "INFO"),
    ("kyber", r"\b(?:CRYSTALS[\s\-]?Kyber|ML[\s\-]?KEM)\b", "SAFE", "PQC Key Encapsulation (NIST-selected)", "INFO"),
    ("dilithium", r"\b(?:CRYSTALS[\s\-]?Dilithium|ML[\s\-]?DSA)\b", "SAFE", "PQC Digital Signature (NIST-selected)", "INFO"),
    ("sphincs", r"\bSPHINCS[+]?(?:-SHA\d+)?\b|\bSLH[\s\-]?DSA\b", "SAFE", "PQC Digital Signature (NIST-selected)", "INFO"),
    ("falcon", r"\b(?:Falcon|FN[\s\-]?DSA)\b", "SAFE", "PQC Digital Signature (NIST-selected)", "INFO"),
    ("chacha20", r"\bChaCha20[\s\-_]?Poly1305\b|TLS[_\-]CHACHA20[_\-]POLY1305", "SAFE", "Symmetric Cipher (AEAD)", "INFO"),
]


def crypto_findings(files: DataFrame) -> DataFrame:
    """(file, priority, start, end, rule, found, status, category, severity): matches in rule order that overlap no earlier one.

    A text's matches are taken inside its row, so there is no shuffle.
    """
    rules = [(i, name, re.compile(p, re.I), *rest) for i, (name, p, *rest) in enumerate(ALGORITHMS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                taken: list[tuple[int, int]] = []
                for i, name, pattern, status, category, severity in rules:
                    for m in pattern.finditer(content or ""):
                        # spans taken are apart, so only the neighbours can overlap
                        at = bisect.bisect(taken, m.span())
                        if (at == 0 or taken[at - 1][1] <= m.start()) and (at == len(taken) or taken[at][0] >= m.end()):
                            taken.insert(at, m.span())
                            out.append((file, i, m.start(), m.end(), name, m.group(), status, category, severity))
            yield pd.DataFrame(out, columns=["file", "priority", "start", "end", "rule", "found", "status", "category", "severity"])

    return files.select("file", "content").mapInPandas(run, "file string, priority int, start int, end int, rule string, found string, status string, category string, severity string")


def dependency_chains(content: Column) -> Column:
    """Chains "A -> B -> C" in the lines of a text, as arrays of two or more names."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike("->|→"))
    return F.filter(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\s*(?:->|→)\s*"), lambda p: F.trim(p)), lambda p: p != "")), lambda c: F.size(c) >= 2)


def chain_flags(findings: DataFrame, chains: DataFrame) -> DataFrame:
    """``findings`` (asset, status) with ``linked``: another asset of one of its chains is vulnerable."""
    members = chains.select("chain_id", F.explode("chain").alias("asset")).distinct()
    bad = findings.where("status = 'VULNERABLE'").select("asset").distinct()
    counted = members.join(bad, "asset", "left_semi").groupBy("chain_id").agg(F.count("*").alias("n_bad"))
    own = members.join(bad.withColumn("own", F.lit(1)), "asset", "left").join(counted, "chain_id")
    linked = own.where(F.col("n_bad") > F.coalesce("own", F.lit(0))).select("asset").distinct().withColumn("linked", F.lit(True))
    return findings.join(linked, "asset", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
