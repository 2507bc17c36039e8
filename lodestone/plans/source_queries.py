"""Scanner exports, file operators and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql.window import Window

from lodestone.operators import windows as W
from lodestone.plans.fixtures import Rows
from lodestone.plans.registry import query, table
from lodestone.sources import files as S
from lodestone.sources import scanners as X
from lodestone.streaming import counters as C
from lodestone.streaming import sessions as L

NESSUS = """<NessusClientData_v2><Report name="r"><ReportHost name="web01"><HostProperties><tag name="host-ip">10.0.0.9</tag><tag name="os">linux</tag></HostProperties>
<ReportItem port="443" svc_name="www" protocol="tcp" severity="3" pluginID="100" pluginName="Weak TLS"><risk_factor>High</risk_factor><cvss3_base_score>7.4</cvss3_base_score><cvss3_vector>AV:N/AC:H</cvss3_vector><cve>CVE-2024-0002</cve><cve>CVE-2024-0001</cve><description>weak</description><solution>fix</solution><plugin_output>out</plugin_output></ReportItem>
<ReportItem port="0" svc_name="general" protocol="tcp" severity="0" pluginID="101" pluginName="Host info"><risk_factor>None</risk_factor><description>info only</description></ReportItem>
</ReportHost><ReportHost name="db01"><ReportItem port="1433" svc_name="mssql" protocol="tcp" severity="4" pluginID="102" pluginName="Old SQL"><description>old</description></ReportItem></ReportHost></Report></NessusClientData_v2>"""
NMAP = """<nmaprun><host><address addr="10.0.0.3" addrtype="ipv4"/><hostnames><hostname name="gw"/></hostnames><ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="OpenSSH" version="8.2"/></port><port protocol="tcp" portid="445"><state state="open"/><service name="smb"/><script id="smb-vuln-ms17-010" output="VULNERABLE: CVE-2017-0143"/><script id="banner" output="hello"/></port></ports></host></nmaprun>"""
GREPABLE = "# Nmap 7\nHost: 10.0.0.4 (app)\tPorts: 22/open/tcp//ssh//OpenSSH 8/, 80/closed/tcp//http///\tIgnored State: filtered (998)\nHost: 10.0.0.5 ()\tPorts: 53/open/udp//domain///"
TRIVY = '{"SchemaVersion": 2, "ArtifactName": "img", "Results": [{"Target": "app.jar", "Vulnerabilities": [{"VulnerabilityID": "CVE-2021-44228", "PkgName": "log4j", "InstalledVersion": "2.14", "FixedVersion": "2.17", "Title": "Log4Shell", "Severity": "CRITICAL", "CVSS": {"nvd": {"V3Score": 10.0, "V3Vector": "CVSS:3.1/AV:N"}}}, {"VulnerabilityID": "GHSA-1", "PkgName": "x", "InstalledVersion": "1", "Severity": "UNKNOWN"}]}, {"Target": "Dockerfile", "Misconfigurations": [{"ID": "DS002", "Title": "root user", "Severity": "HIGH", "Resolution": "Add USER", "Message": "no USER"}]}]}'
BURP = '<issues burpVersion="2"><issue><name>SQL injection</name><host ip="1.2.3.4">https://shop</host><path>/q</path><severity>High</severity><confidence>Certain</confidence><issueDetail>detail</issueDetail></issue><issue><name>Cross-site scripting (stored)</name><host ip="1.2.3.4">https://shop</host><path>/c</path><severity>Information</severity><issueDetail>i</issueDetail></issue></issues>'
CRYPTO = "Certificate : RSA2048\nKey Exchange : DH Group 14 then DH Group 16\nCurve : P-256\nSignature : Ed25519\nHash : MD5 and SHA1\nCipher : 3DES\nCipher : AES256-GCM\nKEM : CRYSTALS-Kyber\nProtocol : TLS 1.0"


def _files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file string, content string")


@query("v2_nessus_xml", "SELECT * FROM (VALUES ('100', 'Weak TLS', 'HIGH', 7.4::DOUBLE, 'CVSS:3.0/AV:N/AC:H', 'CVE-2024-0001|CVE-2024-0002', '10.0.0.9:443/tcp (www)', 'out'), ('101', 'Host info', 'INFO', NULL, NULL, '', '10.0.0.9', 'info only'), ('102', 'Old SQL', 'CRITICAL', NULL, NULL, '', 'db01:1433/tcp (mssql)', 'old')) AS t(plugin, title, severity, score, vector, cves, target, evidence)")
def v2(spark, d):
    return X.nessus_xml(_files(spark, ("a.nessus", NESSUS))).select("plugin", "title", "severity", "score", "vector", F.array_join("cves", "|").alias("cves"), "target", "evidence")


@query("v3_score_bands", "SELECT event_id, CASE WHEN value / 10 >= 9 THEN 'CRITICAL' WHEN value / 10 >= 7 THEN 'HIGH' WHEN value / 10 >= 4 THEN 'MEDIUM' WHEN value > 0 THEN 'LOW' ELSE 'INFO' END AS band FROM events")
def v3(spark, d):
    from lodestone.functions.rules import score_band

    return table(spark, d, "events").select("event_id", score_band(F.col("value") / 10).alias("band"))


@query("v4_nmap_ports", "SELECT * FROM (VALUES ('gw (10.0.0.3)', '22/tcp', 'open', 'ssh OpenSSH 8.2'), ('gw (10.0.0.3)', '445/tcp', 'open', 'smb'), ('app (10.0.0.4)', '22/tcp', 'open', 'ssh OpenSSH 8'), ('app (10.0.0.4)', '80/tcp', 'closed', 'http'), ('10.0.0.5', '53/udp', 'open', 'domain')) AS t(target, port, state, service)")
def v4(spark, d):
    a = X.nmap_ports(_files(spark, ("a.xml", NMAP))).select("target", "port", "state", "service")
    return a.unionByName(X.nmap_grepable(_files(spark, ("a.gnmap", GREPABLE))).select("target", "port", "state", "service"))


@query("v4_nmap_scripts", "SELECT * FROM (VALUES ('smb-vuln-ms17-010', 'HIGH', 'CVE-2017-0143', 'gw (10.0.0.3)')) AS t(plugin, severity, cves, target)")
def v4b(spark, d):
    return X.nmap_scripts(_files(spark, ("a.xml", NMAP))).select("plugin", "severity", F.array_join("cves", "|").alias("cves"), "target")


@query("v5_burp_xml", "SELECT * FROM (VALUES ('SQL injection', 'HIGH', 9.8::DOUBLE, 'https://shop/q'), ('Cross-site scripting (stored)', 'INFO', 0.0, 'https://shop/c')) AS t(title, severity, score, target)")
def v5(spark, d):
    return X.burp_xml(_files(spark, ("b.xml", BURP))).select("title", "severity", "score", "target")


@query("v6_qualys_rows", "SELECT * FROM (VALUES ('38170', 'Old TLS', 'HIGH', 'CVE-2011-3389|CVE-2013-0169', '10.1.1.1:443', 6.5::DOUBLE), ('11', 'Info', 'INFO', '', 'srv', NULL)) AS t(plugin, title, severity, cves, target, score)")
def v6(spark, d):
    raw = spark.createDataFrame([("10.1.1.1", "", "38170", "Old TLS", "4", "CVE-2013-0169, cve-2011-3389", "443", "6.5 (AV:N)"), ("", "srv", "11", "Info", "1", None, None, None), (None, None, "12", " ", "5", None, None, None)], "`IP` string, `DNS` string, `QID` string, `Vulnerability Title` string, `Severity` string, `CVE ID` string, `Port` string, `CVSS Base` string")
    return X.qualys_rows(raw).select("plugin", "title", "severity", F.array_join("cves", "|").alias("cves"), "target", "score")


@query("v7_trivy_json", "SELECT * FROM (VALUES ('CVE-2021-44228', 'Log4Shell', 'CRITICAL', 10.0::DOUBLE, 'CVE-2021-44228', 'app.jar', 'Update log4j from 2.14 to fixed version 2.17.'), ('GHSA-1', 'GHSA-1', 'INFO', NULL, '', 'app.jar', 'No fixed version available yet for x 1; monitor vendor advisory for GHSA-1.'), ('DS002', 'root user', 'HIGH', NULL, '', 'Dockerfile', 'Add USER')) AS t(plugin, title, severity, score, cves, target, remediation)")
def v7(spark, d):
    return X.trivy_json(_files(spark, ("t.json", TRIVY))).select("plugin", "title", "severity", "score", F.array_join("cves", "|").alias("cves"), "target", "remediation")


@query("v1_dispatch", "SELECT * FROM (VALUES ('a', 'nessus'), ('b', 'nmap'), ('c', 'burp'), ('d', 'trivy'), ('e', 'generic'), ('f', 'nessus'), ('g', 'generic'), ('h', 'generic')) AS t(file, tool)")
def v1(spark, d):
    x = _files(spark, ("a", NESSUS), ("b", NMAP), ("c", BURP), ("d", TRIVY), ("e", "just text"), ("f", "Nessus export with a Risk Factor"), ("g", "one weak phrase: tenable"), ("h", None))
    return x.select("file", X.route(F.col("content")).alias("tool"))


@query("v9_crypto_scan", "SELECT * FROM (VALUES ('rsa-small', 'VULNERABLE', 'CRITICAL'), ('dh-small', 'VULNERABLE', 'CRITICAL'), ('dh-large', 'VULNERABLE', 'HIGH'), ('ecc-curve', 'VULNERABLE', 'HIGH'), ('ecc-curve', 'VULNERABLE', 'HIGH'), ('md5', 'WEAK', 'HIGH'), ('sha1', 'WEAK', 'HIGH'), ('3des', 'WEAK', 'CRITICAL'), ('aes256-gcm', 'SAFE', 'INFO'), ('kyber', 'SAFE', 'INFO'), ('tls10', 'WEAK', 'CRITICAL')) AS t(rule, status, severity)")
def v9(spark, d):
    return X.crypto_findings(_files(spark, ("c.txt", CRYPTO))).select("rule", "status", "severity")


OIDS = Rows("o", "oid string, algorithm string", [("1.2.840.113549.1.1.11", "sha256WithRSA"), ("1.2.840.10045.4.3.2", "ecdsa-with-SHA256"), ("1.3.101.112", "Ed25519")])


@query("v10_oid_lookup", "SELECT * FROM (VALUES ('x', 'sha256WithRSA'), ('x', 'Ed25519'), ('y', 'ecdsa-with-SHA256')) AS t(file, algorithm)")
def v10(spark, d):
    x = _files(spark, ("x", "sig 1.2.840.113549.1.1.11, again 1.2.840.113549.1.1.11 and 1.3.101.112"), ("y", "1.2.840.10045.4.3.2 ecdsa"), ("z", "1.1"))
    found = x.select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b\d+(?:\.\d+){3,}\b"), F.lit(0)))).alias("oid"))
    return found.join(F.broadcast(OIDS.df(spark)), "oid").select("file", "algorithm")


@query("v12_dependency_chains", "SELECT * FROM (VALUES ('a', 'Portal > Gateway > Core DB'), ('a', 'VPN > HSM')) AS t(file, chain)")
def v12(spark, d):
    x = _files(spark, ("a", "Portal -> Gateway -> Core DB\nplain line\nVPN → HSM"), ("b", "lonely ->"))
    return x.select("file", F.explode(X.dependency_chains(F.col("content"))).alias("c")).select("file", F.array_join("c", " > ").alias("chain"))


@query("v13_chain_flags", "SELECT * FROM (VALUES ('Portal', true), ('Gateway', true), ('Core DB', true), ('Archive', false), ('Solo', false)) AS t(asset, linked)")
def v13(spark, d):
    f = spark.createDataFrame([("Portal", "VULNERABLE"), ("Gateway", "SAFE"), ("Core DB", "VULNERABLE"), ("Archive", "VULNERABLE"), ("Solo", "SAFE")], "asset string, status string")
    c = spark.createDataFrame([(1, ["Portal", "Gateway", "Core DB"]), (2, ["Archive", "Tape"])], "chain_id int, chain array<string>")
    return X.chain_flags(f, c).select("asset", "linked")


@query("v15_nearest_heading", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 800 PRECEDING AND 1 PRECEDING) AS heading FROM events")
def v15(spark, d):
    x = table(spark, d, "events").withColumn("h", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return W.nearest_before(x, "user_id", "event_id", "h", 800, "heading").select("event_id", "heading")


@query("w5_free_spans", "SELECT * FROM (VALUES (1, 0, 5), (1, 10, 20), (1, 5, 10), (2, 3, 9)) AS t(doc, a, z)")
def w5(spark, d):
    x = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 10, 20), (1, 1, 4, 8), (1, 1, 5, 10), (1, 2, 12, 13), (2, 1, 0, 4), (2, 0, 3, 9)], "doc int, priority int, a int, z int")
    return W.free_spans(x, "doc", "priority", "a", "z").select("doc", "a", "z")


@query("w11_rate_limited", "SELECT * FROM (VALUES (1, 3), (2, 2)) AS t(user_id, accepted)")
def w11b(spark, d):
    x = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 61), (2, 5, 0), (2, 6, 100)], "user_id int, event int, s int")
    return W.rate_limited(x, "user_id", "event", "s", 2, 60).where("accepted").groupBy("user_id").agg(F.count("*").alias("accepted"))


@query("s10_flatten_json", "SELECT event_id AS id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def s10(spark, d):
    return S.flatten_json(table(spark, d, "events"), "event_id", "props")


@query("s10_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def s10b(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("s16_ad_hoc_sql", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3")
def s16(spark, d):
    for name in ("customer", "nation"):
        table(spark, d, name).createOrReplaceTempView(f"s16_{name}")
    return spark.sql("SELECT n_name, count(*) AS n FROM s16_customer JOIN s16_nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3")


@query("s18_feedback_import", "SELECT * FROM (VALUES ('c3', 'ok')) AS t(control, verdict)")
def s18(spark, d):
    fresh = spark.createDataFrame([("c1", "ok"), ("c2", None), ("c3", "ok"), ("c3", "ok"), (" ", "ok")], "control string, verdict string")
    known = spark.createDataFrame([("c1", "ok"), ("c2", None)], "control string, verdict string")
    return S.import_feedback(fresh, known, ["control", "verdict"], ["control", "verdict"])


@query("s24_upsert", "SELECT event_type AS key, max(event_id) AS event_id FROM events GROUP BY 1")
def s24(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), "event_id")
    return S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["key"], "event_id")


@query("x1_session_counters", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def x1(spark, d):
    return C.drain(C.session_counters(C.event_stream(spark, d))).select("user_id", "n", "total", "errors")


@query("x3_newest_completed", "SELECT user_id FROM (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1) ORDER BY seen DESC, user_id LIMIT 50")
def x3(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.orderBy(F.desc("last"), "user_id").limit(50).select("user_id")


@query("x4_estimated_fallback", "SELECT c_custkey, coalesce(n, 0) AS n, n IS NULL AS is_estimated FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id")
def x4(spark, d):
    live = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(live, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("is_estimated"))


@query("x6_busy_windows", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts) HAVING count(*) >= 5")
def x6(spark, d):
    return C.busy_users(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 5, "1 day").select("user_id", "n")


@query("x6_streamed_windows", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type, date_trunc('day', ts)")
def x6b(spark, d):
    return C.drain(C.windowed_counts(C.event_stream(spark, d), "1 day")).select("event_type", "n")


@query("x7_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def x7(spark, d):
    return C.retained(table(spark, d, "events"), "2024-01-31 00:00:00", 7).select("event_id")


@query("x9_event_log", "SELECT event_type, count(*) AS entries, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def x9(spark, d):
    """An append-only log by day: a second run over the same events adds no entry."""
    home = C.new_folder(spark, "log")
    for _ in range(2):
        C.append_log(C.event_stream(spark, d), f"{home}/log", f"{home}/at").awaitTermination()
    log = C.read_log(spark, f"{home}/log")
    return log.groupBy("event_type").agg(F.count("*").alias("entries"), F.min("ts").cast("timestamp_ntz").alias("first"), F.max("ts").cast("timestamp_ntz").alias("last"), F.count_distinct("day").alias("days"))


#: Sessions without a gap of more than 24 hours, of which that of the last event is too long ago to go on.
SESSIONS_SQL = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
c AS (SELECT user_id, session, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session)
SELECT user_id, first, last, n, total FROM c WHERE last + INTERVAL 24 HOUR < (SELECT max(ts) FROM events)
"""


@query("x2_refreshed_state", SESSIONS_SQL)
def x2b(spark, d):
    """State that each update keeps alive for 24 hours: all events in three parts, the stream being started anew for each."""
    home = C.new_folder(spark, "sessions")
    events = table(spark, d, "events")
    cuts = [F.lit("2024-01-11").cast("timestamp_ntz"), F.lit("2024-01-21").cast("timestamp_ntz")]
    for part in (F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]):
        events.where(part).write.mode("append").parquet(f"{home}/in/events.parquet")
        L.replay(spark, f"{home}/in", home)
    done = L.sessions_of(spark, home)
    return done.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n", F.round("total", 4).alias("total"))
