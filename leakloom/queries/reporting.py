"""Queries of web tokens, findings, deduplication, reports and streams."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions import scalars as sc
from ..functions.rows import materialised, shared_path
from ..operators import files as fs, findings as fd, redact as rd
from ..operators.detect import detect, detect_all
from ..operators.redact import counts_by_label
from ..operators.registry import SCAN_SPECS, Registry, Vectorised
from ..plans import workflows as wf
from ..operators.text import to_lines
from ..sources.files import only_files, read_files, report_json, write_back, write_report_json
from ..sources.files import read_lines as read_lines_of
from ..streaming.streams import dedup_stream, detect_stream, redact_stream
from .detection import NOW, SQL_RULES, documents, hits_sql, redaction_ctes
from .plant import Part, quote, spark_text, spark_token, sql_text, sql_token
from .preparation import _PATH, _TAGGED, _path
from .preparation import files as _files

#: Payloads by doc_id; {k} is the id.
PAYLOADS = (
    '{"iss":"kubernetes/serviceaccount","sub":"s{k}","kubernetes.io":{"namespace":"n{k}","serviceaccount":{"name":"a"}},"exp":1600000000.7}',
    '{"iss":"https://token.actions.githubusercontent.com","repository":"r{k}","ref":"","aud":["x","y"],"exp":"1800000000","iat":1}',
    '{"iss":"https://oidc.eks.eu-west-1.amazonaws.com/id/{k}","aud":"sts"}',
    '{"iss":"https://sts.windows.net/t/","tid":"t{k}","appid":"p"}',
    '{"iss":"accounts.google.com","sub":"u{k}"}',
    '{"iss":"x@y.iam.gserviceaccount.com"}',
    '{"iss":"own","aud":["My-VAULT.{k}"]}',
    '{"iss":5,"sub":"void{k}"}',
    '{"iss":"plain{k}","exp":true}',
    "no json {k}",
    '{"iss":"none{k}"}',
)


def _jwt(key: str = "doc_id"):
    k = F.col(key)
    payload = F.replace(F.element_at(F.array(*map(F.lit, PAYLOADS)), (k % len(PAYLOADS) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    coded = F.translate(F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), "[=\r\n]", ""), "+/", "-_")
    return F.concat(F.lit("eyJ"), spark_token((Part(1, 10),), k), F.lit("."), coded, F.lit("."), spark_token((Part(2, 20),), k))


def jwt_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" é "), _jwt(), F.lit(" "), _jwt(), F.lit(".x.y")).alias("text"))
    hits = detect(texts, "jwt", now=NOW)
    return hits.select("doc_id", "finding_id", sc.plain_fingerprint(F.col("value")).alias("fingerprint"), F.explode_outer(F.map_filter("metadata", lambda k, v: v.isNotNull())).alias("claim", "said"))


_PAYLOAD = f"replace(([{', '.join(map(quote, PAYLOADS))}])[doc_id % {len(PAYLOADS)} + 1], '{{k}}', doc_id::VARCHAR)"
_JWT_SQL = f"""WITH d AS (SELECT doc_id, doc_id % {len(PAYLOADS)} AS c, doc_id::VARCHAR AS k, {sql_token(("eyJ", Part(1, 10), "."), "doc_id")} || rtrim(translate(to_base64(encode({_PAYLOAD})), '+/', '-_'), '=') || {sql_token((".", Part(2, 20)), "doc_id")} AS v FROM documents),
m AS (SELECT *, CASE c
 WHEN 0 THEN [['iss', 'kubernetes/serviceaccount'], ['sub', 's' || k], ['exp', '1600000000'], ['expired', 'true'], ['k8s_namespace', 'n' || k], ['k8s_serviceaccount', 'a'], ['jwt_subtype', 'jwt-kubernetes-service-account']]
 WHEN 1 THEN [['iss', 'https://token.actions.githubusercontent.com'], ['aud', '["x","y"]'], ['exp', '1800000000'], ['expired', 'false'], ['iat', '1'], ['github_repository', 'r' || k], ['jwt_subtype', 'jwt-github-actions-oidc']]
 WHEN 2 THEN [['iss', 'https://oidc.eks.eu-west-1.amazonaws.com/id/' || k], ['aud', '["sts"]'], ['oidc_issuer', 'https://oidc.eks.eu-west-1.amazonaws.com/id/' || k], ['jwt_subtype', 'jwt-aws-irsa']]
 WHEN 3 THEN [['iss', 'https://sts.windows.net/t/'], ['azure_tenant', 't' || k], ['azure_app_id', 'p'], ['jwt_subtype', 'jwt-azure-ad']]
 WHEN 4 THEN [['iss', 'accounts.google.com'], ['sub', 'u' || k], ['jwt_subtype', 'jwt-gcp-id-token']]
 WHEN 5 THEN [['iss', 'x@y.iam.gserviceaccount.com'], ['gcp_service_account', 'x@y.iam.gserviceaccount.com'], ['jwt_subtype', 'jwt-gcp-service-account']]
 WHEN 6 THEN [['iss', 'own'], ['aud', '["My-VAULT.' || k || '"]'], ['jwt_subtype', 'jwt-vault-auth']]
 WHEN 10 THEN [['iss', 'none' || k]] ELSE [[NULL, NULL]] END AS e FROM d)
SELECT doc_id, 'jwt-jwt-token' AS finding_id, sha256(v) AS fingerprint, u[1] AS claim, u[2] AS said FROM (SELECT doc_id, v, unnest(e) AS u FROM m)
UNION ALL SELECT doc_id, 'jwt-jwe-token', sha256(v || '.x.y'), NULL, NULL FROM d"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host for each source."""
    return documents(spark, sf_dir).select(F.col("source").alias("host_id")).distinct().select("host_id", F.lit("linux").alias("os"), F.lit("amd64").alias("arch"), F.col("host_id").alias("hostname"), F.lit("").alias("username"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("file:/d/"), F.col("doc_id").cast("string")).alias("path"), F.lit("docs").alias("probe"), F.lit(0).alias("line_number"), F.lit("").alias("env_var"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spark_token(_SHARED, (F.col("doc_id") % 40)), F.lit(" k")).alias("text"))


#: The same token in several documents of a host.
_SHARED = ("ghp_", Part(1, 36))


def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    found = fd.dedup_findings(fd.to_findings(detect_all(texts, now=NOW), hosts(spark, sf_dir)), most=None)
    return found.select("host_id", "fingerprint", "finding_id", "path", "severity", F.col("n_places").cast("int").alias("n_locations"), F.coalesce(F.array_join("locations", ","), F.lit("")).alias("places"))


def _hmac(value: str) -> str:
    """HMAC-SHA256 in SQL: a key of up to 64 bytes as a bit string, its pads by xor."""
    key = "rpad(hex(encode('linux:amd64:' || host_id || ':')), 128, '0')"
    pad = lambda byte: f"unhex(list_aggregate(list_transform(range(0, 128), lambda i: format('{{:X}}', xor(('0x' || {key}[i + 1])::INT, CASE WHEN i % 2 = 0 THEN {byte >> 4} ELSE {byte & 15} END))), 'string_agg', ''))"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({value}))))"


_HITS = " UNION ALL ".join([f"SELECT path, finding_id, severity, v, {rank} AS rank FROM ({hits_sql(n, 't', 'path')})" for rank, n in enumerate(SQL_RULES)])
_DEDUP = f"""WITH t AS (SELECT source, 'file:/d/' || doc_id AS path, coalesce(text, '') || chr(10) || {sql_token(_SHARED, "(doc_id % 40)")} || ' k' AS text FROM documents), h AS ({_HITS}), j AS (SELECT h.*, source AS host_id FROM h JOIN t USING (path)),
o AS (SELECT host_id, v, list({{'p': path, 'r': rank, 'f': finding_id, 's': severity}} ORDER BY path, rank, finding_id) AS l FROM j GROUP BY ALL)
SELECT host_id, {_hmac("v")} AS fingerprint, l[1].f AS finding_id, l[1].p AS path, l[1].s AS severity, len(l)::INT AS n_locations, CASE WHEN len(l) > 1 THEN array_to_string(list_transform(l, lambda x: x.p), ',') ELSE '' END AS places FROM o"""


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wf.scan_keyed_lines(documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("file:/d/"), F.format_string("%09d", "doc_id")).alias("path"), F.lit("docs").alias("probe"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spark_token(_SHARED, F.col("doc_id")), F.lit(" k")).alias("content")))
    return fd.report_table(fd.to_findings(detect(texts, "github-pat"), hosts(spark, sf_dir)))


_REPORT = "WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL OR text = '' THEN 2 WHEN true THEN len(string_split(text, chr(10))) + 1 END AS line FROM documents) SELECT row_number() OVER (ORDER BY doc_id) AS n, 'critical' AS severity, 'docs' AS probe, 'GitHub token' AS title, 'GitHub token in file:/d/' || lpad(doc_id::VARCHAR, 9, '0') || ':' || line || '.' AS message, 'file:/d/' || lpad(doc_id::VARCHAR, 9, '0') || ':' || line AS location FROM d"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into lines, a planted secret in each; all detectors, salted fingerprints, deduplication, numbered report."""
    files = documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("file:/d/"), F.col("doc_id").cast("string")).alias("path"), F.lit("docs").alias("probe"), F.concat(F.coalesce("text", F.lit("")), F.lit("\napi_key = '"), spark_token((Part(1, 32),), F.col("doc_id")), F.lit("'")).alias("content"))
    return fd.report_table(wf.findings_of_texts(wf.scan_keyed_lines(files), hosts(spark, sf_dir), NOW, most=None))


_RANKS = {name: rank for rank, name in enumerate("github-pat npm-token ssh-private-key ai-service http-auth cloud-credentials vault-token pypi-token wireguard-key splunk-token database-connection slack-token stripe-key twilio-key generic-api-key".split())}
_LINE_HITS = " UNION ALL ".join(f"SELECT key, finding_id, severity, v, {_RANKS[n]} AS rank FROM ({hits_sql(n, 'u', 'key')})" for n in SQL_RULES)
_TITLED = "CASE WHEN finding_id LIKE 'github%' THEN 'GitHub token' WHEN finding_id LIKE 'cloud-credential-aws%' THEN 'AWS access key id' WHEN finding_id LIKE 'generic%' THEN 'High-entropy secret' WHEN finding_id LIKE 'http-auth%' THEN 'HTTP credential' WHEN finding_id LIKE 'ai-%' THEN 'AI service credential' WHEN finding_id LIKE 'database%' THEN 'Database URL with a password' END"
_FLAGSHIP = f"""WITH d AS (SELECT source AS host_id, 'file:/d/' || doc_id AS path, coalesce(text, '') || chr(10) || 'api_key = ' || chr(39) || {sql_token((Part(1, 32),), "doc_id")} || chr(39) AS content FROM documents),
l AS (SELECT host_id, path, string_split(content, chr(10)) AS l FROM d), n AS (SELECT host_id, path, unnest(range(1, len(l) + 1)) AS line_number, unnest(l) AS line FROM l),
u AS (SELECT host_id, path, line_number, rtrim(line, chr(13)) AS text, path || '|' || line_number AS key FROM n), h AS ({_LINE_HITS}),
f AS (SELECT host_id, path, line_number, rank, finding_id, severity, {_hmac("v")} AS fingerprint FROM h JOIN u USING (key)),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY host_id, fingerprint) AS c, list(path || ':' || line_number) OVER (PARTITION BY host_id, fingerprint ORDER BY path, line_number, rank, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS places FROM f WINDOW w AS (PARTITION BY host_id, fingerprint ORDER BY path, line_number, rank, finding_id)),
m AS (SELECT row_number() OVER (ORDER BY path, line_number, rank, finding_id, fingerprint) AS n, severity, 'docs' AS probe, {_TITLED} AS title, path || ':' || line_number AS place, CASE WHEN c > 1 THEN array_to_string(places, ', ') ELSE path || ':' || line_number END AS location FROM o WHERE i = 1)
SELECT n, severity, probe, title, title || ' in ' || place || '.' AS message, location FROM m"""


def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose documents hold a token, which those of every other source do."""
    texts = documents(spark, sf_dir).select("doc_id", F.col("source").alias("host_id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.length("source") % 2 == 0, F.concat(F.lit(" "), spark_token(_SHARED, F.col("doc_id")), F.lit(" k"))).otherwise("")).alias("text"))
    return fd.strict_gate(detect(texts, "github-pat"), hosts(spark, sf_dir))


def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = documents(spark, sf_dir)
    found = o.select("doc_id", F.col("source").alias("host_id"), F.concat(F.lit("file:/d/"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 > 0, F.lit(":12")).otherwise("")).alias("path"))
    known = o.where(F.col("doc_id") % 50 < 25).select(F.col("source").alias("host_id"), F.concat(F.lit("/d/"), (F.col("doc_id") % 50).cast("string")).alias("path"))
    return fd.affected_files(found, known, ("doc_id",))


_AFFECTED = "SELECT host_id, path, row_number() OVER (PARTITION BY host_id ORDER BY first) AS n FROM (SELECT source AS host_id, '/d/' || doc_id % 50 || CASE WHEN doc_id % 3 > 0 AND doc_id % 50 >= 25 THEN ':12' ELSE '' END AS path, min(doc_id) AS first FROM documents GROUP BY ALL)"


def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fd.to_findings(detect(_texts(spark, sf_dir), "github-pat"), hosts(spark, sf_dir))
    kept = report_json(rows)
    return kept.select("host_id", *(F.get_json_object("json", f"$.{c}").alias(c) for c in ("id", "type_name", "path")), F.get_json_object("json", "$.locations").isNull().cast("string").alias("no_locations"))


#: As an object: a type in words needs a session, which need not be there when this is imported.
FOUND = ArrayType(StructType([StructField("value", StringType()), StructField("metadata", MapType(StringType(), StringType()))]))


@F.pandas_udf(FOUND)
def card_numbers(texts: pd.Series) -> pd.Series:
    """Numbers of 13 to 19 digits whose check digit holds."""

    def holds(digits: str) -> bool:
        return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0

    return texts.map(lambda t: [{"value": x, "metadata": {"length": str(len(x))}} for x in re.findall(r"(?<![0-9])[0-9]{13,19}(?![0-9])", t or "") if holds(x)])


CARDS = Vectorised("card-number", 16, card_numbers, severity="medium", title="Card number")


def vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of pattern detectors and one of code: hits of a planted token and planted numbers, with their ranks."""
    texts = documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spark_token(_SHARED, F.col("doc_id")), F.lit(" 4"), F.format_string("%014d", F.col("doc_id") * 7919), F.lit(" 5"), F.format_string("%012d", F.col("doc_id") * 104729)).alias("text"))
    specs = Registry(tuple(d for d in SCAN_SPECS if d.name == "github-pat")).register_detector(CARDS).detectors
    return detect_all(texts, specs=specs).select("doc_id", "finding_id", "rank", "severity", sc.plain_fingerprint(F.col("value")).alias("fingerprint"))


_CARDS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || {sql_token(_SHARED, "doc_id")} || ' 4' || lpad((doc_id * 7919)::VARCHAR, 14, '0') || ' 5' || lpad((doc_id * 104729)::VARCHAR, 12, '0') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM d),
c AS (SELECT * FROM w WHERE len(v) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(v)), lambda i: CASE WHEN i % 2 = 0 THEN v[len(v) - i]::INT ELSE v[len(v) - i]::INT * 2 // 10 + v[len(v) - i]::INT * 2 % 10 END)) % 10 = 0)
SELECT doc_id, 'card-number' AS finding_id, 16 AS rank, 'medium' AS severity, sha256(v) AS fingerprint FROM c UNION ALL SELECT doc_id, finding_id, 0, severity, sha256(v) FROM ({hits_sql('github-pat', 'd')})"""


def _through_stream(spark: SparkSession, sf_dir: str, table: str, step, name: str) -> DataFrame:
    """A whole table as a stream, through a step, into files of the shared folder."""
    schema, out = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema, shared_path(spark, name)
    stream = step(spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*"))
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-state").format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_CHAT = (("ghs_", Part(1, 36)), ("Bearer ", Part(2, 30)))


def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda s: detect_stream(s.select("conv_id", "turn", spark_text(_CHAT, "conv_id").alias("text"))).select("conv_id", "turn", "finding_id", sc.plain_fingerprint(F.col("value")).alias("fingerprint"))
    return _through_stream(spark, sf_dir, "conversations", step, "stream")


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda s: redact_stream(s.select("conv_id", "turn", spark_text(_CHAT, "conv_id").alias("text"))).select("conv_id", "turn", sc.plain_fingerprint(F.col("scrubbed")).alias("scrubbed_hash"))
    return _through_stream(spark, sf_dir, "conversations", step, "stream")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda s: dedup_stream(s.select(F.col("event_type").alias("host_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("fingerprint"), F.col("ts").cast("timestamp").alias("ts")), lateness="3650 days").select("host_id", "fingerprint")
    return _through_stream(spark, sf_dir, "events", step, "stream")


def scan_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat logs: a line of JSON for each turn, whole conversations as files."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = c.select("conv_id", "turn", F.to_json(F.struct("role", spark_text(_CHAT, "conv_id").alias("text"))).alias("line"))
    files = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("content"))
    files = files.select(F.lit("h").alias("host_id"), F.concat(F.lit("file:.claude/projects/p"), F.col("conv_id").cast("string"), F.lit("/s.jsonl")).alias("path"), F.lit("ai_chats").alias("probe"), "content", F.octet_length("content").alias("size"))
    return detect(wf.scan_chats(files), "github-pat").select("path", "line_number", "finding_id")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source's host, at a path of the catalogue, with a token in its last line."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spark_token(_SHARED, F.col("doc_id")), F.lit(" k"))
    return documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.col("doc_id").cast("string"), F.lit("/"), _path()).alias("path"), text.alias("content"), F.octet_length(text).cast("long").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit(0o644).alias("mode"), F.lit("linux").alias("os"))


def scrub_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scrub: chats and histories with a finding, rewritten."""
    return wf.scrub(_snapshot(spark, sf_dir), 0, NOW).transform(counts_by_label).select("host_id", "path", "label", "n")


def scan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan, with an environment entry for each document: findings of the planted token, and in how many places each stands."""
    entries = documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("K"), F.col("doc_id").cast("string"), F.lit("="), spark_token(_SHARED, F.col("doc_id") + 7)).alias("entry"))
    found = wf.scan(_snapshot(spark, sf_dir), hosts(spark, sf_dir), NOW, entries).where("finding_id = 'github-token-classic-pat'")
    return found.select("host_id", "fingerprint", "severity", F.col("n_places").cast("int").alias("n_places"))


def _stored(files: DataFrame, name: str) -> DataFrame:
    """A snapshot as data files by ranges of host and path."""
    out = shared_path(files.sparkSession, name)
    files.repartitionByRange("host_id", "path").write.parquet(out)
    return files.sparkSession.read.parquet(out)


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot scanned by what differs from an earlier one, which lacks a fifth of its files, has other texts in a seventh, and some files more."""
    now = _snapshot(spark, sf_dir)
    k = F.split("path", "/")[0].cast("long")
    older = F.col("mtime") - F.expr("INTERVAL 1 DAY")
    other = now.where(k % 5 != 2).withColumn("mtime", F.when(k % 7 == 3, older).otherwise(F.col("mtime"))).withColumn("content", F.when(k % 7 == 3, F.concat(F.lit("x "), F.reverse("content"), F.lit("\n"), spark_token(_SHARED, k + 11))).otherwise(F.col("content")))
    gone = now.where(k % 11 == 4).withColumn("path", F.concat(F.lit("gone/"), "path"))
    before = _stored(other.unionByName(gone).withColumn("size", F.octet_length("content").cast("long")), "snapshot-before")
    present = _stored(now, "snapshot")
    host = hosts(spark, sf_dir)
    listing = lambda s: s.select("host_id", "path", "mtime", "size")
    state = materialised(wf.raw_findings(before, host, NOW), "state")
    found = wf.incremental_findings(lambda wanted: only_files(present, wanted), listing(present), listing(before), state, host, NOW)
    return fd.dedup_findings(found).where("finding_id = 'github-token-classic-pat'").select("host_id", "fingerprint", "severity", F.col("n_places").cast("int").alias("n_places"))


def write_back_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshot after its chats and histories are scrubbed in place: every file's content by its hash."""
    stored = _stored(_snapshot(spark, sf_dir), "scrubbed-snapshot")
    folder = stored.inputFiles()[0].rpartition("/")[0]
    write_back(spark, folder, lambda files: wf.scrub(files, 0, NOW))
    return spark.read.parquet(folder).select("host_id", "path", F.sha2("content", 256).alias("content_hash"), "size", "mode")


def finding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every fingerprint, numbered."""
    return fd.finding_places(fd.to_findings(detect_all(_texts(spark, sf_dir), now=NOW), hosts(spark, sf_dir)))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container tool's registry file for each document, with a token as the password of a registry named after it, and its text beside."""
    k = F.col("doc_id").cast("string")
    auth = F.base64(F.encode(F.concat(F.col("source"), F.lit(":"), spark_token(_SHARED, F.col("doc_id"))), "UTF-8"))
    doc = F.to_json(F.struct(F.create_map(F.concat(F.lit("r"), k, F.lit(".io")), F.struct(auth.alias("auth"), F.col("text").alias("note"))).alias("auths")))
    name = F.element_at(F.array(*map(F.lit, ("docker_config", "podman_config", "helm_oci_registry"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("/r/"), k).alias("path"), F.lit("docker").alias("probe"), name.alias("pattern_name"), doc.alias("content"))


def rescan_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens inside decoded registry passwords, and where they stand."""
    texts = wf.nested_texts(_registry(spark, sf_dir))
    rows = fd.to_findings(detect(texts, "github-pat", now=NOW), hosts(spark, sf_dir))
    return rows.select("host_id", "path", "finding_id", "fingerprint", "message", *(F.col("metadata")[c].alias(c) for c in ("detector_name", "token_type", "runtime", "registry_host", "location")))


_RESCANNED = f"""SELECT source AS host_id, '/r/' || doc_id AS path, 'github-token-classic-pat' AS finding_id, {_hmac("v")} AS fingerprint, 'GitHub token in /r/' || doc_id || '.' AS message, 'github-pat' AS detector_name, 'classic-pat' AS token_type,
['docker', 'podman', 'helm'][doc_id % 3 + 1] AS runtime, 'r' || doc_id || '.io' AS registry_host, 'auths["r' || doc_id || '.io"].auth' AS location FROM (SELECT doc_id, source, source AS host_id, {sql_token(_SHARED, "doc_id")} AS v FROM documents)"""


def scan_config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Git settings of every document's text, with a token in one of them."""
    k = F.col("doc_id").cast("string")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\nalias.k"), k, F.lit(" = x "), spark_token(_SHARED, F.col("doc_id")), F.lit(" y\n"))
    files = documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("/g/"), k).alias("path"), F.lit("git").alias("probe"), content.alias("content"))
    return detect(wf.scan_config_values(files), "github-pat").select("host_id", "path", "file", "finding_id", sc.plain_fingerprint(F.col("value")).alias("fingerprint"))


_CONFIG_VALUES = f"SELECT source AS host_id, 'git-config:alias.k' || doc_id || ' ' AS path, '/g/' || doc_id AS file, 'github-token-classic-pat' AS finding_id, sha256({sql_token(_SHARED, 'doc_id')}) AS fingerprint FROM documents"


def scan_ai_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential files of assistants up to a size, the token in the line after the document's text."""
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spark_token(_SHARED, F.col("doc_id")), F.lit(" "))
    files = documents(spark, sf_dir).select(F.col("source").alias("host_id"), F.concat(F.lit("/c/"), F.col("doc_id").cast("string")).alias("path"), F.lit("ai_credentials").alias("probe"), content.alias("content"), F.octet_length(content).alias("size"))
    return detect(wf.scan_ai_credentials(files, 4096), "github-pat").select("path", "line_number", "finding_id")


_AI_CREDENTIALS = "SELECT '/c/' || doc_id AS path, len(string_split(coalesce(text, ''), chr(10)))::INT + 1 AS line_number, 'github-token-classic-pat' AS finding_id FROM documents WHERE strlen(coalesce(text, '')) + 1 + 41 <= 4096"


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to text files by source, and the lines of these files as they are read whole."""
    out = shared_path(spark, "texts")
    documents(spark, sf_dir).where("text IS NOT NULL").select("source", "text").write.partitionBy("source").text(out)
    lines = to_lines(read_files(spark, out, "*.txt"))
    return lines.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.sha2("line", 256).alias("line_hash")).agg(F.count(F.lit(1)).alias("n"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, read by parts of files: how many and how long those of each source are."""
    out = shared_path(spark, "long-texts")
    documents(spark, sf_dir).where("text IS NOT NULL").select("source", "text").write.partitionBy("source").text(out)
    lines = read_lines_of(spark, out, "*.txt")
    return lines.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("n_bytes"))


_SPLIT_LINES = """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
n AS (SELECT source, count(*) FILTER (trim(line, chr(32) || chr(9) || chr(13)) <> '') AS n, sum(strlen(rtrim(line, chr(13)))) FILTER (trim(line, chr(32) || chr(9) || chr(13)) <> '') AS n_bytes FROM l GROUP BY ALL) SELECT source, n, n_bytes::BIGINT AS n_bytes FROM n"""

_READ_LINES = "SELECT source, sha256(rtrim(line, chr(13))) AS line_hash, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE trim(line, chr(32) || chr(9) || chr(13)) <> '' GROUP BY ALL"


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it is read back from its files."""
    out = shared_path(spark, "report")
    write_report_json(fd.to_findings(detect(_texts(spark, sf_dir), "github-pat"), hosts(spark, sf_dir)), out)
    said = F.get_json_object("value", "$.json")
    return spark.read.text(out).select(F.get_json_object("value", "$.host_id").alias("host_id"), *(F.get_json_object(said, f"$.{c}").alias(c.rpartition(".")[2]) for c in ("id", "severity", "path", "metadata.detector_name")))


_WRITTEN = "SELECT source AS host_id, 'github-token-classic-pat' AS id, 'critical' AS severity, 'file:/d/' || doc_id AS path, 'github-pat' AS detector_name FROM documents"


def pattern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pattern of the catalogue, and how many of the documents' files have its name."""
    counts = fs.index_counts(fs.tag_files(_files(spark, sf_dir))).where("pattern_name IS NOT NULL").withColumnsRenamed({"pattern_name": "name", "n": "n_files"})
    return fs.pattern_catalog(spark).join(counts, "name", "left").select("name", "kind", "pattern", "ord", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def _catalogue_sql() -> str:
    from ..operators.catalogue import PATTERNS

    rows = ", ".join(f"({quote(name)}, {quote(kind)}, {quote(glob)}, {i})" for i, (name, globs, kind) in enumerate(PATTERNS) for glob in globs)
    return f"WITH {_TAGGED}, c AS (SELECT pattern_name, count(*) AS n FROM tags GROUP BY ALL) SELECT name, kind, pattern, ord, coalesce(n, 0) AS n_files FROM (VALUES {rows}) AS v(name, kind, pattern, ord) LEFT JOIN c ON c.pattern_name = v.name"


def scrub_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that may be scrubbed."""
    return rd.scrub_targets(fs.tag_files(_files(spark, sf_dir)), fs.routes_table(spark)).select("doc_id", "pattern_name")


_TARGETS = f"WITH {_TAGGED} SELECT doc_id, pattern_name FROM tags WHERE pattern_name IN ('shell_history', 'claude_chats', 'codex_chats')"


QUERIES = {
    "scrub_snapshot": scrub_snapshot, "scan_snapshot": scan_snapshot, "incremental_scan": incremental_scan, "write_back": write_back_scrubbed, "finding_places": finding_places,
    "rescan_decoded": rescan_decoded, "scan_config_values": scan_config_values, "scan_ai_credentials": scan_ai_credentials, "read_lines": read_lines, "split_lines": split_lines, "written_report": written_report, "pattern_catalog": pattern_catalog, "scrub_targets": scrub_targets,
    "report_documents": flagship, "detect_jwt": jwt_claims, "dedup_findings": dedup_findings, "report_table": report_table, "strict_gate": strict_gate, "affected_files": affected_files, "report_json": findings_json, "vectorised_detector": vectorised,
    "stream_detect": stream_detect, "stream_redact": stream_redact, "stream_dedup": stream_dedup, "scan_chats": scan_chats,
}

_CHATS = f"t AS (SELECT conv_id, turn, row_number() OVER () AS r, {sql_text(_CHAT, 'conv_id')} AS text FROM conversations)"
_STREAM_HITS = f"h AS (SELECT r, finding_id, v FROM ({' UNION ALL '.join(f'SELECT r, finding_id, v FROM ({hits_sql(n, chr(116), chr(114))})' for n in SQL_RULES)}))"

_SCRUB = f"""WITH t AS (SELECT doc_id, source, doc_id || '/' || {_PATH} AS path, coalesce(text, '') || chr(10) || {sql_token(_SHARED, "doc_id")} || ' k' AS text FROM documents WHERE regexp_matches({_PATH}, '^([.]claude/projects/|[.]codex/sessions/|[.]bash_history$)')),
{redaction_ctes('t')}, x AS (SELECT doc_id, unnest(counts) AS u FROM redacted) SELECT source AS host_id, path, u.label AS label, sum(u.n)::INT AS n FROM x JOIN t USING (doc_id) GROUP BY ALL"""


_BACK = f"""WITH s AS (SELECT doc_id, source AS host_id, doc_id || '/' || {_PATH} AS path, coalesce(text, '') || chr(10) || {sql_token(_SHARED, "doc_id")} || ' k' AS text FROM documents),
t AS (SELECT * FROM s WHERE regexp_matches(path, '^[0-9]+/([.]claude/projects/|[.]codex/sessions/|[.]bash_history$)')), {redaction_ctes('t')}
SELECT host_id, path, sha256(coalesce(scrubbed, s.text)) AS content_hash, strlen(s.text) AS size, 420 AS mode FROM s LEFT JOIN redacted USING (doc_id)"""

_FINDING_PLACES = _DEDUP.rpartition("SELECT host_id,")[0] + f"SELECT host_id, {_hmac('v')} AS fingerprint, unnest(range(1, len(l) + 1)) AS n, unnest(list_transform(l, lambda x: x.p)) AS place FROM o"


def _scan_sql(with_environment: bool = True) -> str:
    """Every routed file has its token in a line of its own, once for each probe that reads lines or whole files; every environment entry has one."""
    from ..operators.catalogue import ROUTES

    reads = ", ".join(f"({quote(name)}, {quote(probe)})" for name, probe, route, *_ in ROUTES if route in ("line", "history", "whole") or name in ("kubeconfig", "terraform_vars", "terraform_state", "npmrc", "yarnrc", "pypirc", "pip_config"))
    tagged = _TAGGED.replace(f"{_PATH} AS path", f"doc_id || '/' || {_PATH} AS path")
    more = f' UNION ALL SELECT source, {sql_token(_SHARED, "(doc_id + 7)")}, 1 FROM documents' if with_environment else ""
    return f"""WITH {tagged}, reads AS (SELECT * FROM (VALUES {reads}) AS v(pattern_name, probe)), n AS (SELECT doc_id, count(DISTINCT probe) AS n FROM tags JOIN reads USING (pattern_name) WHERE NOT ends_with(path, 'fish_history') GROUP BY ALL),
t AS (SELECT source AS host_id, {sql_token(_SHARED, "doc_id")} AS v, n FROM documents JOIN n USING (doc_id){more})
SELECT host_id, {_hmac("v")} AS fingerprint, 'critical' AS severity, sum(n)::INT AS n_places FROM t GROUP BY ALL"""


ORACLES = {
    "scrub_snapshot": _SCRUB, "scan_snapshot": _scan_sql(), "incremental_scan": _scan_sql(False), "write_back": _BACK, "finding_places": _FINDING_PLACES,
    "rescan_decoded": _RESCANNED, "scan_config_values": _CONFIG_VALUES, "scan_ai_credentials": _AI_CREDENTIALS, "read_lines": _READ_LINES, "split_lines": _SPLIT_LINES, "written_report": _WRITTEN, "pattern_catalog": _catalogue_sql(), "scrub_targets": _TARGETS,
    "detect_jwt": _JWT_SQL,
    "dedup_findings": _DEDUP,
    "report_table": _REPORT,
    "report_documents": _FLAGSHIP,
    "strict_gate": "SELECT source AS host_id, count(*) FILTER (len(source) % 2 = 0) AS n_findings, bool_or(len(source) % 2 = 0) AS any_finding FROM documents GROUP BY ALL",
    "affected_files": _AFFECTED,
    "report_json": "SELECT source AS host_id, 'github-token-classic-pat' AS id, 'Secret' AS type_name, 'file:/d/' || doc_id AS path, 'true' AS no_locations FROM documents",
    "vectorised_detector": _CARDS,
    "stream_detect": f"WITH {_CHATS}, {_STREAM_HITS} SELECT conv_id, turn, finding_id, sha256(v) AS fingerprint FROM h JOIN t USING (r)",
    "stream_redact": f"WITH {_CHATS}, {redaction_ctes('t', 'r')} SELECT conv_id, turn, sha256(scrubbed) AS scrubbed_hash FROM redacted JOIN t USING (r)",
    "stream_dedup": "SELECT DISTINCT event_type AS host_id, sha256(user_id::VARCHAR) AS fingerprint FROM events",
    "scan_chats": "WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS line_number FROM conversations) SELECT 'file:.claude/projects/p' || conv_id || '/s.jsonl' AS path, line_number, 'github-token-app-server-token' AS finding_id FROM n",
}
