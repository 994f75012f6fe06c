"""Misconfiguration findings from key/value configurations, SSH scopes and file modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.rows import exploded
from .text import ssh_scopes


@dataclass(frozen=True)
class Rule:
    """A finding for each setting of a tool whose key and value meet the condition."""

    tool: str
    finding_id: str
    severity: str
    condition: Callable[[Column, Column], Column]
    by: str = "path"  # what the fingerprint takes beside the id: path, path and key, path and value, or the key alone


def _is(key: str, value: str) -> Callable[[Column, Column], Column]:
    return lambda k, v: (k == key) & (F.lower(v) == value)


def _no_known_hosts(k: Column, v: Column) -> Column:
    rest = F.regexp_extract(F.lower(v), r"(?s)userknownhostsfile(.*)\z", 1)
    value = F.when(rest.startswith("="), F.substring(rest, 2, 1 << 30)).otherwise(rest)
    first = F.regexp_extract(value, r"^[\t\n\f\r \x0B]*([^\t\n\f\r \x0B]+)", 1)
    return (k == "core.sshcommand") & F.lower(v).contains("userknownhostsfile") & sc.is_null_device(first)


RULES: tuple[Rule, ...] = (
    Rule("git", "git-ssl-verify-disabled", "high", _is("http.sslverify", "false"), "key"),
    Rule("git", "git-ssh-no-host-key-check", "high", lambda k, v: (k == "core.sshcommand") & (F.lower(v).contains("stricthostkeychecking=no") | F.lower(v).contains("stricthostkeychecking no")), "key"),
    Rule("git", "git-ssh-no-known-hosts", "high", _no_known_hosts, "key"),
    Rule("git", "git-credential-plaintext", "high", lambda k, v: (k == "credential.helper") & F.lower(v).contains("store") & ~F.lower(v).contains("cache"), "key"),
    Rule("git", "git-dangerous-protocol", "medium", lambda k, v: k.isin("protocol.ext.allow", "protocol.fd.allow", "protocol.file.allow") & (F.lower(v) == "always"), "key"),
    Rule("git", "git-fsck-disabled", "medium", lambda k, v: k.isin("transfer.fsckobjects", "fetch.fsckobjects", "receive.fsckobjects") & (F.lower(v) == "false"), "key"),
    Rule("git", "git-proxy-configured", "low", lambda k, v: k.isin("http.proxy", "https.proxy", "core.gitproxy") & (v != ""), "key"),
    Rule("git", "git-custom-hooks-path", "medium", lambda k, v: (k == "core.hookspath") & (v != ""), "key"),
    Rule("npm", "npm-ssl-verify-disabled", "high", _is("strict-ssl", "false")),
    Rule("npm", "npm-insecure-registry", "high", lambda k, v: k.contains("registry") & v.startswith("http://"), "path and key"),
    Rule("npm", "npm-always-auth-enabled", "low", _is("always-auth", "true")),
    Rule("pypirc", "pypi-plaintext-password", "high", lambda k, v: k == "password"),
    Rule("pypirc", "pypi-insecure-repository", "high", lambda k, v: (k == "repository") & v.startswith("http://"), "path and value"),
    Rule("pip", "pip-index-embedded-credentials", "high", lambda k, v: k.isin("index-url", "extra-index-url") & v.startswith("http") & v.contains("@"), "path and key"),
)

HIT = "array<struct<finding_id string, severity string, fingerprint string>>"


def apply_config_rules(config: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A finding for each rule that a setting (tool, path, key, value) meets: its columns, finding_id, severity, fingerprint. Narrow."""
    k, v = F.col("key"), F.col("value")

    def hit(r: Rule) -> Column:
        beside = {"path": [F.col("path")], "path and key": [F.col("path"), k], "path and value": [F.col("path"), v], "key": [F.concat(F.lit("git-config:"), k)]}[r.by]
        return F.when((F.col("tool") == r.tool) & r.condition(k, v), F.struct(F.lit(r.finding_id).alias("finding_id"), F.lit(r.severity).alias("severity"), sc.fields_fingerprint(F.lit(r.finding_id), *beside).alias("fingerprint")))

    kept = config.columns
    found = exploded(config, F.filter(F.array(*map(hit, rules)), lambda h: h.isNotNull()).cast(HIT), "__h")
    return found.select(*kept, "__h.*")


SSH_HIT = "array<struct<finding_id string, severity string, key string, value string, host string, line_number int>>"


def ssh_config_rules(files: DataFrame, text: str = "content") -> DataFrame:
    """Findings of SSH client configurations (key, value, host, line_number): each rule once for each file and host, at its first line. Worked out within the row."""

    def hit(r: Column) -> Column:
        rules = (
            ("ssh-strict-host-key-checking-disabled", "high", (r["key"] == "stricthostkeychecking") & (F.lower(r["value"]) == "no")),
            ("ssh-known-hosts-disabled", "high", (r["key"] == "userknownhostsfile") & sc.is_null_device(r["value"])),
            ("ssh-forward-agent-enabled", "medium", (r["key"] == "forwardagent") & (F.lower(r["value"]) == "yes")),
        )
        found = F
        for finding, severity, holds in rules:
            found = found.when(holds, F.struct(F.lit(finding), F.lit(severity), r["key"], r["value"], r["host"], r["line_number"]))
        return found

    def first(hits: Column) -> Column:
        """Settings stand in the order of lines."""
        return F.filter(hits, lambda h, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda g: (g["finding_id"] == h["finding_id"]) & (g["host"] == h["host"])))

    hits = sc.bound(F.filter(F.transform(ssh_scopes(F.col(text)), hit), lambda h: h.isNotNull()).cast(SSH_HIT), first)
    kept = [c for c in files.columns if c != text]
    out = exploded(files, hits, "__h").select(*kept, "__h.*")
    return out.withColumn("for_all_hosts", (F.col("host") == "*") & (F.col("finding_id") == "ssh-forward-agent-enabled")).withColumn("fingerprint", sc.fields_fingerprint(F.col("finding_id"), F.col("path"), F.col("host")))


def key_permissions(files: DataFrame) -> DataFrame:
    """Private key files that others may use: any bit of group or world, but on Windows."""
    hit = files.where(~F.col("path").endswith(".pub") & (F.coalesce("os", F.lit("")) != "windows") & (F.col("mode").bitwiseAND(0o077) != 0))
    return hit.withColumn("finding_id", F.lit("ssh-key-insecure-permissions")).withColumn("severity", F.lit("high")).withColumn("fingerprint", sc.fields_fingerprint(F.lit("ssh-key-insecure-permissions"), F.col("path")))


#: Fixed value: where a pod's service account token is mounted.
SERVICE_ACCOUNT_TOKEN = "/var/run/secrets/kubernetes.io/serviceaccount/token"


def service_account_tokens(files: DataFrame) -> DataFrame:
    hit = files.where(F.col("path") == SERVICE_ACCOUNT_TOKEN)
    return hit.withColumn("finding_id", F.lit("k8s-service-account-token")).withColumn("severity", F.lit("high")).withColumn("fingerprint", sc.fields_fingerprint(F.lit("k8s-service-account-token"), F.col("path")))
