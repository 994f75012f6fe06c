"""The documented workflows: scan a file snapshot, scrub it, and what each probe reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded, materialised, spread
from ..operators import configs, files as fs, findings as fd, nested, text as tx
from ..operators.catalogue import RUNTIMES, SYSTEM_KUBECONFIGS, TITLES
from ..operators.detect import detect_all
from ..operators.redact import redact_all

_CONTEXT = ("host_id", "path", "probe", "line_number", "env_var")
#: What a nested value's place is told by, beside its file; it goes to its findings' metadata.
_PLACES = ("server", "command", "location", "runtime", "registry_host", "config_name", "kubeconfig_path", "kubeconfig_user", "kubeconfig_field")
#: Columns of findings that a document's structure or settings show which go to their metadata; none holds a secret.
_SHOWN = ("runtime", "registry_host", "username", "has_password", "username_present", "host", "file_format", "token_prefix", "token_fragment", "repo_name", "repo_url", "location", "tool", "key", "for_all_hosts")


def _entries(df: DataFrame, names: tuple[str, ...]) -> Column:
    """A map of those columns of df, nulls left out."""
    given = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names if c in df.columns]
    return F.map_from_entries(F.filter(F.array(*given), lambda e: e["value"].isNotNull()) if given else F.array().cast("array<struct<key string, value string>>"))


def _texts(df: DataFrame, text: str = "text") -> DataFrame:
    """host_id, path, file, probe, line_number, env_var, place (a map), text; what is missing is empty. file is the path that a snapshot knows the text's file by."""
    given = set(df.columns)
    fill = {"line_number": F.lit(0), "env_var": F.lit("")}
    file = F.col("file") if "file" in given else F.col("path")
    return df.select(*(F.col(c).cast("int" if c == "line_number" else "string").alias(c) if c in given else fill[c].alias(c) for c in _CONTEXT), file.alias("file"), _entries(df, _PLACES).alias("place"), F.col(text).alias("text"))


def scan_env_table(env: DataFrame) -> DataFrame:
    """Texts of environment entries (host_id, entry); they belong to no file."""
    rows = tx.split_env(env).withColumn("path", F.col("source")).withColumn("probe", F.lit("env")).withColumn("file", F.lit(None).cast("string"))
    return _texts(rows)


def scan_history(files: DataFrame) -> DataFrame:
    """Texts of shell history commands."""
    return _texts(tx.parse_history(tx.to_lines(files)), "line")


def scan_keyed_lines(files: DataFrame, max_line: int = tx.MAX_LINE) -> DataFrame:
    """Texts of lines: shell settings, dotenv files, credentials, context notes, chats."""
    return _texts(tx.to_lines(files, max_line=max_line), "line")


def scan_chats(files: DataFrame, cap: int = 1 << 20) -> DataFrame:
    return scan_keyed_lines(fs.cap_size(files, default=cap), cap + 1)


def scan_ai_credentials(files: DataFrame, cap: int = 1 << 20) -> DataFrame:
    """As chats, but never scrubbed."""
    return scan_chats(files, cap)


def scan_whole(files: DataFrame) -> DataFrame:
    """Texts of whole files, for keys that span lines."""
    return _texts(files, "content")


def scan_config_values(files: DataFrame) -> DataFrame:
    """Texts of git settings, each from `git-config:<key>`."""
    rows = tx.parse_git_config(files).withColumn("file", F.col("path")).withColumn("path", F.concat(F.lit("git-config:"), "key")).drop("line_number")
    return _texts(rows, "value")


REGISTRIES = "docker_config podman_config helm_oci_registry"
#: A line of a file that its size alone cuts may be as long as the file.
_KUBE_LINE, _IAC_LINE = (1 << 20) + 1, (4 << 20) + 1


def _auths(files: DataFrame) -> DataFrame:
    """docker_auths of registry files, with the tool that each belongs to."""
    runtime = F.create_map(*(F.lit(x) for pair in RUNTIMES.items() for x in pair))
    return nested.docker_auths(files).withColumn("runtime", runtime[F.col("pattern_name")])


def nested_texts(files: DataFrame) -> DataFrame:
    """Values within structured documents that are detected again once decoded."""
    of = lambda name: files.where(F.col("pattern_name").isin(*name.split()))
    auths = _auths(of(REGISTRIES))
    tokens = nested.docker_identity_token(auths, keep_token=True)
    users = nested.kube_values(of("kubeconfig")).withColumnsRenamed({"user_name": "kubeconfig_user", "field": "kubeconfig_field"}).withColumn("kubeconfig_path", F.col("path"))
    parts = [
        _texts(nested.docker_inline_auth(auths).where("has_password"), "password"), _texts(tokens, "identitytoken"), _texts(nested.mcp_values(of("claude_app_state claude_settings mcp_project_config kiro_mcp"))), _texts(nested.ide_values(of("jetbrains"))),
        _texts(users), scan_keyed_lines(of("kubeconfig"), _KUBE_LINE), scan_keyed_lines(of("terraform_vars terraform_state"), _IAC_LINE),
    ]
    return fd.union_findings(*parts)


def structural_findings(files: DataFrame) -> DataFrame:
    """Findings that a document's structure alone shows."""
    of = lambda name: files.where(F.col("pattern_name").isin(*name.split()))
    auths = _auths(of(REGISTRIES))
    parts = [nested.docker_inline_auth(auths), nested.docker_identity_token(auths), nested.terraform_creds(of("terraform_credentials")), nested.helm_repo_creds(of("helm_repositories"))]
    return fd.union_findings(*(_shaped(p, "secret") for p in parts))


def config_findings(files: DataFrame) -> DataFrame:
    """Findings of git, npm, pip and SSH settings and of key files' modes."""
    of = lambda name: files.where(F.col("pattern_name").isin(*name.split()))
    tools = (("git", "gitconfig", tx.parse_git_config), ("npm", "npmrc yarnrc", tx.parse_npmrc), ("pypirc", "pypirc", tx.parse_ini), ("pip", "pip_config", tx.parse_ini))
    settings = fd.union_findings(*(parse(of(names)).withColumn("tool", F.lit(tool)) for tool, names, parse in tools))
    parts = [configs.apply_config_rules(settings), configs.ssh_config_rules(of("ssh_config"))]
    if {"mode", "os"} <= set(files.columns):
        parts.append(configs.key_permissions(of("ssh_keys").drop("content")))
    return fd.union_findings(*(_shaped(p, "misconfiguration") for p in parts))


def _shaped(df: DataFrame, kind: str) -> DataFrame:
    given = set(df.columns)
    line = F.col("line_number").cast("int") if "line_number" in given else F.lit(0)
    path = F.concat(F.lit("file:"), "path") if kind == "secret" else F.col("path")
    titles = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    title = F.coalesce(titles[F.col("finding_id")], F.col("finding_id"))
    return df.select("host_id", "finding_id", F.lit(kind).alias("type"), "fingerprint", "probe", "severity", title.alias("title"), F.concat(title, F.lit(" in "), path, F.lit(".")).alias("message"), path.alias("path"), F.col("path").alias("file"), line.alias("line_number"), F.lit("").alias("env_var"), _entries(df, _SHOWN).alias("metadata"), F.lit(0).alias("rank"), F.lit(0).alias("at"), F.col("fingerprint").alias("value_order"))


#: Probes whose files are cut by their size alone, so none of their lines is too long.
_SIZED = ("ai_chats", "ai_context", "ai_credentials", "ai_mcp", "kube", "iac")


def named_kubeconfigs(files: DataFrame, hosts: DataFrame, env: DataFrame | None = None) -> DataFrame:
    """host_id, path of the files that are kubeconfigs by the environment's KUBECONFIG (a list parted by `:`, on Windows by `;`) or by a system's fixed place, not by their own name.

    Only names are joined, no content.
    """
    names = files.select("host_id", "path").where(~fs.matches(F.col("path"), ".kube/config"))
    system = names.join(hosts.where("os = 'windows'").select("host_id"), "host_id", "left_anti").where(F.col("path").isin(*SYSTEM_KUBECONFIGS))
    if env is None:
        return system.distinct()
    named = tx.split_env(env).where("env_var = 'KUBECONFIG'").join(hosts.select("host_id", "os"), "host_id", "left")
    each = F.transform(F.split("text", F.when(F.col("os") == "windows", ";").otherwise(":")), tx.trimmed)
    wanted = named.select("host_id", F.explode(F.filter(each, lambda p: p != "")).alias("path")).distinct()
    return names.join(wanted, ["host_id", "path"], "left_semi").unionByName(system).distinct()


def routed_files(files: DataFrame, hosts: DataFrame, now: int = 0, env: DataFrame | None = None) -> DataFrame:
    """The files that a probe reads, under the first of their tags of that probe, with pattern_name, probe and route; written to the shared folder.

    Tags are an array in the row. Spark knows the size of the written table of named kubeconfigs, and broadcasts it where
    it is small, so no text is shuffled.
    """
    others = materialised(named_kubeconfigs(files, hosts, env).withColumn("__named", F.lit("kubeconfig")), "kubeconfigs")
    tagged = fs.tag_files(spread(files).join(others, ["host_id", "path"], "left"), first=True, also=F.col("__named")).drop("__named")
    routed = fs.route_probes(tagged, fs.routes_table(files.sparkSession))
    routed = materialised(routed.where(F.col("size") <= F.col("size_cap")), "routed")
    cached = F.col("pattern_name").isin("aws_sso_cache", "aws_cli_cache")
    return fs.drop_expired_cache(routed.where(cached), F.timestamp_seconds(F.lit(now))).unionByName(routed.where(~cached))


def raw_findings(files: DataFrame, hosts: DataFrame, now: int = 0, env: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """All findings of a snapshot before any are merged, with file, the path of the snapshot's file each stands in (null for the environment).

    The snapshot is read once: the files that a probe reads, and then all texts in them, are tables in the shared
    folder, and detection is planned once over all of them, not for each kind of file. listing: names of files to look
    for mounted tokens in, where they aren't those of files.
    """
    routed = routed_files(files, hosts, now, env)
    of = lambda route: routed.where(F.col("route") == route)
    sized = F.col("probe").isin(*_SIZED)
    parts = [
        scan_keyed_lines(of("line").where(~sized)), scan_keyed_lines(of("line").where(sized), 1 << 30), scan_history(of("history")), scan_whole(of("whole").where(~F.col("path").endswith(".pub"))), nested_texts(of("nested")),
        scan_config_values(routed.where(F.col("pattern_name") == "gitconfig")), scan_keyed_lines(routed.where(F.col("pattern_name").isin("npmrc", "yarnrc", "pypirc", "pip_config") & (F.col("route") != "line"))),
    ]
    if env is not None:
        parts.append(scan_env_table(env))
    own = F.col("path").startswith("git-config:") | F.col("path").startswith("env:")
    texts = fd.union_findings(*parts).withColumn("path", F.when(own, F.col("path")).otherwise(F.concat(F.lit("file:"), "path")))
    found = fd.to_findings(detect_all(materialised(texts, "texts"), now=now), hosts, kept=("file",))
    tokens = configs.service_account_tokens((files if listing is None else listing).select("host_id", "path").withColumn("probe", F.lit("cloud")))
    return fd.union_findings(found, structural_findings(routed), config_findings(routed), _shaped(tokens, "misconfiguration"))


def scan(files: DataFrame, hosts: DataFrame, now: int = 0, env: DataFrame | None = None) -> DataFrame:
    """All deduplicated findings of a snapshot (host_id, path, content, size, mtime, mode, os) with its hosts, and of their environments (host_id, entry).

    Intermediate tables are written as the plan is built; they stay in the shared folder, which is cleaned by age.
    """
    return fd.dedup_findings(raw_findings(files, hosts, now, env)).drop("file")


def incremental_findings(content: Callable[[DataFrame], DataFrame], listing: DataFrame, before: DataFrame, state: DataFrame, hosts: DataFrame, now: int = 0, env: DataFrame | None = None) -> DataFrame:
    """raw_findings of a snapshot from those of an earlier one: only new and modified files are read, the rest is carried.

    listing, before: host_id, path, mtime, size of both snapshots. state: raw_findings of the earlier one. content: gives
    the files of some (host_id, path), with their content, such as sources.files.only_files of a stored snapshot. Findings
    of missing files go, those of the environment are found anew. Token caches that expire and kubeconfigs that the
    environment newly names are looked at when they change, or with a full scan.
    """
    status = materialised(fs.changed_since(before, listing), "status")
    fresh = raw_findings(content(status.where("status <> 'missing'").select("host_id", "path")), hosts, now, env)
    kept = state.where("file IS NOT NULL").join(status.select("host_id", F.col("path").alias("file")), ["host_id", "file"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def scrub(files: DataFrame, minutes: int = 0, now: int = 0) -> DataFrame:
    """Chats and histories in which a detector finds something, with scrubbed content and counts."""
    tagged = fs.route_probes(fs.tag_files(spread(files)), fs.routes_table(files.sparkSession)).where("scrub_ok")
    texts = fd.union_findings(scan_keyed_lines(tagged.where("route = 'line'")), scan_history(tagged.where("route = 'history'")))
    hit = detect_all(texts, now=now, fields=("finding_id",)).select("host_id", "path").distinct()
    targets = fs.grace_filter(tagged, minutes, F.timestamp_seconds(F.lit(now))).drop("pattern_name", "probe", "route", "ord", "size_cap", "scrub_ok")
    return redact_all(targets.join(hit, ["host_id", "path"], "left_semi"), "content")


def findings_of_texts(texts: DataFrame, hosts: DataFrame, now: int = 0, most: int | None = fd.MOST_PLACES) -> DataFrame:
    """Deduplicated findings of any texts (host_id, path, probe, line_number, env_var, text), each with its first `most` places, or all with None."""
    return fd.dedup_findings(fd.to_findings(detect_all(texts, now=now), hosts), most=most)


def scan_scrub_rescan(texts: DataFrame, key: str = "doc_id", now: int = 0) -> DataFrame:
    """key, finding_id, n_before, n_after, n_gone of each text's hits before and after its redaction.

    Both versions are rows that one pass detects in; what was redacted is not worked out again, as rows stand between.
    """
    versions = F.array(F.struct(F.lit(False).alias("after"), F.col("text").alias("text")), F.struct(F.lit(True).alias("after"), F.col("scrubbed").alias("text")))
    both = exploded(redact_all(texts.select(key, "text")), versions, "v").select(key, "v.after", "v.text")
    return fd.gone(detect_all(both, now=now, fields=("finding_id",)), "after", (key, "finding_id"))
