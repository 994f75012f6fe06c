"""Credentials inside JSON, YAML, HCL and XML documents: structural findings, and the values to detect in.

A document that doesn't parse, or has another type in a field that is read, gives nothing; other documents of its batch
are read all the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import jsondoc, yamldoc
from ..functions import scalars as sc
from ..functions.regexport import UNICODE_SPACE
from ..functions.rows import exploded
from ..functions.yamldoc import Unfit
from .text import trimmed


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _base64(c: Column) -> Column:
    return F.make_valid_utf8(F.try_to_binary(F.regexp_replace(c, "[\r\n]", ""), F.lit("base64")).cast("string"))


def _exploded(df: DataFrame, rows: Column, text: str) -> DataFrame:
    kept = [c for c in df.columns if c != text]
    return exploded(df, rows, "__r").select(*kept, "__r.*")


#: Characters of values after which a task hands its rows on.
MOST_CHARS = 1 << 20


def _entries(files: DataFrame, text: str, rows_of, names: str, ints: str = "") -> DataFrame:
    """The columns of files but the text, and those of names (texts) and ints, of each row that rows_of gives for a document. One that doesn't fit gives none."""
    keys = [c for c in files.columns if c != text]
    texts, numbers = names.split(), ints.split()
    schema = StructType([*(files.schema[c] for c in keys), *(StructField(n, StringType()) for n in texts), *(StructField(n, IntegerType()) for n in numbers)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows_of_batches(batches, keys, texts, numbers, rows_of, MOST_CHARS)

    return files.select(*(F.col(f"`{c}`") for c in keys), F.col(f"`{text}`")).mapInArrow(read, schema)


def _rows_of_batches(batches: Iterator[pa.RecordBatch], keys: list[str], texts: list[str], numbers: list[str], rows_of, most: int) -> Iterator[pa.RecordBatch]:
    """A document at a time, and rows are handed on once their texts have some size: a batch's documents and values never all stand as Python's."""

    def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
        new = [pa.array([r[i] for r in rows], pa.string() if i < len(texts) else pa.int32()) for i in range(len(texts) + len(numbers))]
        return pa.RecordBatch.from_arrays([*own, *new], [*keys, *texts, *numbers])

    for batch in batches:
        at, rows, size = [], [], 0
        documents = batch.column(len(keys))
        for i in range(len(documents)):
            try:
                found = rows_of(documents[i].as_py() or "")
            except Unfit:
                continue
            at += [i] * len(found)
            rows += found
            size += sum(len(v) for r in found for v in r[: len(texts)])
            if size > most:
                yield made(batch, at, rows)
                at, rows, size = [], [], 0
        if rows:
            yield made(batch, at, rows)


def docker_auths(files: DataFrame, text: str = "content") -> DataFrame:
    """registry_host, auth, identitytoken of each entry."""
    shape = {"auths": {jsondoc.ANY: {"auth": str, "username": str, "identitytoken": str}}}
    return _entries(files, text, lambda doc: [(host, e.get("auth", ""), e.get("identitytoken", "")) for host, e in jsondoc.fields(doc, shape).get("auths", {}).items()], "registry_host auth identitytoken")


def docker_inline_auth(auths: DataFrame) -> DataFrame:
    """Findings of inline credentials, with username, has_password and the password, which is for detection only."""
    decoded = auths.where("auth <> ''").withColumn("__d", _base64(trimmed(F.col("auth")))).where(F.col("__d").contains(":"))
    at = F.instr("__d", ":")
    out = decoded.withColumn("username", F.left("__d", at - 1)).withColumn("password", F.substring(F.col("__d"), at + 1, F.length("__d"))).withColumn("has_password", F.col("password") != "")
    return _finding(out.drop("__d", "auth", "identitytoken"), "docker-registry-inline-auth", "registry_host").withColumn("location", F.concat(F.lit("auths["), _quoted(F.col("registry_host")), F.lit("].auth")))


def docker_identity_token(auths: DataFrame, keep_token: bool = False) -> DataFrame:
    """Findings of identity tokens; the token itself stays for detection only."""
    out = _finding(auths.where("identitytoken <> ''").drop("auth", *([] if keep_token else ["identitytoken"])), "docker-registry-inline-identity-token", "registry_host")
    return out.withColumn("location", F.concat(F.lit("auths["), _quoted(F.col("registry_host")), F.lit("].identitytoken")))


def _finding(df: DataFrame, finding_id: str, name: str) -> DataFrame:
    return df.withColumn("finding_id", F.lit(finding_id)).withColumn("severity", F.lit("critical")).withColumn("fingerprint", sc.fields_fingerprint(F.lit(finding_id), F.col("path"), F.col(name)))


#: Fixed value: a credentials block.
HCL = re.compile(r"""credentials[\t\n\f\r ]+["']([^"']+)["'][\t\n\f\r ]*\{[^}]*?token[\t\n\f\r ]*=[\t\n\f\r ]*["']([^"']+)["']""")


def _terraform_tokens(doc: str) -> list[tuple[str, str, str]]:
    """host, token, format of each entry of the JSON form if that has any, else of the blocks."""
    try:
        entries = jsondoc.fields(doc, {"credentials": {jsondoc.ANY: {"token": str}}}).get("credentials", {})
    except Unfit:
        entries = {}
    if entries:
        return [(host, e["token"], "json") for host, e in entries.items() if e.get("token")]
    return [(host, token, "hcl") for host, token in HCL.findall(doc)]


def terraform_creds(files: DataFrame, text: str = "content") -> DataFrame:
    """Findings of stored tokens (host, file_format, token_prefix, token_fragment): the JSON form, else HCL blocks."""
    out = _entries(files, text, _terraform_tokens, "host token file_format").withColumn("token_prefix", F.left("token", F.lit(8))).withColumn("token_fragment", sc.mask_token(F.col("token")))
    return _finding(out.drop("token"), "terraform-cloud-credential", "host").withColumn("location", F.concat(F.lit("credentials["), _quoted(F.col("host")), F.lit("].token")))


#: Fixed value: commands whose first argument that is no option may be a package's own name.
RUNNERS = ("npx", "bunx", "uvx")
_MCP = {"mcpServers": {jsondoc.ANY: {"command": str, "args": [str], "env": {jsondoc.ANY: str}, "envVars": {jsondoc.ANY: str}}}}


def _mcp_rows(doc: str) -> list[tuple]:
    """server, command, kind, env_var, text, place of each value."""
    out = []
    for name, s in jsondoc.fields(doc, _MCP).get("mcpServers", {}).items():
        command, args = s.get("command", ""), s.get("args", [])
        out += [(name, command, kind, key, value, 0) for kind in ("env", "envVars") for key, value in s.get(kind, {}).items() if value]
        first = next((i for i, a in enumerate(args) if not a.startswith("-")), -1)
        own = first if first >= 0 and command in RUNNERS and re.match(r"(?s)@[^/]+/.", args[first]) else -1
        out += [(name, command, "args", "", a, i) for i, a in enumerate(args) if a and i != own]
    return out


def mcp_values(files: DataFrame, text: str = "content") -> DataFrame:
    """server, command, location, env_var and text of every value of env and envVars and every argument, but a package's own name."""
    rows = _entries(files, text, _mcp_rows, "server command kind env_var text", "place")
    key = F.when(F.col("kind") == "args", F.col("place").cast("string")).otherwise(_quoted(F.col("env_var")))
    return rows.withColumn("location", F.concat(F.lit("mcpServers["), _quoted(F.col("server")), F.lit("]."), "kind", F.lit("["), key, F.lit("]"))).drop("kind", "place")


def ide_values(files: DataFrame, text: str = "content") -> DataFrame:
    """config_name, env_var, line_number and text of the parameters and environment of an IDE's run configurations."""
    env = "envs struct<env array<struct<_name string, _value string>>>"
    schema = f"component array<struct<_name string, configuration array<struct<_name string, parameters struct<_value string>, {env}>>>>"
    doc = F.from_xml(F.col(text), schema)
    entry = "array<struct<config_name string, env_var string, text string>>"

    def of_configuration(c: Column) -> Column:
        own = F.array(F.struct(c["_name"], F.lit(""), c["parameters"]["_value"])).cast(entry)
        return F.concat(own, F.transform(F.coalesce(c["envs"]["env"], F.array().cast("array<struct<_name string, _value string>>")), lambda v: F.struct(c["_name"], v["_name"], v["_value"])).cast(entry))

    managers = F.filter(doc["component"], lambda c: c["_name"] == "RunManager")
    rows = F.flatten(F.transform(managers, lambda m: F.flatten(F.transform(F.coalesce(m["configuration"], F.array()), of_configuration))))
    placed = F.transform(rows, lambda r: F.struct(r["config_name"], r["env_var"], r["text"], sc.value_line(F.coalesce(r["text"], F.lit("")), F.col(text)).alias("line_number")))
    return _exploded(files, placed, text).where(trimmed(F.col("text")) != "")


_ENCODED = ("client-key-data", "token-data")


def _kube_users(doc: str) -> list[tuple]:
    users = yamldoc.fields(doc, {"users": [{"name": str, "user": dict.fromkeys(_ENCODED, str)}]}).get("users", [])
    return [(u.get("name", ""), field, u["user"][field], i) for i, u in enumerate(users) for field in _ENCODED if u.get("user", {}).get(field)]


def kube_values(files: DataFrame, text: str = "content") -> DataFrame:
    """user_name, field, location and decoded text of base64 keys and tokens of a kubeconfig."""
    rows = _entries(files, text, _kube_users, "user_name field encoded", "user_index")
    out = rows.withColumn("text", _base64(F.regexp_replace("encoded", f"[{UNICODE_SPACE}]", ""))).where("text IS NOT NULL AND text <> ''")
    return out.withColumn("location", F.concat(F.lit("users["), F.col("user_index").cast("string"), F.lit("].user."), "field")).drop("encoded", "user_index")


def _helm_repositories(doc: str) -> list[tuple]:
    names = ("name", "url", "username")
    found = yamldoc.fields(doc, {"repositories": [dict.fromkeys((*names, "password"), str)]}).get("repositories", [])
    return [tuple(r.get(n, "") for n in names) for r in found if r.get("password")]


def helm_repo_creds(files: DataFrame, text: str = "content") -> DataFrame:
    """Findings of chart repositories with a password: repo_name, repo_url, username."""
    rows = _entries(files, text, _helm_repositories, "repo_name repo_url username")
    return _finding(rows, "helm-repository-credential", "repo_name").withColumn("username_present", F.col("username") != "").withColumn("location", F.concat(F.lit("repositories["), _quoted(F.col("repo_name")), F.lit("]")))
