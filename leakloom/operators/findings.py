"""Findings: fingerprints, order, deduplication, report rows."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.rows import materialised
from .ranks import ranked

#: The order of a report: a hit of an earlier detector stands before others on the same line.
ORDER = ("probe", "path", "line_number", "rank", "finding_id", "at", "value_order")

FINDING_SCHEMA = (
    "host_id string, finding_id string, type string, fingerprint string, probe string, severity string, title string, message string, path string, "
    "line_number int, env_var string, metadata map<string,string>, rank int, at int, value_order string"
)


def merge_maps(*maps: Column) -> Column:
    """One map of all; a later one's value wins."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


#: Most hosts whose pads are broadcast; a row of pads takes under 300 bytes, so all take under 30 MB.
BROADCAST_HOSTS = 100_000


def salted_fingerprint(df: DataFrame, value: str, hosts: DataFrame, to: str = "fingerprint", most: int | None = None) -> DataFrame:
    """Add the HMAC-SHA256 of a value under its host's salt; pads are worked out once for each host. hosts: host_id, os, arch, hostname, username.

    The pads of up to `most` hosts are broadcast, so rows stay where they are. With more hosts rows are dealt by host,
    and the value crosses the wire only sealed with a key of this one call.
    """
    pads = hosts.select("host_id", sc.hmac_pads(sc.host_salt(*(F.col(c) for c in ("os", "arch", "hostname", "username")))).alias("__pads"))
    most = BROADCAST_HOSTS if most is None else most
    if hosts.select("host_id").limit(most + 1).count() <= most:
        return df.join(F.broadcast(pads), "host_id", "left").withColumn(to, sc.hmac_hex(F.col("__pads"), F.col(value))).drop("__pads")
    key = F.lit(secrets.token_bytes(32))
    sealed = df.withColumn("__sealed", F.aes_encrypt(F.encode(F.col(value), "UTF-8"), key)).drop(value)
    # repartition before the join, so that the seal isn't opened before the exchange.
    joined = sealed.repartition("host_id").join(pads, "host_id", "left")
    opened = joined.withColumn(value, F.decode(F.aes_decrypt("__sealed", key), "UTF-8"))
    return opened.withColumn(to, sc.hmac_hex(F.col("__pads"), F.col(value))).select(*df.columns, to)


def to_findings(hits: DataFrame, hosts: DataFrame, extra: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """Columns in kept stay. Hits with host_id, path, probe, line_number, env_var as findings. The value leaves with its fingerprint; columns in extra, and entries of a map column place, go to metadata, over a detector's own."""
    rows = salted_fingerprint(hits, "value", hosts)
    own = F.create_map(F.lit("detector_name"), F.col("detector"), F.lit("token_type"), F.col("token_type"))
    placed = F.filter(F.array(F.struct(F.lit("line_number").alias("key"), F.when(F.col("line_number") > 0, F.col("line_number").cast("string")).alias("value")), F.struct(F.lit("env_var").alias("key"), F.when(F.col("env_var") != "", F.col("env_var")).alias("value")), *(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in extra)), lambda e: e["value"].isNotNull())
    source = sc.format_source(F.col("path"), F.col("line_number"))
    return rows.withColumn("metadata", merge_maps(own, F.col("metadata"), *([F.col("place")] if "place" in hits.columns else []), F.map_from_entries(placed))).select(
        "host_id", "finding_id", F.lit("secret").alias("type"), "fingerprint", "probe", "severity", "title", F.concat("title", F.lit(" in "), source, F.lit(".")).alias("message"), "path", "line_number", "env_var", "metadata", "rank", "at",
        F.col("fingerprint").alias("value_order"), *kept,
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def format_location(path: Column, line: Column, env_var: Column, locations: Column) -> Column:
    """All locations, or the path (`-` if none), its line, and the variable unless the path names it after its scheme."""
    base = F.when(F.coalesce(path, F.lit("")) == "", "-").otherwise(path)
    line_part = F.when(line > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise("")
    env = F.when((F.coalesce(env_var, F.lit("")) != "") & (F.substring(base, F.lit(5), F.length(env_var)) != env_var), F.concat(F.lit(" (env: "), env_var, F.lit(")"))).otherwise("")
    return F.when(F.size(locations) > 0, F.array_join(locations, ", ")).otherwise(F.concat(base, line_part, env))


#: Most places that one finding carries; all of them are rows of finding_places.
MOST_PLACES = 1000


def _order(findings: DataFrame, order: tuple[str, ...]) -> Column:
    kinds = dict(findings.dtypes)
    return F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in order))


def _fingerprinted(findings: DataFrame) -> DataFrame:
    return findings.where(F.coalesce("fingerprint", F.lit("")) != "")


def _place() -> Column:
    return format_location(F.col("path"), F.col("line_number"), F.col("env_var"), F.lit(None).cast("array<string>"))


def dedup_findings(findings: DataFrame, order: tuple[str, ...] = ORDER, keys: tuple[str, ...] = ("host_id", "fingerprint"), most: int | None = MOST_PLACES) -> DataFrame:
    """One finding for each host and fingerprint, the first in order, with n_places and, if there are several, their locations in order.

    Findings without a fingerprint are never merged. The findings are written to the shared folder once, without text or
    secrets. The first of each and their number come from partial aggregates. locations holds the first `most` places:
    each task hands on no more than these of a fingerprint, so one that stands in millions of lines is no task's whole
    load; finding_places has all of them as rows. With most=None a finding carries every place, however many: they are
    numbered by a sort that spills, and then stand in its one row.
    """
    findings = materialised(findings, "findings")
    have = _fingerprinted(findings)
    none = findings.where(F.coalesce("fingerprint", F.lit("")) == "").withColumn("n_places", F.lit(1).cast("long")).withColumn("locations", F.lit(None).cast("array<string>"))
    rest = [c for c in findings.columns if c not in keys and not dict(findings.dtypes)[c].startswith("map")]
    maps = [c for c in findings.columns if c not in keys and dict(findings.dtypes)[c].startswith("map")]
    row = F.struct(_order(findings, order).alias("o"), *(F.col(c) for c in rest), *(F.array_sort(F.map_entries(c)).alias(c) for c in maps))
    first = have.groupBy(*keys).agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("n_places"))
    placed = have.select(*keys, _order(findings, order).alias("o"), _place().alias("place"))
    few = placed.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "place"))).select(*keys, "n", "place")
    few = few if most is None else few.where(F.col("n") <= most)
    lists = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "place"))), lambda x: x["place"]).alias("locations"))
    both = first.join(lists, list(keys))
    merged = both.select(*keys, *(F.col(f"r.{c}") for c in rest), *(F.map_from_entries(f"r.{c}").alias(c) for c in maps), "n_places", F.when(F.col("n_places") > 1, F.col("locations")).alias("locations"))
    return merged.select(*none.columns).unionByName(none)


def finding_places(findings: DataFrame, order: tuple[str, ...] = ORDER, keys: tuple[str, ...] = ("host_id", "fingerprint")) -> DataFrame:
    """keys, n and place of every place of every fingerprint, numbered from 1 in order, however many a fingerprint has."""
    rows = _fingerprinted(findings).select(*keys, _order(findings, order).alias("o"), _place().alias("place"))
    return ranked(rows, ("o", "place"), keys).select(*keys, "n", "place")


def report_table(findings: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """n, severity, probe, title, message, location in report order, numbered from 1."""
    locations = F.col("locations") if "locations" in findings.columns else F.lit(None).cast("array<string>")
    rows = findings.withColumn("location", format_location(F.col("path"), F.col("line_number"), F.col("env_var"), locations))
    return ranked(rows, order).select("n", "severity", "probe", "title", "message", "location")


def strict_gate(findings: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """n_findings (before deduplication) and any_finding of each host with findings, or of each of hosts (host_id)."""
    counts = findings.groupBy("host_id").agg(F.count(F.lit(1)).alias("n_findings"))
    if hosts is not None:
        counts = hosts.select("host_id").join(counts, "host_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("long")))
    return counts.withColumn("any_finding", F.col("n_findings") > 0)


def affected_files(findings: DataFrame, files: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Distinct host_id, path of findings, and n, the path's place among its host's by its first finding in order: without the `file:` scheme, and without a last `:N` if only the shorter path is a file."""
    seen = findings.select("host_id", F.regexp_replace("path", "^file:", "").alias("full"), _order(findings, order).alias("o"))
    paths = seen.groupBy("host_id", "full").agg(F.min("o").alias("o")).withColumn("short", F.regexp_replace("full", r":[0-9]+\z", ""))
    known = files.select("host_id", F.col("path").alias("short")).distinct().withColumn("__is", F.lit(True))
    out = paths.join(known, ["host_id", "short"], "left").groupBy("host_id", F.when(F.col("__is"), F.col("short")).otherwise(F.col("full")).alias("path")).agg(F.min("o").alias("o"))
    return ranked(out, ("o", "path"), ("host_id",)).select("host_id", "path", "n")


def gone(hits: DataFrame, after: str, keys: tuple[str, ...] = ("doc_id", "finding_id")) -> DataFrame:
    """keys, n_before, n_after, n_gone of hits before and after a scrub, which the boolean column after tells apart."""
    both = hits.groupBy(*keys).agg(F.count_if(~F.col(after)).alias("n_before"), F.count_if(F.col(after)).alias("n_after"))
    return both.withColumn("n_gone", F.col("n_before") - F.col("n_after"))
