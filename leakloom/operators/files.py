"""File selection over a table of files. Paths are matched, never walked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regexport import glob_regex
from ..functions.rows import exploded
from .catalogue import PATTERNS, ROUTES
from .ranks import ranked

#: Names of directories, and trees, that are not scanned.
DEFAULT_EXCLUDES = (
    "node_modules", "__pycache__", ".tox", "~/Library/Caches", "~/Library/Logs", "~/Library/Developer/Xcode/DerivedData", "~/.Trash", "~/.cache", "~/go/pkg/mod", "~/.gradle/caches", "~/.m2/repository", "~/.npm/_cacache",
)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches(path: Column, pattern: str, kind: str = "glob") -> Column:
    """Whether a relative path matches one pattern: a glob of the last segment, a suffix as it stands, or a glob of as many last segments; exact: the path or its last segment."""
    if kind == "exact":
        return (path == pattern) | (basename(path) == pattern)
    if kind != "glob":
        return F.lit(False)
    body = glob_regex(pattern)
    if "/" not in pattern:
        return basename(path).rlike(f"^(?:{body})\\z") if body is not None else F.lit(False)
    if not any(c in pattern for c in "*?["):
        return path.endswith(pattern)
    return path.rlike(f"(?:^|/){body}\\z") if body is not None else F.lit(False)


def tags_of(path: Column, patterns: tuple[tuple[str, tuple[str, ...], str], ...] = PATTERNS) -> Column:
    """The names of all patterns that a path matches, in catalogue order. A row stays one row."""
    named = [F.when(reduce(lambda a, b: a | b, (matches(path, g, kind) for g in globs)), F.lit(name)) for name, globs, kind in patterns]
    return F.filter(F.array(*named), lambda n: n.isNotNull())


def tag_files(files: DataFrame, patterns: tuple = PATTERNS, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, max_depth: int = 0, path: str = "path", home: str | None = None, first: bool = False, also: Column | None = None) -> DataFrame:
    """A row for each file and pattern name that it matches (pattern_name), or with first for each probe's first one. Excluded and too deep files are left out; 0 is any depth.

    also: a pattern name (or null) that a file has whatever its path, even where it is excluded.
    """
    keep = ~(_below_named(path, excludes) | _below_tree(path, excludes, home) | _deeper(path, max_depth))
    tags = tags_of(F.col(path), patterns)
    if also is not None:
        none = F.array().cast("array<string>")
        tags = F.array_distinct(F.concat(F.when(keep, tags).otherwise(none), F.when(also.isNotNull(), F.array(also)).otherwise(none)))
        keep = keep | also.isNotNull()
    rows = files.where(keep)
    if first:
        rows = rows.withColumn("__tags", tags)
        return exploded(rows, first_tags(F.col("__tags")), "pattern_name").drop("__tags")
    return exploded(rows, tags, "pattern_name")


def first_tags(tags: Column, routes: tuple = ROUTES) -> Column:
    """Of a row's pattern names, the first of each probe in the probe's order."""
    of_probe = {}
    for name, probe, _, order, *_ in sorted(routes, key=lambda r: (r[3], r[0])):
        of_probe.setdefault(probe, []).append(name)
    firsts = F.array(*(F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(tags, n)), F.lit(0)) for names in of_probe.values()))
    return F.array_distinct(F.filter(firsts, lambda n: n.isNotNull()))


def pattern_catalog(spark: SparkSession, patterns: tuple = PATTERNS) -> DataFrame:
    return spark.createDataFrame([(name, kind, glob, i) for i, (name, globs, kind) in enumerate(patterns) for glob in globs], "name string, kind string, pattern string, ord int")


def routes_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in ROUTES], "pattern_name string, probe string, route string, ord int, size_cap long, scrub_ok boolean")


def _below_named(path: str, excludes: tuple[str, ...]) -> Column:
    names = [x for x in excludes if "/" not in x and not x.startswith("~")]
    parts = F.split(F.col(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, names))) if names else F.lit(False)


def _below_tree(path: str, excludes: tuple[str, ...], home: str | None) -> Column:
    below = F.lit(False)
    for tree in (x for x in excludes if "/" in x or x.startswith("~")):
        root = tree.replace("~", home, 1) if home else tree.removeprefix("~/")
        below = below | (F.col(path) == root) | F.col(path).startswith(root.rstrip("/") + "/")
    return below


def _deeper(path: str, max_depth: int) -> Column:
    return F.size(F.split(F.col(path), "/")) - 1 > max_depth if max_depth else F.lit(False)


def exclude_basename(files: DataFrame, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, path: str = "path") -> DataFrame:
    """Files below no directory of an excluded name."""
    return files.where(~_below_named(path, excludes))


def exclude_tree(files: DataFrame, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, path: str = "path", home: str | None = None) -> DataFrame:
    """Files below no excluded tree. Trees under `~` are taken relative to the home folder, as paths are, unless home is given."""
    return files.where(~_below_tree(path, excludes, home))


def max_depth_filter(files: DataFrame, max_depth: int, path: str = "path") -> DataFrame:
    return files.where(~_deeper(path, max_depth))


def expand_base_dirs(files: DataFrame, bases: list[str], home: str, path: str = "path") -> DataFrame:
    """A row for each base folder that holds the file: base_dir, and rel_path below it. `~` and `$HOME` stand for home."""
    roots = [b.replace("$HOME", home).replace("~", home, 1) if b.startswith(("~", "$HOME")) else b for b in bases]
    each = F.array(*(F.when(F.col(path).startswith(r.rstrip("/") + "/"), F.struct(F.lit(r).alias("base_dir"), F.substring(F.col(path), len(r.rstrip("/")) + 2, 1 << 30).alias("rel_path"))) for r in roots))
    kept = files.columns
    return exploded(files, F.filter(each, lambda b: b.isNotNull()), "__b").select(*kept, "__b.*")


def index_counts(tagged: DataFrame) -> DataFrame:
    """n of each pattern_name, and of all (a null name)."""
    return tagged.rollup("pattern_name").agg(F.count(F.lit(1)).alias("n"))


def route_probes(tagged: DataFrame, routes: DataFrame, enabled: tuple[str, ...] | None = None) -> DataFrame:
    rows = tagged.join(F.broadcast(routes), "pattern_name")
    return rows.where(F.col("probe").isin(*enabled)) if enabled is not None else rows


def dedup_paths(routed: DataFrame) -> DataFrame:
    """One row for each (host_id, probe, path): the first pattern in the probe's order."""
    order = Window.partitionBy("host_id", "probe", "path").orderBy("ord", "pattern_name", *(c for c in ("size", "doc_id") if c in routed.columns))
    return routed.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def cap_size(files: DataFrame, caps: dict[str, int] | None = None, default: int = 1 << 20, size: str = "size", probe: str = "probe") -> DataFrame:
    """Files of no more bytes than their probe's cap; a cap that isn't positive is the default."""
    limit = F.lit(default)
    for name, cap in (caps or {}).items():
        limit = F.when(F.col(probe) == name, F.lit(cap if cap > 0 else default)).otherwise(limit)
    return files.where(F.col(size) <= limit)


def drop_expired_cache(files: DataFrame, now: Column, text: str = "content") -> DataFrame:
    """Token cache files whose own expiry lies over a minute back go; what can't be read stays."""
    doc = F.from_json(F.col(text), "Credentials struct<Expiration string>, expiresAt string")
    ends = F.try_to_timestamp(F.coalesce(F.nullif(doc["Credentials"]["Expiration"], F.lit("")), F.nullif(doc["expiresAt"], F.lit(""))))
    return files.where(~F.coalesce(ends + F.expr("INTERVAL 60 SECONDS") < now, F.lit(False)))


def grace_filter(files: DataFrame, minutes: int, now: Column, mtime: str = "mtime") -> DataFrame:
    """Files last written before `minutes` ago; all if minutes isn't positive."""
    return files.where(F.col(mtime) < now - F.make_interval(mins=F.lit(minutes))) if minutes > 0 else files


def changed_since(prev: DataFrame, cur: DataFrame, keys: tuple[str, ...] = ("host_id", "path")) -> DataFrame:
    """keys and status (missing, modified, new) of files that differ in time or size between two snapshots."""
    a, b = (df.select(*keys, F.struct("mtime", "size").alias(n)) for df, n in ((prev, "was"), (cur, "is")))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "modified")
    return a.join(b, list(keys), "full_outer").withColumn("status", status).where("status IS NOT NULL").select(*keys, "status")


def even_sample(files: DataFrame, n: int, by: str = "host_id", path: str = "path") -> DataFrame:
    """n evenly spaced files of each host in path order, or all if there are no more: those at floor(i * count / n).

    Each host's picks are rows of their own (host, place), which meet the ranked files by both, so no task takes a
    whole host. A null host is a host of its own.
    """
    rows = ranked(files, (path,), (by,), "__n")
    counts = files.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__count"))
    picks = F.when(F.col("__count") <= n, F.sequence(F.lit(1).cast("long"), F.col("__count"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__count") / F.lit(float(n)))) + 1)))
    wanted = counts.select("__by", F.explode(picks).alias("__pick"))
    return rows.join(wanted, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__n") == F.col("__pick")), "left_semi").drop("__n")
