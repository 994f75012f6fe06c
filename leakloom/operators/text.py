"""Text preparation: lines, histories, key/value configurations, SSH scopes, environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.rows import exploded
from ..functions.regexport import UNICODE_SPACE

MAX_LINE = 1 << 20


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z", "")


def not_blank(c: Column) -> Column:
    return c.rlike(f"[^{UNICODE_SPACE}]")


def pieces(text: Column, joins: tuple[str, ...] = (), any_case: bool = False, least: int = 200) -> Column:
    """A text in pieces of `least` characters and some more, each but the last with white space at its end, but none that follows one of joins. They make up the whole text."""
    s = "[\\t\\n\\f\\r ]"
    on = f"(?:(?<={'|'.join(f'\\Q{j}\\E' for j in joins)}){s}++[^{s[1:]}*+)*+" if joins else ""
    return F.regexp_extract_all(text, F.lit(f"(?s{'iu' if any_case else ''}).{{0,{least}}}+{s}*+[^{s[1:]}*+{on}{s}*+"), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines without their ends; nothing follows a last newline."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r\\z", ""))


def to_lines(files: DataFrame, text: str = "content", max_line: int = MAX_LINE, keep_blank: bool = False) -> DataFrame:
    """Every line of every file: line_number (from 1) and line beside the other columns.

    A line of max_line bytes or more stops its file: it and all after it are left out. Blank lines are left out unless
    keep_blank. Both are decided within the row, so no text is shuffled.
    """

    def short(lines: Column) -> Column:
        stop = F.array_position(F.transform(lines, lambda x: F.octet_length(x) >= max_line), True)
        return F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)

    out = files.withColumn("__lines", sc.bound(lines_of(F.col(text)), short)).drop(text)
    kept = [c for c in out.columns if c != "__lines"]
    # The outer form: for the plain one Spark would infer a filter that cuts the lines a second time.
    rows = out.select(*kept, F.posexplode_outer("__lines").alias("__at", "line")).where("__at IS NOT NULL").select(*kept, (F.col("__at") + 1).alias("line_number"), "line")
    return rows if keep_blank else rows.where(not_blank(F.col("line")))


def strip_zsh(line: Column) -> Column:
    return F.when(line.startswith(":") & line.contains(";"), F.substring(line, F.instr(line, ";") + 1, F.length(line))).otherwise(line)


def parse_history(lines: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """Replace each history line by its command: zsh timestamps go, a fish history keeps its cmd rows only."""
    plain = strip_zsh(F.col(line))
    fish = F.col(path).endswith("fish_history")
    rule = r"^[ \t]*(?:- )?cmd:[ \t]*(.*)\z"
    rows = lines.withColumn("__plain", plain).where(~fish | F.col("__plain").rlike(rule))
    command = F.when(fish, sc.unescape_fish(F.regexp_extract("__plain", rule, 1))).otherwise(F.col("__plain"))
    return rows.withColumn(line, command).drop("__plain").where(not_blank(F.col(line)))


PAIR = "array<struct<key string, value string, line_number int>>"


def _key_values(files: DataFrame, text: str, pair_of) -> DataFrame:
    """key, value, line_number of each key's last line, worked out within the row."""

    def last_of(pairs: Column) -> Column:
        """Of pairs by key and line, those that another key follows."""
        return F.filter(pairs, lambda p, i: ~F.coalesce(F.get(pairs, i + 1)["key"] == p["key"], F.lit(False)))

    pairs = F.filter(F.transform(lines_of(F.col(text)), pair_of), lambda p: p.isNotNull())
    by_key = F.array_sort(F.transform(pairs, lambda p: F.struct(p["key"], p["line_number"], p["value"])))
    kept = [c for c in files.columns if c != text]
    return exploded(files, sc.bound(by_key, last_of), "__p").select(*kept, "__p.key", "__p.value", "__p.line_number")


def _pair(key: Column, value: Column, at: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"), (at + 1).alias("line_number"))


def parse_git_config(files: DataFrame, text: str = "content") -> DataFrame:
    """`key=value` rows, as `git config --list` prints them."""
    return _key_values(files, text, lambda x, i: F.when(trimmed(x).contains("="), _pair(F.substring_index(trimmed(x), "=", 1), F.substring(trimmed(x), F.instr(trimmed(x), "=") + 1, F.length(x)), i)))


def _commented(x: Column, signs: str) -> Column:
    return ~not_blank(x) | trimmed(x).rlike(f"^[{signs}]")


def parse_npmrc(files: DataFrame, text: str = "content") -> DataFrame:
    """`key = value`, or `key: value` without an equals sign; quotes around a value go."""

    def pair(x: Column, i: Column) -> Column:
        at = F.when(F.instr(x, "=") > 0, F.instr(x, "=")).otherwise(F.instr(x, ":"))
        value = F.regexp_replace(trimmed(F.substring(x, at + 1, F.length(x))), "^[\"']+|[\"']+\\z", "")
        return F.when(~_commented(x, "#;") & (at > 0), _pair(trimmed(F.left(x, at - 1)), value, i))

    return _key_values(files, text, lambda x, i: pair(trimmed(x), i))


def parse_ini(files: DataFrame, text: str = "content") -> DataFrame:
    """`key = value` with a lower-case key; sections are ignored."""

    def pair(x: Column, i: Column) -> Column:
        at = F.instr(x, "=")
        return F.when(~_commented(x, "#;\\[") & (at > 1), _pair(F.lower(trimmed(F.left(x, at - 1))), trimmed(F.substring(x, at + 1, F.length(x))), i))

    return _key_values(files, text, lambda x, i: pair(trimmed(x), i))


def ssh_scopes(text: Column) -> Column:
    """An array of key (lower case), value, host and line_number of each setting of an SSH client configuration; host is the last Host before it, or `*`."""

    def fold(lines: Column) -> Column:
        rows = F.transform(lines, lambda x, i: F.struct(trimmed(x).alias("t"), (i + 1).alias("line_number")))
        rows = F.transform(F.filter(rows, lambda r: (r["t"] != "") & ~r["t"].startswith("#")), lambda r: F.struct(F.split(r["t"], f"[{UNICODE_SPACE}]+").alias("f"), r["line_number"]))
        rows = F.transform(F.filter(rows, lambda r: F.size(r["f"]) >= 2), lambda r: F.struct(F.lower(F.get(r["f"], 0)).alias("key"), F.array_join(F.slice(r["f"], 2, F.size(r["f"]) - 1), " ").alias("value"), r["line_number"]))
        return sc.bound(rows, lambda r: sc.bound(F.struct(r.alias("rows"), F.filter(r, lambda h: h["key"] == "host").alias("hosts")), scoped))

    def scoped(of: Column) -> Column:
        host = lambda r: F.coalesce(F.get(of["hosts"], F.size(F.filter(of["hosts"], lambda h: h["line_number"] <= r["line_number"])) - 1)["value"], F.lit("*"))
        settings = F.filter(of["rows"], lambda r: r["key"] != "host")
        return F.transform(settings, lambda r: F.struct(r["key"], r["value"], host(r).alias("host"), r["line_number"]))

    return sc.bound(lines_of(text), fold)


def ssh_host_scope(files: DataFrame, text: str = "content") -> DataFrame:
    """A row for each setting of ssh_scopes."""
    kept = [c for c in files.columns if c != text]
    return exploded(files, ssh_scopes(F.col(text)), "__r").select(*kept, "__r.*")


def split_env(env: DataFrame, entry: str = "entry") -> DataFrame:
    """source, env_var and text of each `NAME=VALUE` with a value."""
    at = F.instr(entry, "=")
    rows = env.withColumn("env_var", F.left(F.col(entry), at - 1)).withColumn("text", F.substring(F.col(entry), at + 1, F.length(entry))).where((F.instr(entry, "=") > 0) & (F.col("text") != ""))
    return rows.withColumn("source", F.concat(F.lit("env:"), "env_var")).drop(entry)
