"""Redaction: rules in order, each on what the one before left, with counts by label."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded
from ..functions.scalars import bound
from .anchored import Anchored, replaced
from .detect import _any_of
from .registry import REDACT_SPECS, Redaction
from .text import pieces


def _makes(replacement: str, literal: str) -> bool:
    """Whether putting in a replacement can make a literal that its text didn't hold: one inside it, or across either end."""
    fixed = re.split(r"\$[0-9]", replacement)
    inside = any(literal in x for x in fixed)
    across = any(x.startswith(literal[i:]) or x.endswith(literal[:i]) for x in fixed if x for i in range(1, len(literal)))
    return inside or across


def _made(specs: tuple[Redaction, ...]) -> set[int]:
    """The numbers of the rules whose gate can't be told from the text alone: those a literal of which an earlier rule's replacement can make."""
    return {k for k, rule in enumerate(specs) if any(_makes(r.replacement, x) for r in specs[:k] for x in rule.gate)}


def _may_match(text: Column, specs: tuple[Redaction, ...], made: set[int]) -> Column:
    """The numbers of the rules that have to run on a text: those a literal of whose gate it holds, those without a gate, and those of made."""
    numbers = [F.lit(k) if k in made or not rule.gate else F.when(_any_of(text, rule.gate, False), F.lit(k)) for k, rule in enumerate(specs)]
    return F.filter(F.array(*numbers), lambda k: k.isNotNull())


def _local(specs: tuple[Redaction, ...]) -> int:
    """From which rule on all of them may work on pieces: what they replace makes no new place where white space may join."""
    ends = lambda r, literal: any(x.endswith(literal[:i]) for x in re.split(r"\$[0-9]", r.replacement) for i in range(1, len(literal) + 1))
    at = len(specs)
    while at and specs[at - 1].joins is not None and not any(ends(r, j) for r in specs[at - 1 :] for s in specs[at - 1 :] for j in s.joins):
        at -= 1
    return at


def redact_all(df: DataFrame, text: str = "text", specs: tuple[Redaction, ...] = REDACT_SPECS) -> DataFrame:
    """Add scrubbed and counts (label to number of matches, labels without any left out). A null text stays null.

    Rules run in order, each on what the one before left: the first ones that name the literals that their matches begin
    with in one Arrow stage, all from there on as expressions. Of these, one look at a text's literals tells which may
    match; only they run. The last rules whose matches end at white space run on pieces of the text, so that each
    searches no more than the pieces that hold its literals.
    """
    columns, none = df.columns, F.array().cast("array<struct<k: int, label: string, n: int>>")
    first = next((k for k, r in enumerate(specs) if not r.starts), len(specs))
    rest, at = specs[first:], first + _local(specs[first:])
    joins = tuple(dict.fromkeys(j for r in specs[at:] for j in r.joins))
    start = F.struct(F.col(text).alias("s"), none.alias("n"))
    if first:
        df = df.withColumn("__replaced", replaced(F.col(text), (Anchored(r.pattern, r.starts, r.gate, to=r.replacement, label=r.label) for r in specs[:first])))
        # A text that no rule changes stays as it is, to the byte.
        scrubbed = F.coalesce(F.col("__replaced.s"), F.col(text))
        if not rest:
            return df.select(*columns, scrubbed.alias("scrubbed"), F.map_from_arrays("__replaced.labels", "__replaced.n").alias("counts"))
        # Numbered in their order, below all later rules' numbers.
        counts = F.transform("__replaced.labels", lambda label, i: F.struct(i.alias("k"), label.alias("label"), F.get("__replaced.n", i).alias("n")))
        start = F.struct(scrubbed.alias("s"), counts.cast("array<struct<k: int, label: string, n: int>>").alias("n"))

    def in_pieces(state: Column) -> Column:
        each = F.transform(pieces(state["s"], joins), lambda p: _chain(F.struct(p.alias("s"), none.alias("n")), specs[at:], at))
        whole = lambda done: F.struct(F.array_join(F.transform(done, lambda d: d["s"]), "").alias("s"), F.concat(state["n"], F.flatten(F.transform(done, lambda d: d["n"]))).alias("n"))
        return F.when(F.size(_may_match(state["s"], specs[at:], set())) > 0, bound(each, whole)).otherwise(state)

    def outcome(state: Column) -> Column:
        labels = F.array_distinct(F.transform(F.array_sort(state["n"]), lambda x: x["label"]))
        total = lambda label: F.aggregate(state["n"], F.lit(0), lambda a, x: a + F.when(x["label"] == label, x["n"]).otherwise(0))
        return F.struct(state["s"].alias("scrubbed"), F.map_from_arrays(labels, F.transform(labels, total)).alias("counts"))

    done = _chain(start, specs[first:at], first)
    if rest and at < len(specs):
        done = bound(done, in_pieces)
    # As the one element of an array, so that nothing that uses either part works the chain out once more.
    return exploded(df, F.array(bound(done, outcome)), "__done").select(*columns, "__done.scrubbed", "__done.counts")


def _chain(start: Column, specs: tuple[Redaction, ...], first_number: int = 0) -> Column:
    """A state of text and counts by rule after the rules, which are numbered from first_number on, each on what the one before left."""
    if not specs:
        return start
    made = _made(specs)

    def step(state: Column, i: Column) -> Column:
        """One rule. Patterns stay literals, and the plan names each rule twice however long the list is."""
        s, n, t, label = state["s"], F, F, F
        for k, rule in enumerate(specs):
            runs = (i == k) & _any_of(s, rule.gate, False) if k in made else i == k
            n, t, label = n.when(runs, F.regexp_count(s, F.lit(rule.pattern))), t.when(i == k, F.regexp_replace(s, rule.pattern, rule.replacement)), label.when(i == k, F.lit(rule.label))
        # Texts without a match, which are most, are searched but not replaced.
        return bound(n.otherwise(0), lambda found: F.struct(F.when(found > 0, t).otherwise(s).alias("s"), F.when(found > 0, F.array_append(state["n"], F.struct((i + first_number).alias("k"), label.alias("label"), found.alias("n")))).otherwise(state["n"]).alias("n")))

    return bound(start, lambda first: F.aggregate(_may_match(first["s"], specs, made), first, step))


def _total(counts) -> F.Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + b)


def scrub_preview(redacted: DataFrame) -> DataFrame:
    """rows_scanned, rows_with_counts, redactions."""
    n = _total(F.col("counts"))
    return redacted.agg(F.count(F.lit(1)).alias("rows_scanned"), F.coalesce(F.sum((F.size("counts") > 0).cast("long")), F.lit(0)).alias("rows_with_counts"), F.coalesce(F.sum(n), F.lit(0)).alias("redactions"))


def scrub_apply(redacted: DataFrame, text: str = "text") -> DataFrame:
    """rows_modified and their redactions: a row counts when its text differs."""
    # A sum of what holds, not a filter: Spark would push that below, with the whole redaction once more.
    changed = F.col("scrubbed") != F.col(text)
    return redacted.agg(F.count_if(changed).alias("rows_modified"), F.coalesce(F.sum(F.when(changed, _total(F.col("counts")))), F.lit(0)).alias("redactions"))


def counts_by_label(redacted: DataFrame) -> DataFrame:
    """label and n of each row's counts, beside its other columns but the texts."""
    kept = [c for c in redacted.columns if c != "counts"]
    # The outer form: for the plain one Spark would infer a filter that repeats the whole redaction.
    return redacted.select(*kept, F.explode_outer("counts").alias("label", "n")).where("label IS NOT NULL")


def redactions_by_type(redacted: DataFrame) -> DataFrame:
    """label, n over all rows, by label."""
    return counts_by_label(redacted).groupBy("label").agg(F.sum("n").cast("long").alias("n")).orderBy("label")


def scrub_targets(tagged: DataFrame, routes: DataFrame) -> DataFrame:
    """Files with a tag that may be scrubbed (chats and histories)."""
    return tagged.join(F.broadcast(routes.where("scrub_ok").select("pattern_name")), "pattern_name", "left_semi")
