"""URL filters: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

The classifier learns from a small labelled URL table. Its features are the distinct n-grams of the host and, hashed
apart from them, those of the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .char_ngrams import ngram_buckets
from .toxicity import descend

SIZES, BITS = (2, 3, 4, 5), 18
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


#: The contract's rules.
RULES = (Rule(ALLOW, "com", "/"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"), Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: from the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. Both are empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(bare, "/", 1)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def judged_by_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule and ruled (its verdict); of several rules that fit the one of the longest name counts, of equally long ones the first."""
    host, path = host_and_path(F.col(url))
    rows = df.withColumn("host", host).withColumn("path", path)
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: -len(r.name))[::-1]:
        found = F.when(rule.fits(F.col("host"), F.col("path")), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return rows.withColumn("__rule", found).withColumn("rule", F.col("__rule.name")).withColumn("ruled", F.col("__rule.verdict")).drop("__rule")


def labelled_urls(ruled: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """A small labelled table: host, path, blocked of at most max_rows distinct URLs of each verdict of the rules, none longer than max_chars, those with the least hash."""
    known = ruled.where(F.col("ruled").isNotNull() & (F.length("host") + F.length("path") <= max_chars)).groupBy("host", "path").agg(F.max((F.col("ruled") == BLOCK).cast("int")).alias("blocked"))
    # Each half by its own top-k, so that no sort of all URLs takes place.
    half = lambda x: known.where(F.col("blocked") == x).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows)
    return half(0).unionByName(half(1))


def buckets(host: str, path: str) -> np.ndarray:
    """The distinct buckets of a URL's n-grams, ascending; the upper half are those of the path."""
    own, rest = ngram_buckets(host, SIZES, BITS), ngram_buckets(path, SIZES, BITS) + np.uint32(1 << BITS)
    return np.unique(np.concatenate((own, rest)))


@dataclass(frozen=True)
class UrlModel:
    weight: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """How likely the URL is to be blocked."""
        return float(1 / (1 + np.exp(-(self.bias + self.weight[buckets(host, path)].sum(dtype=np.float64)))))


def fit(labelled: DataFrame, penalty: float = 1.0, steps: int = 200) -> UrlModel:
    """Fit on a small table (host, path, blocked). Without rows of both labels every URL gets the share of blocked ones, and under a half if there are none."""
    rows = sorted((r.host, r.path, r.blocked) for r in labelled.select("host", "path", "blocked").collect())
    blocked = np.array([r[2] > 0 for r in rows], bool)
    weight = np.zeros(2 << BITS, np.float32)
    if not blocked.any() or blocked.all():
        return UrlModel(weight, float(np.log((blocked.sum() + 0.5) / ((~blocked).sum() + 1))))
    has = [buckets(host, path) for host, path, _ in rows]
    ids, columns = np.unique(np.concatenate(has), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in has]))).astype(np.int64)
    w, bias = descend(starts, columns, np.ones(len(ids)), blocked, penalty, steps)
    weight[ids] = w
    return UrlModel(weight, bias)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, max_rows: int = 2000, max_chars: int = 2000) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row.

    labelled: a small table of url and verdict (`allow`, `block`); without one, the classifier learns from a sample of
    the pages' own URLs that rules judge (labelled_urls). score is the classifier's, how likely the URL is to be
    blocked; verdict is the rule's, or else `block` for a score of a half and more. Null URLs and those without `://`
    have an empty host and path and no rule. Repeated rows and ties each give a row, a null page_id stays null, an empty
    table gives none, other columns are not read.
    """
    ruled = judged_by_rules(pages.select("page_id", "url"), rules)
    if labelled is None:
        small = labelled_urls(ruled, max_rows, max_chars)
    else:
        host, path = host_and_path(F.col("url"))
        small = labelled.select(host.alias("host"), path.alias("path"), (F.col("verdict") == BLOCK).cast("int").alias("blocked")).where("blocked IS NOT NULL")
    model = pages.sparkSession.sparkContext.broadcast(fit(small))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(i).to_pylist() for i in (1, 2))
            yield batch.append_column("score", pa.array([model.value.score(h, p) for h, p in zip(hosts, paths, strict=True)], pa.float64()))

    scored = ruled.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "ruled").mapInArrow(score, "page_id long, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
