"""Mix sources to target weights.

The documents of a source stand in a keyed random order and form one stream of words, cut into blocks of equal length.
A source's target gives whole passes over its stream and an exact quota of blocks of one more, drawn from all of them by
a keyed permutation; the last one drawn is cut to meet the target. A splitting tree parts
the quotas of all sources among the output shards by multivariate hypergeometric draws, each node seeded by its own
range of shards, so that a task finds the shard of a block by walking down and no table of shards is shipped. The
drawn blocks of a source are permuted in the same way, so shards hold disjoint blocks. A document that several
shards share is parted among them, and the rows of the mix are written by shard and by random places within it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, mix

#: Rows, about, of a range of the random order in which running sums are taken; a source's running sum is that of ranges,
#: then of rows. The number of ranges grows with the rows, between the two powers of two.
RANGE_ROWS, LEAST_BITS, MOST_BITS = 20_000, 6, 24

#: Rounds of a permutation: six for each bit of a source's blocks and more, up to 10**6 blocks (10**9 words); beyond, it is a little less mixed.
ROUNDS = 128

#: Words, about, of a partition of the mix.
PARTITION_WORDS = 4_000_000

#: Facts of up to so many sources (about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000

PIECES = "array<struct<copy int, block long, first long, n long, shard int>>"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: share of all words by weight, none above most times its size, the excess given to the others by weight.

    Sources stand in code point order, null last, and take the weights in turn.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total >= most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * float(sizes[s])
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out


#: The generator draws exactly from fewer things than this; from more, the rounded normal law of the same mean and spread.
EXACT_BELOW = 10**9


def drawn(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each kind are among `take` things drawn from counts of them, kind by kind. The sum is exact."""
    if counts.sum() < EXACT_BELOW:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, n in enumerate(map(int, counts)):
        if left < EXACT_BELOW:
            out[i:] = rng.multivariate_hypergeometric(counts[i:], take, method="marginals")
            break
        share = n / left
        x = round(rng.normal(take * share, math.sqrt(take * share * (1 - share) * (left - take) / (left - 1))))
        out[i] = min(max(x, 0, take - (left - n)), n, take)
        left, take = left - n, take - int(out[i])
    return out


@dataclass(frozen=True)
class SplitTree:
    """Which shard gets the block of a given rank among a source's drawn blocks. quotas: drawn blocks by source."""

    quotas: tuple[int, ...]
    shards: int
    seed: int

    def split(self, lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        """How many of a node's blocks, by source, go to its left half of shards."""
        total, mid = int(counts.sum()), (lo + hi) // 2
        take = total * (mid - lo) // (hi - lo)
        return drawn(np.random.default_rng([self.seed, lo, hi]), counts, take) if total else counts * 0

    def shard_of(self, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """All blocks of a batch walk down the tree together; a node is split once for all that pass it."""
        out = np.zeros(len(rank), np.int64)
        todo = [(0, self.shards, np.asarray(self.quotas, np.int64), np.arange(len(rank)), np.asarray(rank, np.int64))]
        while todo:
            lo, hi, counts, rows, at = todo.pop()
            if hi - lo == 1:
                out[rows] = lo
                continue
            left = self.split(lo, hi, counts)
            goes = at < left[source[rows]]
            for side, a, b, n in ((goes, lo, (lo + hi) // 2, left), (~goes, (lo + hi) // 2, hi, counts - left)):
                if side.any():
                    todo.append((a, b, n, rows[side], at[side] if side is goes else at[side] - left[source[rows[side]]]))
        return out


def permuted(block: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A keyed permutation of 0..size-1 for each size, of any size below 2**63: the place of each block.

    Swap or not: each round pairs every number with its reflection about a keyed one, and a keyed bit of the greater of
    the two tells whether both change places. Only sums and differences below the size occur, so nothing overflows.
    """
    block, size = np.asarray(block, np.int64).copy(), np.asarray(size, np.int64)
    if not len(block):
        return block
    key = mix(size.view(np.uint64) ^ mix(np.full(len(size), seed & (1 << 64) - 1, np.uint64)))
    for i in range(ROUNDS):
        own = mix(key + np.uint64((i + 1) * _STEP & (1 << 64) - 1))
        other = (own % size.view(np.uint64)).view(np.int64) - block
        other[other < 0] += size[other < 0]
        swap = mix(np.maximum(block, other).view(np.uint64) ^ own) >> np.uint64(63) == 1
        block[swap] = other[swap]
    return block


#: An odd number that parts the keys of rounds.
_STEP = 0x9E3779B97F4A7C15


def drawn_blocks(size: int, rest: int, block_words: int, seed: int) -> tuple[int, int]:
    """How many blocks the partial pass of rest words draws by permuted rank, and how many words of the last one it takes."""
    n, short = -(-size // block_words), -size % block_words
    if not rest:
        return 0, 0
    at = int(permuted(np.array([n - 1]), np.array([n]), seed)[0])  # the rank of the stream's last block, which lacks some words
    words = lambda k: k * block_words - (short if at < k else 0)  # noqa: E731  of the first k ranks
    k = -(-rest // block_words)
    k += words(k) < rest
    return k, rest - words(k - 1)


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, pieces, shards, position of each row.

    pieces: the stretches of the document that the mix takes (copy, block, first word, number of words), shards: the
    output shard of each. Null texts have size 0 and take no piece; a null source is a source of its own; rows that tie
    in everything are interchangeable, and each gives a row; an empty table gives none; other columns, whatever their
    names, are not read. The driver holds one number a source, as the weights are given for each source.
    """
    return _plan(docs, **options)[0]


def _plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 1024, shards: int = 16, seed: int = 17, carry: bool = False) -> tuple[DataFrame, float]:
    """plan_mix, with carry also the whole row as one struct (row), which no other column can clash with; and the words that the mix takes."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    bits = min(MOST_BITS, max(LEAST_BITS, (docs.count() // RANGE_ROWS).bit_length()))
    sized = sized.withColumn("at", F.xxhash64("doc_id", F.lit(seed))).withColumn("range", F.shiftrightunsigned("at", 64 - bits).cast("int"))
    totals = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sizes = {r.source: r.words for r in totals.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes, weights, share, most)
    whole, rest = {}, {}
    for s in order:
        goal = round(want[s])
        whole[s], rest[s] = divmod(goal, sizes[s]) if sizes[s] else (0, 0)
    blocks = lambda n: -(-n // block_words)
    draw = {s: drawn_blocks(sizes[s], rest[s], block_words, seed + 2) for s in order}
    tree = SplitTree(tuple(whole[s] * blocks(sizes[s]) + draw[s][0] for s in order), shards, seed)
    facts = spark.createDataFrame(
        [(s, i, sizes[s], want[s]) for i, s in enumerate(order)],
        "source string, source_at int, source_size long, target double",
    )

    few = F.broadcast if len(order) <= BROADCAST_SOURCES else (lambda df: df)
    # The window of ranges has a row for some RANGE_ROWS of a source, that of rows about so many rows.
    by_range = Window.partitionBy("source").orderBy("range")
    begins = totals.select("source", "range", (F.sum("words").over(by_range) - F.col("words")).alias("range_start"))
    by_row = Window.partitionBy("source", "range").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sized.withColumn("local", F.sum("size").over(by_row) - F.col("size"))
    keyed = local.join(begins.withColumnsRenamed({"source": "s", "range": "r"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    keyed = keyed.join(few(facts.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("start", F.col("range_start") + F.col("local"))

    per_copy, quotas, whole_of = ([int(x) for x in of] for of in ([max(1, blocks(sizes[s])) for s in order], tree.quotas, [whole[s] for s in order]))
    drawn_of, last_of = [draw[s][0] for s in order], [draw[s][1] for s in order]

    @F.arrow_udf(PIECES)
    def pieces_of(source_at: pa.Array, start: pa.Array, size: pa.Array) -> pa.Array:
        """All pieces of a batch of rows, each copy of a row in turn, and their shards: of each block that a row reaches, what it has of the block's words that are taken."""
        at, first, n_words = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (source_at, start, size))
        n_blocks, quota, n_whole, drawn_, last = (np.asarray(x, np.int64)[at] for x in (per_copy, quotas, whole_of, drawn_of, last_of))
        low = first // block_words
        reached = np.where(n_words > 0, (first + n_words - 1) // block_words - low + 1, 0)
        each = reached * (n_whole + 1)
        ends = np.cumsum(each)
        row = np.repeat(np.arange(len(at)), each)
        place = np.arange(len(row)) - np.repeat(ends - each, each)
        copy, block = place // np.maximum(reached[row], 1), low[row] + place % np.maximum(reached[row], 1)
        # Blocks of the partial pass count by their rank among all of the source.
        partial = copy == n_whole[row]
        rank = np.full(len(row), -1, np.int64)
        rank[partial] = permuted(block[partial], n_blocks[row][partial], seed + 2)
        taken = np.where(~partial | (rank < drawn_[row] - 1), block_words, np.where(rank == drawn_[row] - 1, last[row], 0))
        begin = np.maximum(block * block_words, first[row])
        n = np.minimum(block * block_words + taken, (first + n_words)[row]) - begin
        kept = np.flatnonzero(n > 0)
        row, copy, block, n = row[kept], copy[kept], block[kept], n[kept]
        number = copy * n_blocks[row] + np.where(partial[kept], rank[kept], block)
        shard = tree.shard_of(at[row], permuted(number, quota[row], seed))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(at))))).astype(np.int32)
        fields = [pa.array(x.astype(t)) for x, t in ((copy, np.int32), (block, np.int64), (begin[kept] - first[row], np.int64), (n, np.int64), (shard, np.int32))]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["copy", "block", "first", "n", "shard"]))

    cut = keyed.withColumn("cut", pieces_of("source_at", F.col("start").cast("long"), "size"))
    drawn = cut.withColumn("pieces", F.transform("cut", lambda p: F.struct(*(p[c] for c in ("copy", "block", "first", "n"))))).withColumn("shards", F.transform("cut", lambda p: p["shard"]))
    plan = (
        drawn.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda total, p: total + p["n"]))
        .withColumn("position", F.xxhash64("start", "source", F.lit(seed + 1)))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "pieces", "shards", "position", *(["row"] if carry else []))
    )
    return plan, sum(want.values())


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_pieces and first_shard of each row; odd rows as in plan_mix."""
    return plan_mix(docs, **options).select("doc_id", "size", "source_size", "target", "taken", F.size("pieces").cast("long").alias("n_pieces"), F.when(F.size("shards") > 0, F.array_min("shards")).alias("first_shard"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, by shard and place: a row for each piece of a document that it takes.

    A copy taken whole into one shard is one row and keeps its text; of other copies each block's words are a row, parted
    by spaces. The columns of docs stay, whatever their names, with n_chars (where present) set to the new text's; shard
    and position follow, as mix_shard and mix_position if docs has columns of those names. Rows lie in partitions by
    shard and ranges of position, ascending within. Null and empty texts have no words and so no place in the mix; a null
    source is a source of its own; a null doc_id is kept; repeated rows are each mixed; an empty table gives none.
    """
    plan, words_taken = _plan(docs, carry=True, **options)
    row = lambda copy, shard, first, n: F.struct(copy.alias("copy"), shard.alias("shard"), first.cast("long").alias("first"), n.cast("long").alias("n"))

    def of_copy(copy):
        own = F.filter(F.arrays_zip("pieces", "shards"), lambda z: z["pieces"]["copy"] == copy)
        n = F.aggregate(own, F.lit(0).cast("long"), lambda total, z: total + z["pieces"]["n"])
        together = (n == F.col("size")) & (F.size(F.array_distinct(F.transform(own, lambda z: z["shards"]))) == 1)
        return F.when(together, F.array(row(copy, F.element_at(own, 1)["shards"], F.lit(0), n))).otherwise(F.transform(own, lambda z: row(copy, z["shards"], z["pieces"]["first"], z["pieces"]["n"])))

    parts = plan.withColumn("parts", F.flatten(F.transform(F.array_distinct(F.transform("pieces", lambda p: p["copy"])), of_copy)))
    cut = F.exists("parts", lambda p: p["n"] < F.col("size"))
    # The words are found once for each row; a piece's text is null if it is the document's.
    words = F.when(cut, F.regexp_extract_all("row.text", F.lit(WORD_PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    text = lambda w, p: F.when(p["n"] < F.col("size"), F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p["n"].cast("int")), " "))
    texts = F.get(F.transform(F.array(words), lambda w: F.transform("parts", lambda p: F.struct(*(p[c].alias(c) for c in ("copy", "shard", "first")), text(w, p).alias("own")))), F.lit(0))
    # The outer form: for the plain one Spark would infer a filter that cuts the texts a second time.
    rows = parts.withColumn("part", F.explode_outer(texts)).where("part IS NOT NULL").withColumn("text", F.coalesce("part.own", "row.text"))
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    own = [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns]
    shard, position = (n if n not in docs.columns else f"mix_{n}" for n in ("shard", "position"))
    rows = rows.select(*own, F.col("part.shard").alias(shard), F.xxhash64("position", "part.copy", "part.first").alias(position))
    # Each shard's rows go to as many partitions, by ranges of position, as its share of the words asks for.
    shards = options.get("shards", 16)
    levels = max(0, math.ceil(math.log2(max(1, words_taken / shards / PARTITION_WORDS))))
    place = F.shiftrightunsigned(F.col(position).bitwiseXOR(F.lit(-(1 << 63))), 64 - levels).cast("int") if levels else F.lit(0)
    return rows.repartitionById(shards << levels, (F.col(shard) * (1 << levels) + place).cast("int")).sortWithinPartitions(shard, position)
