"""Phrase collocations by dynamic itemset counting.

The corpus is numbered once and dealt into a few shards, which are scanned in turn, round and round. A phrase becomes
active as soon as both of its subphrases, one word shorter, have reached the threshold in what was scanned so far; from
the next scan on it is counted, beside shorter and longer ones, until it has been through every shard once. So lengths
interleave, and a scan that has no active phrase is the last.

What a scan needs of all frequent phrases are two bit maps of bounded size, of all of them and of those that became
frequent within the last cycle. A phrase that passes them by chance is counted like others; that changes no result, as
every phrase that reaches the threshold is truly frequent, hence truly active, and counted through one full cycle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, shared_path, text_parts, word_hashes, word_spans

#: Bytes that end a piece, and with white space those that end a word.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = PIECE.copy()
WORD[[0x20, 0x09]] = True

#: Bits of a map for each frequent phrase, and the most of a map (32 MB); beyond it more phrases pass by chance.
BITS_EACH, MOST_BITS = 32, 1 << 28
#: Bytes of a map that travel as one row.
BLOCK = 1 << 16
#: Distinct phrases that a task gathers before it hands them on, and words whose text it remembers to have given.
TALLY, KNOWN = 1 << 19, 1 << 19
#: Salts by which a language's best are found before they meet.
SALTS = 64

_LEFT, _RIGHT, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of each phrase whose subphrases (without its last, without its first word) have these numbers."""
    return mix(left * _LEFT + right * _RIGHT + np.uint64(1))


def numbered_words(docs: DataFrame, shards: int) -> DataFrame:
    """shard, lang, n_words, words: a row for each text, a word's number depending on its language and 0 between pieces; and known: rows of (id, word) with each word's text once at least for each task that has it.

    A null text is empty, a null language `und`. The shard comes from doc_id; any dealing gives the same result.
    """

    most = KNOWN

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            langs, shard = batch.column(1).to_pylist(), batch.column(2)
            salts = {x: _salt(x) for x in set(langs)}
            salt = np.array([salts[x] for x in langs], np.uint64)
            for a, b, data, offsets in text_parts(batch):
                starts, ends, rows = word_spans(data, offsets, WORD)
                ids = mix(word_hashes(data, starts, ends) ^ salt[a:b][rows])
                ids[ids == 0] = 1  # 0 parts pieces
                parted = np.concatenate(([0], np.cumsum(PIECE[data])))
                gap = np.zeros(len(ids), bool)
                gap[1:] = (parted[starts[1:]] > parted[ends[:-1]]) & (rows[1:] == rows[:-1])
                place = np.arange(len(ids)) + np.cumsum(gap)
                flat = np.zeros(len(ids) + int(gap.sum()), np.uint64)
                flat[place] = ids
                words_before = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=b - a))))
                gaps_before = np.concatenate(([0], np.cumsum(gap)))[words_before]
                lists = pa.ListArray.from_arrays(pa.array((words_before + gaps_before).astype(np.int32)), pa.array(flat.view(np.int64)))
                if len(given) > most:
                    given.clear()
                known = _new_words(data, starts, ends, ids, rows, b - a, given)
                yield pa.RecordBatch.from_arrays([shard.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(words_before)), lists, known], ["shard", "lang", "n_words", "words", "known"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return rows.mapInArrow(number, "shard int, lang string, n_words long, words array<long>, known array<struct<id: long, word: string>>")


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _new_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, rows: np.ndarray, n_rows: int, given: set[int]) -> pa.ListArray:
    """A list for each row: id and word of the words that first stand there and aren't in given yet."""
    once, at = np.unique(ids.view(np.int64), return_index=True)
    new = np.array([i not in given for i in once.tolist()], bool)
    given.update(once[new].tolist())
    at = np.sort(at[new])  # in the order of rows
    raw = data.tobytes()
    words = [raw[a:b].lower().decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows[at], minlength=n_rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(ids[at].view(np.int64)), pa.array(words, pa.string())], ["id", "word"]))


@dataclass(frozen=True)
class Maps:
    """Bit maps of the numbers of frequent phrases: all, and those frequent since less than a cycle, of up to longest words."""

    every: np.ndarray
    recent: np.ndarray
    longest: int

    @staticmethod
    def _bits(size: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(size - 1)
        return ids & last, (mix(ids ^ _SECOND) & last)

    @classmethod
    def has(cls, bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in cls._bits(len(bits) * 8, ids):
            out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def add(cls, bits: np.ndarray, ids: np.ndarray) -> None:
        for at in cls._bits(len(bits) * 8, ids):
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


class Tally:
    """Counts of phrases told apart by both subphrases, merged now and then; full when most distinct ones are gathered."""

    def __init__(self, most: int) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.most = 0, most

    def add(self, length: int, left: np.ndarray, right: np.ndarray) -> None:
        if len(left):
            self.parts.append(_merged(left, right, np.full(len(left), length, np.int8), np.ones(len(left), np.int64)))
            self.size += len(self.parts[-1][0])

    def full(self) -> bool:
        if self.size > 2 * self.most:
            self.parts = [_merged(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
        return self.size > self.most

    def batch(self) -> pa.RecordBatch:
        left, right, length, n = _merged(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(length), pa.array(n)], ["hp", "hs", "len", "n"])


def _merged(left: np.ndarray, right: np.ndarray, length: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(joined(left, right))
    left, right, length, n = left[order], right[order], length[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (length[1:] != length[:-1]))))
    return left[first], right[first], length[first], np.add.reduceat(n, first)


def scanned(shard: DataFrame, maps: Broadcast | None, words: bool) -> DataFrame:
    """hp, hs, len, n of the active phrases in one shard: partial sums of tasks. hp and hs are the numbers of both subphrases; a word has its own and 0."""

    most = TALLY

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(most)
        for batch in batches:
            lists = batch.column(0)
            for a in range(0, len(lists), 256):
                part = lists.slice(a, 256)
                flat, ends = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))
                ids = np.insert(flat, ends, np.uint64(0))  # no phrase spans two texts
                if words:
                    own = ids[ids != 0]
                    tally.add(1, own, np.zeros(len(own), np.uint64))
                if maps is not None:
                    _longer(ids, maps.value, tally)
                if tally.full():
                    yield tally.batch()
        if tally.parts:
            yield tally.batch()

    return shard.select("words").mapInArrow(count, "hp long, hs long, len byte, n long")


def _longer(ids: np.ndarray, maps: Maps, tally: Tally) -> None:
    """Count the active phrases of two words and more."""
    at = np.flatnonzero(ids)
    number = ids.copy()
    for length in range(2, maps.longest + 2):
        # at: places where a phrase of length - 1 words starts that may be frequent; number: its number there.
        every = Maps.has(maps.every, number[at])
        at = at[every]
        recent = np.zeros(len(ids), bool)
        recent[at[Maps.has(maps.recent, number[at])]] = True
        next_to = at[:-1][np.diff(at) == 1] if len(at) else at
        chosen = next_to[recent[next_to] | recent[next_to + 1]]
        tally.add(length, number[chosen], number[chosen + 1])
        longer = joined(number[next_to], number[next_to + 1])
        number[next_to] = longer
        at = next_to


def bit_maps(frequent: DataFrame, since: int, longest: int) -> Maps | None:
    """Maps of the phrases in frequent (id, len, first) under longest words, or None if none became frequent at step since or later."""
    rows = frequent.where(F.col("len") < longest)
    n, recent, most = rows.agg(F.count(F.lit(1)), F.count_if(F.col("first") >= since), F.max(F.when(F.col("first") >= since, F.col("len")))).first()
    if not recent:
        return None
    size = min(MOST_BITS, max(BLOCK * 8, 1 << (n * BITS_EACH - 1).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = np.zeros((2, size // 8), np.uint8)
        for batch in batches:
            ids, new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            Maps.add(maps[0], ids)
            Maps.add(maps[1], ids[new])
        for kind in (0, 1):
            blocks = maps[kind].reshape(-1, BLOCK)
            for k in np.flatnonzero(blocks.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()])], ["kind", "k", "bits"])

    def united(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BLOCK, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                out |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()])], ["kind", "k", "bits"])

    schema = "kind int, k int, bits binary"
    parts = rows.select("id", (F.col("first") >= since).alias("new")).mapInArrow(bits, schema)
    maps = np.zeros((2, size // 8), np.uint8)
    for row in parts.groupBy("kind", "k").applyInArrow(united, schema).toLocalIterator():  # at most two maps of MOST_BITS
        maps[row.kind, row.k * BLOCK : (row.k + 1) * BLOCK] = np.frombuffer(row.bits, np.uint8)
    return Maps(maps[0], maps[1], int(most))


def phrase_id(hp: Column, hs: Column, length: Column) -> Column:
    """joined() as a column of numpy's results, or a word's own number."""

    @F.pandas_udf("long")
    def number(left, right):
        import pandas as pd

        return pd.Series(joined(left.to_numpy(np.int64).view(np.uint64), right.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return F.when(length == 1, hp).otherwise(number(hp, hs))


def count_phrases(corpus: DataFrame, shards: int, least: int, longest: int) -> DataFrame:
    """id, hp, hs, len, n of every phrase of up to longest words that occurs least times; n is exact.

    Each step scans one shard. Counts of the last `shards` steps are kept by shard, so their sum is a phrase's count
    once it has been through all, and never more. The state is written anew at each step.
    """
    spark = corpus.sparkSession
    columns = [f"c{i}" for i in range(shards)]
    state: DataFrame | None = None
    frequent: DataFrame | None = None
    maps: Maps | None = None
    step = 0
    while step < shards or maps is not None:
        shard = step % shards
        held = spark.sparkContext.broadcast(maps) if maps is not None else None
        new = scanned(corpus.where(F.col("shard") == shard), held, words=step < shards)
        new = new.select("hp", "hs", "len", *(F.col("n").alias(c) if c == columns[shard] else F.lit(0).cast("long").alias(c) for c in columns))
        if state is not None:  # this shard's counts of a cycle ago have had their time
            rest = state.withColumn(columns[shard], F.lit(0).cast("long")).where(reduce(lambda a, b: a | b, (F.col(c) > 0 for c in columns if c != columns[shard]), F.lit(False)))
            new = new.unionByName(rest)
        state = materialise(new.groupBy("hp", "hs", "len").agg(*(F.sum(c).alias(c) for c in columns)), "phrases")
        hits = state.withColumn("n", sum((F.col(c) for c in columns), F.lit(0))).where(F.col("n") >= least)
        hits = hits.select(phrase_id(F.col("hp"), F.col("hs"), F.col("len")).alias("id"), "hp", "hs", "len", F.lit(step).alias("first"), F.col("n").cast("long").alias("n"))
        both = hits if frequent is None else frequent.unionByName(hits)
        frequent = materialise(both.groupBy("id", "hp", "hs", "len").agg(F.min("first").alias("first"), F.max("n").alias("n")), "frequent")
        step += 1
        maps = bit_maps(frequent, step - shards, longest)
        if held is not None:
            held.destroy()
    return frequent


def with_parts(frequent: DataFrame, longest: int) -> DataFrame:
    """id, hp, hs, n, words, firsts, rests of phrases of two words and more: the numbers of their words, and the counts of their first 1, 2, ... words and of what follows these."""
    none = F.array().cast("array<long>")
    before = frequent.where("len = 1").select("id", "n", F.array("id").alias("words"), none.alias("firsts"), none.alias("rests"))
    levels = []
    for length in range(2, longest + 1):
        left, right = (before.select(*(F.col(c).alias(f"{side}_{c}") for c in before.columns)) for side in ("l", "r"))
        rows = frequent.where(F.col("len") == length).join(left, F.col("hp") == F.col("l_id")).join(right, F.col("hs") == F.col("r_id"))
        words, firsts, rests = F.concat("l_words", F.slice("r_words", -1, 1)), F.concat("l_firsts", F.array("l_n")), F.concat(F.array("r_n"), "r_rests")
        level = materialise(rows.select("id", "hp", "hs", "n", words.alias("words"), firsts.alias("firsts"), rests.alias("rests")), "phrase-parts")
        levels.append(level)
        before = level.drop("hp", "hs")
    return reduce(DataFrame.unionByName, levels)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, shards: int = 2, most: int = 2000, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to longest words.

    Texts (null: empty) are lower-cased in A-Z and split into pieces at `.,;:!?` and line ends, pieces into words at
    spaces and tabs; a null lang is `und`. A phrase is a candidate if it occurs `least` times (a); n is the number of
    words in its language. The cut of the lowest floor(1000 * a * n / (l * r)) counts, the earliest of equal ones.
    Candidates inside a longer candidate with at least share per cent of their count are left out; one word longer is
    enough to look at, as a count never grows with length. Order: score, a (both falling), phrase in byte order.
    Repeated rows count as often as they stand; an empty table gives none; other columns are not read. Words are told
    apart by 64 bits of a hash: should two words that are reported share one, the query fails.
    """
    numbered = numbered_words(docs, shards)
    path = shared_path(docs.sparkSession, "numbered")
    # Word numbers repeat: a large dictionary keeps the file at two or three bytes a word.
    numbered.write.option("parquet.dictionary.page.size", 8 << 20).option("compression", "zstd").partitionBy("shard").parquet(path)
    corpus = docs.sparkSession.read.schema(numbered.schema).parquet(path)
    found = with_parts(count_phrases(corpus, shards, least, longest), longest)
    longer = found.select(F.col("hp").alias("part"), "n").unionByName(found.select(F.col("hs").alias("part"), "n")).groupBy("part").agg(F.max("n").alias("longer"))
    kept = found.join(longer, F.col("id") == F.col("part"), "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("n"), F.lit(True)))
    return _texts(_best(_scored(_with_language(kept, corpus), corpus), most), corpus, most)


def _with_language(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found with lang, that of each phrase's first word."""
    words = found.select(F.col("words")[0].alias("word_id")).distinct()
    langs = _known(corpus).join(words, F.col("id") == F.col("word_id"), "left_semi").groupBy(F.col("id").alias("word_id")).agg(F.max("lang").alias("lang"))
    return found.join(langs, F.col("words")[0] == F.col("word_id")).drop("word_id")


def _known(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.size("known") > 0).select("lang", F.explode_outer("known").alias("k")).select("lang", "k.id", "k.word")


def _scored(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found with a, l, r, n and score of its lowest cut, and n of its language."""
    sizes = corpus.groupBy("lang").agg(F.sum("n_words").alias("size"))
    big = lambda c: c.cast("decimal(38,0)")
    cuts = F.transform("firsts", lambda l, i: F.struct(F.call_function("div", big(F.lit(1000)) * big(F.col("n")) * big(F.col("size")), big(l) * big(F.get("rests", i))).alias("score"), i.alias("cut"), l.alias("l"), F.get("rests", i).alias("r")))
    rows = found.join(sizes, "lang").withColumn("low", F.array_min(cuts))
    return rows.select("lang", "id", "words", F.col("n").alias("a"), "low.l", "low.r", F.col("size").alias("n"), "low.score")


def _best(scored: DataFrame, most: int) -> DataFrame:
    """Rows that may be among a language's `most` best, ties for the last place included: first within salts, so that no task sorts a whole language."""
    order = (F.desc("score"), F.desc("a"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= most)
    return few.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most).drop("salt", "place")


def _texts(best: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """Numbers replaced by words, and ranks in the final order."""
    best = materialise(best, "best-phrases")
    wanted = best.select(F.explode("words").alias("id")).distinct()
    same = F.when(F.min("word") == F.max("word"), F.min("word")).otherwise(F.raise_error(F.lit("two words share a number")))
    texts = _known(corpus).join(wanted, "id", "left_semi").groupBy("id").agg(same.alias("word"))
    placed = best.select("id", F.posexplode("words").alias("at", "word_id")).join(texts.withColumnRenamed("id", "word_id"), "word_id")
    phrases = placed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(phrases, "id").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < k),
s AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, h.a AS l, t.a AS r, n, ((1000::HUGEINT * cut.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score,
 row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY (1000::HUGEINT * cut.a * n) // (h.a::HUGEINT * t.a), j) AS first
 FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail JOIN size ON size.lang = cut.lang),
inside AS (SELECT DISTINCT b.lang, array_to_string(b.w[i:i + m - 1], ' ') AS phrase, b.a FROM c b, (SELECT unnest([2, 3, 4]) AS m) x, (SELECT unnest([1, 2, 3, 4]) AS i) y WHERE m < b.k AND i + m - 1 <= b.k),
kept AS (SELECT s.* FROM s WHERE first = 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 100 * s.a)),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM r WHERE rank <= 2000"""
