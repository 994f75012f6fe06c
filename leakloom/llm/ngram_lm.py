"""Language-model scores from an n-gram trie in Elias-Fano form.

The model holds every training word with its count, and every pair and triple seen at least `least` times, at any size
of input. Probabilities are discounted counts that back off to shorter contexts, quantised. Each level of the trie is
cut by its contexts' hashes into shards, which Spark tasks build and write as files in the shared folder; workers map
them map them into memory. In a shard, a context is found by successor search among ascending hashes; monotone pointers give
the range of its words, whose numbers are relative to it: they ascend from the range's beginning, and are as far apart
on average in every context, so that the search for one stays short. A Bloom filter before it spares most searches for
n-grams that are not there.

A context of very many occurrences is wide: its words are dealt out among shards by their own hashes, so no shard
gathers it whole. Words are told apart by 64 bits of a hash; within one context another word takes a word's place with a
chance of one in 2**24.
"""

from __future__ import annotations

import glob
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, materialise, mix, shared_path, text_parts, word_hashes, word_spans
from .elias_fano import PARTS, EliasFano

#: Pairs and triples seen less often are left to back-off, at every size of input.
LEAST = 2
DISCOUNT = 0.75
#: The hashes of the end and of the beginning of a text.
END, BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
#: Occurrences that a task holds before it merges and sends them on.
FLUSH = 1_250_000
#: Training tokens, about, of a shard of pairs or triples, and documents of a shard of words.
SHARD_TOKENS, SHARD_DOCS = 1 << 22, 1 << 12
#: A context of so many occurrences is wide.
WIDE = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token: words, then an end for each text, in order."""
    starts, ends, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    last = np.searchsorted(rows, np.arange(n), "right")
    return np.insert(words, last, END), np.insert(rows, last, np.arange(n))


def before(values: np.ndarray, rows: np.ndarray, first) -> np.ndarray:
    """Each token's predecessor's value; first for the first token of a text."""
    out = np.full(len(values), first, values.dtype)
    if len(values) > 1:
        same = rows[1:] == rows[:-1]
        out[1:][same] = values[:-1][same]
    return out


def numbers(word: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of words in the range of their context, which begins at `first` and has n words."""
    return (first.astype(np.uint64) << np.uint64(24)) + ((word.astype(np.uint64) * n.astype(np.uint64)) >> np.uint64(8))


def short(h: np.ndarray) -> np.ndarray:
    """What tells words of one context apart."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def pair_context(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two words as a context."""
    return mix(a * _STEP ^ short(b))


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code of eight bits for each value and the mean of each code's values; codes have about equally many."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(edges, values, "left")
    n = np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), np.bincount(code, values, len(edges) + 1) / np.maximum(n, 1)


def to_bytes(parts: list[np.ndarray]) -> bytes:
    """All arrays one after the other, each at a multiple of 8 bytes, before them their kinds, lengths and places."""
    table, at = [], 8 + 24 * len(parts)
    for x in parts:
        table.append((ord(x.dtype.kind) * 100 + x.dtype.itemsize, len(x), at))
        at += -(-x.nbytes // 8) * 8
    head = np.int64(len(parts)).tobytes() + np.array(table, np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0") for x in parts)


def mapped(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    n = int(raw[:8].view(np.int64)[0])
    table = raw[8 : 8 + 24 * n].view(np.int64).reshape(n, 3).tolist()
    return [raw[at : at + length * (kind % 100)].view(np.dtype(f"{chr(kind // 100)}{kind % 100}")) for kind, length, at in table]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _cuts(ordered: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    starts = _runs(ordered).tolist()
    return list(zip(starts, [*starts[1:], len(ordered)], strict=False))


def _probes(context: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that stand for an n-gram in a Bloom filter of 2**bits."""
    h = mix(context ^ (word.astype(np.uint64) * _STEP))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


class Words:
    """A shard of all words and their counts."""

    def __init__(self, parts: list[np.ndarray]):
        self.hashes, self.n = EliasFano(*parts[:PARTS]), parts[PARTS]

    @staticmethod
    def built(hashes: np.ndarray, n: np.ndarray) -> bytes:
        """Ascending hashes and their counts as a file."""
        return to_bytes([*EliasFano.of(hashes).arrays(), n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)])

    def count(self, hashes: np.ndarray) -> np.ndarray:
        at, equal = self.hashes.search(hashes)
        return np.where(equal, self.n[np.minimum(at, len(self.n) - 1)], 0).astype(np.int64)


class Grams:
    """A shard of contexts, the words that follow each, and the quantised log10 of each one's probability and of each context's back-off weight."""

    def __init__(self, parts: list[np.ndarray]):
        self.contexts, self.pointers, self.words = (EliasFano(*parts[i * PARTS : (i + 1) * PARTS]) for i in range(3))
        self.n, self.code, self.book, self.back_code, self.back_book, self.bloom = parts[3 * PARTS :]

    @staticmethod
    def built(context: np.ndarray, word: np.ndarray, n: np.ndarray, context_n: np.ndarray, lower: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """A file of rows that ascend by (context, word); and each context with the probability that its words have, and have one context shorter."""
        starts = _runs(context)
        contexts, place = context[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
        code, book = quantised(np.log10(np.maximum(n - DISCOUNT, 0.01) / np.maximum(context_n, n)))
        kept, below = np.bincount(place, 10 ** book[code], len(starts)), np.bincount(place, lower, len(starts))
        back_code, back_book = quantised(back_off(kept, below))
        ends = np.append(starts[1:], len(word))
        bits = max(6, int(12 * len(word)).bit_length())
        bloom = np.zeros(1 << (bits - 6), np.uint64)
        for at in _probes(context, word, bits):
            np.bitwise_or.at(bloom, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        lists = (EliasFano.of(contexts), EliasFano.of(np.append(starts, len(word))), EliasFano.of(numbers(word, starts[place], (ends - starts)[place])))
        counts = n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)
        return to_bytes([*(a for x in lists for a in x.arrays()), counts, code, book, back_code, back_book, bloom]), contexts, kept, below

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each n-gram, or -1, and log10 of the back-off weight of its context."""
        distinct, back = np.unique(context, return_inverse=True)
        i, have = self.contexts.search(distinct)
        some = np.flatnonzero(have)
        weight = np.zeros(len(distinct))
        weight[some] = self.back_book[self.back_code[i[some]]]
        place = np.full(len(context), -1, np.int64)
        bits = 6 + len(self.bloom).bit_length() - 1
        asked = np.flatnonzero(have[back])
        one, two = _probes(context[asked], word[asked], bits)
        held = lambda at: (self.bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        asked = asked[held(one) & held(two)]
        if len(asked):
            first, n = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            first[some] = self.pointers.get(i[some]).astype(np.int64)
            n[some] = self.pointers.get(i[some] + 1).astype(np.int64) - first[some]
            own = back[asked]
            at, equal = self.words.search(numbers(word[asked], first[own], n[own]))
            place[asked[equal]] = at[equal]
        return place, weight[back]


def back_off(kept: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 of the weight that spreads what a context's words leave over all other words."""
    return np.log10(np.maximum(1 - kept, 1e-6) / np.maximum(1 - below, 1e-6))


@dataclass
class Level:
    """A folder of shards. wide: ascending hashes of wide contexts, by how many bits their words are dealt out, and log10 of their back-off weights."""

    path: str
    bits: int
    kind: type
    wide: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    wide_back: np.ndarray = field(default_factory=lambda: np.zeros(0))
    wide_at: int = WIDE
    #: Ascending numbers of the shards that hold something: each has a file, and any other is empty. None before they are written.
    written: np.ndarray | None = None

    def _is_wide(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.wide[0], context), max(len(self.wide[0]) - 1, 0))
        hit = np.flatnonzero(self.wide[0][at] == context) if len(self.wide[0]) else np.zeros(0, np.int64)
        return hit, at[hit]

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What a context is found by: its hash, or for a word of a wide one a hash of both."""
        hit, at = self._is_wide(context)
        if not len(hit):
            return context
        out = context.copy()
        out[hit] = lane_keys(context[hit], word[hit].astype(np.uint64) >> (np.uint64(32) - self.wide[1][at].astype(np.uint64)))
        return out

    def shards(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def start(self, shard: int) -> np.uint64:
        """The least key of a shard."""
        return np.uint64(shard << (64 - self.bits))

    def open(self, shard: int):
        """A shard as this process has it mapped, or None if it is empty; raises if its file should be there and isn't.

        A process keeps at most MOST_MAPPED shards mapped, those it asked last.
        """
        at = np.searchsorted(self.written, shard)
        if at == len(self.written) or self.written[at] != shard:
            return None
        key = (self.path, shard)
        if key in _mapped:
            _mapped[key] = _mapped.pop(key)
            return _mapped[key]
        for old in [k for k in _mapped if k[0].rpartition("/")[0] != self.path.rpartition("/")[0]]:
            del _mapped[old]  # a reused worker keeps one model
        while len(_mapped) >= MOST_MAPPED:
            del _mapped[next(iter(_mapped))]
        files = glob.glob(f"{local_folder(self.path)}/shard={shard}/*.txt")
        if len(files) != 1:
            raise FileNotFoundError(f"shard {shard} of {self.path} has {len(files)} files in {local_folder(self.path)}")
        _mapped[key] = self.kind(mapped(files[0]))
        return _mapped[key]

    def parts(self, keys: np.ndarray) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """Each shard that is asked, the places of what is asked of it, and the keys there, from the shard's start."""
        shard = self.shards(keys)
        order = np.argsort(shard, kind="stable")
        for a, b in _cuts(shard[order]):
            number = int(shard[order[a]])
            own = self.open(number)
            if own is not None:
                yield own, order[a:b], keys[order[a:b]] - self.start(number)

    def count(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for own, at, keys in self.parts(words):
            out[at] = own.count(keys)
        return out

    def find(self, context: np.ndarray, word: np.ndarray, counts: bool = False) -> tuple[np.ndarray, ...]:
        """log10 of the probability of each word after its context (nan if the level hasn't it), of the context's back-off weight; with counts also the n-gram's."""
        logp, weight, n = np.full(len(context), np.nan), np.zeros(len(context)), np.zeros(len(context) if counts else 0)
        for own, at, keys in self.parts(self.keys(context, word)):
            place, weight[at] = own.find(keys, word[at])
            hit = np.flatnonzero(place >= 0)
            logp[at[hit]] = own.book[own.code[place[hit]]]
            if counts:
                n[at[hit]] = own.n[place[hit]]
        hit, at = self._is_wide(context)
        weight[hit] = self.wide_back[at]
        return (logp, weight, n) if counts else (logp, weight)


_mapped: dict[tuple[str, int], object] = {}
#: Linux lets a process have some 65 000 maps.
MOST_MAPPED = 8192


def lane_keys(context: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return mix(context ^ mix(lane + np.uint64(1)))


def local_folder(path: str) -> str:
    """Where this process finds a folder of the shared one: there if that is mounted, else among the files that Spark fetched."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return f"/{rest.lstrip('/')}" if colon else path
    return SparkFiles.get(path.rpartition("/")[2])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for, which need not be a mounted one."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()


def write_shards(shards: DataFrame, level: Level) -> None:
    """Each row's data as a file of its own below the level's path, written by the tasks that hold it, and their numbers to the level. The text writer writes bytes as they are."""
    spark = shards.sparkSession
    shards.select("shard", F.col("data").cast("string")).write.partitionBy("shard").text(level.path)
    level.written = np.sort(shards.select("shard").toArrow().column(0).to_numpy().astype(np.int64))  # one row a shard, 2 ** bits at most
    if level.path.partition(":")[1] and not level.path.startswith("file:"):
        spark.sparkContext.addFile(level.path, recursive=True)


def _tally_words(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """Distinct words and their counts, merged within a task before they leave it, by shard."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        held.clear()
        shard = level.shards(keys)
        cuts = _cuts(shard)
        return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in cuts], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary())], ["shard", "keys", "n"])

    for batch in batches:
        for _, _, data, offsets in text_parts(batch):
            held.append(token_hashes(data, offsets)[0])
            if sum(map(len, held)) > 2 * FLUSH:
                yield flush()
    yield flush()


def _build_words(part: pa.Table, level: Level) -> pa.Table:
    keys, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("n", np.uint32)))
    keys, place = np.unique(keys, return_inverse=True)
    n = np.bincount(place, n, len(keys)).astype(np.int64)
    wide = np.flatnonzero(n >= level.wide_at)
    return pa.table({"shard": part.column("shard")[:1], "data": pa.array([Words.built(keys - level.start(part.column("shard")[0].as_py()), n)], pa.binary()), "total": [int(n.sum())], "distinct": [len(keys)], "wide": pa.array([keys[wide].view(np.int64)], pa.list_(pa.int64())), "wide_n": pa.array([n[wide]], pa.list_(pa.int64()))})


GRAMS = "shard int, context binary, run binary, context_n binary, word binary, n binary, lower binary"


def _tally_grams(batches: Iterator[pa.RecordBatch], level: Level, found) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams and their counts by shard, contexts once for all their words. found: what a chunk of tokens gives, as context, word, context_n, lower."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        context, word, context_n, lower = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        context = level.keys(context, word)
        back = np.unique(context, return_inverse=True)[1]
        key = (back.astype(np.uint64) << np.uint64(32)) | word
        order = np.argsort(key)
        first = _runs(key[order])
        n = np.diff(np.append(first, len(order))).astype(np.uint32)
        at = order[first]
        shard = level.shards(context[at])
        cuts = _cuts(shard)
        out: list[list] = [[] for _ in range(6)]
        for a, b in cuts:
            rows = at[a:b]
            runs = _runs(context[rows])
            for x, y in zip(out, (context[rows[runs]], np.diff(np.append(runs, b - a)).astype(np.uint32), context_n[rows[runs]].astype(np.float64), word[rows], n[a:b], lower[rows].astype(np.float32)), strict=True):
                x.append(y.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in cuts], pa.int32()), *(pa.array(x, pa.binary()) for x in out)], ["shard", "context", "run", "context_n", "word", "n", "lower"])

    for batch in batches:
        for _, _, data, offsets in text_parts(batch):
            held.append(found(*token_hashes(data, offsets)))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield flush()
    if held:
        yield flush()


def _build_grams(least: int, level: Level):
    lanes = np.int64(1) << level.wide[1]
    of = np.repeat(level.wide[0], lanes)
    lane = lane_keys(of, (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)).astype(np.uint64))
    by_key = np.argsort(lane)
    lane, of = lane[by_key], of[by_key]

    def build(part: pa.Table) -> pa.Table:
        joined = {c: np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("context", np.uint64), ("run", np.uint32), ("context_n", np.float64), ("word", np.uint32), ("n", np.uint32), ("lower", np.float32))}
        distinct, own = np.unique(joined["context"], return_inverse=True)
        key = (np.repeat(own, joined["run"]).astype(np.uint64) << np.uint64(32)) | joined["word"]
        order = np.argsort(key)
        first = _runs(key[order])
        n = np.add.reduceat(joined["n"][order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keep = n >= least
        key, lower, n = key[order[first[keep]]], joined["lower"][order[first[keep]]].astype(np.float64), n[keep]
        place, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        context_n = np.zeros(len(distinct))
        context_n[own] = joined["context_n"]
        start = level.start(part.column("shard")[0].as_py())
        data, contexts, kept, below = Grams.built(distinct[place] - start, word, n, context_n[place], lower)
        contexts = contexts + start
        hashes = contexts.copy()  # of the contexts themselves, where their keys are those of a wide one's words
        at = np.minimum(np.searchsorted(lane, contexts), max(len(lane) - 1, 0))
        broad = np.flatnonzero(lane[at] == contexts) if len(lane) else np.zeros(0, np.int64)
        if len(broad):
            hashes[broad] = of[at[broad]]
        next_wide = np.flatnonzero(n >= level.wide_at)
        before_next = hashes[np.searchsorted(contexts, distinct[place[next_wide]])]
        longs = lambda x: pa.array([x.astype(np.uint64).view(np.int64)], pa.list_(pa.int64()))
        return pa.table(
            {
                "shard": part.column("shard")[:1], "data": pa.array([data], pa.binary()), "rows": [len(n)], "broad": longs(hashes[broad]), "kept": pa.array([kept[broad]], pa.list_(pa.float64())), "below": pa.array([below[broad]], pa.list_(pa.float64())),
                "wide": longs(pair_context(before_next, word[next_wide].astype(np.uint64))), "wide_n": longs(n[next_wide]),
            }
        )

    return build


def _wide(built: DataFrame, wide_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Wide contexts of the next level and the bits that deal out their words: at most one for wide_at training tokens."""
    rows = built.select(F.explode_outer(F.arrays_zip("wide", "wide_n")).alias("w")).where("w IS NOT NULL").select("w.*").toArrow()
    keys, n = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], np.ceil(np.log2(n[order] / wide_at)).astype(np.int64) + 1


@dataclass
class Model:
    """The levels of the trie, all training tokens and distinct ones."""

    words: Level
    pairs: Level
    triples: Level
    total: int
    distinct: int

    @property
    def base(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def singles(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each token's word, and log10 of its probability alone."""
        distinct, back = np.unique(h, return_inverse=True)
        n = self.words.count(distinct)
        return n[back], np.log10((n + 0.5) / self.base)[back]

    def log10(self, h: np.ndarray, rows: np.ndarray, one: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token after the two before it. one: of each alone."""
        first, word = before(h, rows, BEGIN), short(h)
        pair, weight = self.pairs.find(first, word)
        out = np.where(np.isnan(pair), weight + one, pair)
        # A context of two words is in the trie only if it is a pair there.
        after = np.flatnonzero(before(~np.isnan(pair), rows, False))
        triple, weight = self.triples.find(pair_context(before(first, rows, BEGIN)[after], first[after]), word[after])
        out[after] = np.where(np.isnan(triple), weight + out[after], triple)
        return out


def _level(texts: DataFrame, level: Level, found, least: int, name: str) -> tuple[Level, tuple[np.ndarray, np.ndarray]]:
    """Tally and build one level; and the wide contexts of the next."""
    tallied = texts.mapInArrow(lambda batches: _tally_grams(batches, level, found), GRAMS)
    schema = "shard int, data binary, rows long, broad array<long>, kept array<double>, below array<double>, wide array<long>, wide_n array<long>"
    built = materialise(tallied.groupBy("shard").applyInArrow(_build_grams(least, level), schema), name)
    write_shards(built, level)
    if len(level.wide[0]):
        rows = built.select(F.explode_outer(F.arrays_zip("broad", "kept", "below")).alias("b")).where("b IS NOT NULL").groupBy("b.broad").agg(F.sum("b.kept").alias("kept"), F.sum("b.below").alias("below")).toArrow()
        at = np.searchsorted(level.wide[0], rows.column(0).to_numpy().view(np.uint64))
        level.wide_back = np.zeros(len(level.wide[0]))
        level.wide_back[at] = back_off(rows.column(1).to_numpy(), rows.column(2).to_numpy())
    return level, _wide(built, level.wide_at)


def train(texts: DataFrame, least: int = LEAST, wide_at: int = WIDE) -> Model:
    """A model of all texts (one text column) with all n-grams seen at least so often; 1 keeps every one. wide_at: occurrences of a wide context."""
    spark = texts.sparkSession
    folder = qualified(spark, shared_path(spark, f"trie-{uuid.uuid4().hex[:8]}"))
    bits = lambda n, each, lo: int(np.clip(np.ceil(np.log2(max(1, n / each))), lo, 20))
    words = Level(f"{folder}/words", bits(texts.count(), SHARD_DOCS, 3), Words, wide_at=wide_at)
    built = materialise(texts.mapInArrow(lambda b: _tally_words(b, words), "shard int, keys binary, n binary").groupBy("shard").applyInArrow(lambda part: _build_words(part, words), "shard int, data binary, total long, distinct long, wide array<long>, wide_n array<long>"), "words")
    write_shards(built, words)
    total, distinct = built.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    size = bits(total, SHARD_TOKENS, 3)
    model = Model(words, Level(f"{folder}/pairs", size, Grams, _wide(built, wide_at), wide_at=wide_at), Level(f"{folder}/triples", size, Grams, wide_at=wide_at), int(total), int(distinct))

    def pairs(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        n, one = model.singles(h)
        # A word occurs as often as something follows it, and a text begins as often as one ends.
        return before(h, rows, BEGIN), short(h), before(n, rows, model.words.count(np.array([END]))[0]), 10**one

    model.pairs, model.triples.wide = _level(texts, model.pairs, pairs, least, "pairs")

    def triples(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        first, word = before(h, rows, BEGIN), short(h)
        logp, _, n = model.pairs.find(first, word, counts=True)
        both = np.flatnonzero(~np.isnan(logp) & before(~np.isnan(logp), rows, False))  # a triple isn't rarer than its pairs
        return pair_context(before(first, rows, BEGIN)[both], first[both]), word[both], before(n, rows, 0.0)[both], 10 ** logp[both]

    model.triples, _ = _level(texts, model.triples, triples, least, "triples")
    return model


def score_texts(docs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs, learnt from texts.

    Null and empty texts are their end alone; a null doc_id stays null; repeated rows each give a row; without training
    texts every token is unknown; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    model = train(texts, least)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_parts(batch):
                h, rows = token_hashes(data, offsets)
                n, one = model.singles(h)
                sums = [np.bincount(rows, x, b - a) for x in (np.ones(len(h)), n > 0, one, model.log10(h, rows, one))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_digest(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all; odd rows as in score_texts."""
    out = score_texts(docs, docs.where(fold_of(F.col("doc_id"), folds) != held).select("text"))
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
