"""Exact Jaccard links between documents' sets of word n-grams, and their components.

The n-grams of a set stand in one global order: rare ones by hash, then those that were not counted, then frequent ones.
Two sets that link share an n-gram among the first few of each, so those few are an index. Sets of candidates meet in
prefix-tree order: the walk keeps the overlap with the other set at each depth, the next set takes up where it leaves
the last one's path, and a subtree goes when what is left of either set cannot reach the overlap that a link needs.

Equal sets are one class before any join. Candidates are first one pair for each index entry (with the least set that
shares it), then the nearest by bitmaps; only sets that are then in different components, and still share an index
entry, are compared in full.
Links between sets that earlier links join already change no component, so no group of copies becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, text_parts, word_hashes, word_spans
from .components import components

#: N-grams whose hash lies in this share of all hashes are counted; those beyond come later in the order.
COUNTED = int(0.4 * 2**32)
#: At most so many n-grams are frequent, as each makes up more than one part in so many of all occurrences.
FREQUENT_PARTS = 1 << 20
FREQUENT_LEAST = 16
#: Sets of an index entry are compared in blocks of about so many.
BLOCK = 512
#: So many n-grams at a set's start tell whether a pair has met in an earlier index entry.
HEAD = 32
#: Node ids up to so many (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_ONE, _TWO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word n-gram of several texts; a text with fewer words gives its whole sequence as one."""
    starts, ends, rows = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    if len(h) >= words:
        whole = np.flatnonzero(rows[: len(h) - words + 1] == rows[words - 1 :])
        grams = sum(h[whole + i] * _PLACES[i] for i in range(words))
    else:
        whole, grams = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        first = np.searchsorted(rows, few)
        short = np.array([sum((int(h[f + i]) * int(_PLACES[i]) for i in range(k)), k) & (2**64 - 1) for f, k in zip(first.tolist(), n[few].tolist(), strict=True)], np.uint64)
        grams, whole_rows = np.concatenate((grams, short)), np.concatenate((rows[whole], few))
    else:
        whole_rows = rows[whole]
    return mix(np.asarray(grams, np.uint64)), whole_rows


def ordered(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A 63-bit key of each hash, whose order is the global order."""
    high = (grams >> np.uint64(32)).astype(np.uint32)
    kind = (high >= COUNTED).astype(np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)
        kind[frequent[at] == high] = 2
    return (kind << np.uint64(61)) | (grams >> np.uint64(3))


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending keys) of each text with a word."""
    grams, rows = shingles(data, offsets, words)
    keys = ordered(grams, frequent)
    by_row = np.argsort(rows, kind="stable")
    keys, rows = keys[by_row], rows[by_row]
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
        if b > a:
            yield int(rows[a]), np.unique(keys[a:b])


def frequent_grams(docs: DataFrame, words: int) -> np.ndarray:
    """The upper hash halves of frequent n-grams, ascending: counted over all documents, few in number by the threshold."""
    ranges = int(min(65536, max(64, docs.count() // 2000)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint32), return_counts=True)
            held.clear()
            at = np.searchsorted(grams, [COUNTED * i // ranges for i in range(ranges + 1)])
            at[-1] = len(grams)
            parts = []
            for i in range(ranges):
                g, k = grams[at[i] : at[i + 1]], n[at[i] : at[i + 1]]
                if len(g):
                    parts.append((i, g[k == 1].tobytes(), g[k > 1].tobytes(), k[k > 1].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[i] for p in parts], pa.binary()) for i in (1, 2, 3))], ["range", "once", "more", "n"])

        for batch in batches:
            for _, _, data, offsets in text_parts(batch):
                grams, rows = shingles(data, offsets, words)
                high = (grams >> np.uint64(32)).astype(np.uint32)
                few = high < COUNTED
                if few.any():
                    pairs = np.unique((rows[few].astype(np.uint64) << np.uint64(32)) | high[few])
                    held.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                if sum(map(len, held)) > 8_000_000:
                    yield flush()
        yield flush()

    def merge(part: pa.Table) -> pa.Table:
        join = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32)
        once, more, n = join("once"), join("more"), join("n")
        grams, place = np.unique(np.concatenate((once, more)), return_inverse=True)
        total = np.bincount(place, np.concatenate((np.ones(len(once)), n))).astype(np.int64)
        keep = total >= FREQUENT_LEAST
        return pa.table({"gram": pa.array([-1, *grams[keep].tolist()], pa.int64()), "n": pa.array([int(total.sum()), *total[keep].tolist()], pa.int64())})

    counts = docs.select("text").mapInArrow(tally, "range int, once binary, more binary, n binary")
    merged = materialise(counts.groupBy("range").applyInArrow(merge, "gram long, n long"), "grams")
    total = merged.where("gram < 0").agg(F.sum("n")).first()[0] or 0
    rows = merged.where((F.col("gram") >= 0) & (F.col("n") > total / FREQUENT_PARTS)).select("gram").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.uint32))


def required(na: int, nb: int, percent: int) -> int:
    """The least overlap with which sets of na and nb n-grams link: 100 * overlap >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def lead_length(n: int, percent: int) -> int:
    """A set of n n-grams shares one of its first so many with any longer or equal set that it links with."""
    return -(-(100 - percent) * n // (100 + percent))


class Walk:
    """Walk one set's prefix tree of others; they come in the tree's order."""

    STEP = 64

    def __init__(self, other: np.ndarray, percent: int):
        self.other, self.percent = other, percent
        self.path, self.overlap, self.place = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def links(self, keys: np.ndarray) -> bool:
        n, m = len(keys), len(self.other)
        need = required(n, m, self.percent)
        if need > min(n, m):
            return False
        depth = min(n, len(self.path))
        apart = keys[:depth] != self.path[:depth]
        if apart.any():
            depth = int(apart.argmax())
        overlap, place = [self.overlap[: depth + 1]], [self.place[: depth + 1]]
        have, at = int(self.overlap[depth]), int(self.place[depth])
        while depth < n and have + min(n - depth, m - at) >= need:
            part = keys[depth : depth + self.STEP]
            index = np.searchsorted(self.other, part)
            hit = self.other[np.minimum(index, m - 1)] == part
            hit &= index < m
            overlap.append(have + np.cumsum(hit))
            place.append(index + hit)
            have, at, depth = int(overlap[-1][-1]), int(place[-1][-1]), depth + len(part)
        self.path, self.overlap, self.place = keys[:depth], np.concatenate(overlap), np.concatenate(place)
        return depth == n and have >= need


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link. A b with many a is dealt out in parts."""
    spread = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("parts"))
    dealt = pairs.join(spread, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).select("a", "b", "part")
    members = dealt.join(sets, F.col("a") == F.col("node")).select("b", "part", F.lit(1).alias("kind"), "a", "keys")
    heads = dealt.select("b", "part").distinct().join(sets, F.col("b") == F.col("node")).select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("a"), "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walks = None, []
        for batch in batches:
            found_a, found_b = [], []
            for b, part, kind, a, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(keys, ">u8").astype(np.uint64)
                if at != (b, part):
                    at, walks = (b, part), []
                if not kind:
                    walks.append(Walk(keys, percent))
                elif any([w.links(keys) for w in walks]):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    # Keys are big-endian, so that Spark's order of bytes is the order of the prefix tree.
    return members.union(heads).repartition("b", "part").sortWithinPartitions("b", "part", "kind", "keys").mapInArrow(compare, "a long, b long").distinct()


def bitmap(keys: np.ndarray) -> bytes:
    """The parity of keys in each of about as many buckets as there are keys, a power of two."""
    size = 64 << max(0, int(np.ceil(np.log2(max(1, len(keys)) / 64))))
    return np.packbits((np.bincount((keys & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At most how many keys two sets don't share is bounded from below by this: buckets of different parity, the longer bitmap folded."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def may_link(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave a link possible; loses none. rows: doc_id, n, bits."""
    one = rows.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, bits_a, bits_b = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            near = [apart(x, y) <= n + m - 2 * required(n, m, percent) for n, m, x, y in zip(na, nb, bits_a, bits_b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(keep, "a long, b long").distinct()


def index_entries(classes: DataFrame, percent: int) -> DataFrame:
    """key, gram, node, n, leads, pivot, pivot_n of the index entries where sets may link by their lengths.

    Of two sets that link, the shorter has a shared n-gram among its first lead_length ones; such a row leads, and only
    longer sets that could still link follow it. pivot is the first to lead of an unbroken chain of lengths, and key
    tells chains apart.
    """
    rows = classes.select("node", "n", F.posexplode("prefix").alias("at", "key")).select("key", "n", "node", (100 + percent) * F.col("at") < (100 - percent) * F.col("n") + (100 + percent))
    rows = rows.toDF("key", "n", "node", "leads").repartition("key").sortWithinPartitions("key", "n", F.desc("leads"), "node")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led: tuple[int, int] | None = None  # key and n of the last row that led
        pivot: tuple[int, ...] | None = None  # key, n, node of the chain that the last batch ended in
        shown = True  # whether the pivot's own row has gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, node = (batch.column(i).to_numpy() for i in range(3))
            leads = batch.column(3).to_numpy(zero_copy_only=False)
            at = np.arange(len(key))
            last = np.maximum.accumulate(np.where(leads, at, -1))
            before = np.concatenate(([-1], last[:-1]))  # the last row that led before this one
            near = np.where(before >= 0, (key[before] == key) & (n * percent <= n[before] * 100), (key == led[0]) & (n * percent <= led[1] * 100) if led else False)
            if last[-1] >= 0:
                led = (int(key[last[-1]]), int(n[last[-1]]))
            keep = leads | near
            key, n, node, leads, first = key[keep], n[keep], node[keep], leads[keep], ~near[keep]
            if not len(key):
                continue
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            pivot_node = np.where(start >= 0, node[start], pivot[2] if pivot else 0)
            pivot_n = np.where(start >= 0, n[start], pivot[1] if pivot else 0)
            go = ~first
            go[:-1] |= first[:-1] & ~first[1:]
            out = [x[go].astype(np.int64) for x in (key, n, node, pivot_node, pivot_n)] + [leads[go]]
            if not first[0] and not shown:
                out = [np.concatenate(([v], x)) for v, x in zip((*pivot, pivot[2], pivot[1], True), out, strict=True)]
                shown = True
            if start[-1] >= 0:
                pivot = (int(key[start[-1]]), int(n[start[-1]]), int(node[start[-1]]))
                shown = bool(start[-1] < len(key) - 1)
            chain = mix(out[0].view(np.uint64) ^ mix(out[3].view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (chain, out[0], out[2], out[1], out[5].astype(bool), out[3], out[4])], ["key", "gram", "node", "n", "leads", "pivot", "pivot_n"])

    return rows.mapInArrow(chains, "key long, gram long, node long, n long, leads boolean, pivot long, pivot_n long")


def folded(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By bitmap length in words: a matrix of all bitmaps of that length or twice it, folded to it, and each row's place in it (or -1)."""
    words = [np.frombuffer(x, np.uint64) for x in bits]
    sizes, out = np.array([len(x) for x in words]), {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        place = np.full(len(bits), -1)
        place[own] = np.arange(len(own))
        out[size] = (np.stack([np.bitwise_xor.reduce(words[i].reshape(-1, size), axis=0) for i in own]), place)
    return out


def rest_pairs(entries: DataFrame, labels: DataFrame, rows: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Distinct pairs of sets that share an index entry, aren't known to be in one component, and may link by their lengths and bitmaps.

    An entry's sets are compared in blocks, so that none is gathered whole. With nearest, a set that leads gives of each
    block only the pair whose bitmaps differ least; without, a pair stands in the first entry that the heads of both show
    them to share: as both lead there, neither lengths nor bitmaps nor blocks can part them. rows: doc_id, bits, head.
    """
    known = entries.select("key", "gram", "node", "n", "leads").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    rows_of = known.join(mixed, "key").join(rows.select(F.col("doc_id").alias("node"), "bits", F.lit(b"").alias("head") if nearest else "head"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows_of = rows_of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows_of.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "leads", "label", "bits", "gram", "head")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", F.desc("leads"), "node")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        seen: set[tuple[int, int]] = set()

        def pairs() -> None:
            i, j, block, node, n, leads, label = (np.array(x) for x in zip(*(r[1:8] for r in held), strict=True))
            bits = folded([r[8] for r in held])
            heads: dict[int, frozenset[int]] = {}

            def head(at: int) -> frozenset[int]:
                if at not in heads:
                    heads[at] = frozenset(x for x in np.frombuffer(held[at][10], np.int64).tolist() if x < held[at][9])
                return heads[at]

            last = np.searchsorted(n * percent, n * 100, "right")  # rows up to here are short enough to link
            for k in np.flatnonzero(leads):
                others = np.arange(k + 1, last[k])
                others = others[(label[others] != label[k]) & ((i[0] == j[0]) | (block[others] != block[k]))]
                if len(others):
                    matrix, place = bits[len(held[k][8]) // 8]
                    differ = np.bitwise_count(matrix[place[others]] ^ matrix[place[k]]).sum(axis=1)
                    most = n[others] + n[k] - 2 * -(-percent * (n[others] + n[k]) // (100 + percent))
                    near = others[differ <= most]
                    if nearest and len(near):
                        near = others[[int(np.where(differ <= most, differ, np.iinfo(np.int64).max).argmin())]]
                    seen.update((int(node[x]), int(node[k])) for x in near.tolist() if head(k).isdisjoint(head(x)))

        def flush() -> pa.RecordBatch:
            out = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != row[:3]:
                    if len(held) > 1:
                        pairs()
                    at, held = row[:3], []
                    if len(seen) > 200_000:
                        yield flush()
                held.append(row)
        if len(held) > 1:
            pairs()
        yield flush()

    return dealt.mapInArrow(cross, "a long, b long").where("a <> b").distinct()


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    A set is the distinct n-grams of a text's lower-cased words; a text with fewer words has its whole sequence as one,
    null, empty and blank texts have none and link with nothing. Two sets link when 100 * overlap >= percent * union;
    component_id is the least doc_id that links reach. Repeated rows each give a row; rows of one doc_id are one
    document, whose links are those of all its texts; a null doc_id is its own (null) component; an empty table gives
    none; other columns, whatever their names, are not read. N-grams are told apart by 61 bits of a hash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, words))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_parts(batch):
                n, one, two = (np.zeros(b - a, t) for t in (np.int64, np.uint64, np.uint64))
                prefix: list = [None] * (b - a)
                bits: list = [None] * (b - a)
                heads: list = [None] * (b - a)
                for row, keys in sets_of(data, offsets, words, frequent.value):
                    n[row], one[row], two[row] = len(keys), mix(keys ^ _ONE).sum(), mix(keys ^ _TWO).sum()
                    prefix[row], bits[row] = keys[: prefix_length(len(keys), percent)].astype(np.int64), bitmap(keys)
                    heads[row] = keys[: min(HEAD, lead_length(len(keys), percent))].astype(np.int64).tobytes()
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(heads, pa.binary())], ["doc_id", "n", "one", "two", "prefix", "bits", "head"])

    rows = materialise(docs.mapInArrow(summarise, "doc_id long, n long, one long, two long, prefix array<long>, bits binary, head binary"), "sets")
    same = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "one", "two")
    entries = materialise(index_entries(same.agg(F.min_by("prefix", "doc_id").alias("prefix"), F.min("doc_id").alias("node")).select("node", "n", "prefix"), percent), "entries")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_parts(batch):
                keys: list = [b""] * (b - a)
                for row, k in sets_of(data, offsets, words, frequent.value):
                    keys[row] = k.astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary())], ["node", "keys"])

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
        few = nodes.count() <= BROADCAST_IDS
        chosen = docs.join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("wanted")).select("wanted", "text")
        sets = chosen.mapInArrow(keep, "node long, keys binary").where(F.octet_length("keys") > 0)
        return materialise(verify(pairs, materialise(sets, "keys"), percent), "links")

    near = entries.where((F.col("node") != F.col("pivot")) & (100 * F.col("pivot_n") >= percent * F.col("n"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = linked(may_link(near, rows, percent))
    # Nearest pairs first: they join most of a group of near copies, whose many other pairs then need no look.
    joined = first.union(linked(rest_pairs(entries, components(first), rows, percent, nearest=True)))
    # A document with several texts stands in several classes, so no head tells what its entries are.
    twice = rows.where("n > 0").groupBy("doc_id").agg(F.min("one").alias("lo"), F.max("one").alias("hi")).where("lo <> hi").select("doc_id")
    headed = rows.join(twice.withColumn("several", F.lit(True)), "doc_id", "left").withColumn("head", F.when(F.col("several"), F.lit(b"")).otherwise(F.col("head")))
    second = joined.union(linked(rest_pairs(entries, components(joined), headed, percent)))
    # The own id of a document with several texts joins the nodes of their classes.
    classes = same.agg(F.min("doc_id").alias("node"))
    belongs = rows.select("doc_id", "n", "one", "two").join(classes, ["n", "one", "two"]).where("doc_id IS NOT NULL").select("doc_id", "node")
    bridges = belongs.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = materialise(components(second.union(bridges)), "labels")
    with_node = rows.select("doc_id", "n", "one", "two").join(classes.where("n > 0"), ["n", "one", "two"], "left")
    out = with_node.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.least(F.coalesce("label", "node"), "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those that link, directly or not, to a document of a smaller id; all columns stay, whatever their names.

    Rows of the kept id stay as they are, repeated ones too; so do rows with a null id, and null, empty and blank texts,
    which link with nothing; an empty table gives none.
    """
    linked = jaccard_components(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.alias("d").join(linked.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left_anti")
