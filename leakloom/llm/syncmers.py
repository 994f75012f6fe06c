"""Document fingerprints from closed syncmers, with Spark's own functions only.

Words are the letters of the k-mers, and so is each character of a word of more than LONG_WORD characters (text without
white space): of each run of K letters, hashed in pairs, the least pair is looked for, and runs where it is the first or
the last pair are anchors. Whether a run is an anchor depends on its own letters alone, so an edit elsewhere moves no
anchor. A fingerprint is the least hashes of a text's distinct anchors, each with the place where it first stands; two
fingerprints match in the anchors that both have, in the same order as a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a run, of which neighbours are paired: K - 1 pairs. The code below is written for these six.
K = 6
#: The characters of a longer word are letters of their own.
LONG_WORD = 24
#: Anchors in a fingerprint.
KEPT = 64
#: Rows of neighbouring doc_id that are dealt out together.
TOGETHER = 20_000
MOST_LEVELS = 14


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letter_hashes(text: Column) -> Column:
    """Hash of each letter: a word [^\\x20\\x09-\\x0D]+, or each character of a long one; null and empty texts have none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    is_long = lambda w: F.length(w) > LONG_WORD
    parts = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(is_long(w), F.split(w, "")).otherwise(F.array(w))))
    letters = _bound(words, lambda ws: F.when(F.exists(ws, is_long), parts(ws)).otherwise(ws))
    return F.transform(letters, lambda w: F.xxhash64(w))


def anchors_of(text: Column) -> Column:
    """The anchors (position in letters, hash) of a text; fewer than K letters are one anchor at 0."""

    def of_pairs(pair: Column) -> Column:
        runs = F.size(pair) - (K - 2)
        part = lambda start: F.slice(pair, start, runs)
        inner = F.zip_with(F.zip_with(part(2), part(3), _lesser), part(4), _lesser)
        edge = F.zip_with(part(1), part(5), _lesser)
        marks = F.zip_with(edge, inner, lambda e, i: e <= i)
        hashes = F.zip_with(F.zip_with(part(1), part(3), lambda a, b: F.xxhash64(a, b)), part(5), lambda ab, c: F.xxhash64(ab, c))
        placed = F.transform(F.arrays_zip(marks.alias("mark"), hashes.alias("hash")), lambda x, i: F.struct(x["mark"].alias("mark"), i.alias("position"), x["hash"].alias("hash")))
        return F.transform(F.filter(placed, lambda x: x["mark"]), lambda x: F.struct(x["position"], x["hash"]))

    def of_letters(w: Column) -> Column:
        pair = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
        short = F.slice(F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(w).alias("hash"))), 1, F.least(F.size(w), F.lit(1)))
        return F.when(F.size(w) >= K, _bound(pair, of_pairs)).otherwise(short)

    return _bound(letter_hashes(text), of_letters)


def sketch(anchors: Column) -> Column:
    """The least KEPT hashes of distinct anchors, ascending, each with its first position."""
    by_hash = F.array_sort(F.transform(anchors, lambda a: F.struct(a["hash"], a["position"])))
    return F.slice(_bound(by_hash, lambda s: F.filter(s, lambda a, i: (i == 0) | (F.get(s, i - 1)["hash"] != a["hash"]))), 1, KEPT)


def matches(a: Column, b: Column) -> Column:
    """(here, there): positions of the anchors that both sketches have and that stand in the same order as a neighbour; one alone counts."""
    places = F.map_from_entries(b)
    both = _bound(places, lambda m: F.array_sort(F.filter(F.transform(a, lambda x: F.struct(x["position"].alias("here"), F.try_element_at(m, x["hash"]).alias("there"))), lambda x: x["there"].isNotNull())))

    def in_order(pairs: Column) -> Column:
        follows = lambda x, y: F.coalesce(x["there"] < y["there"], F.lit(False))
        return F.filter(pairs, lambda x, i: (F.size(pairs) == 1) | follows(F.get(pairs, i - 1), x) | follows(x, F.get(pairs, i + 1)))

    return _bound(both, in_order)


def likeness(a: Column, b: Column) -> Column:
    """Share of the least KEPT hashes of both sketches together that match by place; 1 if both are empty."""
    hashes = lambda s: F.transform(s, lambda x: x["hash"])
    within = lambda s, union: F.filter(s, lambda x: x["hash"] <= F.get(union, F.size(union) - 1))
    least = F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, KEPT)
    return _bound(least, lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(matches(within(a, union), within(b, union))) / F.size(union)))


def as_text(found: Column) -> Column:
    """24 hexadecimal digits for each anchor: 16 of its hash, 8 of its position."""
    return F.array_join(F.transform(found, lambda a: F.concat(F.lpad(F.lower(F.hex(a["hash"])), 16, "0"), F.lpad(F.lower(F.hex(a["position"])), 8, "0"))), "")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column> of the row that follows in descending (doc_id, text), null ids last; after the last row the first.

    Rows are dealt out by cuts of doc_id; the first row of each part also goes, as a guest, to the part before it.
    """
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, rows.select("doc_id").count() / TOGETHER)))))
    rows = rows.withColumn("__key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if levels:
        shares = [i / (1 << levels) for i in range(1, 1 << levels)]
        cuts = rows.agg(F.percentile_approx("__key", shares, 100_000).alias("cuts")).first().cuts
        cut = F.array(*map(F.lit, cuts or [0] * len(shares)))
        # Binary search for the number of cuts below the key.
        part = F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(levels)))), F.lit(0), lambda at, step: F.when(F.get(cut, at + step - 1) < F.col("__key"), at + step).otherwise(at))
    else:
        part = F.lit(0)
    rows = rows.withColumn("__part", part)
    # One row for each part.
    firsts = rows.groupBy("__part").agg(F.max("__key").alias("__first"))
    by_part = Window.orderBy("__part")
    hosts = firsts.select("__first", F.coalesce(F.lead("__part").over(by_part), F.min("__part").over(Window.partitionBy())).alias("__host"))
    both = rows.join(F.broadcast(hosts), F.col("__key") == F.col("__first"), "left")
    both = both.withColumn("__to", F.explode(F.when(F.col("__host").isNull(), F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("__host").alias("part"), F.lit(True).alias("guest"))))))
    order = Window.partitionBy("__to.part").orderBy("__to.guest", F.desc("__key"), F.desc("text"))
    led = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where(~F.col("__to.guest")).drop("__key", "__part", "__first", "__host", "__to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors, sketch of each row.

    Null and empty texts have no anchors; a null doc_id stays null; repeated rows each give a row with equal anchors; an
    empty table gives none; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("anchors", anchors_of(F.col("text"))).withColumn("sketch", sketch(F.col("anchors")))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text (the last half replaced by the next document's beginning), with their likeness."""
    rows = with_next(fingerprints(docs).select("doc_id", "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(anchors_of(F.col("edited"))))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
