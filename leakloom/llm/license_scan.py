"""Short licence notices, also with a few wrong characters.

A notice with at most k edits, cut into k + 1 pieces, still holds one piece unchanged; those exact seeds give candidate
places, and the regex library's bounded-error matching verifies each, counts its edits and reports its span. Of places
of one notice that overlap, the one of fewest edits stays.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Notice:
    """words: lower case, parted by single spaces. edits: how many a match may have. base: exact matches count as base.

    sure: what tells this licence from others, which a match must hold unchanged, as it must all digits.
    """

    label: str
    words: str
    edits: int
    base: bool = False
    sure: tuple[str, ...] = ()

    def told_by(self, match: str) -> bool:
        return all(x in match for x in self.sure) and re.findall("[0-9]+", match) == re.findall("[0-9]+", self.words)


NOTICES = (
    Notice("mit", "under the mit license", 2, True, (" mit ",)),
    Notice("apache-2", "apache license version 2", 2, True, ("ap",)),
    Notice("cc-by-nc", "cc by nc", 0, True),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3, False, ("non",)),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "under the bsd license", 1, False, (" bsd ",)),
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 3, False, (" les",)),
    Notice("mpl-2", "mozilla public license version 2", 3),
    Notice("isc", "under the isc license", 1, False, (" isc ",)),
)

#: Lower-cases A-Z and makes every byte that parts words a space: the words are what is left of 0-9, a-z and all beyond ASCII.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

SPAN = "struct<label string, notice string, first_word long, last_word long, edits int, base boolean, matched string>"


@cache
def _seeds(notice: Notice) -> tuple[tuple[bytes, int], ...]:
    """Each piece with its place in the notice."""
    text, parts = notice.words.encode(), notice.edits + 1
    cuts = [round(i * len(text) / parts) for i in range(parts + 1)]
    return tuple((text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False))


@cache
def _verifier(notice: Notice):
    return regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(notice.words, literal_spaces=True)}){{e<={notice.edits}}}(?![^ ])")


def _windows(words: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Stretches that may hold the notice: one around each seed, widened to whole words, so that it begins and ends between characters."""
    found, last = set(), len(words) - 1
    for seed, place in _seeds(notice):
        at = words.find(seed)
        while at >= 0:
            a, b = max(at - place - notice.edits - 1, 0), min(at - place + len(notice.words) + notice.edits + 1, last)
            found.add((words.rfind(b" ", 0, a) + 1 if a else 0, words.find(b" ", b)))
            at = words.find(seed, at + 1)
    return sorted(found)


def _apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end), those of fewest edits that don't overlap, by start."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for edits, a, b in sorted(found):
        at = bisect(starts, a)
        if (not at or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
            starts.insert(at, a)
            kept.insert(at, (a, b, edits))
    return kept


def scan_text(text: str, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[dict]]:
    """The number of words of a text, and the span of each notice in it. Exact places may overlap; others don't overlap those of the same notice."""
    each = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    words, spans = b" " + b" ".join(each) + b" ", []
    begins = cache(lambda: np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20) + 1)
    index = lambda at: int(np.searchsorted(begins(), at, "right")) - 1  # noqa: E731  the word that holds this byte

    def add(notice: Notice, a: int, b: int, edits: int) -> None:
        spans.append({"label": notice.label, "notice": notice.words, "first_word": index(a), "last_word": index(b - 1), "edits": edits, "base": notice.base and not edits, "matched": words[a:b].decode("utf-8", "replace")})

    for notice in notices:
        exact = set()
        needle = b" " + notice.words.encode() + b" "
        at = words.find(needle)
        while at >= 0:
            exact.add(at + 1)
            add(notice, at + 1, at + len(needle) - 1, 0)
            at = words.find(needle, at + 1)
        if not notice.edits:
            continue
        found = {(0, a, a + len(notice.words)) for a in exact}
        for a, b in _windows(words, notice):
            window = words[a:b].decode("utf-8", "replace")
            # The best match of one seed's window; a window of several notices would hide all but its best.
            m = _verifier(notice).search(window)
            if m and (hit := m[0].strip(" ")) and notice.told_by(hit):
                start = a + len(window[: m.start() + len(m[0]) - len(m[0].lstrip(" "))].encode())
                found.add((sum(m.fuzzy_counts), start, start + len(hit.encode())))
        for a, b, edits in _apart(found):
            if edits:
                add(notice, a, b, edits)
    return len(each), spans


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, spans of each row.

    Null and empty texts have no words and no spans; a null doc_id stays null; repeated rows each give a row; an empty
    table gives none; other columns, whatever their names, are not read. Words number from 0. Spans may touch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_()), ("matched", pa.string())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [scan_text(x, notices) if x else (0, []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], kind)], ["doc_id", "n_words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, n_words long, spans array<{SPAN}>")


def license_digest(docs: DataFrame) -> DataFrame:
    """One row a document: places, labels and the best match's share of unchanged characters; odd rows as in scan_licenses."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    closeness = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"]))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"),
    )
