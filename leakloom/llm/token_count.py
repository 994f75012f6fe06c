"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast hash table with the token counts of frequent pre-tokens; tier two is a cache in each
Python worker that asks the tokenizer once for a pre-token it has not met. No pre-token is ever shuffled.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizers library has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level split of a text into pre-tokens.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Letters, numbers and white space up to U+00FF, for texts without other characters: the standard library is faster there.
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN_PRE_TOKEN = re.compile(rf" ?[{LATIN_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{LATIN_NUMBER}]+| ?[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pre_tokens(text: str) -> list[str]:
    return (_LATIN_PRE_TOKEN if is_latin(text) else PRE_TOKEN).findall(text)


#: The normaliser and the split that PRE_TOKEN stands for.
BYTE_LEVEL_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}

#: A worker keeps so many pre-tokens besides the frequent ones; later ones are encoded each time.
CACHE_ENTRIES = 800_000

_loaded: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once for each process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def refuse_others(path: str, rules: dict) -> None:
    """Raise unless the tokenizer file has exactly these parts, as this module splits texts by rules of its own."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    for part, rule in rules.items():
        if found.get(part) != rule:
            raise ValueError(f"{path}: this {part} is not known here: {found.get(part)}")


class Lengths(dict):
    """Token counts by pre-token: the frequent ones, and what the tokenizer said of the others."""

    def __init__(self, tokenizer, frequent: dict[str, int], entries: int = CACHE_ENTRIES):
        super().__init__(frequent)
        self.tokenizer, self.room = tokenizer, len(frequent) + entries

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) < self.room:
            self[piece] = n
        return n


def special_pattern(tokenizer):
    """Matches the special strings that the tokenizer takes out of a text, or None."""
    words = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(words, key=len, reverse=True)))) if words else None


def frequent_lengths(docs: DataFrame, tokenizer_path: str, sample_rows: int = 10_000, entries: int = 65_536) -> dict[str, int]:
    """Token counts of frequent pre-tokens, found in about sample_rows whole texts (drawn by a hash of doc_id).

    Only speed depends on this table, so a bounded sample does; counts are exact whatever it holds.
    """
    total = docs.count()
    if not total:
        return {}
    share = min(1.0, sample_rows / total)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(pre_tokens(text or ""))
        kept = [(k, v) for k, v in counts.most_common(entries) if v > 1]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in kept], pa.string()), "n": pa.array([v for _, v in kept], pa.int64())})

    merged: Counter[str] = Counter()
    for row in drawn.mapInArrow(tally, "piece string, n long").toLocalIterator():
        merged[row.piece] += row.n
    pieces = [k for k, _ in merged.most_common(entries)]
    tokenizer = load_tokenizer(tokenizer_path)
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, sample_rows: int = 10_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row with a byte-level BPE tokenizer.

    Null and empty texts have 0 bytes and tokens; a null doc_id stays null; repeated rows each give a row; an empty
    table gives none; other columns, whatever their names, are not read. Texts are never cut. A tokenizer with other
    rules than BYTE_LEVEL_RULES is refused.
    """
    refuse_others(tokenizer_path, BYTE_LEVEL_RULES)
    spark, key = docs.sparkSession, ("lengths", uuid.uuid4().hex)
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs.select("doc_id", "text"), tokenizer_path, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        if key not in _loaded:
            for old in [k for k in _loaded if isinstance(k, tuple)]:
                del _loaded[old]  # a reused worker keeps the cache of one query
            _loaded[key] = Lengths(tokenizer, frequent.value)
        lengths = _loaded[key]
        special, pieces, get = special_pattern(tokenizer), pre_tokens, lengths.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n = []
                for text in part.column(1).to_pylist():
                    if not text:
                        n.append(0)
                    elif special is None or "<|" not in text and not special.search(text):
                        n.append(sum(map(get, pieces(text))))
                    else:
                        parts = special.split(text)
                        n.append(len(parts) - 1 + sum(get(p) for x in parts for p in pieces(x)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
