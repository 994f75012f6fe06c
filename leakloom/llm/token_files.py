"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Rows lie in ascending doc_id order over the files; each holds its place within its shard, so that readers take stripes
in parallel and skip those whose statistics or Bloom filter exclude a document.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path
from .token_count import LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE, SPACE, is_latin, load_tokenizer, refuse_others, special_pattern

#: The word split, after the tokenizer's normalisation.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_LATIN_WORD = re.compile(rf"[{LATIN_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_NUMBER}]|[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+")

#: The normaliser and the split that normalised and WORD stand for.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}

#: Totals of up to so many shards (12 bytes each) are broadcast to readers; more are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000

FILE_SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens long, ids array<int>"

_caches: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable ones for themselves, the others for letters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (x for x in range(256) if x not in own)
    return {byte: 0x100 + i for i, byte in enumerate(others)}


_LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of a word as little-endian 32-bit bytes. A word met again (by its hash) is kept, up to a bounded number; others go to the tokenizer's model each time."""

    def __init__(self, tokenizer, entries: int = 200_000, met_bits: int = 22):
        super().__init__()
        self.tokenizer, self.room, self.mask = tokenizer, entries, (1 << met_bits) - 1
        self.met = bytearray(1 << met_bits)
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        # Words come here normalised and split, so only the model's own step is left: its letters are bytes.
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_LETTERS)
        ids = array("I", [token.id for token in self.tokenize(letters)]).tobytes()
        at = hash(word) & self.mask
        if not self.met[at]:
            self.met[at] = 1
        elif len(self) < self.room:
            self[word] = ids
        return ids

    def encode(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


def normalised(text: str) -> str:
    """NFC and lower case, letter by letter (a final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def words_of(text: str) -> list[str]:
    text = normalised(text)
    return (_LATIN_WORD if is_latin(text) else WORD).findall(text)


def text_ids(text: str, words: WordIds, special) -> bytes:
    """Ids of a whole text, as bytes; special strings give their own id."""
    if "<|" not in text:
        return words.encode(words_of(text))
    out, at = [], 0
    for m in special.finditer(text):
        out += (words.encode(words_of(text[at : m.start()])), np.uint32(words.tokenizer.token_to_id(m[0])).tobytes())
        at = m.end()
    return b"".join((*out, words.encode(words_of(text[at:]))))


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2) -> None:
    """Encode each whole text, append end_id, and write ids as ORC in ascending (doc_id, text) order, null ids first.

    A null or empty text is end_id alone; repeated rows are each written; an empty table leaves files without rows;
    other columns, whatever their names, are not read. A tokenizer with other rules than WORD_RULES is refused.
    """
    refuse_others(tokenizer_path, WORD_RULES)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    end = np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        words = _caches.setdefault(tokenizer_path, WordIds(tokenizer))
        special, start = special_pattern(tokenizer), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                each = [text_ids(x, words, special) + end for x in part.column(1).to_pylist()]
                n = np.fromiter(map(len, each), np.int64, len(each)) // 4
                offsets = np.concatenate(([0], np.cumsum(n)))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(each))]))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(start + offsets[:-1]), pa.array(n), ids], ["shard", "doc_id", "start_in_shard", "n_tokens", "ids"])
                start += int(offsets[-1])

    placed.mapInArrow(encode, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, start, n_tokens, ids: start counts the ids of all documents before. Filters on doc_id reach the stripes."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    # One row for each file: the running total of the shards before it.
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = sizes.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("shard_start"))
    few = sizes.count() <= BROADCAST_SHARDS
    return rows.join(F.broadcast(before) if few else before, "shard").select("shard", "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy(zero_copy_only=False)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files to the shared folder and give doc_id, start, n_tokens, ids_crc32 of what is read back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, path)
    return with_checksum(read_token_files(docs.sparkSession, path))
