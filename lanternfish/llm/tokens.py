"""Token-ID output as Parquet lists: dictionary-encoded ids, delta-encoded metadata, small row groups with page indexes.

A folder of token files holds, in ascending doc_id order over its parts, the columns part, doc_id, part_start (ids of the
part's documents before this one), n_tokens and ids. The ids are a dictionary-encoded list column, all else is
delta-encoded. As each column has its own pages, metadata can be read without the ids; as row groups are small and pages are
indexed, a filter on doc_id reads the pages of those documents alone.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import RUN_BYTES, bounded_batches, small, text_runs

SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 16 << 20, 64 << 10
OPTIONS = {
    "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.writer.version": "PARQUET_2_0", "compression": "zstd",
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
}
#: Distinct pieces of text whose ids a worker keeps; when more have come, the half met most often stays.
CACHE = 400_000
#: Bytes that these pieces and ids may take, and those of a piece that stays when more have come.
CACHE_BYTES, PIECE_BYTES = 32_000_000, 32
#: Bytes of text that are cut at a time, a longer text alone.
CUT_BYTES = 4_000_000


#: ASCII punctuation that, behind a letter, begins a pre-token; an apostrophe may go with letters, and a bar ends an added token.
MARKS = string.punctuation.replace("'", "").replace("|", "")
#: What a byte of a text is: white space to cut at, such a mark, a letter, the first byte of a Latin letter of two or the second one.
SPACE, MARK, LETTER, LEAD, SECOND = 1, 2, 3, 4, 5


def _kinds() -> bytes:
    """A table of that for bytes.translate; second bytes are not those of the signs × and ÷ and of İ, which ends in a mark when it is lower-cased."""
    second = set(range(0x80, 0xC0)) - {0x97, 0xB0, 0xB7}
    kinds = {SPACE: b" \n", MARK: MARKS.encode(), LETTER: string.ascii_letters.encode(), LEAD: range(0xC3, 0xC9), SECOND: second}
    of = {byte: kind for kind, some in kinds.items() for byte in some}
    return bytes(of.get(byte, 0) for byte in range(256))


KINDS = _kinds()
#: An added token that no cut breaks.
ADDED = re.compile(r"<\|[a-z]+\|>")


#: A space and a word of lower-case Latin letters, which the vocabulary's rules before its model leave as it is.
PLAIN = re.compile(" [" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower()) + "]+")


def lowered(text: str) -> str:
    """The text lower-cased where that may come before composition of characters and is what the vocabulary's rule does; else as it is."""
    if text.isascii():
        return text if "<|" in text else text.lower()
    low = text.lower()
    special = "<|" in text or "\u03a3" in text or "\u0130" in text
    return low if not special and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


#: The rules before the model under which a text may be cut at spaces and line feeds: composed characters, white space made one
#: space, lower case; pre-tokens are contractions, runs of letters, single digits and runs of other marks, never white space.
CUTTABLE_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTABLE_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@lru_cache(maxsize=2)
def cuttable(vocabulary: str) -> bool:
    """Whether the vocabulary file's own rules prove that a text's ids are those of its pieces between spaces and line feeds.

    They do if white space never gets into a pre-token, every pre-token goes to a plain BPE model by itself and added tokens
    hold nothing to cut at. Any other file is encoded whole.
    """
    with open(vocabulary, encoding="utf-8") as file:
        rules = json.load(file)
    model = rules.get("model") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    plain = plain and all(ADDED.fullmatch(x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in rules.get("added_tokens") or [])
    return plain and rules.get("normalizer") == CUTTABLE_NORMALIZER and rules.get("pre_tokenizer") == CUTTABLE_PRE_TOKENIZER


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    """The file's tokenizer, which a worker loads once for all of its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


class Encoder:
    """Ids of texts, by any vocabulary file of the tokenizers library.

    With a cuttable file, texts are cut before spaces, line feeds and ASCII punctuation behind a Latin letter, as arrays of bytes;
    each distinct piece is encoded once, and the pieces' ids, joined, are the text's. A word of Latin letters goes straight to
    the vocabulary's model, whose own rules before it would leave the word as it is. Texts are lower-cased first, as the
    vocabulary does itself, but for those where that isn't the same before its other rules: it composes characters first, so
    a capital that composes with no mark keeps the mark apart when it is lower-cased later. Texts that composition would
    change, in either case, therefore reach the vocabulary as they are. Any other file, or `whole`, encodes whole texts.
    Pieces and their ids are kept as arrays, a few bytes each; those met seldom leave memory and are encoded again if they return.
    """

    def __init__(self, vocabulary: str, whole: bool = False):
        self.tokenizer, self.whole, self.letters = _tokenizer(vocabulary), whole or not cuttable(vocabulary), _byte_letters()
        self.pieces, self.met = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.ends, self.ids = np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def _encoded(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each piece, by the file's own tokenizer, of some pieces at a time, as what it returns is large."""
        at = size = 0
        for upto, piece in enumerate(pieces, 1):
            size += len(piece)
            if size >= RUN_BYTES // 4 or upto == len(pieces):
                yield from (x.ids for x in self.tokenizer.encode_batch_fast(pieces[at:upto], add_special_tokens=False))
                at, size = upto, 0

    def _learn(self, pieces: list[str]) -> None:
        """Have the ids of more pieces behind the known ones."""
        rest = self._encoded([x for x in pieces if not PLAIN.fullmatch(x)])
        tokenize, letters, plain, name, ids, counts = self.tokenizer.model.tokenize, self.letters, PLAIN.fullmatch, attrgetter("id"), array("I"), array("i")
        for piece in pieces:
            if plain(piece):
                own = map(name, tokenize(piece[1:] if piece.isascii() else piece[1:].encode().decode("latin-1").translate(letters)))
            else:
                own = next(rest)
            at = len(ids)
            ids.extend(own)
            counts.append(len(ids) - at)
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int32)])

    def _forget(self) -> None:
        """Keep, of the pieces that aren't long, the half of CACHE that was met most often."""
        stay = np.flatnonzero(np.asarray(pc.binary_length(self.pieces)) <= PIECE_BYTES)
        if len(stay) > (most := CACHE // 2):
            stay = np.sort(stay[np.argpartition(self.met[stay], -most)[-most:]])
        kept = self._joined(stay)
        self.pieces, self.met = self.pieces.take(pa.array(stay)), self.met[stay] // 2
        self.ends, self.ids = np.asarray(kept.offsets), np.asarray(kept.values)

    def _joined(self, codes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(pa.array(codes))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's begin and the last one's end."""
        if self.whole:
            ids = [np.asarray(x, np.uint32) for x in self._encoded(texts)]
            return np.concatenate([self.ids, *ids]), np.cumsum([0, *map(len, ids)])
        low = [lowered(x).encode() for x in texts]
        begins = np.cumsum([0, *(len(x) + 1 for x in low)])[:-1]
        data = b" ".join([b"", *low]).replace(b"\n", b" ")
        kinds = np.frombuffer(data.translate(KINDS), np.uint8)
        cut, letter = kinds == SPACE, kinds == LETTER
        letter[1:] |= (kinds[1:] == SECOND) & (kinds[:-1] == LEAD)
        cut[1:] |= (kinds[1:] == MARK) & letter[:-1]
        at = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        both = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        codes, known = np.asarray(both.indices)[len(self.pieces) :], both.dictionary
        self._learn(known[len(self.pieces) :].to_pylist())
        met = np.bincount(codes, minlength=len(known))
        met[: len(self.met)] += self.met
        self.pieces, self.met = known, met
        joined = self._joined(codes)
        if len(known) > CACHE or known.nbytes + self.ids.nbytes > CACHE_BYTES:
            self._forget()
        return np.asarray(joined.values), np.append(np.asarray(joined.offsets)[np.searchsorted(at[:-1], begins)], len(joined.values))

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encoded(texts)
        return [ids[a:b].astype("<u4").tobytes() for a, b in pairwise(ends.tolist())]


@lru_cache(maxsize=2)
def encoder(vocabulary: str, whole: bool = False) -> Encoder:
    """The file's encoder, which a worker keeps, with the pieces it has met, for all of its tasks."""
    return Encoder(vocabulary, whole)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, whole: bool = False) -> None:
    """Encode each document's text, append the end id and write token files.

    docs: doc_id, text; other columns are ignored. A null or empty text has the end id alone, a very long one is encoded
    whole; repeated rows are documents of their own; rows of null doc_id come first; an empty table gives no rows. The texts
    are dealt out by ranges of doc_id and a hash of the text, so that parts are in order, rows of one doc_id (null, too) may
    go to many tasks, and the sample that finds the ranges brings no text to the driver.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start, part = encoder(vocabulary, whole), 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for at, upto in text_runs(texts, size=CUT_BYTES):
                values, ends = own.encoded(["" if x is None else x for x in texts[at:upto].to_pylist()])
                ends = ends.astype(np.int64)
                if end_id is not None:
                    values, ends = np.insert(values, ends[1:], end_id), ends + np.arange(len(ends))
                counts = np.diff(ends)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(upto - at, part, np.int32)), batch.column(0)[at:upto], pa.array(start + ends[:-1]), pa.array(counts), ids],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).parquet(path)


def read(spark: SparkSession, path: str, *columns: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The named columns (all, if none is named), of all documents or of those named."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.select(*columns) if columns else rows


def with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows with part and part_start get start, the ids of all documents before theirs; the parts' totals come from metadata alone."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = read(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("words"))
    starts = parts.select("part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    return rows.join(small(starts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, part_start, n_tokens, ids_crc32 of each document, counted and summed from the ids read back."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = np.asarray(ids.offsets)
            values = np.asarray(ids.values, dtype="<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(np.asarray(sums, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    rows = read(spark, path, "part", "doc_id", "part_start", "ids")
    return rows.mapInArrow(digest, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")
