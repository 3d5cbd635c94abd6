"""Token ids of whole texts in word-aligned binary blocks (Simple-8b), written by Spark and decoded with numpy.

A block holds whole documents and is one row of a Parquet data set (``shard``, ``block``, ``first``, ``n_ids``, ``payload``), so tasks write and commit
through Spark and a lost executor repeats only its own. Shards are ranges of (doc_id, hash of the text); ``first`` counts ids of the shard
before the block.

Payload, little endian: ``S8B1``, uint32 documents, uint32 ids, uint32 words, uint32 escapes; int64 id of each document; uint8 1 where that id is null;
uint32 ids of each document; uint32 ids before each group of 256 words; the 64-bit words; the escaped values. A word is a selector in its low
4 bits and 60 bits of equally wide ids. Selector 15 holds one value of up to 60 bits; a value of 60 bits that are all ones stands for the
next escaped value.

A null text is empty: only the end id. Rows with a null doc_id come first. Repeated doc_ids keep a row each, ordered by the hash of their text.
An empty table writes no blocks. Columns other than the two named are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import table, work_dir
from .registry import query

# Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = (1 << 60) - 1
GROUP = 256
BLOCK_IDS = 1 << 16
CACHE_WORDS = 800_000
FILE = "shard int, block int, first bigint, n_ids bigint, payload binary"


WIDTHS = sorted(set(BITS))


def _rank(ids: np.ndarray) -> np.ndarray:
    """The place in WIDTHS of the narrowest width that holds an id."""
    if len(ids) and len(ids) > (top := int(ids.max())) + 1:  # look each up instead
        return _rank(np.arange(top + 1, dtype=np.uint64))[ids]
    return np.searchsorted(np.array([1 << b for b in WIDTHS[:-1]], np.uint64), ids, "right").astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped values of ``ids``; each word takes as many ids as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    escaped = ids[ids >= ESCAPE]
    ids = np.minimum(ids, np.uint64(ESCAPE))
    width = _rank(ids)
    choice = np.full(n, 15, np.uint8)
    widest, span = width, 1
    for s in range(14, -1, -1):  # ever more ids in a word
        while span < COUNTS[s] < n + 1:
            step = min(span, COUNTS[s] - span)
            widest, span = np.maximum(widest[:-step], widest[step:]), span + step
        fits = widest <= WIDTHS.index(BITS[s])
        if span < COUNTS[s] or not fits.any():  # then no longer run fits fewer bits
            break
        np.copyto(choice[: len(widest)], s, where=fits)
    jump, at, i = np.array(COUNTS)[choice].tolist(), [], 0
    while i < n:
        at.append(i)
        i += jump[i]
    at = np.array(at, np.int64)
    selector = choice[at] if n else choice
    words = selector.astype(np.uint64)
    for s in np.unique(selector):
        if BITS[s]:
            which = np.flatnonzero(selector == s)
            first, packed = at[which], words[which]
            for k in range(COUNTS[s]):
                packed |= ids[first + k] << np.uint64(4 + k * BITS[s])
            words[which] = packed
    return words, escaped


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    selector = (words & np.uint64(15)).astype(np.int64)
    ends = np.cumsum(np.array(COUNTS)[selector])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = ends - np.array(COUNTS)[selector]
    for s in np.unique(selector):
        if BITS[s]:
            which = np.flatnonzero(selector == s)
            first, packed = at[which], words[which] >> np.uint64(4)
            for k in range(COUNTS[s]):
                out[first + k] = packed >> np.uint64(k * BITS[s]) & np.uint64((1 << BITS[s]) - 1)
    out[out == ESCAPE] = escaped
    return out


def write_block(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    words, escaped = pack(ids)
    before = np.cumsum(np.concatenate([[0], np.array(COUNTS)[(words & np.uint64(15)).astype(np.int64)]]))[:-1][::GROUP] if len(words) else []
    return b"".join([
        b"S8B1", struct.pack("<4I", len(counts), len(ids), len(words), len(escaped)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(counts, "<u4").tobytes(), np.array(before, "<u4").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes(),
    ])


def read_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, and all ids."""
    if payload[:4] != b"S8B1":
        raise ValueError("not a block of this format")
    docs, n, words, escaped = struct.unpack_from("<4I", payload, 4)
    at, out = 20, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", -(-words // GROUP)), ("<u8", words), ("<u8", escaped)):
        out.append(np.frombuffer(payload, kind, count, at))
        at += out[-1].nbytes
    ids = unpack(out[4], out[5])
    if len(ids) != n or out[2].sum() != n:
        raise ValueError("a block's counts and ids differ")
    return [None if null else int(d) for d, null in zip(out[0], out[1], strict=True)], out[2].astype(np.int64), ids


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers.

    Byte-level pre-tokenisation always cuts before a space that stands between two characters which are not white space. The pieces between such
    cuts are independent, so each piece's ids are kept (a bounded number of pieces) and only new pieces go through the tokenizer. It also cuts at both ends of
    a run of letters beside ASCII signs, so a new piece is put together from its words and signs, and only new words go through the tokenizer's model. A
    piece that may have been cut elsewhere (white space at its ends) is never kept, and its text takes the slow way, as all texts do where the tokenizer
    is not a plain byte-level one (``whole``).
    """

    letter = "A-Za-zÀ-ÖØ-öø-ɏ"
    cut = re.compile(r"(?<=\S)(?= \S)")
    # An apostrophe may draw letters to it, two white spaces are cut by what follows them, and added tokens begin with "<".
    joined = re.compile(rf"[{letter}]+(?:(?:[!-&(-;=-@\[-`{{-~]+\n?|\n)[{letter}]+)*[!-&(-;=-@\[-`{{-~]*").fullmatch
    runs = re.compile(rf"[{letter}]+|[^{letter}]+").findall

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.whole = not byte_level(json.loads(self.tokenizer.to_str()))
        self.rest: dict[str, bytes] = {}  # by the piece without the space before it
        self.first: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        # Byte-level vocabularies name a byte by its Latin-1 character, or by the next character from 256 on where that is not a visible one.
        shown = {b: chr(b) for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b != 0xAD}
        self.names = shown | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.four = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, known: dict[str, bytes], lead: str) -> bytes:
        ids = known.get(word)
        if ids is None:
            name = word if word.isascii() else word.encode().decode("latin-1").translate(self.names)
            ids = known[word] = b"".join([self.four[x.id] for x in self.tokenizer.model.tokenize(lead + name)])
        return ids

    def _signs(self, signs: str) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            if len(self.signs) >= 1 << 12:
                self.signs.clear()
            ids = self.signs[signs] = self._ids(signs)
        return ids

    def _learn(self, known: dict[str, bytes], pieces: set[str], before: str) -> dict[str, bytes]:
        """The ids of new pieces; those likely to come again are kept, and the words in them."""
        if len(known) + len(pieces) > self.cache:
            known.clear()
        if len(self.first) > self.cache:
            self.first.clear()
        out, other, lead = {}, [], before.translate(self.names)
        for p in pieces:
            if p.isalpha() and p.isascii():
                out[p] = self._word(p, known, lead)
            elif self.joined(p):
                word, *runs = self.runs(p)
                ids = self._word(word, known, lead)
                for k, r in enumerate(runs):
                    ids += self._word(r, self.first, "") if k % 2 else self._signs(r)
                out[p] = ids
                if len(runs) < 2:
                    known[p] = ids
            elif p and not p[0].isspace() and not p[-1].isspace():
                other.append(p)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([before + p for p in part], add_special_tokens=False), strict=True):
                out[p] = known[p] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        holes = []
        for i, t in enumerate(texts):
            pieces = t.split(" ")
            ids = list(map(self.rest.get, pieces))
            ids[0] = self.first.get(pieces[0])
            if None in ids:
                holes.append((i, pieces, ids, [k for k, x in enumerate(ids) if x is None]))
            else:
                out[i] = b"".join(ids)
        first = self._learn(self.first, {p[0] for _, p, _, k in holes if k[0] == 0}, "")
        rest = self._learn(self.rest, {p[x] for _, p, _, k in holes for x in k if x}, " ")
        for i, pieces, ids, missing in holes:
            for k in missing:
                ids[k] = (rest if k else first).get(pieces[k])
            if None in ids:  # white space beside a space, or an empty text
                cut = self.cut.split(texts[i])
                ids = [self._ids(c) if k == 0 or (known := rest.get(c[1:], self.rest.get(c[1:]))) is None else known for k, c in enumerate(cut)]
            out[i] = b"".join(ids)
        return out


def byte_level(told: dict) -> bool:
    """True for a byte-pair vocabulary over bytes whose texts are cut only by the usual byte-level pattern."""
    cut, model = told.get("pre_tokenizer") or {}, told["model"]
    return (
        told.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and all(t["content"][:1] == "<" and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens", []))
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker. A task has one core, so the tokenizers library starts no threads of its own there unless it is told to."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _encode(batches, path: str, end_id: int, block_ids: int):
    shard, block, first = TaskContext.get().partitionId(), 0, 0
    enc, end = encoder(path), struct.pack("<I", end_id)
    doc_ids, counts, parts, size = [], [], [], 0

    def flush():
        nonlocal doc_ids, counts, parts, size, block, first
        row = {"shard": shard, "block": block, "first": first, "n_ids": size, "payload": write_block(doc_ids, counts, np.frombuffer(b"".join(parts), "<u4"))}
        block, first = block + 1, first + size
        doc_ids, counts, parts, size = [], [], [], 0
        return pa.RecordBatch.from_pylist([row], schema=_FILE)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for d, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                doc_ids.append(d)
                counts.append(len(ids) // 4 + 1)
                parts += [ids, end]
                size += counts[-1]
                if size >= block_ids:
                    yield flush()
    if doc_ids:
        yield flush()


_FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, in ascending order of the document's id, each closed by ``end_id``."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _encode(batches, tokenizer, end_id, block_ids), FILE).write.parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks with ``before``, the ids of all earlier shards. There are as many shards as tasks, so their running sum is a small table."""
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(sizes.select("shard", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("before")), "shard")


def _decoded(batches: Iterator[pa.RecordBatch], digest: bool):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(("before", "first", "payload"))}
            docs, counts, ids = read_block(row["payload"])
            ends = np.cumsum(counts)
            small = ids.astype("<u4")
            last = (pa.array([zlib.crc32(small[e - c : e]) for e, c in zip(ends, counts, strict=True)], pa.int64()) if digest
                    else pa.array([ids[e - c : e].astype(np.int64) for e, c in zip(ends, counts, strict=True)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(row["before"] + row["first"] + ends - counts), pa.array(counts), last],
                                             ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids of every document."""
    return _blocks(spark, path).select("before", "first", "payload").mapInArrow(
        lambda b: _decoded(b, False), "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, from the files."""
    return _blocks(spark, path).select("before", "first", "payload").mapInArrow(
        lambda b: _decoded(b, True), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame) -> DataFrame:
    """Write the texts' ids to a new folder in the shared folder and return the digests read back."""
    spark, path = docs.sparkSession, work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path())
    return token_digests(spark, path)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))


