"""Exact deduplication: Patricia tries own the texts.

Every task inserts its texts into a compressed radix trie first, so a text that a third of all documents share leaves a task once (with the number
of its rows and its best id) each time the trie is emptied. These classes are dealt by their length and content hash, and every partition inserts the full
byte strings into a trie of its own. Terminal nodes hold the row that stays. Equality is that of the bytes along the path; hashes only choose the partition.

A trie is held to ``limit`` bytes: when it is larger, its heaviest subtree is spilled. The subtree's strings go, as rows, to the next round, where they are
dealt anew over more partitions, and whatever else belongs below it follows them without being inserted. Every round writes its rows to the
shared folder, so a lost executor repeats tasks of one round only.

Null counts as an empty text. Of equal texts the row with the largest id stays (or the smallest, by ``keep``); a null id loses to all others, and of
repeated rows of one id and text exactly one stays. A group of null ids only has a null ``keep_id``. Other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .files import staged, table
from .registry import query

LIMIT = 96 << 20  # bytes that a trie may hold
COMBINED = 32 << 20  # bytes of the tries before the exchange
PARTITION = 16 << 20  # bytes of text in a partition
NODE = 250  # what a node takes beside its label
PIECE = 4 << 20  # bytes of the rows that are passed on together
LINK, CLASS, OWNER = 0, 1, 2
_ROWS = pa.schema([("kind", pa.int8()), ("member", pa.int64()), ("node", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("size", pa.int64()),
                   ("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("sha", pa.binary())])
ROWS = "kind tinyint, member bigint, node bigint, doc_id bigint, row bigint, size bigint, length bigint, hash bigint, text binary, sha binary"


class Entry:
    """What a terminal node holds: the class's number, its best row as (is null, sign * id, row), and how many rows it has."""

    __slots__ = ("node", "best", "size")

    def __init__(self, node: int, best: tuple, size: int):
        self.node, self.best, self.size = node, best, size


class Node:
    __slots__ = ("label", "next", "entry", "spilled")

    def __init__(self, label: bytes):
        self.label, self.next, self.entry, self.spilled = label, None, None, False


def shared(label: bytes, text: bytes, at: int) -> int:
    """How many leading bytes of ``label`` are those of ``text`` from ``at`` on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over byte strings; ``bytes`` is about what it holds."""

    def __init__(self):
        self.root, self.bytes, self.entries = Node(b""), 0, 0

    def find(self, text: bytes) -> Node | None:
        """The node where ``text`` ends, made if it is new; None if its subtree is spilled."""
        node, at = self.root, 0
        while at < len(text):
            if node.spilled:
                return None
            if node.next is None:
                node.next = {}
            child = node.next.get(text[at])
            if child is None:
                child = node.next[text[at]] = Node(text[at:])
                self.bytes += len(child.label) + NODE
                return child
            if not text.startswith(child.label, at):
                same = shared(child.label, text, at)
                middle = Node(child.label[:same])
                child.label = child.label[same:]
                middle.next = {child.label[0]: child}
                node.next[text[at]] = child = middle
                self.bytes += NODE
            node, at = child, at + len(child.label)
        return None if node.spilled else node

    def add(self, text: bytes, best: tuple, size: int, number: Callable[[], int]) -> Entry | None:
        """The entry of ``text`` with this row counted; None if its subtree is spilled."""
        node = self.find(text)
        if node is None:
            return None
        if node.entry is None:
            node.entry = Entry(number(), best, 0)
            self.entries += 1
        node.entry.best = min(node.entry.best, best)
        node.entry.size += size
        return node.entry

    def strings(self, node: Node | None = None, before: bytes = b""):
        """(text, entry) of every terminal node below ``node``."""
        todo = [(node or self.root, before)]
        while todo:
            n, path = todo.pop()
            path += n.label
            if n.entry is not None:
                yield path, n.entry
            todo.extend((c, path) for c in (n.next or {}).values())

    def weights(self) -> dict[int, tuple[int, int]]:
        """Bytes and entries of every subtree, by the id of its node."""
        order, todo = [], [self.root]
        while todo:
            order.append(node := todo.pop())
            todo.extend((node.next or {}).values())
        out = {}
        for n in reversed(order):
            below = [out[id(c)] for c in (n.next or {}).values()]
            out[id(n)] = len(n.label) + NODE + sum(w for w, _ in below), (n.entry is not None) + sum(k for _, k in below)
        return out

    def spill(self) -> list[tuple[bytes, Entry]]:
        """Take out the heaviest subtree that leaves an entry behind, mark its place and return its strings. Whatever begins with the mark's byte follows it."""
        weight, node, path = self.weights(), self.root, b""
        total, entries = weight[id(node)]
        while True:
            child = max((c for c in node.next.values() if not c.spilled), key=lambda c: weight[id(c)])
            size, held = weight[id(child)]
            deeper = any(not c.spilled for c in (child.next or {}).values())
            if not deeper or (2 * size <= total and held < entries):
                break
            node, path = child, path + child.label
        out = list(self.strings(child, path))
        child.label, child.next, child.entry, child.spilled = child.label[:1], None, None, True
        self.bytes -= size - NODE - 1
        self.entries -= len(out)
        return out


class Rows:
    """Rows of the exchange, gathered into batches."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def put(self, kind, member=None, node=None, best=None, size=None, length=None, digest=None, text=None, sha=None, sign=1):
        doc_id = None if best is None or best[0] else sign * best[1]
        self.rows.append((kind, member, node, doc_id, None if best is None else best[2], size, length, digest, text, sha))
        self.bytes += 100 + (len(text) if text is not None else 0)

    def full(self, least: int = PIECE):
        if self.bytes > least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)
            self.rows, self.bytes = [], 0


def _number(turn: int):
    """Numbers that no other task of any round gives."""
    last = (turn << 56) | (TaskContext.get().partitionId() << 32)

    def following() -> int:
        nonlocal last
        last += 1
        return last

    return following


def content_hash(text: bytes) -> int:
    return xxh64_intdigest(text) - (1 << 63)


def _combine(batches, sign: int, limit: int):
    """Rows of documents (doc_id, text): a link of every row to its class, and the classes of this task."""
    number, trie, out = _number(0), Trie(), Rows()

    def classes():
        for text, e in trie.strings():
            out.put(CLASS, node=e.node, best=e.best, size=e.size, length=len(text), digest=content_hash(text), text=text, sign=sign)
            yield from out.full()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = number()
            best = (doc_id is None, 0 if doc_id is None else sign * doc_id, row)
            e = trie.add(text or b"", best, 1, number)
            out.put(LINK, member=row, node=e.node, best=best, sign=sign)
            if trie.bytes > limit:
                yield from classes()
                trie = Trie()
            yield from out.full()
    yield from classes()
    yield from out.full(0)


def _own(batches, sign: int, limit: int, turn: int):
    """Rows of classes: links to the nodes of this partition's trie and their owners; what is spilled stays a class."""
    number, trie, out = _number(turn), Trie(), Rows()
    for batch in batches:
        for node, doc_id, row, size, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            best = (doc_id is None, 0 if doc_id is None else sign * doc_id, row)
            e = trie.add(text, best, size, number)
            if e is None:
                out.put(CLASS, node=node, best=best, size=size, length=len(text), digest=digest, text=text, sign=sign)
            else:
                out.put(LINK, member=node, node=e.node)
            while trie.bytes > limit and trie.entries > 1:
                for t, e in trie.spill():
                    out.put(CLASS, node=e.node, best=e.best, size=e.size, length=len(t), digest=content_hash(t), text=t, sign=sign)
                    yield from out.full()
            yield from out.full()
    for text, e in trie.strings():
        out.put(OWNER, node=e.node, best=e.best, size=e.size, sha=hashlib.sha256(text).digest(), sign=sign)
        yield from out.full()
    yield from out.full(0)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                normal: Callable[[Column], Column] = lambda text: text, limit: int = LIMIT, combined: int = COMBINED) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 of ``normal(text)``."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    sign = -1 if keep == "largest" else 1
    text = F.coalesce(normal(F.col(text_col).cast("string")), F.lit("")).cast("binary")
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = staged(given.mapInArrow(lambda b: _combine(b, sign, combined), ROWS), "dedup-classes")
    documents = rows.where(F.col("kind") == LINK).select("doc_id", "row", F.col("node").alias("class"))
    group = rows.where(F.col("kind") == CLASS).select(F.col("node").alias("class"), F.col("node").alias("now"))
    owners, turn = [], 0
    while True:
        left = rows.where(F.col("kind") == CLASS)
        size = left.agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).first()
        if turn and not size["n"]:
            break
        turn += 1
        partitions = max(8, -(-(size["bytes"] or 0) * turn // PARTITION))
        place = F.pmod(F.xxhash64("length", "hash", F.lit(turn)), F.lit(partitions))
        dealt = left.repartition(partitions, place).select("node", "doc_id", "row", "size", "hash", "text")
        rows = staged(dealt.mapInArrow(lambda b, turn=turn: _own(b, sign, limit, turn), ROWS), "dedup-owners")
        links = rows.where(F.col("kind") == LINK).select("member", "node")
        group = group.join(links, F.col("now") == F.col("member"), "left").select("class", F.coalesce("node", "now").alias("now"))
        owners.append(rows.where(F.col("kind") == OWNER).select("node", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "size", "sha"))
    every = owners[0]
    for more in owners[1:]:
        every = every.unionAll(more)
    group = group.join(every, F.col("now") == F.col("node")).select("class", "keep_id", "keep_row", "size", "sha")
    return documents.join(group, "class").select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op11_exact_dedup", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
