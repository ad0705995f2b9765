"""Exact deduplication by Patricia-trie owners.

Two texts are equal when they are identical after every run of `[\\x20\\x09-\\x0D]` is replaced by one space.

1. Each input partition puts its normalised byte strings into a compressed radix trie. Of equal texts the partition
   keeps one row, the one with the smallest identifier, and the number of its copies, so a text that fills a third of
   the table reaches its owner once per input partition.
2. The kept rows go to the owner of (length, content hash), sorted by it. An owner inserts the full byte strings, led by
   length and hash, into its trie. Terminal nodes hold the smallest identifier and the local rows they stand for. Rows
   come in trie order, so once the path moves on, all subtrees to its left are complete: beyond a memory budget
   they are spilled, that is, their results are sent on and their nodes dropped. Spark's sort holds what is to come.

Defined results: a null text counts as empty; an empty table gives an empty result; null identifiers sort after all
others and a class without any identifier has keep_id null; of rows that repeat one identifier and text exactly
one is kept. Texts are compared whole, of whatever length. Columns besides identifier and text are passed along unread.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import frugal, id_and_text, kept_on_disk, slices

#: Bytes of labels and rows that a trie holds before it is emptied or spilled.
TRIE_BYTES = 96 << 20
WHITE = b" \t\n\x0b\x0c\r"
NO_ID = 1 << 63


def normalise(text: bytes | None) -> bytes:
    """Each run of white space becomes one space; bytes.split() splits at exactly those six characters."""
    if not text:
        return b""
    core = b" ".join(text.split())
    if not core:
        return b" "
    return (b" " if text[0] in WHITE else b"") + core + (b" " if text[-1] in WHITE else b"")


class Node:
    """One edge of the trie with the node below it."""

    __slots__ = ("label", "kids", "terminal")

    def __init__(self, label: bytes, terminal: object = None) -> None:
        self.label, self.kids, self.terminal = label, {}, terminal


def shared_length(key: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of key[at:] and label, which differ or of which one ends first."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal is whatever `insert` was given first for that string."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def insert(self, key: bytes, make: object) -> tuple[object, bool]:
        """The terminal of key, and whether it is new; `make()` builds one."""
        node, at = self.root, 0
        while at < len(key):
            child = node.kids.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.kids[key[at]] = child
                self.bytes += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                k = shared_length(key, at, child.label)
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.kids[child.label[0]] = child
                node.kids[key[at]] = upper
                self.bytes += 200
                node, at = upper, at + k
        if node.terminal is None:
            node.terminal = make()
            return node.terminal, True
        return node.terminal, False

    def spill(self, path: bytes | None = None) -> Iterator[object]:
        """Drop the subtrees left of the path (all, if None) and give their terminals in order."""
        if path is None:
            done, self.root, self.bytes = [self.root], Node(b""), 0
        else:
            done, node, at = [], self.root, 0
            while node is not None and at < len(path):
                for byte in sorted(b for b in node.kids if b < path[at]):
                    done.append(node.kids.pop(byte))
                node = node.kids.get(path[at])
                at += len(node.label) if node else 0
        stack = done[::-1]
        while stack:
            node = stack.pop()
            if node.terminal is not None:
                yield node.terminal
            if path is not None:
                self.bytes -= len(node.label) + 200
            stack += [node.kids[b] for b in sorted(node.kids, reverse=True)]


def _rank(doc_id: int | None) -> int:
    return NO_ID if doc_id is None else doc_id


LOCAL = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_sha256", T.StringType()),
    T.StructField("local", T.LongType()),
    T.StructField("chosen", T.BooleanType()),
    T.StructField("copies", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("hash", T.BinaryType()),
    T.StructField("packed", T.BinaryType()),
])


def _local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; the one chosen for each text of this partition carries the packed text."""
    part, turn = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("local", pa.int64()), ("chosen", pa.bool_()), ("copies", pa.int64()), ("length", pa.int64()), ("hash", pa.binary()), ("packed", pa.binary())])
    trie = PatriciaTrie()

    def rows(local: int) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in schema]
        size = 0
        for ids, sha, length, packed in trie.spill():
            best = min(range(len(ids)), key=lambda i: _rank(ids[i]))
            for i, doc_id in enumerate(ids):
                own = i == best
                row = (doc_id, sha, local, own, len(ids), length, bytes.fromhex(sha[:16]), packed if own else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            size += len(packed)
            if size > 8 << 20 or len(columns[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                columns, size = [[] for _ in schema], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            key = normalise(text.as_py())

            def make(key: bytes = key) -> tuple:
                packed = squeeze(key)
                trie.bytes += len(packed) + 400
                return ([], hashlib.sha256(key).hexdigest(), len(key), packed)

            trie.insert(key, make)[0][0].append(doc_id)
            trie.bytes += 40
            if trie.bytes > TRIE_BYTES:
                yield from rows((part << 24) + turn)
                turn += 1
    yield from rows((part << 24) + turn)


OWNED = "text_sha256 string, local long, keep_id long, group_size long, wins boolean"


def _owner_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each local row, from a partition sorted by length and hash."""
    unpack = zstandard.ZstdDecompressor().decompress
    trie = PatriciaTrie()

    def rows(path: bytes | None) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for members in trie.spill(path):
            best = min(members, key=lambda m: (_rank(m[0]), m[2]))
            total = sum(m[3] for m in members)
            for member in members:
                for column, value in zip(out, (member[1], member[2], best[0], total, member is best), strict=True):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.bool_())], names=["text_sha256", "local", "keep_id", "group_size", "wins"])

    for batch in batches:
        columns = [batch.column(n) for n in ("doc_id", "text_sha256", "local", "copies", "length", "hash", "packed")]
        for doc_id, sha, local, copies, length, code, packed in zip(*(c.to_pylist() for c in columns), strict=True):
            lead = struct.pack(">Q", length) + code
            key = lead + unpack(packed, max_output_size=max(1, length))
            if trie.bytes > TRIE_BYTES:
                yield from rows(lead)
            trie.insert(key, list)[0].append((doc_id, sha, local, copies))
            trie.bytes += 150
    yield from rows(None)


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = kept_on_disk(id_and_text(docs, id_col, text_col).mapInArrow(_local_tries, LOCAL))
    owned = (
        rows.where("chosen")
        .repartition("length", "hash")
        .sortWithinPartitions("length", "hash")
        .select("doc_id", "text_sha256", "local", "copies", "length", "hash", "packed")
        .mapInArrow(_owner_tries, OWNED)
    )
    return (
        rows.select("doc_id", "text_sha256", "local", "chosen")
        .join(owned, ["text_sha256", "local"])
        .select("doc_id", "keep_id", "group_size", (F.col("chosen") & F.col("wins")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they came: of equal texts the one with the smallest identifier.

    The whole rows travel once, those chosen by the partition's own trie only; the owner's trie lets the first of each
    class through, and rows come to it sorted by identifier.
    """
    fields = docs.schema.fields
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    n = len(fields)
    wide = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("rank", T.LongType()), T.StructField("none", T.BooleanType()), T.StructField("length", T.LongType()), T.StructField("hash", T.BinaryType())])

    @frugal
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, waiting = PatriciaTrie(), []

        def rows() -> Iterator[pa.RecordBatch]:
            chosen: dict[int, list] = {}
            for best in trie.spill():
                chosen.setdefault(best[1], []).append(best)
            for k, kept in sorted(chosen.items()):
                kept.sort(key=lambda b: b[2])
                taken = waiting[k].take(pa.array([b[2] for b in kept], pa.int64()))
                for part in slices(taken.append_column("at", pa.array(range(len(kept)), pa.int64())), f"c{at_text}", 8 << 20):
                    own = [kept[i] for i in part.column("at").to_pylist()]
                    extra = [pa.array([None if b[0] == NO_ID else b[0] for b in own], pa.int64()), pa.array([b[0] == NO_ID for b in own], pa.bool_()), pa.array([b[3] for b in own], pa.int64()), pa.array([b[4] for b in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *extra], names=wide.fieldNames())
            waiting.clear()

        for batch in batches:
            for part in slices(batch, f"c{at_text}"):
                k = len(waiting)
                waiting.append(part)
                trie.bytes += part.nbytes
                for i, (doc_id, text) in enumerate(zip(part.column(at_id).to_pylist(), part.column(at_text), strict=True)):
                    text = text.as_py()
                    key = normalise(text.encode() if isinstance(text, str) else text)

                    def make(key: bytes = key) -> list:
                        return [NO_ID + 1, 0, 0, len(key), hashlib.sha256(key).digest()[:8]]

                    best = trie.insert(key, make)[0]
                    if _rank(doc_id) < best[0]:
                        best[:3] = _rank(doc_id), k, i
                if trie.bytes > TRIE_BYTES:
                    yield from rows()
        yield from rows()

    @frugal
    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            first = []
            for length, code, text in zip(batch.column(n + 2).to_pylist(), batch.column(n + 3).to_pylist(), batch.column(at_text), strict=True):
                text, lead = text.as_py(), struct.pack(">Q", length) + code
                if trie.bytes > TRIE_BYTES:
                    for _ in trie.spill(lead):
                        pass
                first.append(trie.insert(lead + normalise(text.encode() if isinstance(text, str) else text), object)[1])
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=[f"c{i}" for i in range(n)]).filter(pa.array(first, pa.bool_()))

    rows = docs.toDF(*(f"c{i}" for i in range(n))).mapInArrow(local, wide)
    kept = rows.repartition("length", "hash").sortWithinPartitions("length", "hash", "none", "rank")
    return kept.mapInArrow(owner, T.StructType(wide.fields[:n])).toDF(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from folioscope.llm.common import table

    return duplicate_classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
