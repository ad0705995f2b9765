"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints link at LINK or fewer
differing bits; a component is what links connect.

Equal fingerprints are one from the start. The 64 bits are cut into m blocks; of two linked fingerprints at
least m - LINK blocks agree, so every fingerprint goes to one bucket for each choice of m - LINK blocks (m grows with the number of
fingerprints, all choices are exact). Inside a bucket fingerprints are sorted by Gray rank and every FAN neighbours form a node,
every FAN nodes one above, and so on. A node holds the bits all below it share (mask and pattern). A search starts at the
top, adds at each node the differences in the bits that the node shares beyond its parent, and drops the whole group once
they exceed LINK. A bucket is explored component by component, only fingerprints not reached yet are searched for, and
only one edge per reached fingerprint leaves the bucket, so near copies don't multiply into pairs. Components are joined
across buckets by contraction: labels hook to the smallest neighbour and pointers are halved, cut by checkpoints.

Defined results: null counts as empty; texts without words have fingerprint zero, which links like any other; texts with
fewer words than a shingle are one shingle; rows that repeat share a component; a component whose identifiers are
all null has a null component_id; an empty table gives an empty result. Texts are read whole. Other columns don't matter.

`near_representatives` keeps one document of each group whose distinct shingles of SIMILAR_WORDS words have a Jaccard similarity of
SIMILAR or more. 64 bits can't tell that: such texts differ in about ten of them. Its fingerprints have PARTS x 64 bits, one majority for each;
candidates share one of several random choices of bits (as many as a pair at SIMILAR needs to share one with probability CAUGHT), and
inside such a bucket the same Gray-order index finds the fingerprints within WORD_LINK bits of one 64-bit part, of which
those within the distance of `loose_distance` over SENT parts are links. A reached fingerprint is closed, so groups of near copies give one
edge each. Every edge's texts are then compared exactly; what falls short of SIMILAR is dropped. Before, parities of the shingles by
cell, which can't differ in more cells than the texts have shingles apart, drop what can't be at SIMILAR.

Fingerprints lose links now and then, and a candidate that is dropped may have closed a text to others. What they leave is completed
exactly: with all shingles in one order, the seldom ones first, two texts at SIMILAR share one of the first n - SIMILAR n + 1 of their
n shingles. Texts of different groups that share one, and whose sizes and places in the order allow it, are compared as well.
The order comes from a table of counts; it matters for speed alone. Most of these shingles occur in one text: 32 bits of each
are dealt out to find those that come twice, and only what may be one of them (a table of `Marks`) is dealt out with its text's size and group.

Texts are not dealt out but where they are needed: those of edges, as sets of hashes, and the rows that are dropped or repeat, found by `Marks` too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.llm.common import PIECE_BITS, SLICE_BYTES, Marks, binary_column, cut, frugal, hot_join, id_and_text, kept_on_disk, marked_keys, partitions, scaled, slices, small_batches, table

WORDS = 4
LINK = 4
SEED = 42
FAN = 16
#: Rows of buckets in one task, about: 16 bytes each.
TASK_ROWS = 400_000
#: Frontier entries that a search holds at once.
FRONTIER = 1 << 20
#: Near copies: words of a shingle, least similarity, 64-bit parts of a fingerprint, differences of one part that the index looks for, share of pairs at the least similarity that some bucket holds.
SIMILAR_WORDS, SIMILAR, PARTS, WORD_LINK, CAUGHT = 5, 0.8, 8, 18, 0.99
#: Parts of a fingerprint that go to each of its buckets, and cells of a text's parities at most.
SENT, PARITIES = 4, 1 << 14
#: Standard deviations above the distance expected at SIMILAR within which texts are compared.
SPREAD = 2.5
#: Cells of the table that counts shingles (a power of two), pieces that it is summed in, pairs that a search holds at once.
CELLS, PIECES, PAIRS = 1 << 20, 64, 1 << 21
#: Edges per file of the checkpoints between rounds, and files at least (where there are as many partitions).
CUT_ROWS, CUT_PARTS = 250_000, 8


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint, as an unsigned integer."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(words, len(tokens))
    first, last = starts[: len(tokens) - w + 1].tolist(), ends[w - 1 :].tolist()
    n, counts = len(first), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        parts = [joined[a:b] for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.dtype("<u8"), len(parts))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (a signed long with the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order: the prefix xor of its bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def bit_blocks(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m near-equal blocks of the 64 bits."""
    bounds = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def blocks_for(n: int, link: int = LINK) -> int:
    """Enough blocks that a bucket of n spread fingerprints holds tens of them."""
    m = link + 1
    while m < link + 5 and sum(sorted(w for _, w in bit_blocks(m))[: m - link]) < np.log2(max(2, n)) - 6:
        m += 1
    return m


class GrayIndex:
    """The hierarchical index over all buckets of a task; bucket i's top node is node i of the last level."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray) -> None:
        order = np.lexsort((gray_rank(value), bucket))
        self.order, self.value, self.bucket = order, value[order], bucket[order]
        _, first, inverse = np.unique(self.bucket, return_index=True, return_inverse=True)
        self.first = first
        self.last = np.append(first[1:], len(order))
        self.bucket = inverse
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, pattern, of = np.full(len(order), full), self.value, inverse
        self.levels: list[tuple] = []  # from the leaves up: (mask, pattern, first child, end of children)
        while True:
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
            cuts = np.flatnonzero(place % FAN == 0)
            every = np.bitwise_and.reduceat(mask, cuts)
            # shared bits: shared in each child, and equal over the children
            agree = ~(np.bitwise_or.reduceat(pattern, cuts) ^ np.bitwise_and.reduceat(pattern, cuts))
            mask, pattern, of = every & agree, pattern[cuts], of[cuts]
            pattern = pattern & mask
            self.levels.append((mask, pattern, cuts, np.append(cuts[1:], len(place))))
            if len(of) == len(first):
                return

    def alive(self, open_: np.ndarray) -> list[np.ndarray]:
        counts = [open_]
        for _, _, cuts, _ in self.levels:
            counts.append(np.logical_or.reduceat(counts[-1], cuts))
        return counts

    def search(self, queries: np.ndarray, alive: list[np.ndarray], link: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, open leaf) within `link` bits, for queries given as leaf numbers."""
        work = [queries]
        while work:
            block = work.pop()
            q, node = block, self.bucket[block]
            mask, pattern, _, _ = self.levels[-1]
            spent = np.bitwise_count((self.value[q] ^ pattern[node]) & mask[node]).astype(np.int64)
            keep = (spent <= link) & alive[-1][node]
            q, node, spent = q[keep], node[keep], spent[keep]
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, _, start, end = self.levels[depth]
                many = end[node] - start[node]
                if many.sum() > FRONTIER and len(block) > 1:
                    break
                child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[node], many)
                q, spent, shared = np.repeat(q, many), np.repeat(spent, many), np.repeat(mask[node], many)
                if depth:
                    below, pattern = self.levels[depth - 1][:2]
                    more = np.bitwise_count((self.value[q] ^ pattern[child]) & below[child] & ~shared)
                else:
                    more = np.bitwise_count((self.value[q] ^ self.value[child]) & ~shared)
                spent = spent + more
                keep = (spent <= link) & alive[depth][child]
                q, node, spent = q[keep], child[keep], spent[keep]
            else:
                yield q, node
                continue
            work += [block[len(block) // 2 :], block[: len(block) // 2]]


def bucket_edges(bucket: np.ndarray, value: np.ndarray, link: int = LINK, whole: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as pairs of row numbers, that connect inside each bucket exactly what links of at most `link` bits connect.

    With `whole`, the rows' fingerprints of several parts, links are also at most `most` bits of all parts apart.
    """
    _, inverse, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(sizes[inverse] > 1)
    if not len(shared):
        return shared, shared
    index = GrayIndex(bucket[shared], value[shared])
    row = shared[index.order]
    open_ = np.ones(len(value), bool)
    seed = index.first.copy()
    frontier = np.empty(0, np.int64)
    left, right = [], []
    while True:
        # buckets without a frontier start from their next open fingerprint
        busy = np.zeros(len(seed), bool)
        busy[index.bucket[frontier]] = True
        while True:
            stuck = ~busy & (seed < index.last)
            stuck[stuck] = ~open_[seed[stuck]]
            if not stuck.any():
                break
            seed[stuck] += 1
        fresh = seed[~busy & (seed < index.last)]
        open_[fresh] = False
        block = np.concatenate((frontier, fresh))
        if not len(block):
            break
        alive = index.alive(open_)
        reached = []
        for q, found in index.search(block, alive, link):
            if whole is not None:
                near = np.bitwise_count(whole[row[q]] ^ whole[row[found]]).sum(axis=1, dtype=np.int64) <= most
                q, found = q[near], found[near]
            found, once = np.unique(found, return_index=True)
            new = open_[found]  # an earlier part of the block may have reached it
            q, found = q[once][new], found[new]
            open_[found] = False
            left.append(row[q])
            right.append(row[found])
            reached.append(found)
        frontier = np.concatenate(reached) if reached else np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (shared[:0], shared[:0])


def link_edges(distinct: DataFrame, link: int = LINK) -> DataFrame:
    """(a, b) edges that connect what links connect, from distinct fingerprints."""
    spark = distinct.sparkSession
    n = distinct.count()
    m = blocks_for(n, link)
    keys = []
    for k, chosen in enumerate(combinations(bit_blocks(m), m - link)):
        mask = sum(((1 << width) - 1) << shift for shift, width in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("bits")))
    rows = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key")).select(F.xxhash64("key.choice", "key.bits").alias("bucket"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("bucket").to_numpy(), b.column("fingerprint").to_numpy()) for b in batches]
        if parts:
            # two buckets that share a hash are searched as one, which is as exact
            value = np.concatenate([p[1] for p in parts])
            a, b = bucket_edges(np.concatenate([p[0] for p in parts]), value.view(np.uint64), link)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(value[a]), pa.array(value[b])], names=["a", "b"])

    return rows.repartition(scaled(n * len(keys), TASK_ROWS, partitions(spark)), "bucket").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge, label being the smallest node of its component."""
    edges = cut(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct())
    labels = None
    while n := edges.count():
        few = scaled(n, CUT_ROWS, CUT_PARTS)  # files of a checkpoint, by the rows it may hold
        hooks = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("up"))
        roots = edges.select(F.col("low").alias("node")).distinct().join(hooks, "node", "left_anti")
        hooks = cut(hooks.union(roots.select("node", F.col("node").alias("up"))).coalesce(few))
        while True:  # pointer halving until all point at roots
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            raised = cut(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")).coalesce(few))
            hooks = raised.select("node", "up")
            if raised.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("was"), F.col("up").alias("now"))
        if labels is None:
            labels, most = hooks.select("node", F.col("up").alias("label")), few
        else:
            labels = cut(labels.join(to, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")).coalesce(most))
        low, high = to.toDF("low", "new_low"), to.toDF("high", "new_high")
        moved = edges.join(low, "low").join(high, "high").select(F.least("new_low", "new_high").alias("low"), F.greatest("new_low", "new_high").alias("high"))
        edges = cut(moved.where("low < high").distinct().coalesce(few))
    return labels if labels is not None else edges.select(F.col("low").alias("node"), F.col("high").alias("label"))


def near_duplicates(docs: DataFrame, words: int = WORDS, link: int = LINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest identifier that links reach."""
    marks = kept_on_disk(fingerprints(docs, words, id_col, text_col))
    firsts = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("many"))
    labels = connected(link_edges(firsts.select("fingerprint"), link))
    placed = kept_on_disk(firsts.join(labels, firsts["fingerprint"] == labels["node"], "left").select("fingerprint", "first_id", "many", F.coalesce("label", "fingerprint").alias("label")))
    smallest = placed.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("many"))
    component = hot_join(placed.select("fingerprint", "label", F.col("many").alias("rows")), smallest, "label", "component_id", "fingerprint")
    component = component.select("fingerprint", "component_id", F.col("rows").alias("many"))
    return hot_join(marks, component, "fingerprint", "component_id", "doc_id").select("doc_id", "fingerprint", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Hashes of a text's distinct word shingles; of a shorter text, the hash of all its words; none without words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(SEED)), np.uint64, len(tokens))
    n, total = max(1, len(h) - words + 1), np.zeros(max(1, len(h) - words + 1), np.uint64)
    for i in range(min(words, len(h))):
        total = (total ^ (h[i : i + n] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(total)


def wide_fingerprint(hashes: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """`parts` 64-bit majorities, each over its own mixing of the hashes; zero without any."""
    counts, step = np.zeros(64 * parts, np.int64), np.uint64(0xD1B54A32D192ED03)
    of = np.arange(1, parts + 1, dtype=np.uint64) * step
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096, None] + of
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def bit_share(similar: float) -> float:
    """Share of the bits in which fingerprints of sets with this Jaccard similarity differ, as expected: the angle between them."""
    return float(np.arccos(2 * similar / (1 + similar)) / np.pi)


def loose_distance(similar: float = SIMILAR, parts: int = PARTS) -> int:
    """Differences that a pair at `similar` hardly exceeds."""
    p, n = bit_share(similar), 64 * parts
    return int(n * p + SPREAD * np.sqrt(n * p * (1 - p)))


def bit_choices(n: int, similar: float = SIMILAR, parts: int = PARTS) -> np.ndarray:
    """Places of the bits of each bucket key: about log2(n / 32) bits, and choices enough that a pair at `similar` shares one with probability CAUGHT."""
    width = int(np.clip(np.log2(max(2, n)) - 5, 8, 28))
    many = int(np.ceil(np.log(1 - CAUGHT) / np.log1p(-((1 - bit_share(similar)) ** width))))
    rng = np.random.default_rng(SEED)
    return np.stack([np.sort(rng.choice(64 * parts, width, replace=False)) for _ in range(many)])


def similar_edges(marks: DataFrame, n: int, similar: float = SIMILAR) -> DataFrame:
    """(a, b): candidates among distinct nodes with their wide fingerprints (node, wide)."""
    choices, most, spark = bit_choices(n, similar), loose_distance(similar, SENT), marks.sparkSession
    powers = np.int64(1) << np.arange(choices.shape[1], dtype=np.int64)

    @frugal
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                wide = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits, whole = np.unpackbits(wide, axis=1, bitorder="little").astype(np.int64), wide.view("<u8")
                for k, places in enumerate(choices):
                    # a choice's keys are apart from the others' by their high bits; the parts that it gets change with it
                    bucket = (bits[:, places] @ powers) + (np.int64(k) << np.int64(32))
                    sent = binary_column(np.full(len(whole), 8 * SENT), whole[:, (k + np.arange(SENT)) % PARTS])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column("node"), sent], names=["bucket", "node", "sent"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("bucket").to_numpy(), b.column("node").to_numpy(), b"".join(b.column("sent").to_pylist())) for b in batches]
        if parts:
            bucket, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            whole = np.frombuffer(b"".join(p[2] for p in parts), "<u8").reshape(len(node), SENT)
            a, b = bucket_edges(bucket, whole[:, 0].copy(), WORD_LINK, whole, most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    rows = marks.mapInArrow(keys, "bucket long, node long, sent binary")
    return rows.repartition(scaled(n * len(choices), TASK_ROWS, partitions(spark)), "bucket").mapInArrow(run, "a long, b long").distinct()


def shingle_levels(keyed: DataFrame, words: int) -> np.ndarray:
    """How frequent the shingles of each cell are, on a logarithmic scale, from the texts."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint64)
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_hashes(t.as_py(), words) for t in part.column("text")]
                cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint64)
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES)), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(cells, PIECES)], pa.binary())], names=["piece", "counts"])

    @frugal
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
                one = pa.decompress(counts.as_py(), 8 * CELLS // PIECES, "zstd", asbytes=True)
                sums[piece] = np.frombuffer(one, np.uint64) + sums.get(piece, np.uint64(0))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "counts"])

    schema, total = "piece long, counts binary", np.zeros((PIECES, CELLS // PIECES), np.uint64)
    for piece, counts in keyed.select("text").mapInArrow(count, schema).repartition(partitions(keyed.sparkSession), "piece").mapInArrow(add, schema).collect():
        total[piece] = np.frombuffer(bytes(counts), np.uint64)
    return np.minimum(255, 6 * np.log2(1.0 + total.ravel())).astype(np.uint8)


def seldom_first(hashes: np.ndarray, levels: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The shingles of a text of which any other at `similar` has one among its own, seldom ones first."""
    many = len(hashes) - int(np.ceil(similar * len(hashes) * (1 - 1e-12))) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, levels[(hashes & np.uint64(len(levels) - 1)).astype(np.int64)]))[:many]]


def repeated_tokens(marks: DataFrame, tokens: int) -> Marks:
    """The shingles among the seldom ones of all texts that two of them have."""
    found = Marks(tokens // 16)
    high = found.bits - PIECE_BITS

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "seldom"):
                x = np.sort(np.frombuffer(b"".join(part.column("seldom").to_pylist()), np.uint64))
                cuts = np.searchsorted(x >> np.uint64(64 - high), np.arange(1 << high, dtype=np.uint64)) if high else np.zeros(1, np.int64)
                many = np.diff(np.append(cuts, len(x)))
                some = np.flatnonzero(many)
                low = (x >> np.uint64(32 - high)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), binary_column(4 * many[some], low)], names=["piece", "low"])

    @frugal
    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for piece, low in zip(batch.column("piece").to_pylist(), batch.column("low"), strict=True):
                pieces.setdefault(piece, []).append(np.frombuffer(low.as_py(), np.uint32))
        for piece, parts in pieces.items():
            low, bits = np.sort(np.concatenate(parts)), np.zeros(1 << PIECE_BITS, bool)
            bits[low[1:][low[1:] == low[:-1]] >> np.uint32(32 - PIECE_BITS)] = True
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])

    rows = marks.select("seldom").mapInArrow(deal, "piece int, low binary")
    return found.gather(rows.repartition(scaled(tokens, TASK_ROWS, partitions(marks.sparkSession)), "piece").mapInArrow(twice, "piece int, bits binary"))


def shared_tokens(marks: DataFrame, repeated: Marks) -> DataFrame:
    """(node, size, seldom, at): of the seldom shingles those that may be in two texts, with their places in the order; a row for each node that has any, with its parities (odd) if the marks have them."""
    own = {c: t for c, t in (("size", "int"), ("odd", "binary")) if c in marks.columns}

    @frugal
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "seldom"):
                many = pa.compute.binary_length(part.column("seldom")).to_numpy() // 8
                x = np.frombuffer(b"".join(part.column("seldom").to_pylist()), np.uint64)
                at, keep = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many), repeated.has(x)
                left = np.bincount(np.repeat(np.arange(len(many)), many)[keep], minlength=len(many))
                some = np.flatnonzero(left)
                columns = [part.column(c).take(pa.array(some)) for c in ("node", *own)]
                yield pa.RecordBatch.from_arrays([*columns, binary_column(8 * left[some], x[keep]), binary_column(4 * left[some], at[keep].astype(np.int32))], names=["node", *own, "seldom", "at"])

    rows = marks.select("node", *own, "seldom").mapInArrow(pick, ", ".join(("node long", *(f"{c} {t}" for c, t in own.items()), "seldom binary, at binary")))
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in (*own, "seldom", "at")))


def cross_pairs(token: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, similar: float = SIMILAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, as their numbers, of one token and different labels whose sizes and places of the token allow `similar`."""
    order = np.lexsort((label, token))
    token, label, size, at = token[order], label[order], size[order], at[order]
    fresh = np.concatenate(([True], token[1:] != token[:-1]))
    run = fresh | np.concatenate(([True], label[1:] != label[:-1]))
    starts, runs = np.flatnonzero(fresh), np.flatnonzero(run)
    end = np.append(starts[1:], len(token))[np.cumsum(fresh) - 1]
    first = np.append(runs[1:], len(token))[np.cumsum(run) - 1]
    own = np.flatnonzero(end > first)
    upto = np.cumsum(end[own] - first[own])
    while len(own):
        n = max(1, int(np.searchsorted(upto, PAIRS, side="right")))
        rows, many = own[:n], end[own[:n]] - first[own[:n]]
        a = np.repeat(rows, many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[rows], many)
        # the token is the first in common if it counts; what lies before it is not shared
        most = np.minimum(size[a] - at[a], size[b] - at[b])
        keep = most * (1 + similar) >= similar * (size[a] + size[b]) * (1 - 1e-12)
        yield order[a[keep]], order[b[keep]]
        own, upto = own[n:], upto[n:] - upto[n - 1]


def possible_pairs(a: np.ndarray, b: np.ndarray, size: np.ndarray, width: np.ndarray, words: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """Which pairs of rows can be at `similar`, by their parities: `width` of the `words` for each row."""
    offset = np.cumsum(width) - width
    a, b = np.where(width[a] < width[b], b, a), np.where(width[a] < width[b], a, b)
    apart, kind = np.zeros(len(a), np.int64), width[a] << np.int64(20) | width[b]
    for k in np.unique(kind).tolist():
        wide, small, rows = k >> 20, k & ((1 << 20) - 1), np.flatnonzero(kind == k)
        step = max(1, SLICE_BYTES // (8 * wide))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            x = np.bitwise_xor.reduce(words[offset[a[r], None] + np.arange(wide)].reshape(len(r), -1, small), axis=1)
            apart[r] = np.bitwise_count(x ^ words[offset[b[r], None] + np.arange(small)]).sum(axis=1, dtype=np.int64)
    return can_be(apart, size[a] + size[b], similar)


def missed_edges(placed: DataFrame, tokens: int, similar: float = SIMILAR) -> DataFrame:
    """(a, b): every pair of nodes (node, label, size, odd, seldom, at) of different labels that can be at `similar`, also by their parities.

    A node goes to each part of the tokens with its own there, and with its parities: what these rule out, most of the pairs in a large
    group of texts that are alike but not at `similar`, is dropped where the pairs are found.
    """
    parts = scaled(tokens, TASK_ROWS, partitions(placed.sparkSession))

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "seldom"):
                many = pa.compute.binary_length(part.column("seldom")).to_numpy() // 8
                token, at = (np.frombuffer(b"".join(part.column(c).to_pylist()), d) for c, d in (("seldom", np.uint64), ("at", np.int32)))
                # a token's high bits are its place among the marks, its low ones its cell in the table of counts
                to, row = (token >> np.uint64(8)) % np.uint64(parts), np.repeat(np.arange(part.num_rows), many)
                order = np.lexsort((to, row))
                token, at, to, row = token[order], at[order], to[order].astype(np.int64), row[order]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])))) if len(row) else np.zeros(0, np.int64)
                own = np.diff(np.append(first, len(row)))
                for i in range(0, len(first), 4096):
                    x, n = first[i : i + 4096], own[i : i + 4096]
                    ends = slice(x[0], x[-1] + n[-1])
                    columns = [part.column(c).take(pa.array(row[x])) for c in ("node", "label", "size", "odd")]
                    yield pa.RecordBatch.from_arrays([pa.array(to[x].astype(np.int32)), *columns, binary_column(8 * n, token[ends]), binary_column(4 * n, at[ends])], names=["part", "node", "label", "size", "odd", "seldom", "at"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(batches):
            node, label, size, odd, seldom, place = (pa.concat_arrays([b.column(c) for b in rows]) for c in ("node", "label", "size", "odd", "seldom", "at"))
            node, label, size = node.to_numpy(), label.to_numpy(), size.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(node)), pa.compute.binary_length(seldom).to_numpy() // 8)
            token, at = np.frombuffer(b"".join(seldom.to_pylist()), np.uint64), np.frombuffer(b"".join(place.to_pylist()), np.int32).astype(np.int64)
            width, words = pa.compute.binary_length(odd).to_numpy().astype(np.int64) // 8, np.frombuffer(b"".join(odd.to_pylist()), np.uint64)
            for a, b in cross_pairs(token, label[row], size[row], at, similar):
                a, b = row[a], row[b]
                a, b = np.divmod(np.unique(np.minimum(a, b) * len(node) + np.maximum(a, b)), len(node))
                keep = possible_pairs(a, b, size, width, words, similar)
                a, b = node[a[keep]], node[b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rows = placed.select("node", "label", "size", "odd", "seldom", "at").mapInArrow(deal, "part int, node long, label long, size int, odd binary, seldom binary, at binary")
    return rows.repartitionById(parts, "part").mapInArrow(run, "a long, b long").distinct()


def parities(hashes: np.ndarray) -> bytes:
    """For each cell, a bit: whether the number of hashes in it is odd. About a cell for each hash."""
    cells = min(PARITIES, max(64, 1 << max(0, len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def can_be(apart: np.ndarray, total: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets of `total` hashes together that differ in `apart` at least can be at `similar`."""
    return apart * (1 + similar) <= total * (1 - similar) * (1 + 1e-9)


def least_apart(x: bytes, y: bytes) -> int:
    """Sets of hashes with these parities differ in as many hashes at least."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def verified(edges: DataFrame, firsts: DataFrame, keyed: DataFrame, words: int = SIMILAR_WORDS, similar: float = SIMILAR) -> DataFrame:
    """The edges whose nodes' texts are as similar, by their distinct shingles, from the nodes (node, one.key, size, odd) and all texts (key, text)."""
    ends = firsts.select("node", "one.key", "size", "odd")
    pairs = edges.join(ends.toDF("a", "key_a", "size_a", "odd_a"), "a").join(ends.toDF("b", "key_b", "size_b", "odd_b"), "b")

    @frugal
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            odd = zip(batch.column("odd_a"), batch.column("odd_b"), strict=True)
            apart = np.fromiter((least_apart(x.as_py(), y.as_py()) for x, y in odd), np.int64, batch.num_rows)
            yield batch.filter(pa.array(can_be(apart, total, similar))).select(["a", "b", "key_a", "key_b"])

    pairs = cut(pairs.select("a", "b", "key_a", "key_b", "size_a", "size_b", "odd_a", "odd_b").mapInArrow(possible, "a long, b long, key_a string, key_b string"))
    asked = marked_keys(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct(), "key")

    @frugal
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(asked.has(batch.column("hash").to_numpy())))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([shingle_hashes(t.as_py(), words).tobytes() for t in part.column("text")], pa.binary())], names=["key", "set"])

    # told apart where they are hashed: a filter before would be a second Python worker to each task; rows that repeat identifier and text have one set
    sets = keyed.select(F.xxhash64("key").alias("hash"), "key", "text").mapInArrow(hashes, "key string, set binary").groupBy("key").agg(F.first("set").alias("set"))
    pairs = pairs.join(sets.toDF("key_a", "x"), "key_a").join(sets.toDF("key_b", "y"), "key_b")

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_representatives(docs: DataFrame, words: int = SIMILAR_WORDS, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they came: of each group of near copies the row with the smallest identifier.

    Texts with the same shingles are one from the start. Rows are told apart by identifier and text; of rows that repeat both, one stays.
    """
    small_batches(docs.sparkSession)
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).cast("binary"))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), mark.alias("key"))
    levels = shingle_levels(keyed, words)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column("text")]
            node = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            size = pa.array(list(map(len, sets)), pa.int32())
            wide, odd, seldom = (pa.array(x, pa.binary()) for x in ([wide_fingerprint(x).tobytes() for x in sets], list(map(parities, sets)), [seldom_first(x, levels, similar).tobytes() for x in sets]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node), wide, size, odd, seldom], names=["doc_id", "key", "node", "wide", "size", "odd", "seldom"])

    marks = kept_on_disk(keyed.mapInArrow(run, "doc_id long, key string, node long, wide binary, size int, odd binary, seldom binary"))
    # structs compare field by field: rows with an identifier first
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    firsts = kept_on_disk(marks.groupBy("node").agg(one, *(F.first(c).alias(c) for c in ("wide", "size", "odd"))))
    n, tokens = firsts.count(), int(marks.agg(F.coalesce(F.sum(F.length("seldom")), F.lit(0))).first()[0]) // 8
    close = cut(verified(similar_edges(firsts.select("node", "wide"), n, similar), firsts, keyed, words, similar))
    near = connected(close).withColumnRenamed("node", "linked")
    shared = shared_tokens(marks, repeated_tokens(marks, tokens))
    grouped = shared.join(near, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("label", "node").alias("label"), "size", "odd", "seldom", "at")
    rest = verified(missed_edges(grouped, tokens, similar), firsts, keyed, words, similar)
    labels = connected(close.unionByName(rest))
    placed = firsts.join(labels.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("one", F.coalesce("label", "node").alias("label"))
    kept = placed.groupBy("label").agg(F.min("one").alias("one")).select("one.key", F.lit(True).alias("stays")).distinct()
    # all other rows stay as they are
    found = marks.groupBy("key").agg(F.count("*").alias("many")).join(kept, "key", "left").where("stays is null or many > 1")
    found = cut(found.select(F.col("key").alias("found"), F.coalesce("stays", F.lit(False)).alias("stays")))
    marks.unpersist()
    firsts.unpersist()
    n, asked = len(docs.columns), marked_keys(found, "found").of(F.xxhash64("key"))
    rows = docs.select("*", mark.alias("mark of the row")).toDF(*(f"c{i}" for i in range(n)), "key")
    others = rows.where(asked).join(found, F.col("key") == F.col("found"), "left").where("stays is null or stays")
    others = others.withColumn("turn", F.row_number().over(W.partitionBy("key").orderBy("key"))).where("turn = 1")
    columns = [f"c{i}" for i in range(n)]
    return rows.where(~asked).select(*columns).unionByName(others.select(*columns)).toDF(*docs.columns)
