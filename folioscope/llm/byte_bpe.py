"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

Texts are cut by the tokenizer's pattern. Words that a partition has not met yet become rows (word, position, token); a
recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of minimum rank until no
pair merges. Decoding joins every document's ids with the vocabulary and concatenates the pieces in order of position; no byte
of the input reaches the decoded bytes. A worker remembers the ids of the words it has encoded, up to a bound after which it
keeps those met more than once; that affects speed alone.

One contraction a round makes rounds as many as a piece has merges. Pieces of more than LONG bytes therefore go through a
second recursive query that contracts all occurrences of the minimum rank in one round, from the left, without overlaps, wherever
that is what contracting them one after the other gives: no pair that arises on the way has a lower rank. Where
one has, the round contracts the leftmost alone.

Defined results: null counts as empty, which has no ids; an empty table gives an empty result; rows that repeat are
encoded alike; texts are read whole; strings that look like special tokens are ordinary text; of the input's columns
only identifier and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import HELD, frugal, give_back, id_and_text, slices, small_batches, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of a piece from which on a round contracts all occurrences of the minimum rank.
LONG = 256
#: Words that a worker remembers.
MEMORY = 360_000
#: Bytes of text that are encoded together, and bytes of words that one recursive query takes.
SLICE, PORTION = 1 << 20, 1 << 18
#: DuckDB's memory, and what a byte of an oversized piece adds to it.
DUCK_BYTES, PIECE_BYTES = 150 << 20, 600

#: Rows are (word << 32) + position and token. A round looks up each neighbouring pair in the merge table and contracts the
#: leftmost pair of minimum rank of each word; words without one are final and leave the recursion.
ENCODE = """
CREATE OR REPLACE TEMP TABLE done AS
WITH RECURSIVE step AS (
  SELECT false AS final, k, id FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.k, s.id, s.before, s.k >> 32 AS word, m.merged
     FROM (SELECT k, id, lead(id) OVER w AS next_id, lead(k) OVER w AS next_k, lag(k) OVER w AS before
           FROM step WHERE NOT final WINDOW w AS (ORDER BY k)) s
     LEFT JOIN merges m ON m.pair = CASE WHEN s.next_k >> 32 = s.k >> 32 THEN (s.id << 20) + s.next_id END
   ), least AS (
     SELECT word, min((merged << 32) + (k & 4294967295)) AS best FROM pairs WHERE merged IS NOT NULL GROUP BY word
   )
   SELECT best IS NULL, p.k, CASE WHEN p.k & 4294967295 = best & 4294967295 THEN best >> 32 ELSE p.id END
   FROM pairs p LEFT JOIN least l ON p.word = l.word
   WHERE best IS NULL OR before IS NULL OR before <> (p.word << 32) + (best & 4294967295))
)
SELECT k, id FROM step WHERE final
"""

#: The same fixpoint for long pieces. `hits` are the occurrences of a word's minimum rank, every second one of a run that overlaps;
#: `early` are the words where contracting a hit makes a pair of lower rank with the token left of it (as contracted)
#: or right of it (not contracted yet), so that only the leftmost hit may go.
ENCODE_LONG = """
CREATE OR REPLACE TEMP TABLE done AS
WITH RECURSIVE step AS (
  SELECT false AS final, k, id FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.*, s.k >> 32 AS word, m.merged
     FROM (SELECT k, id, row_number() OVER w AS place, lead(id) OVER w AS next_id, lead(k) OVER w AS next_k, lag(id) OVER w AS before_id, lag(k) OVER w AS before,
                  lead(id, 2) OVER w AS far_id, lead(k, 2) OVER w AS far_k
           FROM step WHERE NOT final WINDOW w AS (ORDER BY k)) s
     LEFT JOIN merges m ON m.pair = CASE WHEN s.next_k >> 32 = s.k >> 32 THEN (s.id << 20) + s.next_id END
   ), least AS MATERIALIZED (
     SELECT word, min(merged) AS best FROM pairs WHERE merged IS NOT NULL GROUP BY word
   ), runs AS (
     SELECT p.*, best, place - row_number() OVER (ORDER BY k) AS run FROM pairs p JOIN least l ON p.word = l.word AND p.merged = l.best
   ), hits AS MATERIALIZED (
     SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS turn FROM runs) WHERE turn % 2 = 1
   ), early AS (
     SELECT DISTINCT h.word
     FROM hits h LEFT JOIN hits g ON g.next_k = h.before AND g.word = h.word
     LEFT JOIN merges a ON a.pair = CASE WHEN h.before >> 32 = h.word THEN (CASE WHEN g.k IS NULL THEN h.before_id ELSE h.best END << 20) + h.best END
     LEFT JOIN merges b ON b.pair = CASE WHEN h.far_k >> 32 = h.word THEN (h.best << 20) + h.far_id END
     WHERE a.merged < h.best OR b.merged < h.best
   ), chosen AS MATERIALIZED (
     SELECT k, next_k, best FROM hits WHERE word NOT IN (SELECT word FROM early)
     UNION ALL SELECT min(k), min_by(next_k, k), min(best) FROM hits WHERE word IN (SELECT word FROM early) GROUP BY word
   )
   SELECT l.best IS NULL, p.k, coalesce(c.best, p.id)
   FROM pairs p LEFT JOIN least l ON p.word = l.word LEFT JOIN chosen c ON c.k = p.k LEFT JOIN chosen d ON d.next_k = p.k
   WHERE d.k IS NULL)
)
SELECT k, id FROM step WHERE final
"""

ENCODED = "SELECT k, id FROM done ORDER BY k"

#: The aggregation takes its rows in the subquery's order, as the database has one thread; sorting inside it costs twice as much.
DECODE = """
SELECT doc, string_agg(piece, '') AS decoded
FROM (SELECT doc, piece FROM ids JOIN vocabulary USING (id) ORDER BY pos) GROUP BY doc
"""

#: What the installed pattern finds in texts whose characters beyond ASCII are letters of the Latin blocks, for the built-in engine.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
OWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_find_latin = re.compile(OWN_PATTERN.replace(r"\p{L}+", f"[{LATIN}]+", 1).replace(r"\p{N}+", "[0-9]+", 1).replace(r"\p{L}", LATIN).replace(r"\p{N}", "0-9")).findall
_beyond_latin = re.compile(f"[^\x00-\x1b\x20-\x7f{LATIN}]").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class DuckBpe:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.find_any, self.latin = regex.compile(pattern).findall, pattern == OWN_PATTERN
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{DUCK_BYTES}B", "temp_directory": ""})
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 20) + b)
                    merged.append(rank)
        self.db.register("m", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        pieces = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.db.register("v", pieces)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.code: dict[str, int] = {}
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, text: str) -> list[str]:
        """The pattern's matches; both engines find the same where the text has only ASCII and Latin letters."""
        return (self.find_any if not self.latin or _beyond_latin(text) else _find_latin)(text)

    def places(self, own: np.ndarray) -> np.ndarray:
        """Where the ids of these words lie, one word's after the other's."""
        counts = self.count[own]
        return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - self.start[own], counts)

    def forget(self) -> None:
        """Keep the words met more than once of late, half of MEMORY at most; that affects speed alone."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > MEMORY // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: MEMORY // 2]])
        words, own = list(self.code), keep.tolist()
        self.code = {words[i]: k for k, i in enumerate(own)}
        self.ids, self.count, self.used = self.ids[self.places(keep)], self.count[keep], self.used[keep] >> 1
        self.start = np.cumsum(self.count) - self.count

    @staticmethod
    def portions(data: list[bytes]) -> Iterator[list[bytes]]:
        """Consecutive words of about PORTION bytes, so that a query's tables stay small whatever the text."""
        own: list[bytes] = []
        total = 0
        for d in data:
            if own and total + len(d) > 2 * PORTION:
                yield own
                own, total = [], 0
            own.append(d)
            total += len(d)
            if total >= PORTION:
                yield own
                own, total = [], 0
        if own:
            yield own

    def contract(self, data: list[bytes], query: str) -> list[list[int]]:
        """Ids of words, by a recursive query for each portion of them."""
        ids: list[list[int]] = []
        for own in self.portions(data):
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.frombuffer(b"".join(own), np.uint8)
            word = np.repeat(np.arange(len(own)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            more = max(0, len(flat) - 2 * PORTION) * PIECE_BYTES
            if more:  # one oversized piece
                self.db.execute(f"SET memory_limit = '{DUCK_BYTES + more}B'")
            self.db.register("start", pa.table({"k": (word << 32) + pos, "id": self.byte_id[flat]}))
            self.db.execute(query)
            self.db.unregister("start")
            got = self.db.execute(ENCODED).fetchnumpy()
            if more:
                self.db.execute("DROP TABLE done")
                self.db.execute(f"SET memory_limit = '{DUCK_BYTES}B'")
            ends = np.searchsorted(got["k"] >> 32, np.arange(len(own)), side="right").tolist()
            tokens = got["id"].tolist()
            ids += [tokens[first:end] for first, end in zip([0, *ends], ends, strict=False)]
        return ids

    def learn(self, words: list[str]) -> None:
        """Encode words not met before and remember them."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ids: list = [[whole] if (whole := self.ranks.get(d)) is not None else None for d in data]
        for query, own in ((ENCODE, [i for i, d in enumerate(data) if ids[i] is None and len(d) <= LONG]), (ENCODE_LONG, [i for i, d in enumerate(data) if ids[i] is None and len(d) > LONG])):
            for i, found in zip(own, self.contract([data[i] for i in own], query), strict=True):
                ids[i] = found
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))))
        self.start = np.concatenate((self.start, base + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int64)))
        n = len(self.code)
        self.code.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        if len(self.code) > MEMORY:
            self.forget()
        found = [self.find(t) for t in texts]
        flat = list(chain.from_iterable(found))
        codes = np.fromiter(map(self.code.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            self.learn(list(dict.fromkeys(flat[i] for i in missing.tolist())))
            codes[missing] = [self.code[flat[i]] for i in missing.tolist()]
        self.used += np.bincount(codes, minlength=len(self.used))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return [self.ids[self.places(codes[a:b])] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of lists of ids, by one ordered aggregation for about SLICE ids."""
        out = [b""] * len(lists)
        first = 0
        while first < len(lists):
            end, n = first, 0
            while end < len(lists) and (n == 0 or n + len(lists[end]) <= SLICE):
                n += len(lists[end])
                end += 1
            counts = np.fromiter(map(len, lists[first:end]), np.int64, end - first)
            ids = np.concatenate(lists[first:end]).astype(np.int32)
            more = max(0, n - SLICE) * PIECE_BYTES // 4
            if more:
                self.db.execute(f"SET memory_limit = '{DUCK_BYTES + more}B'")
            self.db.register("ids", pa.table({"doc": np.repeat(np.arange(first, end, dtype=np.int32), counts), "pos": np.arange(n, dtype=np.int32), "id": ids}))
            for i, text in self.db.execute(DECODE).fetchall():
                out[i] = text.encode("latin-1")
            self.db.unregister("ids")
            if more:
                self.db.execute(f"SET memory_limit = '{DUCK_BYTES}B'")
            first = end
        return out


#: The encoder's name among what a worker keeps.
KEPT = "byte_bpe"


def worker_bpe(path: str, pattern: str) -> DuckBpe:
    """The worker's own encoder; it outlives a task, until the worker turns to a stage that lets it go."""
    if HELD.get(KEPT, ((), None))[0] != (path, pattern):
        HELD.pop(KEPT, None)
        HELD[KEPT] = (path, pattern), DuckBpe(path, pattern)
    return HELD[KEPT][1]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit; null unless with_ids), n_tokens, ids_sha256, decoded_sha256."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = vocabulary or tokenizer_path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in part.column("text")]
                ids = bpe.encode(texts)
                del texts
                raw = [i.astype("<u4").tobytes() for i in ids]
                data, n = raw if with_ids else [None] * len(raw), [len(i) for i in ids]
                sha, back = ([hashlib.sha256(x).hexdigest() for x in many] for many in (raw, bpe.decode(ids)))
                arrays = [part.column("doc_id"), pa.array(data, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                del ids, raw, data
                give_back()
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(run, KEPT), "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text (binary) of ids as encode_documents writes them; null ids give an empty text."""
    import public_tokenizers

    path, pattern = vocabulary or tokenizer_path(VOCABULARY), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            for part in slices(batch):
                lists = [np.frombuffer(t.as_py() or b"", "<u4") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bpe.decode(lists), pa.binary())], names=["doc_id", "text"])

    return id_and_text(encoded, id_col, ids_col).mapInArrow(frugal(run, KEPT), "doc_id long, text binary")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
