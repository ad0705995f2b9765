"""Token files: ids in one array per file, document boundaries in Elias-Fano form.

A file holds, in ascending order of identifier (rows without one first):

    magic, the ids (fixed width, 2 or 4 bytes, little-endian), boundaries, identifiers, footer, magic

Boundaries (n + 1 ascending offsets) and identifiers (less the smallest) are Elias-Fano sequences: the low bits of each value
packed, the high parts as a unary bit string, plus the place of every SAMPLE-th one for select. Value i is
((select(i) - i) << low_bits) | low(i): about 2 + log2(universe / n) bits a document rather than a table of 64-bit offsets.

Documents are encoded where they lie. Files are ranges of (identifier, hash of the text), cut at quantiles of a bounded sample
(CUT_ROWS rows a file, MOST_FILES files), so one identifier's rows, or those without one, can fill many files; rows equal in
both fall on all the files that their key ends or begins. Each id list goes to the task of its file, sorted, and is appended
as it comes. A file is written under a name of its task attempt and renamed when whole, so a lost executor leaves nothing
half-written under a final name. What the driver holds is bounded by MOST_FILES.

Defined results: null text counts as empty; each document ends with END_ID, so an empty one has one id; the strings of the
vocabulary's special tokens become these tokens, as the library does by itself; rows that repeat an
identifier follow one another in an order fixed by their texts; an empty table gives no files and an empty result; texts are whole; only
identifier and text are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import id_and_text, new_folder, partitions, scaled, slices, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEED = 42
MAGIC = b"EFTOKEN1"
SAMPLE = 512
#: Documents in a file, about, unless that makes more than MOST_FILES; sampled rows a file that set the cuts.
FILE_DOCS, MOST_FILES, CUT_ROWS = 20_000, 100_000, 48
#: Words that a worker remembers, and words that are encoded together.
MEMORY, TOGETHER = 500_000, 2048
#: Values whose low bits are packed together: a multiple of 8.
PACK = 1 << 16


class EliasFano:
    """An ascending sequence of non-negative integers with random access by select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u8")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = np.arange(bits, dtype=np.uint64)
        low = [np.packbits(((v[at : at + PACK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for at in range(0, n if bits else 0, PACK)]
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, b"".join(low), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8").tobytes())

    def select(self, i: int) -> int:
        """Place of the i-th one of the high bits, from the sample before it."""
        at = int(self.samples[i // SAMPLE])
        missing, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7))
        while (ones := word.bit_count()) <= missing:
            missing, byte = missing - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(missing):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            last = first + self.low_bits
            data = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
            low = (data >> (first & 7)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        """Every value at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        high = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return high | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        return struct.pack("<5Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples) * 8) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<5Q", data)
        return cls(n, bits, data[40 : 40 + a], data[40 + a : 40 + a + b], data[40 + a + b : 40 + a + b + c])


#: White space that parts texts, and a run of ASCII symbols that ends a word in a letter or digit and does not begin with an apostrophe
#: (U+0130 is left out, as lowering it makes a combining mark, which would belong to the run).
_SPACE = r"\t-\r "
_TAIL = rf"([a-z0-9\x{{e0}}-\x{{f6}}\x{{f8}}-\x{{12f}}\x{{131}}-\x{{24f}}])([!-&(-/:-@\[-`{{-~][!-/:-@\[-`{{-~]*)([{_SPACE}]|$)"
_latin_word = re.compile("[a-z\u00e0-\u00f6\u00f8-\u024f]+").fullmatch


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    This vocabulary's normaliser and pre-tokenizer drop white space and never look across it, and its special tokens hold
    none, so a text's ids are those of its parts between ASCII white space, one after the other. Texts without special
    tokens may be lowered and their words parted from the symbols behind them beforehand, as normaliser and
    pre-tokenizer do both. Words of Latin letters alone are one piece that the normaliser leaves as it is: a tokenizer
    without it takes many of them at once, and the vocabulary's end-of-word tokens tell where each ends.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.code: dict[bytes, int] = {}
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, f"<u{self.width}")

    def places(self, own: np.ndarray) -> np.ndarray:
        """Where the ids of these words lie, one word's after the other's."""
        counts = self.count[own]
        return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - self.start[own], counts)

    def forget(self) -> None:
        """Keep the words met more than once of late, half of MEMORY at most; that affects speed alone."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > MEMORY // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: MEMORY // 2]])
        words = list(self.code)
        self.code = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.ids, self.count, self.used = self.ids[self.places(keep)], self.count[keep], self.used[keep] >> 1
        self.start = np.cumsum(self.count) - self.count

    def learn(self, words: list[bytes]) -> None:
        """Encode words not met before and remember them, those of Latin letters many at a time."""
        plain, low, others, ids, counts = [], [], [], [], []
        for w in words:
            text = w.decode("utf-8", "replace").lower()
            if _latin_word(text):
                plain.append(w)
                low.append(text)
            else:
                others.append(w)
        for at in range(0, len(plain), TOGETHER):
            own = np.array(self.plain.encode_batch_fast([" ".join(low[at : at + TOGETHER])], add_special_tokens=False)[0].ids, self.ids.dtype)
            ids.append(own)
            counts.append(np.diff(np.flatnonzero(self.ends[own]), prepend=-1))
        single = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)]
        counts.append(np.fromiter(map(len, single), np.int64, len(single)))
        ids.append(np.fromiter(chain.from_iterable(single), self.ids.dtype, int(counts[-1].sum())))
        own, base, n = np.concatenate(counts), len(self.ids), len(self.code)
        self.ids = np.concatenate((self.ids, *ids))
        self.start = np.concatenate((self.start, base + np.cumsum(own) - own))
        self.count = np.concatenate((self.count, own))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int64)))
        self.code.update(zip(chain(plain, others), range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Each text's ids with the end id, as bytes, from binary texts."""
        if len(self.code) > MEMORY:
            self.forget()
        whole = pc.fill_null(texts, b"").view(pa.string())
        low = pc.ascii_lower(whole)
        if not any(pc.any(pc.match_substring(low, s)).as_py() for s in self.special):
            whole = pc.replace_substring_regex(low, _TAIL, r"\1 \2\3")
        words = pc.ascii_split_whitespace(whole)
        distinct = words.flatten().dictionary_encode()
        known = distinct.dictionary.view(pa.binary()).to_pylist()
        codes = np.fromiter(map(self.code.get, known, repeat(-1)), np.int64, len(known))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            self.learn([known[i] for i in missing.tolist()])
            codes[missing] = [self.code[known[i]] for i in missing.tolist()]
        own = codes[distinct.indices.to_numpy()]
        self.used += np.bincount(own, minlength=len(self.used))
        upto = np.concatenate(([0], np.cumsum(self.count[own])))
        doc = upto[np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))]
        out = np.full(int(upto[-1]) + len(texts), END_ID, self.ids.dtype)
        out[np.arange(int(upto[-1])) + np.repeat(np.arange(len(texts)), np.diff(doc))] = self.ids[self.places(own)]
        ends = ((doc + np.arange(len(doc))) * self.width).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


_WORKER: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER.clear()
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


class TokenFile:
    """A file read back: ids of document i are ids[boundaries[i]:boundaries[i + 1]]."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        (length,) = struct.unpack("<I", tail[:4])
        self.meta = json.loads(self.file.read_at(length, size - 12 - length))
        at = len(MAGIC) + self.meta["n_tokens"] * self.meta["width"]
        self.boundaries = EliasFano.from_bytes(self.file.read_at(self.meta["boundaries"], at))
        self.identifiers = EliasFano.from_bytes(self.file.read_at(self.meta["identifiers"], at + self.meta["boundaries"]))

    def doc_ids(self) -> list[int | None]:
        base = self.meta["base"]
        return [None] * self.meta["n_null"] + [base + int(v) for v in self.identifiers.all()]

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.meta["width"]
        return np.frombuffer(self.file.read_at((end - start) * width, len(MAGIC) + start * width), f"<u{width}")


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the files; the manifest, a dict per file: path, n_docs, n_tokens, start (ids in the files before it)."""
    spark, path = docs.sparkSession, vocabulary or tokenizer_path(VOCABULARY)
    rows = id_and_text(docs, id_col, text_col).withColumn("code", F.xxhash64("text"))
    n = rows.select("doc_id").count()
    files = min(MOST_FILES, scaled(n, FILE_DOCS, 1 if n < 2 else min(partitions(spark), n)))
    cuts: list[tuple] = []
    if files > 1:  # at most MOST_FILES x CUT_ROWS rows of three numbers, in expectation
        some = rows.where(F.rand(SEED) < files * CUT_ROWS / n).select(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "code").toArrow()
        keys = [some.column(c).to_numpy() for c in ("named", "doc_id", "code")]
        order = np.lexsort(keys[::-1])
        order = order[[len(order) * i // files for i in range(1, files)]] if len(order) else order
        cuts = list(zip(*(k[order].tolist() for k in keys), strict=True))
    shared = spark.sparkContext.broadcast(cuts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own_cuts, turn = worker_encoder(path), shared.value, 0
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column("text"))
                own, codes, file = part.column("doc_id"), part.column("code"), []
                for doc_id, code in zip(own.to_pylist(), codes.to_pylist(), strict=True):
                    key = (doc_id is not None, doc_id or 0, code)
                    low, high = bisect_left(own_cuts, key), bisect_right(own_cuts, key)
                    file.append(low + turn % (high - low + 1))  # rows equal in both keys hold the same ids
                    turn += high > low
                yield pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), own, codes, ids], names=["file", "doc_id", "code", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_width = worker_encoder(path).width
        fs, root = _open_folder(folder)
        out, state, done = None, None, []

        def close() -> None:
            nonlocal out
            ids, total = np.array(state["ids"], np.int64), state["bounds"][-1]
            base = int(ids[0]) if len(ids) else 0
            bounds = EliasFano.of(np.array(state["bounds"], np.int64)).to_bytes()
            names = EliasFano.of((ids - base) if len(ids) else ids).to_bytes()
            meta = json.dumps({"n_docs": len(state["bounds"]) - 1, "n_null": state["null"], "n_tokens": total, "width": encoder_width, "base": base, "boundaries": len(bounds), "identifiers": len(names)}).encode()
            out.write(bounds + names + meta + struct.pack("<I", len(meta)) + MAGIC)
            out.close()
            final = f"{root}/tokens-{state['file']:06d}.eft"
            fs.move(state["temp"], final)
            done.append((state["file"], final, len(state["bounds"]) - 1, total))
            out = None

        for batch in batches:
            for file, doc_id, ids in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if out is None or state["file"] != file:
                    if out is not None:
                        close()
                    temp = f"{root}/.{file}-{uuid.uuid4().hex}"
                    state = {"file": file, "temp": temp, "bounds": array("q", [0]), "ids": array("q"), "null": 0}
                    out = fs.open_output_stream(temp)
                    out.write(MAGIC)
                raw = ids.as_py()
                out.write(raw)
                state["bounds"].append(state["bounds"][-1] + len(raw) // encoder_width)
                if doc_id is None:
                    state["null"] += 1
                else:
                    state["ids"].append(doc_id)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "path", "n_docs", "n_tokens"])

    fs, root = _open_folder(folder)
    fs.create_dir(root, recursive=True)
    encoded = rows.mapInArrow(encode, "file int, doc_id long, code long, ids binary")
    dealt = encoded.repartitionById(files, F.col("file")).sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "code")
    written = dealt.drop("code").mapInArrow(write, "file int, path string, n_docs long, n_tokens long").orderBy("file").collect()  # a row per file
    manifest, start = [], 0
    for row in written:
        manifest.append({"path": row["path"], "n_docs": row["n_docs"], "n_tokens": row["n_tokens"], "start": start})
        start += row["n_tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit little-endian), from the files."""
    fs, root = _open_folder(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("start", T.LongType())])
    files = spark.createDataFrame([(i, m["path"], m["start"]) for i, m in enumerate(manifest)], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_fs, _ = _open_folder(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(own_fs, path)
                doc_ids, bounds = file.doc_ids(), file.boundaries.all().astype(np.int64)
                at = 0
                while at < len(doc_ids):  # about a million ids at a time
                    to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 20), side="right")) - 1)
                    to = min(to, len(doc_ids))
                    ids = file.ids(int(bounds[at]), int(bounds[to])).astype("<u4")
                    own = bounds[at : to + 1] - bounds[at]
                    raw = [ids[a:b].tobytes() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    arrays = [pa.array(doc_ids[at:to], pa.int64()), pa.array(first + bounds[at:to]), pa.array(np.diff(own)), pa.array(raw, pa.binary()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])
                    at = to

    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
    return files.repartitionById(len(manifest), F.col("file")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).drop("ids")
