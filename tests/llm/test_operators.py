"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__ as entry
from folioscope.llm import byte_bpe, common, exact_dedup, language_id, mixing, pii, sharding, simhash, token_files, topk, toxicity
from folioscope.llm.common import new_folder

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def same_rows(got, expected):
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in expected)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op10_topk"])
def test_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    expected = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(expected.column_names)
    same_rows(got.select(*sorted(got.columns)).collect(), zip(*(expected[c].to_pylist() for c in sorted(expected.column_names)), strict=True))


# 1: exact dedup


def brute_classes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub(" ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out, groups


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 2000])
def test_classes(docs, rows, budget, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", budget)
    got = exact_dedup.duplicate_classes(docs).collect()
    expected, groups = brute_classes(rows)
    same_rows([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], expected)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    same_rows([(WHITE.sub(" ", r.text or ""), r.doc_id) for r in left.collect()], [(t, min((i for i in ids if i is not None), default=None)) for t, ids in groups.items()])


def test_trie_spills_by_subtree():
    keys = sorted({bytes(x) for x in np.random.default_rng(3).integers(0, 3, (400, 6), dtype=np.uint8)})
    trie, seen = exact_dedup.PatriciaTrie(), []
    for k in keys:
        seen += [t[0] for t in trie.spill(k)] if len(seen) % 7 == 0 else []
        trie.insert(k, list)[0].append(k)
        assert not trie.insert(k, list)[1]
    assert seen + [t[0] for t in trie.spill()] == keys


# 2: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_pii(found, texts):
    spans = found.select("doc_id", *(pii.span_list(F.col(k)).alias(k) for k in BASE)).collect()
    same_rows([(r.doc_id, tuple(r.email + r.ip + r.card + r.phone)) for r in spans], [(i, tuple(base_spans(t or ""))) for i, t in texts])


def test_pii(spark, docs, rows, small):
    check_pii(pii.find_pii(docs), [(r[0], r[1]) for r in rows])
    table = spark.read.parquet(f"{small}/documents.parquet")
    check_pii(pii.find_pii(table), [(r.doc_id, r.text) for r in table.collect()])


def test_pii_added_kinds(spark):
    text = "pay to iban GB82 WEST 1234 5698 7654 32 now; GB82 WEST 1234 5698 7654 33; ssn 123-45-6789; part 123-45-6789"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s["value"] for s in r.iban] == ["GB82 WEST 1234 5698 7654 32"] and r.iban[0]["score"] == 1.0
    assert len(r.national_id) == 1 and text[r.national_id[0]["start"] :].startswith("123-45")


# 3: token files


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [5, 5, 9], np.sort(rng.integers(0, 10**9, 3000)), np.arange(2000) * 7, [0, 2**40]):
        v = np.array(values, np.int64)
        ef = token_files.EliasFano.from_bytes(token_files.EliasFano.of(v).to_bytes())
        assert ef.all().tolist() == v.tolist() and [ef[i] for i in range(len(v))] == v.tolist()
    v = np.sort(rng.integers(0, 10**8, 10_000))
    assert len(token_files.EliasFano.of(v).to_bytes()) < 10_000 * 8 / 3


def check_tokens(got, pairs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, text in pairs]
    order = sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, np.frombuffer(x[1], "<u4").astype("<u2").tobytes()))
    starts = np.cumsum([0] + [len(b) // 4 for _, b in order]).tolist()
    same_rows([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(b) // 4, zlib.crc32(b)) for i, b in ids])
    assert sorted(r.start for r in got) == starts[:-1]
    unique = {i for i, n in Counter(i for i, _ in ids).items() if n == 1}
    same_rows([(r.doc_id, r.start) for r in got if r.doc_id in unique], [(i, s) for (i, _), s in zip(order, starts, strict=False) if i in unique])


def test_token_files(spark, docs, rows, small):
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_token_files(docs, folder)
    assert len(manifest) > 1
    check_tokens(token_files.read_token_files(spark, folder).drop("ids").collect(), [(r[0], r[1]) for r in rows])
    table = spark.read.parquet(f"{small}/documents.parquet")
    check_tokens(token_files.op3_token_files(spark, small).collect(), [(r.doc_id, r.text) for r in table.collect()])


def test_special_strings_are_tokens(spark):
    texts = ["<|endoftext|> hi", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext|><|endoftext|>", "é<|endoftext|>É it's", "<|endoftext|", "\x1c a\x1db\x85c\u3000d"]
    got = {r.doc_id: r for r in token_write(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    check_tokens(got.values(), list(enumerate(texts)))
    assert np.frombuffer(got[0].ids, "<u4").tolist() == [49407, 1883, 2]


def token_write(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(docs, folder)
    return token_files.read_token_files(spark, folder).collect()


def test_words_apart_from_their_symbols(spark):
    """Random strings of letters, symbols, apostrophes, white space, other alphabets and capitals, against the library on whole texts."""
    import pyarrow as pa

    rng = random.Random(14)
    every = [*"abzAZ019", *"!,.;:'\"$%^&*()_-+=<>|/`~[]{}#@?", *"    \t\n\x0b\r", *"'s 't 're ll".split(), *"éÉßÀÿøŁĳİıǅǆ×÷", "e\u0301", "\u2026", "\u00a0", "\u3000", "\x1c", "\x85", "東", "ж", "²", "½"]
    texts = ["".join(rng.choices(every, k=rng.randint(0, 40))) for _ in range(3000)]
    own, plain = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = own.encode(pa.array([t.encode() for t in texts], pa.binary()))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids.as_py(), "<u2").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def test_one_identifier_fills_many_files(spark, monkeypatch):
    """Rows of one identifier, those without one and equal rows are dealt to several files, and the order still holds."""
    monkeypatch.setattr(token_files, "FILE_DOCS", 25)
    rows = [(7, f"word{i} other")for i in range(200)] + [(None, f"null{i}") for i in range(150)] + [(9, "the same")] * 200 + [(i, f"n{i}") for i in range(10, 60)] + [(-(1 << 63), "least"), ((1 << 62), "most")]
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), new_folder(spark, "tokens")
    manifest = token_files.write_token_files(docs, folder)
    assert len(manifest) > 15 and max(m["n_docs"] for m in manifest) < 130
    got = token_files.read_token_files(spark, folder).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, text in rows]
    same_rows([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(b) // 4, zlib.crc32(b)) for i, b in ids])


def test_word_cache_overflow_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 6)
    monkeypatch.setattr(token_files, "TOGETHER", 3)
    import pyarrow as pa

    own, plain = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for at in range(0, len(rows), 4):
        texts = [r[1] for r in rows[at : at + 4] if r[1] is None or len(r[1]) < 9000]
        got = own.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
        assert [np.frombuffer(b.as_py(), "<u2").tolist() for b in got] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


# 4: sharding


def test_differencing():
    rng = np.random.default_rng(5)
    w = (rng.pareto(1.5, 3000) * 1000).astype(int).tolist()
    parts = sharding.differencing(w, 8)
    sums = np.bincount(parts, w, 8)
    assert sums.max() - sums.min() <= 0.001 * sums.mean()
    assert sharding.differencing([8, 7, 6, 5, 4], 2) and sharding.differencing([], 3) == []


def test_shards(spark, docs, rows):
    got = sharding.shard_documents(docs, shards=5).collect()
    same_rows([(r.doc_id, r.size, r.text_crc32) for r in got], [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows])
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len({r.shard for r in got if (r.size, r.text_crc32) == k}) == 1 for k in {(r.size, r.text_crc32) for r in got if r.size > 16})


def test_partial_partitions():
    """Differencing of partial partitions: each keeps its parts whole and apart, whatever part of the result they become."""
    rng = np.random.default_rng(6)
    items = [np.sort(rng.integers(0, 1000, 7)) if i % 3 else int(rng.integers(1, 4000)) for i in range(200)]
    sums = np.zeros(7, np.int64)
    for item, to in zip(items, sharding.partition(items, 7), strict=True):
        assert sorted(to.tolist()) == list(range(7))
        np.add.at(sums, to, np.array([0] * 6 + [item]) if isinstance(item, int) else item)
    assert sums.max() - sums.min() < 0.002 * sums.mean()


def test_cells_of_groups(spark, monkeypatch):
    """Many cells, and one group with a third of all bytes: groups stay whole, and the others balance as far as that group lets them."""
    monkeypatch.setattr(sharding, "CELL", 40)
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(1, 500)) for i in range(900)] + [(1000 + i, "hot " * 50) for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    text, of, sums = dict(rows), defaultdict(set), Counter()
    for r in got:
        of[text[r.doc_id]].add(r.shard)
        sums[r.shard] += r.size
    assert len(got) == 1300 and all(len(s) == 1 for s in of.values())
    (hot,) = of["hot " * 50]
    others = [v for k, v in sums.items() if k != hot]
    assert len(sums) == 6 and max(others) - min(others) < 0.02 * max(others)


def test_shards_are_even(spark):
    got = sharding.op4_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    n = [r.n for r in got]
    assert len(n) == 40 and max(n) - min(n) < 0.01 * sum(n) / 40


# 5: language


def test_language(spark, docs, small):
    got = language_id.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(found[i].nearest == "und" and found[i].score == 0 for i in (0, 6, 12, 15)) and found[18].nearest in ("en", "fr")


def brute_language(model, text):
    """Nearest language and cosine, n-gram by n-gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).encode().split()
    data, counts, shift = b" " + b" ".join(words) + b" ", Counter(), 32 - language_id.DIMS.bit_length() + 1
    for i in range(len(data)):
        code = 0
        for byte in data[i : i + 3]:
            code = ((code << 8) + byte + 1) & 0xFFFFFFFF
            counts[(code * 2654435761 & 0xFFFFFFFF) >> shift] += 1
    v = {d: np.log1p(n) * float(model.idf[d]) for d, n in counts.items()}
    norm = sum(x * x for x in v.values()) ** 0.5
    scores = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centres]
    best = int(np.argmax(scores))
    return model.langs[best], min(max(scores[best], 0.0), 1.0)


def test_language_by_brute_force(spark, docs, rows, small):
    """Every prediction recomputed: nulls, texts without letters, repeated and very long texts; held-out rows by their own hash."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(table)
    assert len(model.centres) <= 4 * language_id.CENTROIDS
    for frame, texts in ((docs, [(r[0], r[1]) for r in rows]), (table, [(r.doc_id, r.text) for r in table.collect()])):
        got = sorted(((r.doc_id, r.nearest, r.score) for r in language_id.identify(frame, model).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        expected = sorted(((i, *brute_language(model, t)) for i, t in texts), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        assert [r[:2] for r in got] == [r[:2] for r in expected]
        assert max(abs(a[2] - b[2]) for a, b in zip(got, expected, strict=True)) < 1e-4
    found = language_id.op5_language_id(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)


# 6: byte-level BPE


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def check_bpe(got, pairs):
    own = encoding()
    expected = []
    for i, text in pairs:
        raw = np.array(own.encode_ordinary(text or ""), "<u4").tobytes()
        expected.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same_rows([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], expected)


def test_bpe(spark, docs, rows, small):
    encoded = byte_bpe.encode_documents(docs)
    check_bpe(encoded.collect(), [(r[0], r[1]) for r in rows])
    same_rows([(r.doc_id, bytes(r.text)) for r in byte_bpe.decode_documents(encoded).collect()], [(r[0], (r[1] or "").encode()) for r in rows])
    table = spark.read.parquet(f"{small}/documents.parquet")
    check_bpe(byte_bpe.op6_byte_bpe(spark, small).collect(), [(r.doc_id, r.text) for r in table.collect()])


def test_bpe_recursion_alone(monkeypatch):
    bpe = byte_bpe.DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own, texts = encoding(), ["aaaaaaaaaaaaaaaaaaaab", "Donaudampfschifffahrt", "été\x00\xff", "  \n\t 　\x1c\x85 x", "東京" * 40]
    assert [ids.tolist() for ids in bpe.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "LONG", 0)
    bpe = byte_bpe.DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [ids.tolist() for ids in bpe.encode(texts)] == [own.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("long", [0, 1 << 30])
def test_both_recursive_queries(long, monkeypatch):
    """Runs that overlap, random letters and whole tokens side by side, each piece by either query."""
    monkeypatch.setattr(byte_bpe, "LONG", long)
    rng, own = random.Random(9), encoding()
    bpe = byte_bpe.DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["x" * 700, "ab" * 300, "aaab" * 90, " " * 300 + "y", "-" * 77 + "=" * 90, "1" * 300, "東京" * 60, "thethe" * 50]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(2, 80))) for alphabet in ("ab", "aeinst", "abcdefghijklmnopqrstuvwxyz") for _ in range(60)]
    got = bpe.encode(texts)
    assert [ids.tolist() for ids in got] == [own.encode_ordinary(t) for t in texts]
    assert bpe.decode(got) == [t.encode() for t in texts]


def test_merges_of_falling_rank(monkeypatch):
    """A made-up vocabulary in which a merge brings up a pair of lower rank: one occurrence at a time is contracted there."""
    monkeypatch.setattr(byte_bpe, "LONG", 0)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"aba": 290, b"cab": 280, b"abab": 310, b"bb": 305, b"abaab": 270}
    monkeypatch.setattr(byte_bpe, "read_ranks", lambda path: ranks)
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(2, 40))) for _ in range(300)]

    def one_by_one(word):
        parts = [bytes([b]) for b in word.encode()]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    assert [ids.tolist() for ids in byte_bpe.DuckBpe("", public_tokenizers.PATTERN).encode(words)] == [one_by_one(w) for w in words]


def test_both_engines_find_the_same():
    import regex

    find, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(4)
    bpe = byte_bpe.DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert bpe.latin
    every = [chr(c) for c in range(0x250)] + [*"'sdmtlrev  \t\n\x1c\x1f"] * 9
    for _ in range(3000):
        text = "".join(rng.choices(every, k=rng.randint(0, 30)))
        assert bpe.find(text) == find(text)


def test_bytes_come_from_the_ids(spark, docs):
    """A wrong id shows in the decoded bytes; a spoiled vocabulary shows in every one of them, long pieces and whole tokens included."""
    bpe = byte_bpe.DuckBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    wrong = bpe.ranks[b" of"]
    bpe.ranks[b"the"] = wrong
    ids = bpe.encode(["the", "hello the world", "x" * 5000, "Donaudampfschifffahrt"])
    assert ids[0].tolist() == [wrong] and bpe.decode(ids)[:1] == [b" of"]
    bpe.db.execute("UPDATE vocabulary SET piece = '#'")
    assert bpe.decode(ids) == [b"#" * len(i) for i in ids]


def test_pipeline_ends_with_ids(spark, docs):
    import corpus_pipeline

    last = corpus_pipeline.byte_bpe(spark, docs, "")
    assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in last.collect())


# 7: mixing


def water(sizes, weights, passes=3):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(passes * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [passes * s if i in capped else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and t[i] > passes * sizes[i] + 1e-9}
        if not over:
            return t
        capped |= over


def check_mix(got, rows, close):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, water([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    same_rows([(r.doc_id, r.size, r.source_size) for r in got], [(i, size(t), total[s]) for i, t, s in rows])
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source])
    for s in names:
        assert abs(taken[s] - target[s]) <= close * max(1, target[s]) + mixing.BLOCK, (s, taken[s], target[s])


def test_mix(spark, docs, rows, small):
    check_mix(mixing.Mix(docs).taken().collect(), [(r[0], r[1], r[3]) for r in rows], 0.02)
    table = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.Mix(table).taken()
    check_mix(got.collect(), [(r.doc_id, r.text, r.source) for r in table.collect()], 0.02)
    same_rows(got.collect(), mixing.Mix(table.repartition(5)).taken().collect())


def test_mixed_documents(docs, rows):
    taken = Counter()
    for r in mixing.Mix(docs).taken().collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words, texts = Counter(), defaultdict(set)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        texts[r.doc_id].add(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})
    source = {r[0]: set((r[1] or "").split()) for r in rows}
    assert all(set(t.split()) <= source[i] | set("one".split()) for i, ts in texts.items() for t in ts)


def spark_hash(*values):
    """Spark's xxhash64 of long, int (as (int,)) and string columns."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(4, "little", signed=True) if isinstance(v, tuple) else int(v).to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


def brute_permuted(i, n, key):
    x = i % n
    for turn in range(1, mixing.ROUNDS + 1):
        partner = (spark_hash((key,), (turn,)) % n - x) % n
        if spark_hash(max(x, partner), (key,), (turn,)) & 1:
            x = partner
    return x


def test_permutations(spark):
    for n in (1, 2, 7, 1000, 20_011):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        if n > 500:
            at = np.array([r.p for r in spark.range(n).orderBy("id").select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()])
            # no rotation or other affine map, and no trace of the order
            assert Counter(np.diff(at) % n).most_common(1)[0][1] < 12 and abs(np.corrcoef(at, np.arange(n))[0, 1]) < 0.12
    rows = spark.range(1 << 12).select(mixing.scattered(F.col("id"), 6).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(1 << 12))
    big = 2_000_000_011
    got = spark.createDataFrame([(i,) for i in (0, 5, big - 1, big + 7)], "i long").select(mixing.permuted(F.col("i"), F.lit(big), F.lit(2)).alias("p")).collect()
    assert [r.p for r in got] == [brute_permuted(i, big, 2) for i in (0, 5, big - 1, big + 7)]


def brute_mix(rows):
    """(doc, source, taken, position, {shard: words}) of (doc_id, text, source) rows, in plain Python."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, many = Counter(), Counter()
    for _, t, s in rows:
        total[s] += size(t)
        many[s] += 1
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    targets = water([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    chunks = max(mixing.CHUNKS, -(-max(many.values()) // mixing.CHUNK_ROWS))
    slots, blocks = [], []
    for o, s in enumerate(names):
        n = -(-total[s] // mixing.BLOCK)
        blocks.append(n)
        slots.append(min(int(targets[o] * n / total[s] + 0.5), 3 * n) if total[s] else 0)
    half = max(1, -(-max(1, (sum(slots) - 1).bit_length()) // 2))
    mask = (1 << half) - 1

    def feistel(a):
        left, right = a >> half, a & mask
        for turn in range(4):
            left, right = right, left ^ (spark_hash(right, (mixing.SEED + turn,)) & mask)
        return (left << half) + right

    layout = sorted((feistel(first), o, j) for o, start in enumerate(np.cumsum([0, *slots])[:-1].tolist()) for j in range(slots[o]) for first in [start + j])
    drawn = defaultdict(list)
    for position, (_, o, j) in enumerate(layout):
        drawn[o, brute_permuted(j, blocks[o], o)].append(position)
    out = []
    for o, s in enumerate(names):
        own = sorted(((spark_hash(i, spark_hash(t)) % chunks, i, spark_hash(t), size(t)) for i, t, src in rows if src == s))
        start = 0
        for _, i, _, n in own:
            taken, shards, at = 0, Counter(), []
            for b in range(start // mixing.BLOCK, (start + n - 1) // mixing.BLOCK + 1 if n else 0):
                words = min(start + n, (b + 1) * mixing.BLOCK) - max(start, b * mixing.BLOCK)
                for p in drawn[o, b]:
                    shards[p // mixing.SHARD_SLOTS] += words
                    taken += words
                    at.append(p)
            out.append((i, s, n, taken, min(at, default=None), " ".join(f"{k}:{v}" for k, v in sorted(shards.items()))))
            start += n
    return out


def test_mix_by_brute_force(spark, small, monkeypatch):
    """Every document's words, position and shards, recomputed: targets, slots, layout, permutations, streams and blocks."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 32)
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()] + [(10**6, None, "src0"), (10**6 + 1, "", None), (10**6 + 2, "few words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.Mix(docs).taken().collect()
    same_rows([(r.doc_id, r.source, r.size, r.taken, r.position, r.shards) for r in got], brute_mix(rows))


def test_shard_draw_reaches_the_results(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    table = spark.read.parquet(f"{small}/documents.parquet")
    mix = mixing.Mix(table)
    slots, sources = mix.slots().collect(), {r.ordinal: r for r in mix.sources.collect()}
    n = len(slots)
    assert sorted(r.position for r in slots) == list(range(n)) and all(r.shard == r.position // 16 for r in slots)
    counts = Counter((r.shard, r.ordinal) for r in slots)
    for o, s in sources.items():
        own = [counts[k, o] for k in range(n // 16)]
        share = s.slots / n
        assert sum(r.ordinal == o for r in slots) == s.slots
        # within a wide band around the variance of a multinomial draw: neither even counts nor one source after the other
        assert share < 0.1 or 0.4 < np.var(own) / (16 * share * (1 - share)) < 1.8
    shards = Counter()
    for r in mixing.op7_mixing(spark, small).collect():
        own = [tuple(map(int, p.split(":"))) for p in r.shards.split()]
        assert sum(w for _, w in own) == r.taken and (r.position is None) == (not own)
        assert not own or own[0][0] == r.position // 16
        shards.update(dict(own))
    full = Counter(r.shard for r in slots)
    assert set(shards) == set(full) and all(shards[k] > (v - 3 * len(sources)) * mixing.BLOCK and shards[k] <= v * mixing.BLOCK for k, v in full.items())
    first = {(r.source, r.doc_id): r.position for r in mix.taken().collect()}
    at = [r.source for r in mixing.mix_documents(table).collect()]
    assert sum(a != b for a, b in zip(at, at[1:], strict=False)) > len(at) / 4
    assert min(first.items(), key=lambda kv: (kv[1] is None, kv[1]))[0][0] == at[0]


# 8: SimHash


def brute_fingerprint(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    """{doc: smallest reachable doc} by all pairs."""
    up = list(range(len(marks)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 4:
                up[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(marks):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, f, low.get(root(i))) for i, (doc, f) in enumerate(marks)]


def test_simhash(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    same_rows([(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got], brute_components([(r[0], brute_fingerprint(r[1], 4)) for r in rows]))


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(marks):
    """{smallest document of each group} by all pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more; equal sets are one."""
    sets = defaultdict(list)
    for doc, text in marks:
        sets[shingle_set(text)].append(doc)
    names, up = list(sets), list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            if a and b and 0.8 * len(a) <= len(b) <= len(a) / 0.8 and (both := len(a & b)) >= 0.8 * (len(a) + len(b) - both):
                up[root(i)] = root(j)
                links += 1
    low = defaultdict(list)
    for i, a in enumerate(names):
        low[root(i)] += [d for d in sets[a] if d is not None] or []
    return {min(ids) for ids in low.values() if ids}, links


def test_near_representatives(spark, docs, rows):
    kept = simhash.near_representatives(docs)
    expected, links = brute_groups([(r[0], r[1]) for r in rows])
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected and links > 10


def test_near_copies_of_many_kinds(spark):
    """Pairs from 0.5 to 1, a group of 300 near copies, short texts: nothing below 0.8 is linked, nearly all from 0.8 on are."""
    rng, rows = random.Random(21), []
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    for i in range(400):
        base = [word() for _ in range(rng.choice([30, 80, 300]))]
        other = base.copy()
        for _ in range(int(len(base) * rng.uniform(0, 0.06))):
            other[rng.randrange(len(other))] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    base = [word() for _ in range(400)]
    rows += [(1000 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(300)]
    kept = {r.doc_id for r in simhash.near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected, links = brute_groups(rows)
    assert expected <= kept and len(kept - expected) <= 0.03 * (len(rows) - len(expected)) and links > 40_000


def test_texts_go_out_in_small_batches(spark):
    """Before it encodes, the session's batches are bounded by bytes, not by 10,000 rows alone; a smaller bound stays."""
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set(name, "64m")
        rows = spark.createDataFrame([(i, "a b " * 5000) for i in range(600)], "doc_id long, text string").coalesce(1)
        assert byte_bpe.encode_documents(rows).count() == 600
        sizes = rows.mapInArrow(lambda batches: (type(b).from_arrays([b.column(0).slice(0, 1)], names=["doc_id"]) for b in batches), "doc_id long")
        assert sizes.count() >= 2 and spark.conf.get(name) == str(common.SLICE_BYTES)
        spark.conf.set(name, "1m")
        byte_bpe.encode_documents(rows)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_no_link_at_the_threshold_is_lost(spark):
    """Pairs of exactly 0.8, which fingerprints tell apart from others only mostly, with a closing line that all long texts share."""
    rng, rows = random.Random(8), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for i in range(1500):
        base = [word() for _ in range(12)] if i % 2 else [word() for _ in range(30)] + "the same closing line of them all".split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([word() for _ in range((len(base) - 4) // 4)] + base))]
    kept = {r.doc_id for r in simhash.near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(1500)}


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    time.sleep(0.3)
    spark.range(1).count()  # Spark's figures follow with the next event
    context.listenerBus().waitUntilEmpty(30_000)
    machines = context.statusStore().executorList(False)
    return sum(machines.apply(i).totalShuffleWrite() for i in range(machines.size()))


def test_near_dedup_deals_out_less_than_the_texts(spark):
    """Shuffles of texts, or of all their seldom shingles with what belongs to each, fill the disks: less is written than the texts' bytes."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = [(i, " ".join(word() for _ in range(400))) for i in range(1500)]
    rows += [(2000 + i, " ".join([*rows[i][1].split()[:390], *(word() for _ in range(10))])) for i in range(30)]
    docs = spark.createDataFrame([*rows, *rows[100:120], *rows[1500:1510]], "doc_id long, text string").repartition(4).persist()
    docs.count()
    before = shuffled(spark)
    kept = simhash.near_representatives(docs).collect()
    assert shuffled(spark) - before < sum(len(t) for _, t in rows)
    # rows that repeat stay once
    assert sorted(r.doc_id for r in kept) == list(range(1500)) and {(r.doc_id, r.text) for r in kept} == set(rows[:1500])
    docs.unpersist()


def test_parities_drop_nothing_similar():
    """Texts differ in as many shingles as their parities say, or more; equal ones in none."""
    rng = np.random.default_rng(5)
    for a, b, both in [(0, 3, 0), (1, 1, 0), (5, 5, 4), (64, 65, 60), (300, 240, 235), (1000, 1200, 0), (40_000, 100, 50), (20_000, 20_000, 19_000)]:
        common, x, y = (rng.integers(0, 1 << 63, n, np.uint64) for n in (both, a - both, b - both))
        x, y = np.concatenate((common, x)), np.concatenate((common, y))
        apart = simhash.least_apart(simhash.parities(x), simhash.parities(y))
        assert apart == simhash.least_apart(simhash.parities(y), simhash.parities(x)) <= len(np.setxor1d(x, y)) and simhash.least_apart(simhash.parities(x), simhash.parities(x)) == 0
        assert both or not a or apart > 0


def test_repeated_shingles_are_marked(spark):
    """What two texts have is marked, whatever else is; keys by their hash as well."""
    rng = np.random.default_rng(6)
    both, sets = rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2), []
    for i in range(200):
        own = rng.integers(0, 1 << 63, 2000, np.uint64) * np.uint64(2) + np.uint64(1)
        sets.append(np.concatenate((own, both[i : i + 2])))
    rows = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, size int, seldom binary").repartition(3)
    marks = simhash.repeated_tokens(rows, sum(map(len, sets)))
    assert marks.has(both[1:200]).all() and marks.has(np.concatenate([x[:-2] for x in sets])).mean() < 0.05
    found = {r.node: (np.frombuffer(r.seldom, np.uint64), np.frombuffer(r.at, np.int32), r.size) for r in simhash.shared_tokens(rows, marks).collect()}
    for i, x in enumerate(sets):
        tokens, at, size = found[i]
        assert set(x[-2:].tolist()) & set(both[1:200].tolist()) <= set(tokens.tolist()) and (x[at] == tokens).all() and size == len(x)
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    held = held_keys(keys)
    assert held[0] == 500 and held[1] < 5000 * 0.2


def held_keys(keys):
    """How many of the marked tenth of the keys are found, and how many of all."""
    few = keys.where("cast(key as int) % 10 = 0")
    found = keys.where(common.marked_keys(few, "key").of(F.xxhash64("key")))
    return found.where("cast(key as int) % 10 = 0").count(), found.count()


def test_hot_join(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(900)] + [(None, 5), (1001, 777_777)], "doc_id long, k long")
    values = rows.where("k <> 777777").groupBy("k").agg(F.min("doc_id").alias("low"), F.count("*").alias("many"))
    got = common.hot_join(rows, values, "k", "low", "doc_id")
    low = {r.k: r.low for r in values.collect()}
    assert got.columns == ["doc_id", "k", "low"]
    same_rows(got.collect(), [(r.doc_id, r.k, low.get(r.k)) for r in rows.collect()])


def test_simhash_links(spark):
    rng = np.random.default_rng(11)
    values = rng.integers(0, 2**64, 60, dtype=np.uint64).tolist()
    for v in list(values):  # chains and balls around each
        for _ in range(12):
            v ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            values.append(v)
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fingerprint long")
    labels = {r.node % 2**64: r.label for r in simhash.connected(simhash.link_edges(frame)).collect()}
    expected = brute_components(list(enumerate(values)))
    groups, own = defaultdict(set), defaultdict(set)
    for i, v, c in expected:
        groups[c].add(v)
        own[labels.get(v, ("alone", v))].add(v)
    assert Counter(map(frozenset, groups.values())) == Counter(map(frozenset, own.values()))
    for m in (5, 6, 7):
        monkey = simhash.blocks_for
        try:
            simhash.blocks_for = lambda n, link=4, m=m: m
            again = {r.node % 2**64: r.label for r in simhash.connected(simhash.link_edges(frame)).collect()}
        finally:
            simhash.blocks_for = monkey
        assert again == labels


# 9: toxicity


def test_ordinal_regression():
    rng = np.random.default_rng(2)
    x = rng.poisson(0.5, (4000, 4)).astype(float)
    z = x @ np.array([2.0, 1.0, 0.0, -1.0]) + rng.logistic(size=4000)
    w, t = toxicity.fit_ordinal(x, np.searchsorted([1.0, 2.5], z), 2)
    assert np.abs(w - [2, 1, 0, -1]).max() < 0.25 and np.abs(t - [1, 2.5]).max() < 0.25


def test_toxicity(spark, docs, small):
    d = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 3 <> 1")
    got = toxicity.severity(table, toxicity.fit(table, train)).join(labels.where("doc_id % 3 = 1"), "doc_id").select("severity", "p_toxic", F.col("grade"), labels["toxic"].alias("label"), (F.col("p_toxic") >= 0.5).alias("found")).collect()
    hit = [r for r in got if r.found]
    assert np.mean([r.label for r in hit]) > 0.85 and sum(r.label for r in hit) / sum(r.label for r in got) > 0.75
    model = toxicity.Model({toxicity.features_of("scum")[0]: 5.0}, np.array([2.0, 3.0, 4.0]))
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == docs.count()
    none = toxicity.severity(docs, toxicity.fit(docs, spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int"))).collect()
    assert all(r.severity == 0 for r in none)


def brute_score(model, text):
    """Severity, P(grade > 0) and grade of a text, one feature at a time."""
    z = 0.0
    counts = Counter(c for w in toxicity.words_of((text or "").encode()) for c in toxicity.features_of(w))
    for code, weight in model.weights.items():
        z += weight * (float(any(c in counts for c in model.typical)) if code == toxicity.ANY else np.log1p(counts[code]))
    above = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
    each = -np.diff([1.0, *above, 0.0])
    return sum(above), above[0], int(np.argmax(each))


def test_severity_by_brute_force(spark, docs, rows, small):
    """Every score recomputed, ties, repeated rows, nulls and long texts included; grades of the fit are the labels' own."""
    table, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(table, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    for frame, texts in ((docs, [(r[0], r[1]) for r in rows]), (table, [(r.doc_id, r.text) for r in table.collect()])):
        got = toxicity.severity(frame, model).collect()
        expected = [(i, *brute_score(model, text)) for i, text in texts]
        key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 6))
        for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) and a[2] == pytest.approx(b[2], abs=1e-9) and a[3] == b[3] and a[4] == (b[2] >= 0.5)


def test_small_language_keeps_its_typical_words(spark):
    """Eight toxic rows of one language among 500 toxic rows of another; no word occurs in both languages."""
    rng, rows = np.random.default_rng(6), []
    for i in range(5100):
        lang, bad = ("big", i % 10 == 0) if i < 5000 else ("tiny", i % 12 == 0)
        own = ["".join(chr(97 + d) for d in k) + lang for k in rng.integers(0, 26, (30, 3))]
        rows.append((i, " ".join(own[:15] + [f"{lang[::-1]}scum"] * bad + own[15:]), int(bad), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    got = toxicity.severity(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).withColumnRenamed("toxic", "found").join(docs, "doc_id").collect()
    for lang in ("big", "tiny"):
        assert all(r.found == bool(r.toxic) for r in got if r.lang == lang), lang


def test_only_copies_share_a_signature():
    """Documents that share some pairs stay apart, copies and most near copies don't."""
    rng = np.random.default_rng(8)
    common = [f"c{i} d{i}" for i in range(40)]
    texts = [" ".join(common[k] for k in rng.permutation(40)[:20]) + " " + " ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(200)]
    own = [toxicity.signature(toxicity.words_of(re.sub(r"\d", lambda m: chr(97 + int(m[0])), t).encode())) for t in texts]
    assert len(set(own)) > 190
    long = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x" for k in rng.integers(0, 676, 400)]
    near = [toxicity.signature([*long[:i], "changed", *long[i + 1 :]]) for i in range(400)]
    assert toxicity.signature(long.copy()) == toxicity.signature(long) and np.mean([s == toxicity.signature(long) for s in near]) > 0.9


# 10: top-k


def test_topk(spark):
    rng = np.random.default_rng(4)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType()), T.StructField("cell", T.IntegerType())])
    rows = [(i, (rng.normal(size=6) * 0.3 + i % 4).astype(np.float32).tolist(), "x", 1) for i in range(900)]
    rows += [(100, rows[100][1], "x", 1), (2000, [float("nan")] * 6, None, None), (2100, None, None, None), (2200, [1.0, None], None, None), (2300, [], None, None), (2400, [0.5], None, None), (None, [1.0], None, None), (-100, rows[4][1], None, None), (2500, [float("inf")], None, None)]
    frame = spark.createDataFrame(rows, schema)
    vectors = topk.whole_vectors(frame)
    got = topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0)).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    expected = []
    for at, (q, e) in enumerate(good):  # every row is a query of its own, and no candidate of itself alone
        if q % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(e, f, strict=False)), i) for to, (i, f) in enumerate(good) if to != at))[:10]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    same_rows(got, expected)
    few = topk.whole_vectors(spark.createDataFrame(rows[:1] + rows[5:8] + [(100, [3e30] * 6, "x", 1)], schema))
    assert few.count() == 5 and topk.top_k(few, few.where("vec_id = 0")).count() == 4


def check_cover(node, rows):
    """Nesting, covering and separation, level by level."""
    d = lambda a, b: float(np.linalg.norm(rows[a] - rows[b]))
    assert all(d(p, node.centre) <= node.radius * (1 + 1e-12) for p in node.points)
    if node.kids:
        scale = node.radius / topk.BASE
        centres = [kid.centre for kid in node.kids]
        assert centres[0] == node.centre and sorted(np.concatenate([kid.points for kid in node.kids]).tolist()) == sorted(node.points.tolist())
        assert all(kid.radius <= scale for kid in node.kids) and all(d(a, b) > scale for i, a in enumerate(centres) for b in centres[:i])
        for kid in node.kids:
            check_cover(kid, rows)


def test_cover_tree_prunes():
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(30, 16)) * 4000
    rows = np.floor(np.concatenate([m + rng.normal(size=(500, 16)) * 60 for m in middle]))
    tree = topk.cover_tree(rows, leaf=8)
    assert tree.kids
    check_cover(tree, rows)
    asked = np.arange(0, len(rows), 25)
    best, best_id, found, pairs = topk.dual_tree_top_k(rows[asked], asked, rows, np.arange(len(rows)))
    score = (rows[asked] @ rows.T).astype(np.int64)
    score[np.arange(len(asked)), asked] = np.iinfo(np.int64).min
    order = np.lexsort((np.broadcast_to(np.arange(len(rows)), score.shape), ~score), axis=1)[:, :10]
    assert (best_id == order).all() and (found == 10).all() and pairs < 0.1 * len(asked) * len(rows)


def test_topk_cells(spark, monkeypatch):
    """Clusters, copies of one vector over many pieces, and terms that cancel: the cells' results are brute force's."""
    monkeypatch.setattr(topk, "GROUP", 40)
    rng = np.random.default_rng(13)
    middle = rng.normal(size=(12, 8)) * 3
    rows = [(i, (middle[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(300)] + [(1100, [1.0] * 8)] * 3
    rows += [(5000 + i, [3e9, -3e9 + i, 1e-3 * i, *[0.0] * 5]) for i in range(60)] + [(6000, [1e9, 1e9, *[0.0] * 6])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    expected = []
    for at, (q, e) in enumerate(whole):
        if q % 100 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(e, f, strict=True)), -(2**63) + 1), 2**63 - 1), i) for to, (i, f) in enumerate(whole) if to != at)[:10]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    same_rows(got, expected)


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = topk.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    for df in (
        exact_dedup.duplicate_classes(empty), exact_dedup.drop_copies(empty), pii.find_pii(empty), sharding.shard_documents(empty), language_id.identify(empty, language_id.fit(empty)), byte_bpe.encode_documents(empty),
        mixing.Mix(empty).taken(), mixing.mix_documents(empty), simhash.near_duplicates(empty), simhash.near_representatives(empty), toxicity.severity(empty, toxicity.fit(empty, labels)), topk.top_k(vectors, vectors),
    ):
        assert df.count() == 0
    folder = new_folder(spark, "tokens")
    assert token_files.write_token_files(empty, folder) == [] and token_files.read_token_files(spark, folder).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, at, small).write.parquet(folder)
        after = spark.read.parquet(folder)
        assert after.columns == docs.columns
        if name == "exact_dedup":
            _, groups = brute_classes([(r.doc_id, r.text) for r in at.collect()])
            assert sorted(r.doc_id for r in after.collect()) == sorted(min(i) for i in groups.values())
        if name == "near_dedup":
            # five words and a similarity of 0.8, as stages on word shingles take unless a contract says otherwise
            assert {r.doc_id for r in after.collect()} == brute_groups([(r.doc_id, r.text) for r in at.collect()])[0]
        at = after
    own = encoding()
    last = corpus_pipeline.STAGES[-1][1](spark, at, small).collect()
    same_rows([(r.doc_id, r.n_tokens) for r in last], [(r.doc_id, len(own.encode_ordinary(r.text))) for r in at.collect()])
    assert corpus_pipeline.run(spark, small).count() == len(last)


def test_byte_bpe_cache_overflow_and_portions_change_nothing(monkeypatch):
    """A cache of a few words and queries of a few bytes give tiktoken's ids and the texts' bytes."""
    import random

    import public_tokenizers
    import tiktoken

    from folioscope.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "MEMORY", 12)
    monkeypatch.setattr(byte_bpe, "PORTION", 40)
    path, pick = byte_bpe.tokenizer_path(byte_bpe.VOCABULARY), random.Random(5)
    bpe = byte_bpe.DuckBpe(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    words = ["".join(pick.choices("abeinrstéüß", k=pick.randint(2, 14))) for _ in range(30)]
    for _ in range(12):
        texts = [" ".join(pick.choices(words, k=pick.randint(0, 9))) for _ in range(4)]
        got = bpe.encode(texts)
        assert [ids.tolist() for ids in got] == [plain.encode_ordinary(text) for text in texts]
        assert bpe.decode(got) == [text.encode() for text in texts]


def test_alike_texts_make_few_pairs(spark):
    """Of a large group of texts that are alike, but not at the similarity, hardly a pair leaves the tokens' parts; no pair at it is lost."""
    rng = np.random.default_rng(8)
    core, sets, pairs = rng.integers(0, 1 << 63, 400, np.uint64), [], set()
    for i in range(600):
        n = 400 if i % 3 == 0 else 100  # of 500 and 520 hashes, or 140: parities of several widths
        x = np.concatenate((core[:n], rng.integers(0, 1 << 63, 200 if n == 400 else 40, np.uint64)))
        sets.append(x[:500] if n == 400 else x)
        if i % 20 == 0:
            pairs.add((len(sets) - 1, len(sets)))
            sets.append(np.concatenate((x[:500], rng.integers(0, 1 << 63, 20, np.uint64))) if n == 400 else np.concatenate((x[:-5], rng.integers(0, 1 << 63, 5, np.uint64))))
    rows = []
    for i, x in enumerate(sets):
        many = len(x) - int(np.ceil(simhash.SIMILAR * len(x))) + 1
        rows.append((i, i, len(x), bytearray(simhash.parities(x)), bytearray(x[:many].tobytes()), bytearray(np.arange(many, dtype=np.int32).tobytes())))
    placed = spark.createDataFrame(rows, "node long, label long, size int, odd binary, seldom binary, at binary").repartition(3)
    found = [(r.a, r.b) for r in simhash.missed_edges(placed, sum(len(r[4]) // 8 for r in rows)).collect()]
    assert len(found) == len(set(found)) and pairs <= set(found) and len(found) < 5 * len(sets)
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (both := len(np.intersect1d(sets[i], sets[j]))) >= simhash.SIMILAR * (len(sets[i]) + len(sets[j]) - both)}
    assert similar <= set(found)


@pytest.mark.parametrize("stage", ["toxicity", "exact_dedup", "near_dedup"])
def test_encoders_do_not_outlive_their_stage(spark, docs, stage):
    """Spark gives a worker to any stage; an encoder that stays takes its memory from the stages that follow."""

    def encoders(batches):
        import gc

        for batch in batches:
            n = sum(type(x).__name__ == "DuckBpe" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    def held():
        return sum(r.n for r in spark.range(0, 64, numPartitions=64).mapInArrow(encoders, "n long").collect())

    rows = docs.repartition(64)
    byte_bpe.encode_documents(rows).write.format("noop").mode("overwrite").save()
    assert held()
    labels = docs.selectExpr("doc_id", "pmod(doc_id, 2) = 0 as toxic", "0 as quality")
    made = {"toxicity": lambda: toxicity.drop_toxic(rows, toxicity.fit(rows, labels)), "exact_dedup": lambda: exact_dedup.drop_copies(rows), "near_dedup": lambda: simhash.near_representatives(rows)}[stage]()
    made.write.format("noop").mode("overwrite").save()
    assert held() == 0


def test_free_memory_goes_back():
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) >> 10

    def run(batches):
        for _ in batches:
            parts = [pa.array([b"x" * 100_000] * 10) for _ in range(150)]  # 150 MB
            yield len(parts)

    before = resident()
    assert list(common.frugal(run)(iter([None]))) == [150]
    assert resident() - before < 60
