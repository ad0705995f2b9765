"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, in an order fixed by hashes and identifiers, packed into blocks of BLOCK words. The
mix has as many slots as the targets ask for. Its layout is a pseudorandom bijection (a Feistel network) of the numbered
(source, ordinal) slots, whose order gives the positions; an output shard is a run of SHARD_SLOTS positions, so the number of slots that each
source gets in a shard is a multinomial draw, conditioned on the sources' totals, which therefore come out exactly.
Which blocks are taken follows from the totals alone; the draw decides their shards and positions, which are part of the results.
Ordinal j of a source with n blocks stands for one of its blocks in the (j div n)-th pass, by a pseudorandom
permutation of 0..n-1 with a key of its own for each source: ROUNDS rounds of swap-or-not, which is a bijection for every n. Slots and the documents' pieces of blocks are joined by source and block index.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; a target is at most 3 times its source's size and the
rest is shared by weight (water filling). A block is taken at most 3 times, so no document exceeds 3 times its size.

Defined results: a null or empty text has size 0 and is taken 0 times; an empty table gives an empty result; a null source is
a source of its own; rows that repeat are separate pieces of the stream. Only identifier, text and source are read by
name; other columns pass through `mix_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.llm.common import kept_on_disk, scaled, table

#: Words in a block.
BLOCK = 128
#: Positions in an output shard.
SHARD_SLOTS = 4096
#: Times the same block may be taken.
PASSES = 3
#: The weights, by the place of the source.
WEIGHTS = (5, 2, 1)
#: Rows of one source that a chunk of its stream holds, about, and chunks at least; slots that one step lays out.
CHUNK_ROWS, CHUNKS, CHUNK_SLOTS = 20_000, 128, 1 << 16
#: Ranges of the layout that are numbered apart; a fixed number, as one task adds up their counts.
RANGES = 1024
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the index permutations.
ROUNDS = 24


def permuted(i: Column, n: Column, key: Column) -> Column:
    """A pseudorandom bijection of 0..n-1: each round pairs x with k - x (mod n) and a hash of the larger says whether to swap."""

    def swap_or_not(x: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, turn), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, partner), key, turn).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.pmod(i.cast("long"), n.cast("long")), swap_or_not)


def scattered(a: Column, half: int) -> Column:
    """A bijection of 0..4**half - 1: four rounds of a Feistel network."""
    mask = (1 << half) - 1
    left, right = F.shiftright(a, half), a.bitwiseAND(mask)
    for turn in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(SEED + turn)).bitwiseAND(mask))
    return F.shiftleft(left, half) + right


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """From (source, source_size): ordinal, target words, blocks and slots of each source."""
    place = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("ordinal", F.row_number().over(place) - 1).withColumn("weight", F.get(cycle, F.col("ordinal") % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * float(passes)).withColumn("ratio", F.col("cap") / F.col("weight"))
    # water filling: sources reach their cap in the order of cap / weight; the level is set by the first that does not
    order = W.orderBy("ratio", "ordinal")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumns({
        "all_size": F.sum("source_size").over(everything).cast("double"),
        "all_weight": F.sum("weight").over(everything),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "capped_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("level", (F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
    level = F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "ordinal", "level"))).over(everything)["level"], F.max("ratio").over(everything))
    rows = rows.withColumn("target", F.least("cap", F.col("weight") * level))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * passes)).otherwise(F.lit(0))
    rows = rows.withColumn("slots", slots.cast("long"))
    first = F.coalesce(F.sum("slots").over(W.orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("source", "ordinal", "source_size", "target", "blocks", "slots", first.alias("first_slot"))


class Mix:
    """The parts of a mix; nothing larger than the table of sources is gathered."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        text = F.col(text_col).cast("string")
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        self.rows = kept_on_disk(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("code"), F.col(source_col).alias("source"), size.alias("size")))
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        self.sources = kept_on_disk(source_targets(sizes))
        counts = sizes.agg(F.coalesce(F.max("n_rows"), F.lit(0))).first()
        slots = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        self.chunks = scaled(counts[0], CHUNK_ROWS, CHUNKS)
        self.half = max(1, -(-max(1, int(slots - 1).bit_length()) // 2))

    def slots(self) -> DataFrame:
        """A row per slot of the mix: shard, position (0 to the number of slots), ordinal of its source, pass and block index."""
        runs = self.sources.where("slots > 0").select("ordinal", "blocks", "slots", "first_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK_SLOTS))).alias("run"))
        start = F.col("run") * CHUNK_SLOTS
        spread = runs.repartition("ordinal", "run")
        one = spread.select("ordinal", "blocks", "first_slot", F.explode(F.sequence(start, F.least(start + CHUNK_SLOTS, F.col("slots")) - 1)).alias("j"))
        place = scattered(F.col("first_slot") + F.col("j"), self.half)
        one = one.withColumn("place", place).withColumn("range", F.floor(F.col("place") * RANGES / F.lit(4**self.half)))
        counts = one.groupBy("range").agg(F.count("*").alias("n"))
        counts = counts.select(F.col("range").alias("of"), (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
        one = one.join(F.broadcast(counts), F.col("range") == F.col("of"))  # RANGES rows at most
        position = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("place")) - 1
        one = one.withColumn("position", position.cast("long"))
        return one.select(
            F.floor(F.col("position") / SHARD_SLOTS).alias("shard"),
            "position",
            "ordinal",
            F.floor(F.col("j") / F.col("blocks")).alias("pass"),
            permuted(F.col("j"), F.col("blocks"), F.col("ordinal")).alias("block"),
        )

    def streams(self) -> DataFrame:
        """The rows with size and source, `copy` among equal rows, and `start`, their first word's place in the source's stream."""
        s = self.sources.select(F.col("source").alias("of"), "ordinal", "source_size", "target")
        rows = self.rows.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "code"), F.lit(self.chunks)))
        totals = rows.groupBy("ordinal", "chunk").agg(F.sum("size").alias("words"))
        totals = totals.select("ordinal", "chunk", (F.sum("words").over(W.partitionBy("ordinal").orderBy("chunk")) - F.col("words")).alias("before"))
        inside = W.partitionBy("ordinal", "chunk").orderBy("doc_id", "code", "size").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("turn", F.row_number().over(W.partitionBy("ordinal", "chunk").orderBy("doc_id", "code", "size")))
        rows = rows.join(totals, ["ordinal", "chunk"])
        return rows.select("doc_id", "code", "source", "size", "ordinal", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))

    def pieces(self, rows: DataFrame) -> DataFrame:
        """The blocks that each row with words lies in: `at` is the first word of it there, `words` how many."""
        last = F.col("start") + F.col("size") - 1
        cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))))
        low = F.greatest(F.col("start"), F.col("block") * BLOCK)
        high = F.least(last + 1, (F.col("block") + 1) * BLOCK)
        return cut.select("doc_id", "code", "start", "ordinal", "block", (low - F.col("start")).alias("at"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """The rows with `taken`, the words of theirs that the mix has, `position`, the first slot with any, and `shards`, the words in each shard as "shard:words"."""
        rows = kept_on_disk(self.streams())
        slots = self.slots().select("ordinal", "block", "shard", "position")
        # both sides of these joins grow with the data, so neither may be broadcast
        row = ("ordinal", "start", "doc_id", "code")
        drawn = self.pieces(rows).join(slots.hint("merge"), ["ordinal", "block"]).groupBy(*row, "shard").agg(F.sum("words").alias("words"), F.min("position").alias("position"))
        shards = F.transform(F.sort_array(F.collect_list(F.struct("shard", "words"))), lambda s: F.concat_ws(":", s["shard"].cast("string"), s["words"].cast("string")))
        drawn = drawn.groupBy(*row).agg(F.sum("words").alias("words"), F.min("position").alias("position"), F.array_join(shards, " ").alias("shards"))
        drawn = drawn.select(F.col("ordinal").alias("o"), F.col("start").alias("s"), "words", "position", "shards")
        # a row with words is the only one that starts at its place in the stream
        same = (F.col("ordinal") == F.col("o")) & (F.col("start") == F.col("s")) & (F.col("size") > 0)
        return rows.join(drawn.hint("merge"), same, "left").select("doc_id", "code", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "position", F.coalesce("shards", F.lit("")).alias("shards"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of docs: one for each document and pass from which words are taken, with those words as its text.

    A document that a pass takes whole keeps its text as it is; else the words taken stand in order, one space between.
    The rows come in the order of the first position that each has in the mix, so every run of them holds the sources as drawn.
    """
    mix = Mix(docs, id_col, text_col, source_col)
    rows = mix.streams()
    drawn = mix.pieces(rows).join(mix.slots().select("ordinal", "block", "pass", "position").hint("merge"), ["ordinal", "block"])
    passes = drawn.groupBy("doc_id", "code", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("cuts"), F.min("position").alias("position"))
    # rows that repeat have pieces of their own; the k-th of them takes the k-th start
    starts = passes.groupBy("doc_id", "code", "start").agg(F.collect_list(F.struct("pass", "cuts", "position")).alias("passes"))
    plan = starts.groupBy("doc_id", "code").agg(F.sort_array(F.collect_list(F.struct("start", "passes"))).alias("turns"))
    plan = plan.select(F.col("doc_id").alias("of_id"), F.col("code").alias("of_code"), "turns")
    names = docs.columns
    wide = docs.toDF(*(f"c{i}" for i in range(len(names))))
    c = {n: f"c{i}" for i, n in enumerate(names)}
    text = F.col(c[text_col])
    wide = wide.withColumn("id", F.col(c[id_col])).withColumn("code", F.xxhash64(text.cast("string")))
    wide = wide.withColumn("turn", F.row_number().over(W.partitionBy("id", "code").orderBy("id")))
    wide = wide.join(plan.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("code") == F.col("of_code")))
    wide = wide.withColumn("own", F.get("turns", F.col("turn") - 1)["passes"]).where("own is not null")
    wide = wide.select(*c.values(), F.explode("own").alias("one"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    whole = F.aggregate("one.cuts", F.lit(0).cast("long"), lambda a, s: a + s["words"]) == F.regexp_count(text, F.lit(WORD))
    # equal shares of a document in one pass never overlap: a pass takes a block once
    part = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("one.cuts", lambda s: F.slice(w, (s["at"] + 1).cast("int"), s["words"].cast("int")))), " ")), 1)
    mixed = F.when(whole, text).otherwise(part).alias(c[text_col])
    rows = wide.select(*(mixed if n == text_col else c[n] for n in names), F.col("one.position").alias("position of the row"))
    return rows.orderBy("position of the row").drop("position of the row").toDF(*names)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "position", "shards")
