"""Mixing sources to target weights, in DataFrame operations only.

The words of each source form one stream, its documents in a fixed pseudorandom
order, cut into blocks of ``block_words`` words.  The output is a row of shards of
``shard_slots`` block slots.  Each shard draws how many slots each source fills from
a multinomial distribution whose probabilities follow the sources' targets
(stratified: the whole part of a source's expectation is granted and only the
fractional rest is drawn, which keeps every mean and lowers the variance).  A
source's slots are numbered through all shards and sent through a pseudorandom
permutation of its block indices, a new one for every pass over the source; blocks
are then joined by index.

Results for edge cases: a null text has size 0; a null source is one source, ranked
last; documents of size 0 are returned and take 0 words; repeated rows are documents
of their own; an empty table gives an empty result; extra columns are ignored.
No block is taken more than twice, so no document exceeds twice its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import parts, whole
from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 16384
BUCKETS = 4096
ROUNDS = 24
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: ``src, source_size, target``.  ``sizes`` has ``src, source, size``.

    Sources in order of their ratio of cap to weight are capped as long as the cap is
    below the weight's share of what is left; the rest share by weight.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    cap = (F.col("source_size") * F.lit(repeats)).cast("double")
    before = Window.orderBy(cap / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "cap": cap,
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "all_weight": F.sum("weight").over(everything),
        "cap_before": F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    by = by.withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * rest / free))
    return by.select("src", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """``index`` through a keyed pseudorandom permutation of 0..n-1, exact for every n:
    each round pairs x with k - x modulo n and swaps the pair by a keyed coin."""

    def step(x: Column, i: Column) -> Column:
        other = (F.pmod(F.xxhash64(key, i), n) + n - x) % n
        coin = F.xxhash64(key, i, F.greatest(x, other), F.lit(7)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), step)


def place(docs: DataFrame) -> DataFrame:
    """Each row of ``doc_id, src, size, tie`` with its bucket and number inside the bucket.
    The order is the same in every run up to rows that are equal in these columns."""
    bucket = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(BUCKETS)).cast("int")
    order = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "tie")
    return docs.withColumn("bucket", bucket).withColumn("seq", F.row_number().over(order))


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document overlaps (one without block for size 0)."""
    order = Window.partitionBy("src", "bucket").orderBy("seq")
    rows = rows.withColumn("local", F.sum("size").over(order) - F.col("size"))
    totals = rows.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("src").orderBy("bucket")
    bases = totals.select("src", "bucket", (F.sum("bucket_size").over(ahead) - F.col("bucket_size")).alias("base"))
    rows = rows.join(bases, ["src", "bucket"]).withColumn("start", F.col("base") + F.col("local"))
    size = F.lit(block_words).cast("long")
    first = F.floor(F.col("start") / size)
    last = F.floor((F.col("start") + F.col("size") - 1) / size)
    rows = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("start"), F.col("block") * size)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    return rows.withColumns({"from_word": begin - F.col("start"), "n_words": F.coalesce(end - begin, F.lit(0).cast("long"))})


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, block_words: int = BLOCK_WORDS, seed: int = SEED, stratified: bool = True) -> DataFrame:
    """The mix: one row per filled slot, ``shard, src, slot, pass, block``.  A slot beyond
    a source's last pass stays empty and has no row.  Unless ``stratified``, every slot of a
    shard is drawn."""
    everything = Window.partitionBy()
    plan = sources.where(F.col("source_size") > 0).withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
    plan = plan.withColumn("expected", F.col("n_blocks") * F.col("target") / F.col("source_size"))
    plan = plan.withColumn("all_slots", F.greatest(F.lit(1), F.round(F.sum("expected").over(everything))).cast("long"))
    plan = plan.withColumns({
        "share": F.col("expected") / F.sum("expected").over(everything),
        "shards": F.ceil(F.col("all_slots") / F.lit(shard_slots)),
    })
    # Full shards are alike; the last one may be shorter.
    plan = plan.withColumn("last", F.explode(F.array(F.lit(False), F.lit(True))))
    wide = F.when(F.col("last"), F.col("all_slots") - (F.col("shards") - 1) * shard_slots).otherwise(F.lit(shard_slots))
    plan = plan.withColumn("mean", wide * F.col("share")).withColumn("granted", F.floor("mean") if stratified else F.lit(0).cast("long"))
    plan = plan.withColumn("part", F.col("mean") - F.col("granted"))
    kind = Window.partitionBy("last")
    upto = kind.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.withColumns({
        "drawn": wide - F.sum("granted").over(kind),
        "hi": F.sum("part").over(upto),
        "final": F.row_number().over(kind.orderBy(F.col("src").desc())) == 1,
    })
    plan = plan.withColumns({"lo": F.col("hi") - F.col("part"), "hi": F.when(F.col("final"), F.col("drawn") + 1.0).otherwise(F.col("hi"))})

    kinds = plan.groupBy("last").agg(F.max("shards").alias("shards"), F.max("drawn").alias("drawn"))
    chunk = 4096
    heads = kinds.withColumn("chunk", F.explode(F.when(F.col("last"), F.array(F.col("shards") - 1)).otherwise(
        F.when(F.col("shards") > 1, F.sequence(F.lit(0).cast("long"), F.col("shards") - 2, F.lit(chunk).cast("long"))))))
    upper = F.when(F.col("last"), F.col("chunk")).otherwise(F.least(F.col("chunk") + chunk - 1, F.col("shards") - 2))
    shards = heads.repartition("chunk", "last").withColumn("shard", F.explode(F.sequence(F.col("chunk"), upper))).select("last", "shard", "drawn")
    draws = shards.where(F.col("drawn") > 0).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("drawn"))))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("shard"), F.col("draw")), 11) / F.lit(float(1 << 53))
    draws = draws.withColumn("x", unit * F.col("drawn")).withColumn("bin", F.floor("x"))
    ranges = plan.select("last", "src", "lo", "hi", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))).alias("bin"))
    won = draws.join(ranges, ["last", "bin"]).where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    won = won.groupBy("src", "shard").agg(F.count("*").alias("extra"))

    counts = shards.join(plan.select("last", "src", "granted", "n_blocks"), "last").join(won.hint("merge"), ["src", "shard"], "left")
    counts = counts.withColumn("n", F.col("granted") + F.coalesce(F.col("extra"), F.lit(0)))
    before = Window.partitionBy("src").orderBy("shard")
    counts = counts.withColumn("first", F.sum("n").over(before) - F.col("n"))
    stop = F.least(F.col("first") + F.col("n"), F.col("n_blocks") * REPEATS)
    # Spread again: a source's shards came together above only to be numbered.  By a given
    # number, as these few rows grow much when exploded and must not be coalesced.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = counts.where(F.col("first") < stop).repartition(parts, "src", "shard").withColumn("slot", F.explode(F.sequence(F.col("first"), stop - 1)))
    filled = filled.withColumns({"pass": F.floor(F.col("slot") / F.col("n_blocks")), "index": F.col("slot") % F.col("n_blocks")})
    key = F.xxhash64(F.lit(seed), F.col("src"), F.col("pass"))
    return filled.withColumn("block", permuted(F.col("index"), F.col("n_blocks"), key)).select("shard", "src", "slot", "pass", "block")


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, stratified: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sources, pieces, filled slots)`` of a mix of ``documents``.

    pieces: ``src, bucket, seq, doc_id, size, block, from_word, n_words``, one row for
    each block that a document overlaps.
    """
    sizes = documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), _source_key(F.col("source")).alias("src"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    sizes = cut(sizes, "mix-sizes")
    sources = cut(source_targets(sizes), "mix-sources")
    pieces = _pieces(place(sizes.drop("source")), block_words)
    return sources, pieces, slots(sources, shard_slots, block_words, seed, stratified)


def targets(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target`` of every row of ``documents``: what is to be taken
    from its source, before any draw."""
    sizes = documents.select("doc_id", F.col("source").cast("string").alias("source"), _source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"))
    sizes = cut(sizes, "mix-sizes")
    return sizes.join(source_targets(sizes), "src").select("doc_id", "size", "source_size", "target")


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per row of ``documents``."""
    sources, pieces, filled = mix(documents, **options)
    times = filled.groupBy("src", "block").agg(F.count("*").alias("times"))
    # Sizes after explode() are underestimated, so these joins must not choose to broadcast.
    took = pieces.join(times.hint("merge"), ["src", "block"], "left")
    took = took.groupBy("src", "bucket", "seq", "doc_id", "size").agg(F.sum(F.col("n_words") * F.coalesce(F.col("times"), F.lit(0))).alias("taken"))
    return took.join(sources, "src").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``documents``: for each document and pass, the words of its
    blocks that the pass takes, with the white space that follows each; ``n_chars`` is
    the new length.  Documents of which a pass takes nothing have no row for it."""
    _, pieces, filled = mix(documents, **options)
    took = pieces.where("block IS NOT NULL").join(filled.select("src", "block", "pass").hint("merge"), ["src", "block"])
    took = took.groupBy("src", "bucket", "seq", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("spans"))
    # The input's columns stay in one struct, so their names can't clash with those used here.
    rows = documents.select(whole(documents).alias("whole"), "doc_id", _source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    rows = place(rows).join(took.hint("merge"), ["src", "bucket", "seq"])
    # Words with the white space after them; white space before the first word stays with it.
    text = F.col("whole").getField("text")
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    units = F.split(F.substring(text, F.length(lead) + 1, F.length(text)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # explode() of one array keeps the optimiser from splitting the text again for each span.
    rows = rows.withColumn("lead", lead).withColumn("units", F.explode(F.array(units)))
    span = F.transform("spans", lambda s: F.array_join(F.slice(F.col("units"), (s["from_word"] + 1).cast("int"), s["n_words"].cast("int")), ""))
    first = F.when(F.element_at("spans", 1)["from_word"] == 0, F.col("lead")).otherwise("")
    rows = rows.withColumn("text", F.concat(first, F.array_join(span, "")))
    new = {"text": F.col("text").cast(documents.schema["text"].dataType)}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return rows.select(*(new[c].alias(c) if c in new else old for c, old in zip(documents.columns, parts(documents, "whole"))))
