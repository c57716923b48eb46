"""Mixing sources to target weights: blocks of words, multinomial draws per shard, permuted block indexes.

DataFrame and SQL functions only. Planning and counting move sizes, offsets and counts; texts move when the mix itself is asked
for (:func:`mixed_texts`), which joins the drawn block numbers with blocks of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgraph.llm.scratch import Scratch
from riskgraph.operators.ordering import running_totals

WEIGHTS = (3, 1, 2)
RATIO, MOST = 1.5, 2
BLOCK = 64
SHARD_SLOTS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mixture:
    plan: DataFrame  # (source, source_idx, weight, source_size, target, n_blocks, quota), one row for each source
    placed: DataFrame  # (doc_id, text_hash, source_idx, size, start): where each document lies in its source's row of words
    slots: DataFrame  # (shard, source_idx, draw, block): the blocks of every output shard


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """One row for each source of ``sizes(source, size)`` with its target.

    Sources in code point order, null last, take ``weights`` in turn and share ``ratio`` times all words. A target
    stops at ``most`` times its source; what is left over is shared by weight among the others. With sources
    in the order of ``limit / weight``, the level of the first one that isn't stopped is the level of all later ones.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    fill = W.partitionBy(F.lit(0)).orderBy("fullness", "source_idx")
    listed = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_idx", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("source_idx") % len(weights) + 1).cast("double"))
        .withColumn("_limit", (F.col("source_size") * most).cast("double"))
        .withColumn("fullness", F.col("_limit") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * ratio)
    )
    levels = listed.select(
        "*",
        ((F.col("_total") - F.coalesce(F.sum("_limit").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))).alias("_level"),
        F.row_number().over(fill).alias("_order"),
    )
    free = F.when(F.col("_level") <= F.col("fullness"), F.struct("_order", "_level"))
    level = F.min(free).over(everything)["_level"]
    return levels.withColumn("target", F.coalesce(F.least("_limit", level * F.col("weight")), F.col("_limit"))).select(
        "source", "source_idx", "weight", "source_size", "target"
    )


def permuted(rows: DataFrame, index: str, size: str, salt: str, name: str, seed: int) -> DataFrame:
    """Add ``name``: a pseudorandom permutation of 0..size-1, another one for each ``salt``, applied to ``index``.

    Twice: Feistel rounds over the largest p x q rectangle in the range, then a rotation that brings the rest inside.
    The rounds are folds inside the row: as plain columns their expressions would multiply when projects merge.
    """
    rows = rows.withColumn("_p", F.floor(F.sqrt(F.col(size))).cast("long")).withColumn("_q", F.expr(f"{size} div _p"))
    # The names inside the folds start with two underscores, so that no column of ``rows`` is taken for one of them.
    feistel = f"""aggregate(sequence(0, 3), named_struct('l', __x div _q, 'r', __x % _q), (__s, __k) -> if(__k % 2 = 0,
        named_struct('l', (__s.l + pmod(xxhash64({seed}, {salt}, __turn, __k, __s.r), _p)) % _p, 'r', __s.r),
        named_struct('l', __s.l, 'r', (__s.r + pmod(xxhash64({seed}, {salt}, __turn, __k, __s.l), _q)) % _q)), __s -> __s.l * _q + __s.r)"""
    turns = f"""aggregate(array(0, 1), {index},
        (__x, __turn) -> (if(__x < _p * _q, {feistel}, __x) + pmod(xxhash64({seed}, {salt}, __turn), {size})) % {size})"""
    return rows.withColumn(name, F.expr(turns)).drop("_p", "_q")


def mixture(docs: DataFrame, *, weights=WEIGHTS, ratio: float = RATIO, most: int = MOST, seed: int = 17) -> Mixture:
    """The plan, the packed documents and the drawn blocks of a mix of ``docs(doc_id, source, text)``.

    1. Documents lie in their source in a pseudorandom order; blocks are ``BLOCK`` words of that row, cutting documents.
    2. Every slot of every output shard draws its source by the targets, so a shard's counts are multinomial. They
       are counted map-side. A source's surplus over its quota at the end is void, and last shards make up what
       others lack, so that the whole mix meets the targets.
    3. A source's draws are numbered through all shards; draw k takes block permutation(k mod number of blocks), so
       no block comes up more than ``most`` times.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sizes = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")), "sizes")
    n_blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * n_blocks / F.col("source_size"))).otherwise(0).cast("long")
    plan = scratch.keep(source_targets(sizes, weights=weights, ratio=ratio, most=most).withColumn("n_blocks", n_blocks).withColumn("quota", quota), "plan")
    named = sizes.join(plan.select(F.col("source").alias("_source"), "source_idx"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "text_hash", "source_idx", "size")
    placed = scratch.keep(
        running_totals(
            named.withColumn("_mixed", F.xxhash64(F.lit(seed), "doc_id")), ["_mixed", F.col("doc_id"), "size", "text_hash"], {"start": "size"}, ["source_idx"]
        ).select("doc_id", "text_hash", "source_idx", "size", "start"),
        "placed",
    )
    slots = plan.agg(F.sum("quota")).first()[0] or 0
    upto = F.try_divide(F.sum("target").over(W.orderBy("source_idx")), F.sum("target").over(W.partitionBy(F.lit(0))))
    edges = plan.select("source_idx", upto.alias("upto")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_idx", "upto"))), lambda s: s["upto"]).alias("edges")
    )
    # Without a word in any source there are no slots, and no edge is ever asked for.
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(1 << 53)) / float(1 << 53)
    drawn = (
        spark.range(slots).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), chance.alias("chance"), edges.scalar().alias("edges"))
        .withColumn("source_idx", F.least(F.size(F.filter("edges", lambda e: e <= F.col("chance"))), F.size("edges") - 1))
        .groupBy("shard", "source_idx").agg(F.count("*").alias("n"))
    )
    limits = plan.select("source_idx", "n_blocks", "quota")
    counted = scratch.keep(running_totals(drawn, ["shard"], {"before": "n"}, ["source_idx"]), "drawn")
    taken = counted.join(limits, "source_idx").withColumn("n", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before")))).filter("n > 0")
    have = counted.groupBy("source_idx").agg(F.sum("n").alias("have"))
    lacking = (
        limits.join(have, "source_idx", "left").withColumn("before", F.coalesce("have", F.lit(0))).withColumn("lack", F.col("quota") - F.col("before")).filter("lack > 0")
        .withColumn("part", F.explode(F.expr(f"sequence(0, (lack - 1) div {SHARD_SLOTS})")))
        .select(
            (F.lit(-(-slots // SHARD_SLOTS)) + F.col("part")).alias("shard"), "source_idx", "n_blocks",
            (F.col("before") + F.col("part") * SHARD_SLOTS).alias("before"), F.least(F.col("lack") - F.col("part") * SHARD_SLOTS, F.lit(SHARD_SLOTS)).alias("n"),
        )
    )
    runs = taken.select("shard", "source_idx", "n_blocks", "before", "n").unionByName(lacking)
    draws = runs.withColumn("draw", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1))).withColumn("_turn", F.col("draw") % F.col("n_blocks"))
    return Mixture(plan, placed, permuted(draws, "_turn", "n_blocks", "source_idx", "block", seed).select("shard", "source_idx", "draw", "block"))


def pieces(placed: DataFrame) -> DataFrame:
    """(source_idx, start, block, words): the part of each document that lies in each block."""
    first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("start"), F.col("block") * BLOCK)
    return cut.select("source_idx", "start", "block", words.alias("words"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """(shard, draw, source, doc_id, position, first_word, words, text): the mix of ``docs(doc_id, source, text)`` itself.

    A block of a source's row of words is cut out of one or more documents; each piece is a row, with its words joined
    by single blanks, for every slot that draws the block. Rows of one (shard, source, draw) in the order of
    ``position`` are a slot's text; shards hold about ``SHARD_SLOTS`` slots. The words of a document over all
    rows are what :func:`mixed_documents` counts. Rows that repeat an id are documents of their own; null and empty texts have no words.
    """
    mix = mixture(docs, **options)
    source = F.col("source").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), source.alias("_source"), F.col("text").cast("string").alias("_text")).filter(word_count("_text") > 0)
    texts = texts.withColumn("_hash", F.xxhash64("_text")).dropDuplicates(["_id", "_source", "_hash"])
    named = mix.placed.filter("size > 0").join(mix.plan.select("source_idx", "source"), "source_idx")
    whole = named.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_hash")))
    words = F.regexp_extract_all(F.col("_text"), F.lit(_WORD), F.lit(0))
    first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")

    def piece(block: Column) -> Column:
        begin = F.greatest(F.lit(0), block * BLOCK - F.col("start"))
        end = F.least(F.col("size"), (block + 1) * BLOCK - F.col("start"))
        text = F.array_join(F.slice("_words", (begin + 1).cast("int"), (end - begin).cast("int")), " ")
        position = F.col("start") + begin - block * BLOCK
        return F.struct(block.alias("block"), position.alias("position"), begin.alias("first_word"), (end - begin).alias("words"), text.alias("text"))

    cut = whole.withColumn("_words", words).select("source_idx", "source", "doc_id", F.inline(F.transform(F.sequence(first, last), piece)))
    return mix.slots.join(cut, ["source_idx", "block"]).select("shard", "draw", "source", "doc_id", "position", "first_word", "words", "text")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source), one row for each row of ``docs(doc_id, source, text)``.

    ``taken`` counts the words of the document in all blocks that the mix draws, repeats included; it is at most twice the
    size. Null and empty texts have no words and are never drawn. A null source is a source, the last one. Repeated
    rows are documents of their own. Reruns give the same rows. Other columns are ignored.
    """
    mix = mixture(docs, **options)
    times = mix.slots.groupBy("source_idx", "block").agg(F.count("*").alias("times"))
    taken = pieces(mix.placed).join(times, ["source_idx", "block"]).groupBy("source_idx", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    key = F.when(F.col("size") > 0, F.col("start"))  # an empty document shares its start with the next one
    rows = mix.placed.withColumn("start", key).join(taken, ["source_idx", "start"], "left")
    return rows.join(mix.plan.select("source_idx", "source", "source_size", "target"), "source_idx").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )
