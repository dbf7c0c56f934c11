"""Mixing sources to target weights.

Each source's documents are laid end to end and cut into blocks of a fixed number of words. The mix
is a run of slots, one block each, cut into output shards. How many blocks of each source a shard gets is drawn
first: a pseudorandom permutation deals all draws to places, so that a shard's counts by source are multinomial
given the sources' totals, and the totals meet their targets to the block. A source's slots are then numbered
along the shards by these counts, and a slot's number maps to a block through pseudorandom permutations of the
block numbers, a new one for each pass, so that no block is used more often than the passes go. Slots and
documents meet in a join on the block.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, block_offsets, div, materialise, running_sum
from .feistel import permute, unpermute

#: Words a block.
BLOCK = 128
#: Blocks an output shard.
SHARD_BLOCKS = 4096
#: Slots that one row is exploded into at a time.
RUN = 4096
#: Slots a task draws.
TASK_SLOTS = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source_key, source_size; a row per source) with source_no and target.

    Sources are numbered by source_key, which sorts as they should; weights repeat along the
    numbers. Targets share ``share`` times all sizes by weight; none goes above ``cap`` times its
    source's size, and what is over is shared again by weight among the others until none is above.
    """
    at = running_sum(sizes, [F.col("source_key")], F.lit(1), "sources").withColumnRenamed("before", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    rated = materialise(at.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size")), "weights")
    total, weight_sum = rated.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level, capped = share * (total or 0), 0.0, -1
    if weight_sum:
        level = wanted / weight_sum
    while weight_sum:
        full = F.col("cap") <= level * F.col("weight")
        now, held, open_weight = rated.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                           F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if now == capped or not open_weight:
            break
        capped, level = now, max(level, (wanted - held) / open_weight)
    return rated.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("cap")


def source_key(source: Column) -> Column:
    """A string that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def lay_out(sized: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(documents, sources) of ``sized`` (id columns, source_key, size).

    documents: a row for each row of ``sized`` with its copy number among equal rows and
    ``begins``, its first word's place in its source. sources: targets, blocks, and draws, the
    number of slots that take from it.
    """
    columns = sized.columns
    slim = materialise(sized.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")), "sized")
    sources = targets(slim.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), **how)
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialise(running_sum(
        sources.withColumns({"blocks": blocks, "draws": draws}), [F.col("source_key")], F.col("draws"), "draws")
        .withColumnRenamed("before", "first_draw"), "sources")
    placed = block_offsets(slim, ["source_key"], [c for c in columns if c != "source_key"], F.col("size") * F.col("copies"))
    documents = (placed.select(*columns, "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
                 .withColumn("begins", F.col("before") + F.col("copy") * F.col("size")).drop("before"))
    return documents, sources


def draw_slots(sources: DataFrame, seed: int) -> DataFrame:
    """A row per slot of the mix: shard, slot (its place in the shard), source_no, number (the slots of its source
    before it), block."""
    total = sources.agg(F.sum("draws")).first()[0] or 0
    runs = (sources.filter("draws > 0")
            .select("source_no", "first_draw", "draws",
                    F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("draws") - 1, RUN))).alias("run"))
            .repartition(int(total // TASK_SLOTS) + 1, "source_no", "run"))  # a set number: what follows grows, AQE can't tell
    each = runs.select("source_no", F.explode(F.sequence(
        F.col("first_draw") + F.col("run") * RUN, F.col("first_draw") + F.least((F.col("run") + 1) * RUN, F.col("draws")) - 1)).alias("draw"))
    place = unpermute(F.col("draw"), F.lit(total), F.lit(seed))
    dealt = materialise(each.select("source_no", place.alias("place")).select(
        "source_no", div("place", SHARD_BLOCKS).alias("shard"), F.pmod("place", F.lit(SHARD_BLOCKS)).alias("slot")), "slots")
    # The draw: blocks by shard and source. A source's slots are numbered by the counts of the shards before.
    counts = shard_counts(dealt)
    before = F.sum("n").over(W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    within = F.row_number().over(W.partitionBy("shard", "source_no").orderBy("slot")) - 1  # SHARD_BLOCKS rows at most
    numbered = (dealt.withColumn("within", within).join(counts.withColumn("before", before).drop("n"), ["shard", "source_no"])
                .join(sources.select("source_no", "blocks"), "source_no"))
    number = (F.col("before") + F.col("within")).cast("long")
    turn = div(number, F.col("blocks"))
    key = F.xxhash64(F.lit(seed), F.col("source_no"), turn)
    return numbered.select("shard", "slot", "source_no", number.alias("number"),
                           permute(number - turn * F.col("blocks"), F.col("blocks"), key).alias("block"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, source_no, n): the drawn counts; each shard's add up to its slots, each source's to its draws."""
    return slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))


def pieces(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each part of a document that lies in one block: source_no, block, from_word, words."""
    ends = F.col("begins") + F.col("size")
    cut = documents.filter("size > 0").join(sources.select("source_key", "source_no"), "source_key").withColumn(
        "block", F.explode(F.sequence(div("begins", BLOCK), div(ends - 1, BLOCK))))
    start = F.greatest(F.col("begins"), F.col("block") * BLOCK)
    return cut.withColumns({"from_word": start - F.col("begins"), "words": F.least(ends, (F.col("block") + 1) * BLOCK) - start})


def mix(sized: DataFrame, seed: int = 8, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, used): ``used`` has the pieces the mix takes, with ``uses``, how often, and where the first
    of them goes: ``first_place`` (shard, slot).

    ``sized`` has id columns of any number, ``source_key`` and ``size``; documents without words
    take part with nothing. Equal rows are told apart by ``copy``. An empty table gives three.
    """
    documents, sources = lay_out(sized, **how)
    documents = materialise(documents, "laid")
    counts = draw_slots(sources, seed).groupBy("source_no", "block").agg(
        F.count(F.lit(1)).alias("uses"), F.min(F.struct("shard", "slot")).alias("first_place"))
    # Both sides come from explode, whose growth Spark's size estimates leave out: no broadcast here.
    return documents, sources, pieces(documents, sources).hint("merge").join(counts, ["source_no", "block"])


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  length_col: str | None = "n_chars", seed: int = 8, **how) -> DataFrame:
    """The mix as rows like those of ``docs``: a document's nth row holds the words that the mix takes at
    least n times, in their order.

    A row that holds all words keeps its text as it is; otherwise words are joined by blanks. Texts
    that are null or have no word are not in the mix. ``length_col`` gets the new length. Rows equal
    in id, text and source are counted and take part each; they come out with the other columns of
    one of them. Columns of ``docs`` may have any names that do not start with two underscores.
    """
    names = docs.columns
    text = F.col(text_col).cast("string")
    rows = docs.withColumns({"__id": F.xxhash64(F.col(id_col).isNull(), id_col, F.lit("row"), text), "__key": source_key(F.col(source_col)),
                             "__size": word_count(text)})
    keys = ["__id", "source_key", "size"]
    sized = rows.select("__id", F.col("__key").alias("source_key"), F.col("__size").alias("size"))
    documents, _, used = mix(sized, seed, **how)
    taken = (used.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))))
             .groupBy(*keys, "copy", "__turn")
             .agg(F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("__spans"), F.sum("words").alias("__taken"))
             .select(F.col("__id").alias("__row"), F.col("source_key").alias("__from"), "__spans", "__taken"))
    if documents.filter("copy > 0").head(1):
        rows = rows.dropDuplicates(["__id", "__key"])
    cut = F.expr("array_join(flatten(transform(__spans, s -> slice(__words, int(s.from_word) + 1, int(s.words)))), ' ')")
    mixed = (taken.hint("merge").join(rows, (F.col("__row") == F.col("__id")) & (F.col("__from") == F.col("__key")))
             .withColumn("__words", F.when(F.col("__taken") < F.col("__size"), F.regexp_extract_all(text, F.lit(WORD), 0)))
             .withColumn(text_col, F.when(F.col("__taken") < F.col("__size"), cut).otherwise(text)))
    if length_col in names:
        mixed = mixed.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return mixed.select(*names)
