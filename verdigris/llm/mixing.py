"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, with DataFrame functions only.

1. Every source gets a token target (weights, a cap of ``max_repeats`` times its size, the excess reshared).
2. Sources are cut into shards of bounded size, by a seeded MD5 of the document's id and size. The documents of a shard,
   in the order of that digest, are one stream of words, cut into blocks of ``block_tokens``; the stream may be passed ``max_repeats`` times.
3. Sainte-Laguë (divisors 1, 3, 5, ...) gives the blocks of the whole mix to sources, and those of a source to its shards.
4. A shard takes whole passes, then blocks of its next pass at seeded places, until its quota is met.

The largest window is one shard. Only the tables of sources and of shards are ranked as a whole; they hold no documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A prime above any number of blocks a shard can have; it steps through the blocks of a shard.
_STEP = 2147483647


def digest_number(text: Column, first: int = 1, digits: int = 8) -> Column:
    """A number from some of the hexadecimal digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Adds weight and target to (source, source_size): ``share`` times all sizes, dealt by weight.

    Sources in order of code points, null last, take the weights in turn. A target stops at ``max_repeats`` times its
    source's size and what is left over is dealt again by weight, until none is above: with the sources in order of
    cap / weight, the first k are at their caps, where k is the least for which no other source is above its cap.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("_at", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("_at"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(after))
        .withColumn("_level", (F.col("_all") * F.lit(float(share)) - F.col("_capped")) / F.col("_open"))
        .withColumn("_free", F.col("_cap") > F.col("_level") * F.col("weight"))
        .withColumn("_rank", F.row_number().over(order))
    )
    ranked = ranked.withColumn("_first", F.min(F.when(F.col("_free"), F.col("_rank"))).over(everything))
    ranked = ranked.withColumn("_water", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_level"))).over(everything))
    target = F.when(F.col("_rank") >= F.col("_first"), F.col("_water") * F.col("weight")).otherwise(F.col("_cap").cast("double"))
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def sainte_lague(parts: DataFrame, key: list[str], seats: Column, value: str, most: str) -> DataFrame:
    """Adds ``quota``: of each group's ``seats``, those that the highest quotients value / (2k + 1) give to its parts.

    No part gets more than ``most``. Of equal quotients that of the smaller ``part`` comes first, so when seats run out
    the larger one goes without. With a total of 0 nobody gets a seat.

    Only quotients near the last one that gets a seat are ranked. The divisor that would hand out the seats exactly, if
    seats could be split, is found from prefix sums over the parts in the order of their caps; rounding by it gives every
    part all its seats but a few. Each part then offers its next seats, and puts up its last ones, in number its share of
    what is still to be moved and one more on either side, so that the ranked rows are a small multiple of the parts.
    """
    group = Window.partitionBy(*key)
    some = F.col(value) > 0
    cap = F.when(some, F.col(most)).otherwise(0)
    order = Window.partitionBy(*key).orderBy(F.when(some, cap / F.col(value)).otherwise(0), "part")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # As in source_targets: the parts with the least caps for their value are full, the others share the rest by value.
    base = parts.withColumn("_seats", F.least(seats, F.sum(cap).over(group)))
    base = base.withColumn("_rate", F.greatest((F.col("_seats") - F.coalesce(F.sum(cap).over(before), F.lit(0))), F.lit(0)) / F.greatest(F.sum(value).over(after), F.lit(1)))
    base = base.withColumn("_free", cap > F.col("_rate") * F.col(value)).withColumn("_rank", F.row_number().over(order))
    base = base.withColumn("_first", F.min(F.when(F.col("_free"), F.col("_rank"))).over(group))
    base = base.withColumn("_even", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_rate"))).over(group))
    base = base.withColumn("_start", F.when(F.col("_rank") >= F.col("_first"), F.least(cap, F.round(F.col("_even") * F.col(value)).cast("long"))).otherwise(cap))
    base = base.withColumn("_left", F.col("_seats") - F.sum("_start").over(group))
    open_value = F.sum(F.when(F.col("_rank") >= F.col("_first"), F.col(value)).otherwise(0)).over(group)
    reach = F.abs("_left") + F.count("*").over(group)
    base = base.withColumn("_near", F.least(reach, F.ceil(F.col(value) * reach / F.greatest(open_value, F.lit(1))) + 1).cast("long"))
    low = F.greatest(F.col("_start") - F.col("_near"), F.lit(0))
    high = F.least(F.col("_start") + F.col("_near"), cap)
    # The seats below ``low`` are sure; those from it on are ranked against each other.
    seat = base.withColumn("_low", low).withColumn("_high", high).where("_high > _low").withColumn("_nth", F.explode(F.sequence("_low", F.col("_high") - 1)))
    seat = seat.withColumn("_given", F.sum(F.when(F.col("_nth") < F.col("_start"), 1).otherwise(0)).over(group) + F.col("_left"))
    ranked = Window.partitionBy(*key).orderBy(F.desc(F.col(value) / (2 * F.col("_nth") + 1)), "part", "_nth")
    chosen = seat.withColumn("_turn", F.row_number().over(ranked)).where(F.col("_turn") <= F.col("_given"))
    changes = chosen.groupBy(*key, "part").agg(F.count("*").alias("_got"))
    mine, theirs = base.withColumn("_low", low).alias("b"), changes.alias("c")
    same = F.col("b.part") == F.col("c.part")
    for k in key:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = mine.join(theirs, same, "left")
    hidden = ["_seats", "_rate", "_free", "_rank", "_first", "_even", "_start", "_left", "_near", "_low"]
    return joined.select("b.*", (F.col("b._low") + F.coalesce(F.col("c._got"), F.lit(0))).alias("quota")).drop(*hidden)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    block_tokens: int = 16,
    shard_tokens: int = 1 << 20,
    seed: int = 7,
    keep_plan: bool = False,
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null texts and texts of white space have size 0 and nothing is taken from them; a null source is a source of its
    own, after the others. Rows that are the same are mixed as separate rows; which of them is first makes no
    difference to the result. A null id is dealt by its size, and the rows of one id and size stand in one shard however
    many they are, spilled but whole. A document longer than a shard is one all the same. An empty table gives no rows.
    Other columns are ignored, whatever their names. Reruns give the same rows. Texts are read once, for their sizes.
    With ``keep_plan``: also what ``apply_mix`` needs of the plan.
    """
    plan_key = [F.xxhash64(docs[text_col]).alias("_th")] if keep_plan else []
    sized = materialize(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *plan_key), "sizes")
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    sources = source_targets(totals, weights=weights, share=share, max_repeats=max_repeats)
    blocks = F.floor(F.col("source_size") * max_repeats / block_tokens) + 1
    wanted = F.round(F.sum("target").over(Window.partitionBy()) / block_tokens).cast("long")
    numbered = sources.withColumn("part", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_most", blocks).withColumn("_one", F.lit(1))
    given = sainte_lague(numbered, ["_one"], wanted, "target", "_most").withColumnRenamed("quota", "source_quota").drop("_most", "_one", "part")
    # The tables of sources and shards are small, and asked for more than once: written, they keep the plans short.
    given = materialize(given.withColumn("_shards", F.floor(F.col("source_size") / shard_tokens).cast("long") + 1), "sources")

    mine, theirs = sized.alias("d"), given.alias("s")
    placed = mine.join(theirs, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.source_quota", "s._shards")
    name = F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.when(F.col("id").isNull(), F.col("size")))
    placed = placed.withColumn("_order", digest_number(name, 1, 12)).withColumn("part", F.pmod(digest_number(name, 17), F.col("_shards")))

    shards = placed.groupBy("source", "part").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = materialize(shards.withColumn("_blocks", F.ceil(F.col("shard_size") / block_tokens).cast("long")).withColumn("_most", F.col("_blocks") * max_repeats), "shards")
    quotas = materialize(sainte_lague(shards, ["source"], F.col("source_quota"), "shard_size", "_most").select("source", "part", "shard_size", "_blocks", "quota"), "quotas")

    left, right = placed.alias("d"), quotas.alias("q")
    rows = left.join(right, F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.part") == F.col("q.part"))).select("d.*", "q._blocks", "q.quota")
    stream = Window.partitionBy("source", "part").orderBy("_order", "id", "size")
    rows = rows.withColumn("_end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_begin", F.col("_end") - F.col("size"))

    passes = F.floor(F.col("quota") / F.greatest(F.col("_blocks"), F.lit(1))).cast("long")
    rest = F.col("quota") - passes * F.col("_blocks")
    shift = F.pmod(digest_number(F.concat_ws(":", F.lit(seed), "source", "part")), F.greatest(F.col("_blocks"), F.lit(1)))
    rows = rows.withColumn("_passes", passes).withColumn("_rest", rest).withColumn("_stride", F.pmod(F.lit(_STEP), F.greatest(F.col("_blocks"), F.lit(1)))).withColumn("_shift", shift)

    def words_of(block: Column) -> Column:
        chosen = F.pmod(block * F.col("_stride") + F.col("_shift"), F.greatest(F.col("_blocks"), F.lit(1))) < F.col("_rest")
        overlap = F.least(F.col("_end"), (block + 1) * block_tokens) - F.greatest(F.col("_begin"), block * block_tokens)
        return F.when(chosen, overlap).otherwise(F.lit(0).cast("long"))

    touched = F.sequence(F.floor(F.col("_begin") / block_tokens), F.floor((F.col("_end") - 1) / block_tokens))
    partial = F.when((F.col("size") > 0) & (F.col("_rest") > 0), F.aggregate(touched, F.lit(0).cast("long"), lambda a, b: a + words_of(b))).otherwise(F.lit(0).cast("long"))
    plan = ["_th", "_begin", "_passes", "_rest", "_stride", "_shift", "_blocks"] if keep_plan else []
    return rows.select(F.col("id").alias(id_col), F.col("source"), *plan, "size", "source_size", "target", (F.col("size") * F.col("_passes") + partial).alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_tokens: int = 16, **options) -> DataFrame:
    """The documents of the mix, all columns of ``docs``: a copy for every whole pass, and one with the words of the chosen blocks.

    The words of all copies of a document are ``taken`` words of ``mix``. Whole copies keep their text; in a part of
    one the words stand apart by a space. Documents of which nothing is taken go, as do those without words.
    """
    plan = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, block_tokens=block_tokens, keep_plan=True, **options).where("taken > 0")
    plan = plan.select(F.col(id_col).alias("_id"), "_th", "size", "taken", "_begin", "_passes", "_rest", "_stride", "_shift", "_blocks")
    plan = plan.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_begin")))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_th"))  # a struct, so that no column can clash
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id")))
    mine, theirs = rows.alias("d"), plan.alias("p")
    on = F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d._th") == F.col("p._th")) & (F.col("d._nth") == F.col("p._nth"))
    both = mine.join(theirs, on).select("d._row", "p.size", "p.taken", "p._begin", "p._passes", "p._rest", "p._stride", "p._shift", "p._blocks")
    both = both.withColumn("_partial", F.col("taken") - F.col("_passes") * F.col("size"))
    words = F.regexp_extract_all(F.col("_row")[text_col], F.lit(WORD), F.lit(0))

    def chosen(_: Column, i: Column) -> Column:
        block = F.floor((F.col("_begin") + i) / block_tokens)
        return F.pmod(block * F.col("_stride") + F.col("_shift"), F.col("_blocks")) < F.col("_rest")

    whole = both.where("_passes > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_passes")))).select("_row.*")
    part = both.where("_partial > 0").select(F.col("_row").withField(text_col, F.array_join(F.filter(words, chosen), " ")).alias("_row")).select("_row.*")
    return whole.unionByName(part)
