"""Mix sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekloom.llm.ranks import ranked
from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
SEED = "mix"


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeating_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, weight)``: weights dealt out in turn to sources by code point, null last."""
    numbered = ranked(sources.select("source").distinct(), [], [F.col("source").asc_nulls_last()], "n")
    turn = F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int")
    dealt = F.element_at(F.array(*(F.lit(w) for w in weights)), turn + 1)
    return numbered.select("source", dealt.cast("long").alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)``: what each source gives to a mix of the whole size.

    A target is the source's share by weight of all sizes, at most ``cap`` times what the
    source has; what that leaves over is shared again by weight among the others until
    none is above. Sources without a weight get nothing. Each round is one aggregate over
    a row per source; only its three sums come to the driver. Sums stay integers until
    the last division, so reruns agree to the last digit.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long"))
    table = written(
        held.join(weighed, held["source"].eqNullSafe(weighed["_source"]), "left").select(
            "source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")
        ),
        "sources",
    )
    most = F.lit(cap) * F.col("source_size")
    zero = F.lit(0).cast("long")
    level, full = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > most
        sums = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, most).otherwise(zero)).alias("capped"),
            F.sum(F.when(above, zero).otherwise(F.col("weight"))).alias("weight"),
            F.sum(above.cast("int")).alias("full"),
        ).first()
        if not sums["weight"] or sums["full"] == full:
            break
        full = sums["full"]
        level = float(sums["all"] - sums["capped"]) / float(sums["weight"])
    share = F.lit(level) * F.col("weight")
    target = F.when(share > most, most.cast("double")).otherwise(share)
    return table.select("source", "source_size", target.alias("target"))


def offset(source: Column | str, seed: str) -> Column:
    """A source's random offset in [0, 1), the same in each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("<null>"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    cap: int = CAP,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` per document.

    Columns named in ``keep`` follow these.

    A document of a source is expected ``target / source_size`` times. The prefix sum of
    the expected copies over the source's documents, shifted by one random offset per
    source, crosses an integer once for each copy that is emitted. Documents stand in
    order of size and id, so neighbours that are rounded differently are of like size
    and the words taken stay near the target. The expected copies are the same for all
    documents of a source, so their prefix sum is the document's number times that value.

    Null text counts no words and null is a source of its own; repeated rows are
    documents of their own; extra columns are ignored. A source without any word has
    target 0 and gives no copies. An empty table gives an empty result.
    """
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"), *keep)
    order = [F.col("size").asc(), F.col("doc_id").asc_nulls_first()]
    placed = written(ranked(sizes, ["source"], order, "_number"), "placed")
    weights = repeating_weights(placed) if weights is None else weights
    targets = source_targets(placed, weights, cap).withColumnRenamed("source", "_source")
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["_source"]))
    expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    start = offset("source", seed)
    crossed = F.floor(expected * F.col("_number") + start) - F.floor(
        expected * (F.col("_number") - 1) + start
    )
    copies = F.least(crossed, F.lit(cap).cast("long"))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *keep,
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of a mix of ``docs``: each document as often as ``systematic_mix`` takes it.

    The copies go to the documents by id and text; they are broadcast if they were
    measured to fit. Rows that share both are told apart by a number of their own, which
    only these rows are shuffled for.
    """
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    mix = systematic_mix(keyed, keep=("_text_key",), **options)
    mix = mix.groupBy(F.col("doc_id").alias("_doc_id"), F.col("_text_key").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    mix = written(mix.filter("_copies > 0"), "copies")
    on = keyed["doc_id"].eqNullSafe(F.col("_doc_id")) & (keyed["_text_key"] == F.col("_key"))
    fits = keys_fit(mix, "_doc_id", "_key", "_copies", "_rows")
    joined = keyed.join(hinted(mix, fits), on)
    again = Window.partitionBy("_doc_id", "_key").orderBy(F.lit(1))
    share = F.floor(F.col("_copies") / F.col("_rows"))
    extra = (F.row_number().over(again) <= F.col("_copies") % F.col("_rows")).cast("long")
    single = joined.filter("_rows = 1").withColumn("_own", F.col("_copies"))
    repeated = joined.filter("_rows > 1").withColumn("_own", share + extra)
    return (
        single.unionByName(repeated)
        .filter("_own > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own").cast("long"))))
        .select(*docs.columns)
    )
