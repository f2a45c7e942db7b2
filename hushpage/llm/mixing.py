"""Mixing sources to target weights, in DataFrame operations only.

Weighted sampling by exponential keys (Efraimidis and Spirakis): a document's key is
-ln(u) / weight, u being a hash of its id in (0, 1), and a source takes its documents
in ascending order of keys. A target beyond a source's size first takes complete
epochs; the rest is a prefix of that order. Prefix sums are taken in key buckets
whose number grows with the source, so that no source meets in one task. Buckets are even whatever the weights: a key's
place is the share of the source's keys expected below it, which follows from how many documents have which weight. They end in
one threshold a source, and texts are kept or repeated where they are scanned: only ids, sizes
and keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut

WEIGHTS = (3, 1, 2)
#: Sources up to this number are joined by broadcast; beyond it by a shuffled join that splits skewed sources. Results are the same. The
#: targets themselves are windows over one row a source, in one task, and a source's buckets are one row each.
BROADCAST_SOURCES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of 50 words or more whose mean word has 3 to 10 characters; each miss divides it by 2 or 4."""
    solid = F.length(F.regexp_replace(text, GAP, ""))
    usual = (solid >= 3 * size) & (solid <= 10 * size)
    return F.when(F.coalesce(usual, F.lit(False)), 1.0).otherwise(0.25) * F.when(size >= 50, 1.0).otherwise(0.5)


def sampling_key(identity: Column, weight: Column) -> Column:
    """Exponential key with rate ``weight`` from 52 bits of MD5; the same on every run."""
    bits = F.conv(F.substring(F.md5(identity), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(1 << 52))) / weight


def _identity(identity: Column | None) -> Column:
    """What a document's key is drawn from: its id, if nothing else is given."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if identity is None else identity


def id_or_text(doc_id: Column, text: Column) -> Column:
    """A document's id, or a hash of its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(stats: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds sid, target, epochs and room to one row a source (source, source_size, docs).

    Targets are ``share`` of all sizes by weight, at most ``most`` times a source's size. Weights go round the
    sources by code point, null last. Capped excess is reshared by weight: with sources in order of cap / weight,
    the first ones are capped as long as the level that the rest would reach lies above their own.
    """
    ranks = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = stats.withColumn("sid", F.row_number().over(ranks) - 1).withColumn("w", turn)
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("w").over(after))
    levels = levels.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # the first free source's: levels fall after it
    found = levels.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("w")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = found.withColumn("epochs", epochs)
    return found.select(
        "source", "sid", "docs", "source_size", "target", "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("room"),
    )


def _order() -> Column:
    return F.struct("key", "doc_id", "size")


def _ahead(units: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the units of the source that come earlier in the order.

    Sums inside a (source, bucket) come from a window; those of earlier buckets from one row a bucket.
    """
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = units.groupBy("sid", "bucket").agg(F.sum(value).alias("part"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = units.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(sums, ["sid", "bucket"]).withColumn(name, F.col("base") + F.col("inside")).drop("base", "inside")


def mixing_plan(
    docs: DataFrame,
    size: Column,
    weight: Column,
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    bucket_docs: int = 2_000,
    identity: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row a source with its target and the thresholds of its fractional part)."""
    sized = docs.select("doc_id", "source", size.alias("size"), weight.alias("weight"), _identity(identity).alias("identity"))
    rate = F.floor(F.log2("weight")).cast("int")
    sized = cut(sized.select("doc_id", "source", "size", sampling_key(F.col("identity"), F.col("weight")).alias("key"), rate.alias("rate")))
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rates = sized.where("size > 0").groupBy("source", "rate").agg(F.count(F.lit(1)).alias("n"))  # a row a source and power of two
    rates = rates.groupBy(F.col("source").alias("its")).agg(F.collect_list(F.struct("rate", "n")).alias("rates"), F.sum("n").alias("solid"))
    targets = source_targets(stats, weights, share, most)
    targets = cut(targets.join(rates, targets["source"].eqNullSafe(rates["its"]), "left").drop("its"))
    buckets = F.greatest(F.ceil(F.col("solid") / bucket_docs), F.lit(1))
    below = F.aggregate("rates", F.lit(0.0), lambda sum_, r: sum_ + r["n"] * (1 - F.exp(-F.col("key") * F.pow(F.lit(2.0), r["rate"])))) / F.col("solid")
    bucket = F.least(F.floor(below * buckets), buckets - 1).cast("long")
    rows = with_source(sized.where("size > 0"), targets).withColumn("bucket", bucket)
    units = rows.groupBy("sid", "bucket", "key", "doc_id", "size").agg(
        F.sum("size").alias("unit"), F.max("room").alias("room")
    )
    first = cut(_ahead(units, "unit", "ahead"))
    fits = F.col("ahead") + F.col("unit") / 2 <= F.col("room")
    taken = first.groupBy("sid").agg(
        F.max(F.when(fits, _order())).alias("upto"), F.sum(F.when(fits, F.col("unit")).otherwise(0)).alias("filled")
    )
    few = targets.count() <= BROADCAST_SOURCES
    rest = first.where(~fits).join(F.broadcast(taken) if few else taken, "sid")
    rest = rest.withColumn("gap", F.col("room") - F.col("filled")).where("unit <= gap")
    second = _ahead(rest, "unit", "later").where(F.col("later") + F.col("unit") / 2 <= F.col("gap"))
    late = second.groupBy("sid").agg(F.max(_order()).alias("late"))
    gaps = taken.join(targets.select("sid", "room"), "sid").select("sid", "upto", (F.col("room") - F.col("filled")).alias("gap"))
    return sized, cut(targets.join(gaps, "sid", "left").join(late, "sid", "left"))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's row: by broadcast while the sources are few, else by a join that splits skew."""
    side = sources.withColumnRenamed("source", "its_source")
    side = F.broadcast(side) if sources.count() <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")


def _copies() -> Column:
    order = _order()
    first = F.coalesce(order <= F.col("upto"), F.lit(False))
    second = F.coalesce((F.col("size") <= F.col("gap")) & (order <= F.col("late")), F.lit(False))
    return F.col("epochs") + ((F.col("size") > 0) & (first | second)).cast("long")


def mix_sources(docs: DataFrame, size: Column, weight: Column, **options) -> DataFrame:
    """How many words a mix takes from each document: doc_id, size, source_size, target, taken, copies.

    Reads doc_id, source and what ``size``, ``weight`` (above 0) and ``identity`` name; other columns are ignored. Whole documents are taken:
    ``copies`` complete epochs, and one more for those in the fractional part, whose prefix sums fill
    what is left of the target. A document that would cross the target is taken if that brings the sum nearer;
    if not, later documents that fit the gap fill it in a second pass. Null sources form one source, listed
    last. Null ids are keyed as an empty id, unless ``identity`` tells them apart. Rows with equal id, key and size are taken together. Documents
    without words belong to complete epochs only. An empty table gives no rows.
    """
    sized, sources = mixing_plan(docs, size, weight, **options)
    rows = with_source(sized, sources).withColumn("copies", _copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of documents, with a row for each copy that it takes. Null ids are told apart by their texts."""
    size = word_count(F.col("text"))
    _, sources = mixing_plan(docs, size, quality_weight(F.col("text"), size), identity=id_or_text(F.col("doc_id"), F.col("text")), **options)
    key = sampling_key(id_or_text(F.col("doc_id"), F.col("its_text")), F.col("weight"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", size.alias("size"), F.col("text").alias("its_text"))
    rows = rows.withColumn("weight", quality_weight(F.col("its_text"), F.col("size"))).withColumn("key", key)
    rows = with_source(rows, sources).withColumn("copies", _copies().cast("int")).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
