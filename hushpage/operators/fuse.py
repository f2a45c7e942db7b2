"""Fusion of overlapping detections into regions, page by page.

The rule is order-dependent: each detection joins the cluster that it overlaps most among those that exist by then, and the
cluster's box grows. It is a fold over a page's detections in order, written as one ``aggregate`` of array expressions, so it
stays in the JVM; the only shuffle is by page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.functions.classify import compatible, is_sensitive_type
from hushpage.functions.geometry import Box, iou, is_valid_box, max_overlap, rounded, union_box

BOX = ("x", "y", "width", "height")
CLUSTERS = "array<struct<type: string, x: double, y: double, width: double, height: double, confidence: double, sources: array<string>, id: string, text: string>>"


@dataclass(frozen=True)
class FuseOptions:
    iou_threshold: float = 0.3
    overlap_threshold: float = 0.5
    keep_generic: bool = False
    image_width: float | None = None
    image_height: float | None = None


def _cluster(kind: Column, box: Box, confidence: Column, sources: Column, ident: Column, text: Column) -> Column:
    return F.struct(
        kind.alias("type"), *[b.alias(n) for n, b in zip(BOX, box, strict=True)],
        confidence.alias("confidence"), sources.alias("sources"), ident.alias("id"),
        F.when(kind != "password", text).alias("text"),
    )


def _alone(d: Column, o: FuseOptions) -> Column:
    return _cluster(d["type"], rounded(Box.field(d), o.image_width, o.image_height), d["confidence"], d["sources"], d["id"], d["text"])


def _merged(a: Column, b: Column, o: FuseOptions) -> Column:
    """a grown by b: a specific kind beats text, the higher confidence, joined sources, the first text."""
    kind = F.when(a["type"] == "text", b["type"]).otherwise(a["type"])
    box = union_box(Box.field(a), Box.field(b), o.image_width, o.image_height)
    sources = F.array_distinct(F.concat(a["sources"], b["sources"]))
    ident = F.when(a["type"] != "text", a["id"]).otherwise(b["id"])
    return _cluster(kind, box, F.greatest(a["confidence"], b["confidence"]), sources, ident, F.coalesce(a["text"], b["text"]))


def fuse_detections(detections: DataFrame, options: FuseOptions = FuseOptions()) -> DataFrame:
    """(snapshot_id, cluster, type, x, y, width, height, confidence, sources, id, text) from detections in order of
    (group_no, ord).

    Boxes that are not valid go first. Sensitive kinds form clusters; other detections then join the cluster they overlap most, or
    with ``keep_generic`` form clusters of their own, and are dropped otherwise. Among equal overlaps the earliest cluster
    wins. A page without clusters gives no rows.
    """
    o = options
    phase = F.when(is_sensitive_type(F.col("type")), 0).otherwise(1)
    rows = detections.where(is_valid_box(Box.of())).select(
        "snapshot_id",
        F.struct(
            phase.alias("phase"), "group_no", "ord", "type", *[F.col(c).cast("double").alias(c) for c in BOX],
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
            "id", "text",
        ).alias("d"),
    )
    pages = rows.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    def overlap(c: Column, d: Column) -> Column:
        a, b = Box.field(c), Box.field(d)
        one, two = iou(a, b), max_overlap(a, b)
        meets = compatible(c["type"], d["type"]) & ((one >= o.iou_threshold) | (two >= o.overlap_threshold))
        return F.when(meets, F.greatest(one, two)).otherwise(F.lit(0.0))

    def step(clusters: Column, d: Column) -> Column:
        # The scores are bound once: a one-element array is transformed by what needs them.
        scores = F.transform(clusters, lambda c: overlap(c, d))

        def place(s: Column) -> Column:
            best = F.array_max(s)
            at = F.array_position(s, best) - 1
            joined = F.transform(clusters, lambda c, i: F.when(i == at, _merged(c, d, o)).otherwise(c))
            begun = F.concat(clusters, F.array(_alone(d, o)))
            fresh = begun if o.keep_generic else F.when(d["phase"] == 0, begun).otherwise(clusters)
            return F.when(F.coalesce(best, F.lit(0.0)) > 0, joined).otherwise(fresh)

        return F.transform(F.array(scores), place)[0]

    fused = pages.select("snapshot_id", F.aggregate("ds", F.array().cast(CLUSTERS), step).alias("clusters"))
    return fused.select("snapshot_id", F.posexplode("clusters").alias("cluster", "c")).select("snapshot_id", "cluster", "c.*")

