"""Queries over the arithmetic around models and over masks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushpage.functions.classify import is_sensitive_type
from hushpage.operators import redact, vision
from hushpage.plans.page_queries import DET, SENS, sql_iou
from hushpage.sources import views

DICTIONARY = ["", "a", "b", "c", " ", "d", "e"]


def _sizes(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return part.select("p_partkey", (F.col("p_size") * 40 + 7).cast("double").alias("w"), (F.col("p_partkey") % 37 * 50 + 11).cast("double").alias("h"))


def det_dims(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", vision.detection_size(F.col("w"), F.col("h")).alias("d")).select("p_partkey", "d.*")


def rec_dims(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", vision.recognition_width(F.col("w"), F.col("h")).alias("width"))


def _maps(spark, sf_dir):
    heat = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 6))
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), heat.alias("prob"))


def heat_components(spark, sf_dir):
    return vision.heat_components(_maps(spark, sf_dir)).withColumn("mean", F.round("mean", 6)).drop("component")


def text_regions(spark, sf_dir):
    found = vision.heat_components(_maps(spark, sf_dir)).withColumns({"width": F.lit(8.0), "height": F.lit(8.0), "scale_x": F.lit(0.1), "scale_y": F.lit(0.16), "image_width": F.lit(80.0), "image_height": F.lit(50.0)})
    return vision.text_regions(found, least_pixels=4).drop("component").withColumn("score", F.round("score", 6))


def ctc_decode(spark, sf_dir):
    decoded = vision.ctc_decode(F.col("embedding"), 8, 8, DICTIONARY)
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", decoded.alias("d")).select("vec_id", "d.text", "d.confidence")
    return rows.withColumn("confidence", F.round("confidence", 6))


def ocr_scores(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", vision.recognition_score(F.col("l_discount") * 9, 0.5 + F.col("l_tax") * 4).alias("score"))


def face_candidates(spark, sf_dir):
    e = F.col("embedding")
    scores = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.array(F.lit(0.0), F.abs(F.element_at(e, i)).cast("double") * 8)))
    boxes = F.transform(e, lambda x, i: F.when(i % 4 < 2, F.abs(x).cast("double")).otherwise(0.4 + F.abs(x).cast("double") * 2))
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), scores.alias("scores"), boxes.alias("boxes"), F.lit(64.0).alias("image_width"), F.lit(48.0).alias("image_height"))
    return vision.face_candidates(rows)


def nms_kept(spark, sf_dir):
    return vision.suppress(views.boxes(spark, sf_dir).drop("type")).select("snapshot_id", "ord", "confidence")


def _regions(spark, sf_dir):
    box = F.struct("x", "y", "width", "height")
    seen = views.detections(spark, sf_dir).where(is_sensitive_type(F.col("type")))
    return seen.groupBy("snapshot_id").agg(F.collect_list(box).alias("regions"))


def redaction_area(spark, sf_dir):
    """Masked pixels of a 50 by 40 image, overlaps counted once."""
    return redact.masked_area(_regions(spark, sf_dir).withColumns({"width": F.lit(50), "height": F.lit(40)}))


def redaction_precision(spark, sf_dir):
    """How much of what the sure detections mask should be masked, and how much of what all sensitive ones ask for is."""
    box = F.struct("x", "y", "width", "height")
    seen = views.detections(spark, sf_dir)
    sure, due = seen.where("confidence >= 0.7 AND type <> 'ui'"), seen.where(is_sensitive_type(F.col("type")))
    masked, truth = (d.groupBy("snapshot_id").agg(F.collect_list(box).alias(n)) for d, n in ((sure, "regions"), (due, "truth")))
    both = masked.join(truth, "snapshot_id", "full").withColumns({"width": F.lit(50), "height": F.lit(40)})
    out = redact.redaction_quality(both)
    share = lambda of: F.round(F.try_divide("both", of), 6)
    return out.select("snapshot_id", "masked", "due", "both", share("masked").alias("precision"), share("due").alias("recall"))


def _images(spark, sf_dir):
    data = F.when(F.col("snapshot_id") % 10 == 9, F.unhex(F.lit("00"))).otherwise(F.unhex(F.repeat(F.lit("0A141EFF"), 2000)))
    return _regions(spark, sf_dir).withColumns({"data": data, "width": F.lit(50), "height": F.lit(40)})


def masked_images(spark, sf_dir):
    out = redact.redact_images(_images(spark, sf_dir))
    return out.select("snapshot_id", F.sha2("data", 256).alias("sha256"), "redacted", "error")


def redacted_verified(spark, sf_dir):
    """Masking and its check in one pass."""
    out = redact.redact_and_verify(_images(spark, sf_dir))
    return out.select("snapshot_id", F.sha2("data", 256).alias("sha256"), "redacted", "error", "code")


def mask_verified(spark, sf_dir):
    """Every third page is checked against its unmasked image, which fails where a region touches it."""
    own = {"data": "own", "width": "width", "height": "height", "regions": "regions"}
    both = redact.redact_images(_images(spark, sf_dir), own).withColumnsRenamed({"data": "masked", "own": "data"}).withColumn("masked", F.when(F.col("snapshot_id") % 3 == 0, F.col("data")).otherwise(F.col("masked")))
    return redact.verify_masks(both)


def _sums(spark, sf_dir, one, digits=0):
    rows = vision.pixel_sums(views.pictures(spark, sf_dir).withColumnRenamed("snapshot_id", "image_id"), one)
    return rows.select("image_id", F.array_join("shape", "x").alias("shape"), F.round("total", digits).alias("total"), F.round("weighted", digits).alias("weighted"))


def resized_pictures(spark, sf_dir):
    return _sums(spark, sf_dir, lambda image: vision.resize(image, 3, 2))


def picture_planes(spark, sf_dir):
    """Planes as the detection model takes them, in 32-bit numbers."""
    return _sums(spark, sf_dir, vision.planes, 2)


def picture_crops(spark, sf_dir):
    return _sums(spark, sf_dir, lambda image: vision.crop(image, 0.5, 1.2, 2.0, 1.5))


def recognition_inputs(spark, sf_dir):
    """A crop of each picture as the recognition model takes it, four lines high."""
    return _sums(spark, sf_dir, lambda image: vision.recognition_input(image, 0.5, 1.2, 2.0, 1.5, target=4), 2)


_QUERIES = (resized_pictures, picture_planes, picture_crops, recognition_inputs, det_dims, rec_dims, heat_components, text_regions, ctc_decode, ocr_scores, face_candidates, nms_kept, redaction_area, redaction_precision, masked_images, mask_verified, redacted_verified)
QUERIES = {f.__name__: f for f in _QUERIES}

_WH = "SELECT p_partkey, (p_size * 40 + 7)::DOUBLE AS w, (p_partkey % 37 * 50 + 11)::DOUBLE AS h FROM part"
_RATIO = "CASE WHEN greatest(w, h) > 960 THEN 960::DOUBLE / greatest(w, h) ELSE 1::DOUBLE END"
_COMPONENTS = """
WITH RECURSIVE c AS (
  SELECT vec_id AS image_id, i - 1 AS p, least(1::DOUBLE, abs(embedding[i]::DOUBLE) * 6) AS v FROM embeddings, range(1, 65) AS t(i)
  WHERE least(1::DOUBLE, abs(embedding[i]::DOUBLE) * 6) >= 0.3),
n AS (SELECT a.image_id, a.p AS p, b.p AS q FROM c AS a JOIN c AS b ON a.image_id = b.image_id
      AND ((a.p // 8 = b.p // 8 AND abs(a.p - b.p) = 1) OR abs(a.p - b.p) = 8)),
r AS (SELECT image_id, p AS root, p FROM c UNION SELECT r.image_id, r.root, n.q FROM r JOIN n ON n.image_id = r.image_id AND n.p = r.p),
l AS (SELECT image_id, p, min(root) AS root FROM r GROUP BY image_id, p),
k AS (SELECT l.image_id, l.root, min(l.p % 8)::INT AS min_x, min(l.p // 8)::INT AS min_y, max(l.p % 8)::INT AS max_x, max(l.p // 8)::INT AS max_y, avg(c.v) AS mean, count(*) AS pixels
      FROM l JOIN c USING (image_id, p) GROUP BY l.image_id, l.root)
"""
_D = "(w * h * 1.5 / greatest(1, 2 * (w + h)))"
_FACE = """
SELECT vec_id AS image_id, (a - 1)::INT AS anchor, abs(embedding[a])::DOUBLE * 8 AS s,
  greatest(0, least(64, abs(embedding[a * 4 - 3])::DOUBLE * 64)) AS x0, greatest(0, least(48, abs(embedding[a * 4 - 2])::DOUBLE * 48)) AS y0,
  greatest(0, least(64, (0.4 + abs(embedding[a * 4 - 1])::DOUBLE * 2) * 64)) AS x1, greatest(0, least(48, (0.4 + abs(embedding[a * 4])::DOUBLE * 2) * 48)) AS y1
FROM embeddings, range(1, 17) AS t(a)
"""

#: Boxes of sensitive detections on images of 50 by 40 pixels, and the bytes of each image once they are black.
_TOUCHED = f"""
SELECT snapshot_id, greatest(0, floor(x))::INT AS x0, greatest(0, floor(y))::INT AS y0, least(50, ceil(x + width))::INT AS x1, least(40, ceil(y + height))::INT AS y1,
  width > 0 AND height > 0 AS valid FROM {DET} AS d WHERE type IN {SENS}"""
_MASKED = f"""
WITH b AS ({_TOUCHED}),
h AS (SELECT snapshot_id, count(*) FILTER (WHERE valid AND x0 < x1 AND y0 < y1)::INT AS n FROM b GROUP BY 1),
p AS (SELECT DISTINCT snapshot_id, py * 50 + px AS spot FROM (SELECT snapshot_id, y0, y1, unnest(range(x0, x1)) AS px FROM b WHERE valid), range(0, 40) AS t(py) WHERE py >= y0 AND py < y1),
i AS (SELECT h.snapshot_id, sha256(from_hex(string_agg(CASE WHEN p.spot IS NULL THEN '0A141EFF' ELSE '000000FF' END, '' ORDER BY r.spot))) AS sha
      FROM h CROSS JOIN range(0, 2000) AS r(spot) LEFT JOIN p ON p.snapshot_id = h.snapshot_id AND p.spot = r.spot GROUP BY 1),
m AS (SELECT snapshot_id, CASE WHEN snapshot_id % 10 <> 9 THEN sha END AS sha256, CASE WHEN snapshot_id % 10 <> 9 THEN n ELSE 0 END::INT AS redacted,
        CASE WHEN snapshot_id % 10 = 9 THEN 'INVALID_IMAGE' END AS error, n FROM h JOIN i USING (snapshot_id))
"""

def _pixels(where: str) -> str:
    box = "greatest(0, floor(x))::INT AS x0, greatest(0, floor(y))::INT AS y0, least(50, ceil(x + width))::INT AS x1, least(40, ceil(y + height))::INT AS y1"
    return f"""SELECT DISTINCT snapshot_id, px, py FROM (SELECT snapshot_id, y0, y1, unnest(range(x0, x1)) AS px FROM (SELECT snapshot_id, width > 0 AND height > 0 AS valid, {box} FROM {DET} AS d WHERE {where}) WHERE valid),
      range(0, 40) AS t(py) WHERE py >= y0 AND py < y1"""




def _sums_sql(values: str, shape: str, digits: int = 0) -> str:
    """SQL of _sums over values (image_id, pos, v)."""
    return f"SELECT image_id, {shape} AS shape, round(sum(v::DOUBLE), {digits}) AS total, round(sum(v::DOUBLE * (1 + pos % 97)), {digits}) AS weighted FROM ({values}) GROUP BY ALL"


def _resized_sql(pixels: str, across: str, down: str, width: int, height: int, channels: int) -> str:
    """SQL of resizing pixels (image_id, x, y, c, v) of an image of across by down; pos counts pixels, then channels."""
    return f"""
    SELECT o.image_id, o.c, o.ox, o.oy, floor((a.v * (1 - wx) + b.v * wx) * (1 - wy) + (d.v * (1 - wx) + e.v * wx) * wy + 0.5)::BIGINT & 255 AS v
    FROM (SELECT *, least(w - 1, x0 + 1) AS x1, least(h - 1, y0 + 1) AS y1, ax - x0 AS wx, ay - y0 AS wy FROM (
            SELECT *, greatest(0, floor(ax))::INT AS x0, greatest(0, floor(ay))::INT AS y0 FROM (
              SELECT image_id, c, w, h, ox, oy, (ox + 0.5::DOUBLE) * (w / {width}::DOUBLE) - 0.5::DOUBLE AS ax, (oy + 0.5::DOUBLE) * (h / {height}::DOUBLE) - 0.5::DOUBLE AS ay
              FROM (SELECT DISTINCT image_id, {across} AS w, {down} AS h FROM ({pixels})), range({channels}) AS k(c), range({width}) AS p(ox), range({height}) AS q(oy)))) AS o
    JOIN ({pixels}) AS a ON a.image_id = o.image_id AND a.c = o.c AND a.x = x0 AND a.y = y0 JOIN ({pixels}) AS b ON b.image_id = o.image_id AND b.c = o.c AND b.x = x1 AND b.y = y0
    JOIN ({pixels}) AS d ON d.image_id = o.image_id AND d.c = o.c AND d.x = x0 AND d.y = y1 JOIN ({pixels}) AS e ON e.image_id = o.image_id AND e.c = o.c AND e.x = x1 AND e.y = y1"""


_PIXELS = f"SELECT snapshot_id AS image_id, width, height, x, y, c, v::DOUBLE AS v FROM ({views.PIXELS})"
_CROP = f"SELECT image_id, x, y - 1 AS y, c, v FROM ({_PIXELS}) WHERE x <= 2 AND y BETWEEN 1 AND 2"
_MEANS = ", ".join(f"({m}::DOUBLE)" for m in vision.MEAN), ", ".join(f"({d}::DOUBLE)" for d in vision.DEVIATION)

ORACLES = {
    "resized_pictures": _sums_sql(f"SELECT image_id, (oy * 3 + ox) * 4 + c AS pos, v FROM ({_resized_sql(_PIXELS, 'width', 'height', 3, 2, 4)})", "'2x3x4'"),
    "picture_planes": _sums_sql(f"SELECT image_id, width, height, (c * height + y) * width + x AS pos, ((v / 255 - [{_MEANS[0]}][c + 1]) / [{_MEANS[1]}][c + 1])::FLOAT AS v FROM ({_PIXELS}) WHERE c < 3", "'3x' || any_value(height) || 'x' || any_value(width)", 2),
    "picture_crops": _sums_sql(f"SELECT image_id, (y * 3 + x) * 4 + c AS pos, v FROM ({_CROP})", "'2x3x4'"),
    "recognition_inputs": _sums_sql(f"SELECT image_id, (c * 4 + oy) * 16 + ox AS pos, ((v / 255::DOUBLE - 0.5) / 0.5)::FLOAT AS v FROM ({_resized_sql(_CROP, '3', '2', 16, 4, 3)})", "'3x4x16'", 2),
    "redaction_precision": f"""
        WITH m AS ({_pixels("confidence >= 0.7 AND type <> 'ui'")}), t AS ({_pixels(f"type IN {SENS}")}),
        c AS (SELECT coalesce(m.snapshot_id, t.snapshot_id) AS snapshot_id, count(m.px) AS masked, count(t.px) AS due, count(*) FILTER (WHERE m.px IS NOT NULL AND t.px IS NOT NULL) AS both_
              FROM m FULL JOIN t ON m.snapshot_id = t.snapshot_id AND m.px = t.px AND m.py = t.py GROUP BY 1),
        s AS (SELECT DISTINCT snapshot_id FROM {DET} AS d WHERE (confidence >= 0.7 AND type <> 'ui') OR type IN {SENS})
        SELECT s.snapshot_id, coalesce(masked, 0) AS masked, coalesce(due, 0) AS due, coalesce(both_, 0) AS both, CASE WHEN masked > 0 THEN round(both_::DOUBLE / masked, 6) END AS precision,
          CASE WHEN due > 0 THEN round(both_::DOUBLE / due, 6) END AS recall FROM s LEFT JOIN c USING (snapshot_id)""",
    "masked_images": f"{_MASKED} SELECT snapshot_id, sha256, redacted, error FROM m",
    "redacted_verified": f"{_MASKED} SELECT snapshot_id, sha256, redacted, error, CASE WHEN error IS NOT NULL THEN 'SCREENSHOT_VERIFICATION_FAILURE' END AS code FROM m",
    "mask_verified": f"""{_MASKED} SELECT snapshot_id, CASE WHEN error IS NOT NULL THEN 'SCREENSHOT_VERIFICATION_FAILURE' WHEN snapshot_id % 3 = 0 AND n > 0 THEN 'SCREENSHOT_UNMASKED_PIXELS' END AS code FROM m""",
    "det_dims": f"""
        SELECT p_partkey, width, height, width / w AS scale_x, height / h AS scale_y FROM (SELECT *, greatest(32::DOUBLE, floor(w * {_RATIO} / 32 + 0.5) * 32) AS width,
          greatest(32::DOUBLE, floor(h * {_RATIO} / 32 + 0.5) * 32) AS height FROM ({_WH}))""",
    "rec_dims": f"SELECT p_partkey, greatest(16::DOUBLE, floor(48::DOUBLE * (w / h) + 0.5)) AS width FROM ({_WH})",
    "heat_components": f"{_COMPONENTS} SELECT image_id, min_x, min_y, max_x, max_y, round(mean, 6) AS mean, pixels FROM k",
    "text_regions": f"""{_COMPONENTS},
        e AS (SELECT *, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h FROM k WHERE mean >= 0.5 AND pixels >= 4),
        o AS (SELECT *, greatest(0, floor(min_x - {_D})) AS x0, greatest(0, floor(min_y - {_D})) AS y0, least(8, ceil(max_x + 1 + {_D})) AS x1, least(8, ceil(max_y + 1 + {_D})) AS y1 FROM e),
        q AS (SELECT *, least(80::DOUBLE, x0 / 0.1::DOUBLE) AS ox, least(50::DOUBLE, y0 / 0.16::DOUBLE) AS oy FROM o),
        z AS (SELECT *, least(80, floor(ox + 0.5)) AS x, least(50, floor(oy + 0.5)) AS y FROM q),
        f AS (SELECT image_id, x::DOUBLE AS x, y::DOUBLE AS y, greatest(0, least(80 - x, floor(least(80 - ox, (x1 - x0) / 0.1::DOUBLE) + 0.5)))::DOUBLE AS width,
          greatest(0, least(50 - y, floor(least(50 - oy, (y1 - y0) / 0.16::DOUBLE) + 0.5)))::DOUBLE AS height, round(least(1, mean), 6) AS score FROM z)
        SELECT * FROM f WHERE width >= 3 AND height >= 3""",
    "ctc_decode": """
        WITH s AS (SELECT vec_id, t, list_position(l, list_max(l)) - 1 AS c, least(1, greatest(0, list_max(l)::DOUBLE)) AS v
          FROM (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] AS l FROM embeddings, range(0, 8) AS r(t))),
        p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY vec_id ORDER BY t), -1) AS before FROM s),
        k AS (SELECT vec_id, trim(string_agg(['', 'a', 'b', 'c', ' ', 'd', 'e'][c + 1], '' ORDER BY t)) AS text, sum(v ORDER BY t) / count(*) AS v
          FROM p WHERE c <> 0 AND c <> before AND c < 7 GROUP BY vec_id)
        SELECT e.vec_id, coalesce(k.text, '') AS text, CASE WHEN coalesce(k.text, '') = '' THEN 0::DOUBLE ELSE round(least(1, k.v), 6) END AS confidence
        FROM embeddings AS e LEFT JOIN k USING (vec_id)""",
    "ocr_scores": "SELECT l_orderkey, l_linenumber, l_partkey, round(least(1::DOUBLE, sqrt(l_discount * 9 * (0.5::DOUBLE + l_tax * 4))), 4) AS score FROM lineitem",
    "face_candidates": f"""
        WITH z AS (SELECT *, least(64, floor(x0 + 0.5)) AS x, least(48, floor(y0 + 0.5)) AS y FROM ({_FACE}) WHERE s >= 0.7::DOUBLE),
        f AS (SELECT image_id, anchor, x, y, greatest(0, least(64 - x, floor(x1 - x0 + 0.5))) AS width, greatest(0, least(48 - y, floor(y1 - y0 + 0.5))) AS height, least(1, s) AS confidence FROM z)
        SELECT * FROM f WHERE width > 0 AND height > 0""",
    "nms_kept": f"""
        WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY confidence DESC, ord) AS k FROM ({views.BOXES})),
        f AS (
          SELECT snapshot_id, k, [{{'ord': ord, 'x': x, 'y': y, 'width': width, 'height': height, 'confidence': confidence}}] AS kept FROM d WHERE k = 1
          UNION ALL
          SELECT d.snapshot_id, d.k, CASE WHEN len(list_filter(f.kept, lambda c: {sql_iou('c', 'd')} > 0.3)) > 0 THEN f.kept
            ELSE list_append(f.kept, {{'ord': d.ord, 'x': d.x, 'y': d.y, 'width': d.width, 'height': d.height, 'confidence': d.confidence}}) END
          FROM f JOIN d ON d.snapshot_id = f.snapshot_id AND d.k = f.k + 1)
        SELECT snapshot_id, c.ord, c.confidence FROM (SELECT snapshot_id, unnest(kept) AS c FROM (SELECT snapshot_id, arg_max(kept, k) AS kept FROM f GROUP BY 1))""",
    "redaction_area": f"""
        WITH b AS (SELECT snapshot_id, greatest(0, floor(x))::INT AS x0, greatest(0, floor(y))::INT AS y0, least(50, ceil(x + width))::INT AS x1, least(40, ceil(y + height))::INT AS y1, width
                   FROM {DET} AS d WHERE type IN {SENS}),
        p AS (SELECT DISTINCT snapshot_id, px, py FROM (SELECT snapshot_id, y0, y1, unnest(range(x0, x1)) AS px FROM b WHERE width > 0), range(0, 40) AS t(py) WHERE py >= y0 AND py < y1)
        SELECT s.snapshot_id, count(p.px) AS area FROM (SELECT DISTINCT snapshot_id FROM b) AS s LEFT JOIN p USING (snapshot_id) GROUP BY s.snapshot_id""",
}
