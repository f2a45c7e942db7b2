"""Shapes of plans: how often rows are shuffled, and how often what is dear is worked out."""

import numpy as np
import pyarrow as pa
import pytest

from hushpage.operators import redact, sanitize
from hushpage.plans import action_queries, html_queries, vision_queries
from hushpage.sources import png, views

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["type_plans", "select_plans", "click_plans", "registered_plans"])
def test_planning_shuffles_tasks_and_elements_once_each(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        plan = plan_of(action_queries.QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 2


def test_actions_are_parsed_at_most_three_times_a_row(spark):
    plan = plan_of(action_queries.contract_disagreements(spark, SF))
    assert plan.count("parse_json") + plan.count("parseJson") <= 3


def test_pictures_are_dealt_out_and_never_joined(spark):
    assert views.pictures(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (html_queries.masked_screenshots(spark, SF), vision_queries.mask_verified(spark, SF)):
        assert "Join" not in plan_of(rows)


def test_a_worker_holds_some_elements_and_pixels_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([b"\0" * 8000] * 4000)], names=["snapshot_id", "data"])
    assert max(at.stop - at.start for at in redact._groups(batch)) * 8000 <= 1 << 22


def test_pages_are_cleaned_many_to_a_batch_each_with_its_own_types(spark):
    def cleaner(rows, seen, options):
        assert rows["sensitive"].dtype == (object if rows["snapshot_id"].iloc[0] == 1 else bool) and len(seen) == (rows["snapshot_id"].iloc[0] != 2)
        return rows.assign(text="x")

    row = ", ".join(f"NULL AS {c}" for c in ("type", "tag_name", "role", "aria_label", "placeholder", "value", "input_type"))
    elements = spark.sql(f"SELECT id AS snapshot_id, 0 AS ord, 'a' AS id, {row}, 't' AS text, 1D AS x, 1D AS y, 1D AS width, 1D AS height, TRUE AS visible, TRUE AS enabled, IF(id = 1, NULL, FALSE) AS sensitive FROM range(4)")
    found = spark.sql("SELECT id AS snapshot_id, 0 AS ord FROM range(4) WHERE id <> 2")
    out = sanitize.each_page(cleaner)(elements, found, sanitize.SanitizeOptions())
    assert sorted((r.snapshot_id, r.ord, r.text, r.failed) for r in out.collect()) == [(p, 0, "x", None) for p in range(4)]
    assert "FlatMapCoGroupsInPandas" not in plan_of(out)


def test_filters_are_undone_alike_byte_by_byte_and_along_diagonals():
    r = np.random.default_rng(3)
    for _ in range(50):
        height, width, step = r.integers(1, 7, 3).tolist()
        kinds, rows, above = r.integers(3, 5, height), r.integers(0, 256, (height, width * step), dtype=np.uint8), r.integers(0, 256, width * step, dtype=np.uint8)
        want = png._diagonals(kinds, rows.reshape(height, -1, step), above.reshape(-1, step)).reshape(height, -1)
        assert np.array_equal(png._one_by_one(kinds, rows, above, step), want)
