"""Stable identifiers of page elements, and looking elements up by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushpage.functions.elements import IDENTIFIER_STEMS, contains_any
from hushpage.functions.text import safe_identifier


def _usable(raw: Column) -> Column:
    return F.when(~contains_any(raw, IDENTIFIER_STEMS), F.nullif(safe_identifier(raw), F.lit("")))


def candidate_id(kind: Column, dom_id: Column, name: Column, n: Column) -> Column:
    """{type}_{id}, else {type}_name_{name}, else {type}_{n}; credential-like ids and names are passed over.

    Joined text is null where a part is, so each part stands here once: the generated code of this and what it is joined to must stay
    below 64 KB.
    """
    return F.coalesce(F.concat(kind, F.lit("_"), _usable(dom_id)), F.concat(kind, F.lit("_name_"), _usable(name)), F.concat(kind, F.lit("_"), n.cast("string")))


def _probe(rows: pd.DataFrame) -> pd.DataFrame:
    """A page's candidates in order; one that is taken gets the first free number from 2 on. Numbers below the last one given are taken."""
    rows, used, last, out = rows.sort_values("ord"), set(), {}, []
    for candidate in rows["candidate"]:
        name, n = candidate, last.get(candidate, 1)
        while name in used:
            n += 1
            name = f"{candidate}_{n}"
        last[candidate] = n
        used.add(name)
        out.append(name)
    return rows.assign(id=out)[["snapshot_id", "ord", "id"]]


def element_ids(elements: DataFrame) -> DataFrame:
    """(snapshot_id, ord, id) of elements (snapshot_id, ord, type, dom_id, raw_name), unique in a page.

    Counting elements by kind is a window. Only pages where two candidates are equal need the sequential
    probing, one page at a time; all others keep their candidates.
    """
    seen = Window.partitionBy("snapshot_id", "type").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    made = elements.withColumn("n", F.count(F.lit(1)).over(seen))
    made = made.select("snapshot_id", "ord", candidate_id(F.col("type"), F.col("dom_id"), F.col("raw_name"), F.col("n")).alias("candidate"))
    twin = Window.partitionBy("snapshot_id", "candidate")
    page = Window.partitionBy("snapshot_id")
    marked = made.withColumn("again", F.count(F.lit(1)).over(twin) > 1).withColumn("clash", F.max("again").over(page))
    kept = marked.where(~F.col("clash")).select("snapshot_id", "ord", F.col("candidate").alias("id"))
    schema = f"snapshot_id {marked.schema['snapshot_id'].dataType.simpleString()}, ord int, id string"
    probed = marked.where("clash").select("snapshot_id", "ord", "candidate").groupBy("snapshot_id").applyInPandas(_probe, schema)
    return kept.unionByName(probed)


def resolve_elements(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """wanted (snapshot_id, element_id, ...) with the ord of the element it names, or null.

    The assigned id decides; else what follows the first underscore is taken as the page's own id (``dom_id``).
    The first element in order answers, so each lookup side has one row a key.
    """
    by_id = elements.groupBy("snapshot_id", F.col("id").alias("element_id")).agg(F.min("ord").alias("by_id"))
    own = elements.where("dom_id IS NOT NULL").groupBy("snapshot_id", F.col("dom_id").alias("own_id")).agg(F.min("ord").alias("by_own"))
    rest = F.when(F.instr("element_id", "_") > 0, F.expr("substring(element_id, instr(element_id, '_') + 1)"))
    found = wanted.join(by_id, ["snapshot_id", "element_id"], "left").withColumn("own_id", rest)
    found = found.join(own, ["snapshot_id", "own_id"], "left")
    return found.withColumn("ord", F.coalesce("by_id", "by_own")).drop("by_id", "by_own", "own_id")
