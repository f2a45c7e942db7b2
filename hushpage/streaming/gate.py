"""The guard on a stream: a page's parts arrive in any order and in any micro-batch, and leave as one verdict.

Parts are rows (snapshot_id, part, ord, body): ``page`` (url, title, and how many elements and detections it has), ``screen`` (a data URL),
``element`` and ``detection``, each with its fields as JSON in ``body``. State by page keeps what has come; a page that is complete goes
through all phases of guard.sanitize. One that is not complete in time is blocked, as silence is no pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hushpage.operators import guard
from hushpage.operators.sanitize import SanitizeOptions
from hushpage.sources.png import decode_screenshots

PART = "snapshot_id long, part string, ord int, body string"
PAGE = "url string, title string, elements long, detections long"
SCREEN = "data_url string"
ELEMENT = (
    "ord int, id string, type string, tag_name string, role string, text string, aria_label string, placeholder string, value string, has_value boolean, input_type string, "
    "autocomplete string, name string, x double, y double, width double, height double, visible boolean, enabled boolean, sensitive boolean"
)
DETECTION = "ord int, id string, type string, x double, y double, width double, height double, confidence double, sources array<string>, text string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageParts(StatefulProcessor):
    """Emits (snapshot_id, complete, parts) once a page: all its parts, or none when its time is over.

    A part that comes again, as after a replay, takes its own place; parts of a page that has left are dropped. That a page has left is
    remembered for ``remember`` milliseconds.
    """

    def __init__(self, timeout: int, remember: int):
        self.timeout, self.remember = timeout, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part string, ord int", "body string")
        self.left = handle.getValueState("left", "complete boolean", self.remember)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.left.exists():
            for _ in rows:
                pass
            return
        for batch in rows:
            for part, order, body in zip(batch["part"], batch["ord"], batch["body"], strict=True):
                self.parts.updateValue((part, int(order)), (body,))
        held = [(part, order, body) for (part, order), (body,) in self.parts.iterator()]
        if self._whole(held):
            yield self._leave(key, held)
        elif not self.due.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.timeout
            self.due.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.left.exists():
            yield self._leave(key, None)

    def _leave(self, key, held) -> pd.DataFrame:
        if self.due.exists():
            at = self.due.get()[0]
            if held is not None:
                self.handle.deleteTimer(at)
            self.due.clear()
        self.parts.clear()
        self.left.update((held is not None,))
        return pd.DataFrame({"snapshot_id": [key[0]], "complete": [held is not None], "parts": [json.dumps(held or [])]})

    @staticmethod
    def _whole(held: list[tuple[str, int, str]]) -> bool:
        """Whether a page's own row, its screenshot, and as many elements and detections as it says are there."""
        page = [body for part, _, body in held if part == "page"]
        try:
            said = json.loads(page[0]) if len(page) == 1 else {}
            wanted = {"screen": 1, "element": int(said["elements"]), "detection": int(said["detections"])}
        except (ValueError, KeyError, TypeError):
            return False
        return all(sum(p == part for p, _, _ in held) == n for part, n in wanted.items())

    def close(self) -> None:
        pass


def parts_of(pages: DataFrame, shots: DataFrame, elements: DataFrame, detections: DataFrame) -> DataFrame:
    """Parts of pages (snapshot_id, url, title), shots (snapshot_id, data_url), elements and detections."""
    n = lambda rows, name: rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0).cast("long")
    counted = pages.join(n(elements, "elements"), "snapshot_id", "left").join(n(detections, "detections"), "snapshot_id", "left")
    counted = counted.withColumns({c: F.coalesce(c, zero) for c in ("elements", "detections")})

    def part(rows: DataFrame, name: str, fields: str) -> DataFrame:
        names = [f.split()[0] for f in fields.split(", ")]
        order = F.col("ord").cast("int") if "ord" in names else F.lit(0)
        return rows.select("snapshot_id", F.lit(name).alias("part"), order.alias("ord"), F.to_json(F.struct(*names)).alias("body"))

    return part(counted, "page", PAGE).unionAll(part(shots, "screen", SCREEN)).unionAll(part(elements, "element", ELEMENT)).unionAll(part(detections, "detection", DETECTION))


def check_pages(held: DataFrame, options: SanitizeOptions = SanitizeOptions()) -> tuple[DataFrame, DataFrame]:
    """(verdicts, contexts) of rows that PageParts emits. Incomplete pages are blocked with the guard's default code."""
    whole = held.where("complete").select("snapshot_id", F.explode(F.from_json("parts", "array<array<string>>")).alias("p"))

    def rows(name: str, fields: str) -> DataFrame:
        return whole.where(F.col("p")[0] == name).select("snapshot_id", F.from_json(F.col("p")[2], fields).alias("f")).select("snapshot_id", "f.*")

    pages = rows("page", PAGE).select("snapshot_id", "url", "title", F.lit(True).alias("has_elements"))
    done = guard.sanitize(pages, decode_screenshots(rows("screen", SCREEN)), rows("element", ELEMENT), rows("detection", DETECTION), options)
    late = held.where(~F.col("complete")).select("snapshot_id", F.lit(False).alias("passed"), F.lit(guard.DEFAULT_CODE).alias("code"))
    return guard.verdicts(pages, done.violations).unionByName(late), done.contexts


def guard_stream(
    parts: DataFrame, out: str, checkpoint: str, timeout: int = 60_000, remember: int = 86_400_000, options: SanitizeOptions = SanitizeOptions(), every: str | None = None
) -> StreamingQuery:
    """Writes ``out/verdicts`` and ``out/contexts`` of a stream of parts, numbered by micro-batch, so that a replayed batch replaces itself.

    timeout: milliseconds that a page may take from its first part on. every: the interval of a query that goes on, in which pages
    time out whether new parts come or not; without it the query takes what is there and ends, and pages time out when a later one
    takes new parts. Parts without a page id, a kind or a position are dropped, and so leave their page incomplete. State needs the RocksDB
    store, which is set where the session has the default one.
    """
    conf, store, idle = parts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
    if "RocksDB" not in conf.get(store, ""):
        conf.set(store, _ROCKS)
    known = parts.where("snapshot_id IS NOT NULL AND part IS NOT NULL AND ord IS NOT NULL AND body IS NOT NULL")
    held = known.groupBy("snapshot_id").transformWithStateInPandas(PageParts(timeout, remember), "snapshot_id long, complete boolean, parts string", "Append", "ProcessingTime")

    def each(batch: DataFrame, number: int) -> None:
        batch = guard.keep(batch)
        verdicts, contexts = check_pages(batch, options)
        contexts.write.mode("overwrite").parquet(f"{out}/contexts/batch={number}")
        verdicts.write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")

    writer = held.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    before = conf.get(idle, "true")
    conf.set(idle, "false")  # read when a query starts: with timers pending, batches without data would follow one another for ever
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(idle, before)
