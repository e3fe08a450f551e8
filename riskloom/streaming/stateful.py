"""Features per customer and per device as two chained state processors.

The first processor holds a customer's live rows, the first sight of each device and merchant, and the last place
that is no longer among the live rows. The second one holds a device's live rows. Rows may come in any order
within the watermark: a late row gets its features, and the rows that it changes are emitted again with a higher revision,
so the newest revision of every transaction equals the batch result. Event-time timers remove what no trailing window
can reach any more.

The key of the state is a hash bucket of customers (devices), as a call to the state costs more than the work on a row. A batch
reads the live rows of a bucket in one call and adds its own as a few chunks, so its calls grow with the buckets that it touches
and hardly with customers or rows; a bucket is one task. Rows come and go as frames, as single rows cost a worker more than
their features. Where single customers hold much of the stream, ``stream_features``
(time slices) is the operator to take.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from riskloom.functions.geo import known_location
from riskloom.operators.features import finished_features, with_micros
from riskloom.operators.ranking import latest_per_key
from riskloom.operators.trailing import MICROS
from riskloom.streaming.jobs import CUSTOMER_TTL_SECONDS, DEVICE_TTL_SECONDS, read_stored, run_available

MINUTE = 60 * MICROS
#: Items of a chunk of state, more of them where a call would write more chunks than ``MOST_CHUNKS``.
CHUNK, MOST_CHUNKS = 16, 8
#: Hash buckets of customers and of devices. A checkpoint keeps the number that it began with.
BUCKETS = 1024
DAY, HOUR = 86_400 * MICROS, 3_600 * MICROS
#: Transactions without features of their own, carried through both processors.
PASSED = ["amount", "merchant_category", "is_international"]
ROW_DDL = """customer_id string, amount double, merchant_category string, is_international boolean, txn_count_1min bigint, txn_count_5min bigint,
 txn_count_1hr bigint, txn_count_24hr bigint, avg_amount_1hr__sum bigint, avg_amount_1hr__n bigint, max_amount_24hr bigint,
 unique_devices_1hr bigint, is_new_device boolean, is_new_merchant boolean, lat double, lng double, last_lat double, last_lng double"""
CUSTOMER_OUT = "transaction_id string, device_fingerprint string, us bigint, timestamp timestamp, revision bigint, row string"
DEVICE_OUT = "transaction_id string, us bigint, timestamp timestamp, revision bigint, row string, device_txn_count bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Chunks:
    """Lists of one key in a map state, as JSON in chunks by number: one call reads them all, one call writes a chunk.

    Calls of a processor to its state cost more than the work on a row, so rows do not have entries of their own.
    """

    def __init__(self, handle, name: str):
        self.state = handle.getMapState(name, "chunk bigint", "items string")

    def read(self) -> dict[int, list]:
        return {key[0]: json.loads(value[0]) for key, value in self.state.iterator()}

    def add(self, items: list, at: int) -> int:
        """Writes the items as chunks from number ``at`` on; returns the next free number."""
        size = max(CHUNK, -(-len(items) // MOST_CHUNKS))
        for i in range(0, len(items), size):
            self.state.updateValue((at,), (json.dumps(items[i:i + size]),))
            at += 1
        return at

    def replace(self, chunks: dict[int, list], left: dict[int, list]) -> None:
        """Leaves the items of ``left`` (by chunk) of what was read."""
        if not any(left.values()):
            return self.state.clear()
        for at, items in left.items():
            if not items:
                self.state.removeKey((at,))
            elif len(items) < len(chunks[at]):
                self.state.updateValue((at,), (json.dumps(items),))


class _Live:
    """The live rows of one bucket, and its head: last revision, next free chunk numbers, next timer and last places.

    Rows name their ``owner``, the customer or device that they belong to.
    """

    def __init__(self, handle, names: list[str], ttl: int):
        self.handle, self.names, self.ttl = handle, names, ttl
        self.us = names.index("us")
        self.rows = _Chunks(handle, "rows")
        self.head_state = handle.getValueState("head", "head string")

    def head(self) -> dict:
        found = self.head_state.get()
        return json.loads(found[0]) if found else {"n": 0, "rows": 0, "firsts": 0, "timer": None, "places": []}

    def all(self, head: dict, owners: Iterable) -> dict[str, list[dict]]:
        """All rows of each of the owners in order of (us, id), the newest version of each."""
        newest: dict[str, dict] = {owner: {} for owner in owners}
        for _, items in sorted(self.rows.read().items()) if head["n"] else ():
            for cells in items:
                if cells[0] in newest:
                    newest[cells[0]][cells[1]] = cells
        return {owner: sorted((dict(zip(self.names, cells)) for cells in own.values()), key=lambda r: (r["us"], r["id"]))
                for owner, own in newest.items()}

    def keep(self, head: dict, fresh: list[dict]) -> None:
        """Adds rows and writes the head; the bucket's one timer is at the time when its oldest minute expires."""
        fresh = sorted(fresh, key=lambda r: (r["us"], r["id"]))
        head["rows"] = self.rows.add([[r[name] for name in self.names] for r in fresh], head["rows"])
        self._timer(head, fresh[0]["us"])
        self.head_state.update((json.dumps(head),))

    def _timer(self, head: dict, oldest: int) -> None:
        at = ((oldest // MINUTE + 1) * MINUTE + self.ttl) // 1000 + 1
        if head["timer"] is None or at < head["timer"]:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            self.handle.registerTimer(at)
            head["timer"] = at

    def expire(self, mark: int, gone_rows=lambda head, gone: None) -> None:
        """Removes the minutes that end ``ttl`` before the mark; the caller may note what goes in the head."""
        head, chunks = self.head(), self.rows.read()
        old = lambda cells: (cells[self.us] // MINUTE + 1) * MINUTE <= mark - self.ttl
        left = {at: [cells for cells in items if not old(cells)] for at, items in chunks.items()}
        self.rows.replace(chunks, left)
        gone_rows(head, [dict(zip(self.names, cells)) for items in chunks.values() for cells in items if old(cells)])
        stay = [cells[self.us] for items in left.values() for cells in items]
        head["timer"] = None  # it has fired
        if stay:
            self._timer(head, min(stay))
        self.head_state.update((json.dumps(head),))


def _frames(ddl: str, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """One frame of the rows, where there are any; their timestamp is made from ``us``."""
    names = [column.split()[0] for column in ddl.split(", ")]
    if found := list(rows):
        frame = pd.DataFrame(dict(zip((name for name in names if name != "timestamp"), zip(*found))))
        frame["timestamp"] = pd.to_datetime(frame["us"], unit="us", utc=True)
        yield frame[names]


def _novel(rows: list[dict], firsts: dict, column: str) -> list[bool]:
    return [firsts.get(r[column]) == (r["us"], r["id"]) for r in rows]


def customer_values(rows: list[dict], start: int, place: tuple | None) -> list[dict]:
    """Trailing aggregates of the rows from position ``start`` on; rows are in order and reach one window back.

    ``place`` is the last known place before the first row.
    """
    us = np.array([r["us"] for r in rows], np.int64)
    total = np.append(0, np.cumsum([r["cents"] for r in rows], dtype=np.int64))
    low = {w: np.searchsorted(us, us - w * MICROS) for w in (60, 300, 3600, 86_400)}
    begin = int(low[86_400][start]) if start < len(rows) else start
    out, best, devices, hour_from = [], deque(), {}, None
    for i in range(begin, len(rows)):
        cents = rows[i]["cents"]
        while best and rows[best[-1]]["cents"] <= cents:
            best.pop()
        best.append(i)
        while best[0] < low[86_400][i]:
            best.popleft()
        hour = int(low[3600][i])
        for k in range(hour_from if hour_from is not None else begin, hour):  # out of the hour
            own = rows[k]["device"]
            if own in devices:
                devices[own] -= 1
                if not devices[own]:
                    del devices[own]
        hour_from = max(hour, begin)
        devices[rows[i]["device"]] = devices.get(rows[i]["device"], 0) + 1
        if i < start:
            continue
        out.append({
            "txn_count_1min": int(i - low[60][i] + 1), "txn_count_5min": int(i - low[300][i] + 1),
            "txn_count_1hr": int(i - hour + 1), "txn_count_24hr": int(i - low[86_400][i] + 1),
            "avg_amount_1hr__sum": int(total[i + 1] - total[hour]), "avg_amount_1hr__n": int(i - hour + 1),
            "max_amount_24hr": int(rows[best[0]]["cents"]), "unique_devices_1hr": len(devices)})
    for r in rows[:start]:
        place = (r["lat"], r["lng"]) if r["lat"] is not None else place
    for r, values in zip(rows[start:], out):
        values["last_lat"], values["last_lng"] = place or (None, None)
        place = (r["lat"], r["lng"]) if r["lat"] is not None else place
    return out


class CustomerProcessor(StatefulProcessor):
    """Emits each row's customer features, and again those of stored rows that a late row changes."""

    def init(self, handle) -> None:
        self.live = _Live(handle, ["owner", "id", "us", "cents", "device", "merchant", "lat", "lng", "passed"], CUSTOMER_TTL_SECONDS * MICROS)
        self.firsts = _Chunks(handle, "firsts")

    def _first_seen(self, head: dict) -> dict[str, dict[str, dict]]:
        """Per customer, (us, id) of the first row of every device and merchant; merges the chunks when they are many."""
        found: dict[str, dict[str, dict]] = {}
        chunks = self.firsts.read() if head["firsts"] else {}
        for _, items in sorted(chunks.items()):
            for owner, column, value, us, i in items:
                found.setdefault(owner, {"device": {}, "merchant": {}})[column][value] = (us, i)
        if len(chunks) > MOST_CHUNKS:
            whole = [[owner, c, v, *at] for owner, both in found.items() for c, own in both.items() for v, at in own.items()]
            if len(chunks) > 2 * (len(whole) // CHUNK + 1):
                self.firsts.state.clear()
                head["firsts"] = self.firsts.add(whole, 0)
        return found

    def _values(self, rows: list[dict], start: int, firsts: dict[str, dict], place: tuple | None) -> list[dict]:
        values = customer_values(rows, start, place)
        for c in ("device", "merchant"):
            for v, new in zip(values, _novel(rows[start:], firsts[c], c)):
                v[f"is_new_{c}"] = new
        return values

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, dict[str, dict]] = {}
        for frame in rows:
            for packed in frame["packed"]:
                r = {**dict.fromkeys(self.live.names), **json.loads(packed)}
                new.setdefault(r["owner"], {}).setdefault(r["id"], r)
        head = self.live.head()
        held = self.live.all(head, new)
        fresh = {}
        for owner, own in new.items():
            known = {s["id"] for s in held[owner]}
            if unknown := [r for r in own.values() if r["id"] not in known]:
                fresh[owner] = unknown
        if not fresh:
            return
        before = self._first_seen(head)
        after, seen = {}, {}
        for owner, own in fresh.items():
            before.setdefault(owner, {"device": {}, "merchant": {}})
            after[owner] = {c: dict(firsts) for c, firsts in before[owner].items()}
            for r in own:
                for c, firsts in after[owner].items():
                    if r[c] not in firsts or (r["us"], r["id"]) < firsts[r[c]]:
                        firsts[r[c]] = (r["us"], r["id"])
                        seen[owner, c, r[c]] = [owner, c, r[c], r["us"], r["id"]]
        head["firsts"] = self.firsts.add(list(seen.values()), head["firsts"])
        places = {owner: place for owner, *place in head["places"]}
        head["n"] += 1
        self.live.keep(head, [r for own in fresh.values() for r in own])
        yield from _frames(CUSTOMER_OUT, (row for owner, own in fresh.items() for row in self._changed(
            owner, own, held[owner], before[owner], after[owner], places.get(owner), head["n"])))

    def _changed(self, owner: str, fresh: list[dict], every: list[dict], before: dict, after: dict, place: list | None,
                 revision: int) -> Iterator[tuple]:
        """The fresh rows of one customer, and the stored rows whose values they change."""
        first = min(r["us"] for r in fresh)
        low = (first - DAY) // MINUTE * MINUTE
        stored = [r for r in every if r["us"] >= low]  # a first sight or a place may change any later row
        both = sorted(stored + fresh, key=lambda r: (r["us"], r["id"]))
        # The place before the first of these rows may lie in rows that no window reaches.
        older = [r for r in every if r["us"] < low and r["lat"] is not None]
        if older:
            place = (older[-1]["lat"], older[-1]["lng"])
        place = tuple(place[:2]) if place else None
        is_new = {r["id"] for r in fresh}
        start = next(i for i, r in enumerate(both) if r["id"] in is_new)
        values = dict(zip((r["id"] for r in both[start:]), self._values(both, start, after, place)))
        old = {}
        later = [i for i, r in enumerate(stored) if (r["us"], r["id"]) > (both[start]["us"], both[start]["id"])]
        if later:
            at = later[0]
            old = dict(zip((r["id"] for r in stored[at:]), self._values(stored, at, before, place)))
        for r in both[start:]:
            v = values[r["id"]]
            if r["id"] in is_new or v != old.get(r["id"]):
                whole = {"customer_id": owner, "lat": r["lat"], "lng": r["lng"], **v, **r["passed"]}
                yield r["id"], r["device"], r["us"], revision, json.dumps(whole)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        def note_place(head: dict, gone: list[dict]) -> None:
            newest = {owner: place for owner, *place in head["places"]}
            for r in sorted((r for r in gone if r["lat"] is not None), key=lambda r: (r["us"], r["id"])):
                newest[r["owner"]] = [r["lat"], r["lng"], r["us"], r["id"]]
            head["places"] = [[owner, *place] for owner, place in newest.items()]
        self.live.expire(timerValues.getCurrentWatermarkInMs() * 1000, note_place)
        return iter(())

    def close(self) -> None:
        pass


class DeviceProcessor(StatefulProcessor):
    """Adds the device's count of the trailing hour; emits rows anew whose count or customer values change."""

    def init(self, handle) -> None:
        self.live = _Live(handle, ["owner", "id", "us", "version", "row"], DEVICE_TTL_SECONDS * MICROS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, dict[str, dict]] = {}
        for frame in rows:
            for owner, i, us, revision, row in zip(*(frame[c].tolist() for c in (
                    "device_fingerprint", "transaction_id", "us", "revision", "row"))):
                own = new.setdefault(owner, {})
                if i not in own or revision > own[i]["version"]:
                    own[i] = {"owner": owner, "id": i, "us": us, "version": revision, "row": row}
        head = self.live.head()
        held = self.live.all(head, new)
        head["n"] += 1
        self.live.keep(head, [r for own in new.values() for r in own.values()])
        yield from _frames(DEVICE_OUT, (row for owner, own in new.items() for row in self._changed(own, held[owner], head["n"])))

    def _changed(self, new: dict[str, dict], every: list[dict], revision: int) -> Iterator[tuple]:
        """The new rows of one device, and the stored rows whose count they change."""
        first, last = min(r["us"] for r in new.values()), max(r["us"] for r in new.values())
        low, high = (first - HOUR) // MINUTE, (last + HOUR) // MINUTE
        stored = [r for r in every if low <= r["us"] // MINUTE <= high]
        count = lambda own: dict(zip((r["id"] for r in own), (
            np.arange(1, len(own) + 1) - np.searchsorted(us := np.array([r["us"] for r in own], np.int64), us - HOUR)).tolist()))
        both = sorted([r for r in stored if r["id"] not in new] + list(new.values()), key=lambda r: (r["us"], r["id"]))
        before, after = count(stored), count(both)
        versions = {r["id"]: r["version"] for r in stored}
        # Rows before the first new one only serve as history; counts of theirs are not whole.
        for r in both:
            if r["us"] >= first and (r["id"] in new and r["version"] != versions.get(r["id"]) or after[r["id"]] != before.get(r["id"])):
                yield r["id"], r["us"], revision, r["row"], after[r["id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.expire(timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def close(self) -> None:
        pass


def customer_stage(stream: DataFrame, delay: str) -> DataFrame:
    """The stream of transactions through the customer processor."""
    rows = with_micros(stream.withWatermark("timestamp", delay))
    known: Column = known_location(F.col("location_lat"), F.col("location_lng"))
    packed = F.struct(F.col("customer_id").alias("owner"), F.col("transaction_id").alias("id"), "us", "cents",
                      F.col("device_fingerprint").alias("device"), F.col("merchant_id").alias("merchant"),
                      F.when(known, F.col("location_lat")).alias("lat"), F.when(known, F.col("location_lng")).alias("lng"),
                      F.struct(*PASSED).alias("passed"))
    # One text is cheaper to hand to a worker than a value per column.
    narrow = rows.select(_bucket("customer_id"), "timestamp", F.to_json(packed).alias("packed"))
    return narrow.groupBy("bucket").transformWithStateInPandas(
        CustomerProcessor(), CUSTOMER_OUT, "Append", "EventTime", eventTimeColumnName="timestamp")


def _bucket(owner: str) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int").alias("bucket")


def device_stage(rows: DataFrame) -> DataFrame:
    """The customer processor's rows through the device processor."""
    named = rows.select(_bucket("device_fingerprint"), "transaction_id", "device_fingerprint", "us", "timestamp", "revision", "row")
    return named.groupBy("bucket").transformWithStateInPandas(
        DeviceProcessor(), DEVICE_OUT, "Append", "EventTime", eventTimeColumnName="timestamp")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that processors need, for queries that start inside; the session keeps its own setting."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, own) if own else spark.conf.unset(PROVIDER)


def stateful_features(stream: DataFrame, root: str, checkpoint: str, delay: str = "1 hour"):
    """Runs both processors over the available input and appends their emissions to ``root``; returns the query.

    Rows that come later than ``delay`` after the newest one are dropped by the watermark; ``late_rows`` keeps them.
    """
    with _state_store(stream.sparkSession):
        query = (device_stage(customer_stage(stream, delay)).writeStream.format("parquet").option("path", root)
                 .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def late_rows(stream: DataFrame, root: str, checkpoint: str, delay_us: int):
    """Keeps the rows that come more than ``delay_us`` behind the newest row of all earlier batches, under ``root``/late.

    The mark is stored per batch and read only below the batch's number, so a repeated batch finds the mark that it
    found before and replaces its own output.
    """
    spark = stream.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = with_micros(batch)
        marks = read_stored(spark, f"{root}/marks")
        marks = rows.select(F.lit(-1).alias("batch"), "us").limit(0) if marks is None else marks
        mark = marks.where(F.col("batch") < batch_id).agg(F.max("us")).scalar()
        rows.where(F.col("us") < mark - F.lit(delay_us)).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        rows.agg(F.max("us").alias("us")).where("us is not null").write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")

    return run_available(stream, on_batch, checkpoint)


def newest_features(emitted: DataFrame) -> DataFrame:
    """The 17 features of every transaction, from its newest emission."""
    newest = latest_per_key(emitted, ["transaction_id"], ["revision"])
    wide = newest.select("transaction_id", "us", "timestamp", "device_txn_count", F.from_json("row", ROW_DDL).alias("r")).select(
        "transaction_id", "us", "timestamp", "device_txn_count", "r.*")
    place = lambda a, b: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("lat"), F.col(b).alias("lng")))
    none = F.lit(None).cast("double")
    return finished_features(wide.withColumns({"place": place("lat", "lng"), "last_place": place("last_lat", "last_lng"),
                                               "baseline_mean": none, "baseline_std": none}))
