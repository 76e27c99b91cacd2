"""Keyed state: change detection, lifecycle transitions and the work queue as streams.

State per product is one small tuple, so it does not grow with a product's records.  A
micro-batch is ordered per product in memory: bound it at the source with
``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PRODUCT = ["marketplace", "product_id"]

CHANGE_OUTPUT = ("marketplace string, product_id string, record_no bigint, price bigint, "
                 "state string, previous_price bigint")
CHANGE_STATE = "updated_at bigint, price bigint, fingerprint string"

TRANSITION_OUTPUT = ("marketplace string, product_id string, record_no bigint, "
                     "last_active_price bigint, sold_at timestamp, first_sold boolean")
TRANSITION_STATE = "status string, active_price bigint, sold_before boolean"

QUEUE_OUTPUT = ("marketplace string, product_id string, state string, attempts int, "
                "available_at timestamp, reason string")
QUEUE_STATE = "fingerprint string, state string, attempts int, at bigint"


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The micro-batch records of one product in record order."""
    return pd.concat(list(batches), ignore_index=True).sort_values("record_no", kind="stable")


def _detect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
    was = state.get if state.exists else None
    rows = []
    for r in _ordered(batches).itertuples(index=False):
        second = int(r.updated_at.timestamp())
        now = (second, int(r.price), r.search_fingerprint)
        if was is None:
            rows.append((*key, r.record_no, now[1], "new", None))
        elif tuple(was) == now:
            rows.append((*key, r.record_no, now[1], "unchanged", None))
        else:
            rows.append((*key, r.record_no, now[1], "updated", int(was[1])))
        was = now
    state.update(was)
    out = pd.DataFrame(rows, columns=["marketplace", "product_id", "record_no", "price", "state",
                                      "previous_price"])
    yield out.astype({"previous_price": "Int64"})


def change_states(records: DataFrame) -> DataFrame:
    """new / updated / unchanged against the last record of the product.

    ``records``: product keys, record_no, updated_at, price, search_fingerprint.
    """
    return records.groupBy(*PRODUCT).applyInPandasWithState(
        _detect, CHANGE_OUTPUT, CHANGE_STATE, "append", GroupStateTimeout.NoTimeout)


def _transitions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
    status, price, sold = state.get if state.exists else (None, None, False)
    rows = []
    for r in _ordered(batches).itertuples(index=False):
        if r.listing_status == "sold" and status == "active":
            rows.append((*key, r.record_no, price, r.updated_at, not sold))
        sold = sold or r.listing_status == "sold"
        if r.listing_status == "active":
            price = int(r.price)
        status = r.listing_status
    state.update((status, price, sold))
    out = pd.DataFrame(rows, columns=["marketplace", "product_id", "record_no",
                                      "last_active_price", "sold_at", "first_sold"])
    yield out.astype({"last_active_price": "Int64"})


def lifecycle_transitions(checks: DataFrame) -> DataFrame:
    """Active-to-sold changes, keeping the last active price.

    ``checks``: product keys, record_no, listing_status, price, updated_at.
    """
    return checks.groupBy(*PRODUCT).applyInPandasWithState(
        _transitions, TRANSITION_OUTPUT, TRANSITION_STATE, "append",
        GroupStateTimeout.NoTimeout)


def _queue(delay_seconds: int, stale_seconds: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        print_, status, attempts, at = (state.get if state.exists
                                        else (None, None, 0, 0))
        reason = "event"
        if state.hasTimedOut:
            reason = "timer"
            if status == "processing":
                status, reason = "retry", "stale processing recovery"
        else:
            for r in _ordered(batches).itertuples(index=False):
                now = int(r.at.timestamp())
                if r.kind == "enqueue":
                    if r.classification_fingerprint != print_:
                        print_, status, attempts, at = (r.classification_fingerprint,
                                                        "pending", 0, now)
                elif r.kind == "start" and status in ("pending", "retry"):
                    status, attempts, at = "processing", attempts + 1, now
                elif r.kind == "finish" and status is not None:
                    status = "completed"
                elif r.kind == "fail" and status is not None:
                    status, at = "retry", now + delay_seconds
        state.update((print_, status, attempts, at))
        if status == "processing":
            state.setTimeoutDuration(stale_seconds * 1000)
        yield pd.DataFrame([(*key, status, attempts, pd.Timestamp(at, unit="s", tz="UTC"),
                             reason)],
                           columns=["marketplace", "product_id", "state", "attempts",
                                    "available_at", "reason"])
    return step


def queue_states(events: DataFrame, delay_seconds: int = 600,
                 stale_seconds: int = 900) -> DataFrame:
    """Work-queue state after each micro-batch; stale work returns by a timer."""
    return events.groupBy(*PRODUCT).applyInPandasWithState(
        _queue(delay_seconds, stale_seconds), QUEUE_OUTPUT, QUEUE_STATE, "update",
        GroupStateTimeout.ProcessingTimeTimeout)


def first_per_product(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a product inside the watermark delay (cross-source duplicates)."""
    return records.withWatermark("updated_at", delay).dropDuplicatesWithinWatermark(PRODUCT)
