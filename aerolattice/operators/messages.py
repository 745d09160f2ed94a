"""Message-log operators: delivery, replies, open traces, lifecycle changes and publisher ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.operators.ordered import running

BROADCAST = "BROADCAST"
# Fixed value: the highest id reserved for the bus itself; publishers are numbered after it.
LAST_RESERVED_ID = 3


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per receiver of each message.

    A broadcast reaches every subscriber of the topic but the sender and the excluded; any other message reaches its
    addressee if that one subscribes to the topic.
    """
    known = subscriptions.distinct()
    to_all = messages.where(F.col("to_id") == BROADCAST).join(known, "topic")
    to_all = to_all.where((F.col("subscriber") != F.col("from_id")) & ~F.array_contains("exclude_ids", F.col("subscriber")))
    direct = messages.withColumn("subscriber", F.col("to_id")).join(known, ["topic", "subscriber"])
    kept = ["trace_id", "topic", "from_id", "subscriber"]
    return to_all.select(*kept).unionByName(direct.select(*kept))


def with_delivered(messages: DataFrame, delivered: DataFrame) -> DataFrame:
    reached = delivered.select("trace_id").distinct().withColumn("delivered", F.lit(True))
    return messages.join(reached, "trace_id", "left").withColumn("delivered", F.coalesce("delivered", F.lit(False)))


def delivery_state(delivered: Column, reply_to: Column) -> Column:
    outcome = F.when(delivered, F.lit("OK")).otherwise(F.lit("FAIL"))
    return F.concat_ws("_", outcome, F.when(reply_to.isNull(), F.lit("REQUEST")).otherwise(F.lit("REPLY")))


def reply_match(messages: DataFrame) -> DataFrame:
    """Requests with the replies that name them; a request without one has a null reply."""
    requests = messages.select(F.col("trace_id").alias("request_id"), F.col("from_id").alias("asked_by"))
    replies = messages.where("reply_to is not null").select(
        F.col("reply_to").alias("request_id"), F.col("trace_id").alias("reply_id"), F.col("from_id").alias("answered_by")
    )
    return requests.join(replies, "request_id", "left")


def open_traces(emitted: DataFrame, closed: DataFrame) -> DataFrame:
    return emitted.join(closed.select("trace_id"), "trace_id", "left_anti")


def lifecycle_changes(states: DataFrame) -> DataFrame:
    """Rows of states(component, seq, state) whose state differs from the component's state before."""
    seen = running(states, ["component"], "seq", {"before": ("last", F.col("state"))}, inclusive=False)
    return seen.where("before is distinct from state").drop("before")


def publisher_ids(messages: DataFrame) -> DataFrame:
    """Ids in order of first appearance, after the reserved ones."""
    first = messages.groupBy(F.col("from_id").alias("publisher")).agg(F.min("seq").alias("first_seq"))
    numbered = running(first, [], "first_seq", {"place": ("sum", F.lit(1))})
    return numbered.select("publisher", "first_seq", (F.col("place") + LAST_RESERVED_ID).alias("publisher_id"))


def trace_tail(trace_id: Column, n: int = 4) -> Column:
    return F.right(trace_id.cast("string"), F.lit(n))


def publisher_label(name: Column, publisher_id: Column) -> Column:
    """Name and id of a publisher; an unknown one is called Publisher."""
    return F.concat(F.coalesce(name, F.lit("Publisher")), F.lit("#p:"), publisher_id.cast("string"))
