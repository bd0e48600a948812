"""Keyed streams: text held back to whole words, event statistics, first sightings.

Every stream has a batch form that must give the same result; the tests hold them against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LONGEST_RUN = 512
TAIL = 160
_last_space = re.compile(r"^.*\s", re.DOTALL)


def released(held: str, more: str, done: bool, longest: int = 0) -> tuple[str, str]:
    """What may go out and what is held: up to the last white space, as a stand-in may go on after it; a
    run without white space goes out past a tail once it is long."""
    text = held + more
    if done:
        return text, ""
    m = _last_space.match(text)
    out = m[0] if m else ""
    rest = text[len(out) :]
    tail = max(TAIL, longest)
    if len(rest) > LONGEST_RUN:
        out, rest = out + rest[:-tail], rest[-tail:]
    return out, rest


def hold_text(chunks: DataFrame, longest: int = 0) -> DataFrame:
    """A stream of (reply, seq, text, done) -> (reply, seq, text) with whole words only.

    State is the held text of a reply, which `longest` bounds; a reply's state goes when it is done.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        rows, done = [], False
        chunk = pd.concat(list(batches)).sort_values("seq")
        for seq, text, last in zip(chunk["seq"], chunk["text"], chunk["done"], strict=True):
            out, held = released(held, text or "", bool(last), longest)
            done = done or bool(last)
            if out:
                rows.append((key[0], int(seq), out))
        if done:
            state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame(rows, columns=["reply", "seq", "text"])

    return chunks.select("reply", "seq", "text", "done").groupBy("reply").applyInPandasWithState(step, "reply string, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def chunked(texts: DataFrame, size: int = 40) -> DataFrame:
    """reply, text -> chunks (reply, seq, text, done). Works on streams, as it has no state."""
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    pieces = texts.select("reply", "text", n.alias("n")).select("reply", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return pieces.select("reply", F.col("i").cast("long").alias("seq"), F.substring("text", F.col("i") * size + 1, F.lit(size)).alias("text"), (F.col("i") == F.col("n") - 1).alias("done"))


def running_stats(events: DataFrame) -> DataFrame:
    """Counts and sums by event type; on a stream, in update or complete mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_id"))


def windowed_stats(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark: state of windows older than `lateness` goes."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def first_seen(texts: DataFrame) -> DataFrame:
    """digest -> the first sequence number that a text was seen under; the same on streams."""
    return texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("seq").alias("first_seq"))


def last_limits(readings: DataFrame) -> DataFrame:
    """session, seq, reading: the last reading stands where a reply has none."""
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn("reading", F.last("reading", ignorenulls=True).over(so_far))


def tool_arguments(events: DataFrame) -> DataFrame:
    """reply, index, seq, fragment, done: fragments of a tool call's arguments, held until the call is whole."""
    whole = events.groupBy("reply", "index").agg(F.array_sort(F.collect_list(F.struct("seq", "fragment"))).alias("all"), F.bool_or("done").alias("done"))
    return whole.where("done").select("reply", "index", F.array_join("all.fragment", "").alias("arguments"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what a stream has now and read the result as a table. Output and checkpoint are below path."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_complete(stream: DataFrame, path: str) -> DataFrame:
    """The same for aggregations in complete mode: each micro-batch replaces the table."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    query = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
