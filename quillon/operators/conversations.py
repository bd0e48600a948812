"""Conversation operators: turns, prompts, tags, labels, numbering, titles, de-duplication, shaping.

Input is a table of items (conv_id, turn, role, text). Windows are partitioned by conversation and ordered
by turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

HARNESS = r"(?s)<(system-reminder|command-message|local-command-stdout|hook)[^>]*>.*?</\1>"
ASKS_SUMMARY = r"(?i)\b(summar(?:y|ize|ise)|recap|tl;dr)\b"
ALLOW_TAG = r"\[allow:([a-z, ]+)\]"
SUMMARY_PROMPT = r"(?is)^\s*(this session is being continued|below is the conversation|the following is a summary)"


def ordered(*partition: str, by: str = "turn"):
    return Window.partitionBy(*(partition or ("conv_id",))).orderBy(by)


def so_far(*partition: str, by: str = "turn"):
    return ordered(*partition, by=by).rowsBetween(Window.unboundedPreceding, 0)


def typed_text(v: Column) -> Column:
    """What a user typed: without harness elements (an unclosed one to the end), fenced blocks and quoted hints."""
    plain = F.regexp_replace(v, HARNESS, "")
    plain = F.regexp_replace(plain, r"(?s)<(system-reminder|command-message|local-command-stdout|hook)[^>]*>.*$", "")
    plain = F.regexp_replace(plain, r"(?s)```.*```", "")
    plain = F.regexp_replace(plain, r"(?m)^>.*$", "")
    return F.trim(plain)


def allow_tags(v: Column) -> Column:
    """The categories of the last allow tag in a prompt; null without one."""
    found = F.regexp_extract_all(v, F.lit(ALLOW_TAG), F.lit(1))
    return F.when(F.size(found) > 0, F.transform(F.split(F.element_at(found, -1), ","), lambda x: F.trim(x)))


def with_turn_tags(items: DataFrame) -> DataFrame:
    """Each item has the tags of the user prompt that it follows; a prompt without tags takes them away."""
    own = F.when(F.col("role") == "user", F.coalesce(allow_tags(typed_text(F.col("text"))), F.array().cast("array<string>")))
    return items.withColumn("allow_tags", F.coalesce(F.last(own, ignorenulls=True).over(so_far()), F.array().cast("array<string>")))


def typed_prompts(items: DataFrame) -> DataFrame:
    """conv_id, n_prompts, first_prompt."""
    typed = typed_text(F.col("text"))
    is_typed = (F.col("role") == "user") & (F.length(typed) > 0)
    first = F.min_by(typed, F.when(is_typed, F.col("turn")))
    return items.groupBy("conv_id").agg(F.count_if(is_typed).alias("n_prompts"), first_line(first).alias("first_prompt"))


def first_line(v: Column) -> Column:
    """Up to the end of the first line or sentence, at most 80 characters."""
    return F.left(F.regexp_extract(v, r"^\s*([^\n]*?(?:[.!?](?=\s)|$|(?=\n)))", 1), F.lit(80))


def asks_for_summary(items: DataFrame) -> DataFrame:
    """conv_id, asks: whether the newest turn is a prompt that asks for a summary."""
    last = F.max_by(F.struct("role", "text"), "turn")
    return items.groupBy("conv_id").agg(last.alias("last")).select("conv_id", F.coalesce((F.col("last.role") == "user") & F.col("last.text").rlike(ASKS_SUMMARY), F.lit(False)).alias("asks"))


def standalone_summary(items: DataFrame) -> DataFrame:
    """conv_id, standalone: only user turns, of which one is a conversation handed over."""
    only = F.bool_and(F.col("role") == "user")
    return items.groupBy("conv_id").agg((only & F.bool_or(F.coalesce(F.col("text").rlike(SUMMARY_PROMPT), F.lit(False)))).alias("standalone"))


def sticky_labels(items: DataFrame, untrusted: Column, private: Column) -> DataFrame:
    """Adds `untrusted` and `private`: once an item of a conversation is, all later ones are."""
    return items.withColumns({"untrusted": F.coalesce(F.bool_or(untrusted).over(so_far()), F.lit(False)), "private": F.coalesce(F.bool_or(private).over(so_far()), F.lit(False))})


def inherited_labels(agents: DataFrame, parents: DataFrame, seconds: int = 600) -> DataFrame:
    """agents: agent_id, conv_id, ts; parents: conv_id, ts, untrusted, private. A subagent's answer has the labels
    that its parent conversation took within so many seconds before."""
    p = parents.select(F.col("conv_id").alias("p_conv"), F.col("ts").alias("p_ts"), "untrusted", "private")
    near = (F.col("conv_id") == F.col("p_conv")) & (F.col("p_ts") <= F.col("ts")) & (F.col("p_ts") >= F.col("ts") - F.expr(f"interval {seconds} seconds"))
    return agents.join(p, near, "left").groupBy("agent_id", "conv_id", "ts").agg(F.coalesce(F.bool_or("untrusted"), F.lit(False)).alias("untrusted"), F.coalesce(F.bool_or("private"), F.lit(False)).alias("private"))


def session_numbers(sessions: DataFrame) -> DataFrame:
    """client, session, first_seen -> n: which session of its client this is."""
    return sessions.withColumn("n", F.row_number().over(Window.partitionBy("client").orderBy("first_seen", "session")))


def session_titles(titles: DataFrame) -> DataFrame:
    """session, source (user, agent or guess), seq, title -> the title that holds: a user's before an agent's
    before a guess, the newest of each."""
    rank = F.when(F.col("source") == "user", 3).when(F.col("source") == "agent", 2).otherwise(1)
    return titles.groupBy("session").agg(F.max_by(T.clean_title(F.col("title")), F.struct(rank, "seq")).alias("title"))


def repeated_outputs(items: DataFrame, min_chars: int = 0) -> DataFrame:
    """Adds first_turn and is_repeat: whether the whole text came before in the conversation, and where."""
    same = Window.partitionBy("conv_id", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy("turn")
    first = F.first("turn").over(same.rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("first_turn", first).withColumn("is_repeat", (F.col("first_turn") < F.col("turn")) & (F.length("text") >= min_chars))


def sizes(items: DataFrame, min_stub: int = 200) -> DataFrame:
    """Adds assistant_turn (how many answers came so far), tokens (characters / 4) and gain of a stub."""
    turn_no = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(so_far())
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    return items.withColumns({"assistant_turn": turn_no, "tokens": tokens, "gain": F.greatest(F.lit(0), tokens - F.lit(min_stub // 4))})


def due_at(turns: Column, tokens: Column, step: int = 10, keep: int = 10, least: int = 30_000) -> Column:
    """The furthest whole step that may be masked."""
    return F.when(tokens >= least, F.greatest(F.lit(0), F.floor((turns - keep) / step) * step)).otherwise(0).cast("long")


def cutoffs(items: DataFrame, step: int = 10, keep: int = 10, least: int = 30_000) -> DataFrame:
    """conv_id, turns: one entry per assistant turn with the cutoff then, which never moves back and moves
    only when the text beyond the present one is large enough.

    A fold: each cutoff depends on the one before. A conversation's turns are sorted and streamed through it, so
    that the work grows with their number and none is held.
    """
    sized = sizes(items).where("role = 'assistant'").select("conv_id", "assistant_turn", "tokens")
    in_order = sized.repartition("conv_id").sortWithinPartitions("conv_id", "assistant_turn", "tokens")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, cutoff, since = None, -1, 0, 0
        for batch in batches:
            places, out = [], []
            for conv, turn, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n < 0 or conv != last:
                    last, n, cutoff, since = conv, -1, 0, 0
                n, since = n + 1, since + tokens
                if since >= least and (due := (turn - keep) // step * step) > cutoff:
                    cutoff, since = due, 0
                places.append(n)
                out.append(cutoff)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int32()), pa.array(out, pa.int64())], names=["conv_id", "n", "cutoff"])

    return in_order.mapInArrow(fold, f"conv_id {in_order.schema['conv_id'].dataType.simpleString()}, n int, cutoff long")


def pays(gain: Column, suffix: Column, read: Column, write: Column, horizon: int = 10) -> Column:
    """Masking pays: what later requests save is more than writing the changed rest again."""
    return gain * read * horizon >= suffix * (write - read)


def stub(name: Column, tokens: Column, note_id: Column) -> Column:
    return F.format_string("[output of %s shortened: %d tokens; read it with id %s]", name, tokens, note_id)


def call_name(arguments: Column) -> Column:
    """Names a call by the first of its usual arguments, in 80 characters."""
    found = [F.get_json_object(arguments, f"$.{k}") for k in ("command", "path", "pattern", "url", "query", "file_path")]
    return F.left(F.coalesce(*found), F.lit(80))


def masked(items: DataFrame, cutoff: Column, min_chars: int = 800) -> DataFrame:
    """Texts of answers before the cutoff become stubs when they are long enough."""
    old = (F.col("assistant_turn") <= cutoff) & (F.length("text") >= min_chars)
    note = stub(F.col("role"), F.col("tokens"), T.output_id(F.col("text")))
    return items.withColumns({"text": F.when(old, note).otherwise(F.col("text")), "masked": F.coalesce(old, F.lit(False))})


def latest_notes(notes: DataFrame) -> DataFrame:
    """conv_id, step, kind, pos, text -> the newest note of each kind in each step."""
    return notes.groupBy("conv_id", "step", "kind").agg(F.max("pos").alias("pos"), F.max_by("text", "pos").alias("text"))


def prefix_digests(items: DataFrame) -> DataFrame:
    """Adds prefix: a running digest, equal for two requests as far as they are the same.

    Digests of items are collected in order (one short string each) and folded.
    """
    listed = items.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("d")))).alias("all"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.struct(F.sha2(F.concat(acc["last"], x["d"]), 256).alias("last"), F.concat(acc["out"], F.array(F.sha2(F.concat(acc["last"], x["d"]), 256))).alias("out"))
    return listed.select("conv_id", F.explode(F.arrays_zip(F.col("all.turn").alias("turn"), F.aggregate("all", start, step, lambda acc: acc["out"]).alias("prefix"))).alias("z")).select("conv_id", "z.turn", "z.prefix")


def first_change(a: Column, b: Column) -> Column:
    """Index of the first difference of two arrays; the shorter length if one continues the other; null if equal."""
    n = F.least(F.size(a), F.size(b))
    # item by item at once: an index into a or b would work them out again for each item where they are no columns
    differs = F.zip_with(F.coalesce(a, F.array()), F.coalesce(b, F.array()), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True).cast("int")
    return F.when(at > 0, F.least(at - 1, n)).when(F.size(a) != F.size(b), n)


def valid_requests(items: DataFrame) -> DataFrame:
    """conv_id, valid: no empty text, and no neighbours of one role."""
    before = F.lag("role").over(ordered())
    marked = items.withColumn("bad", (F.length(F.coalesce("text", F.lit(""))) == 0) | (before == F.col("role")))
    return marked.groupBy("conv_id").agg((~F.bool_or(F.coalesce("bad", F.lit(False)))).alias("valid"))
