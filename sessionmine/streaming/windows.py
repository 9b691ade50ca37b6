"""Streams that need built-in state only: deduplication, turn digests, error rates, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import errors as ef
from ..functions.text import clip_head_tail
from ..plans.failures import fingerprinted, guard_matches
from ..plans.sessions import is_injected


def without_repeats(events: DataFrame, id_col: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Each event once, as long as its copies arrive within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_col])


def turn_digests(events: DataFrame, delay: str = "10 minutes", gap: str = "30 minutes",
                 user_chars: int = 2000, assistant_chars: int = 1200) -> DataFrame:
    """One row per turn once it has been quiet for `gap`.

    The state per turn is a handful of values (counts, first and last texts, tool names),
    never the list of its messages.
    """
    own = ~((F.col("type") == "user/message") & is_injected("text", "source_kind"))
    is_ = lambda t: F.col("type") == t
    g = (events.filter(own).withWatermark("ts", delay)
         .groupBy(F.session_window("ts", gap).alias("w"), "session_id", "turn")
         .agg(F.count(F.lit(1)).alias("events"),
              F.min_by("text", F.when(is_("user/message"), F.col("seq"))).alias("request"),
              F.max_by("text", F.when(is_("assistant/message"), F.col("seq"))).alias("answer"),
              F.array_sort(F.collect_set(F.when(is_("tool/call"), F.col("tool")))).alias("tools"),
              F.count_if(is_("tool/result") & F.col("is_error")).alias("errors")))
    return g.select("session_id", "turn", F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "events",
                    clip_head_tail(F.coalesce("request", F.lit("")), user_chars).alias("request"),
                    clip_head_tail(F.coalesce("answer", F.lit("")), assistant_chars).alias("answer"), "tools", "errors")


def failure_observations(results: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Fingerprints of failed results (`session_id, ts, turn, tool, message, ...`)."""
    return fingerprinted(results.withWatermark("ts", delay))


def tool_failures(events: DataFrame, delay: str = "10 minutes", wait: str = "1 hour") -> DataFrame:
    """Failed results joined with their calls, as two watermarked streams."""
    calls = (events.filter(F.col("type") == "tool/call").withWatermark("ts", delay)
             .select(F.col("session_id").alias("c_session"), F.col("call_id").alias("c_call"), F.col("ts").alias("c_ts"),
                     F.col("tool").alias("tool"), "arguments"))
    bad = events.filter((F.col("type") == "tool/result") & (F.coalesce("is_error", F.lit(False)) | F.col("error_name").isNotNull()))
    bad = bad.filter(~ef.is_own_denial("error_code", "error_name", "text")).withWatermark("ts", delay).drop("tool", "arguments")
    on = ((F.col("session_id") == F.col("c_session")) & (F.col("call_id") == F.col("c_call"))
          & (F.col("c_ts") <= F.col("ts")) & (F.col("c_ts") >= F.col("ts") - F.expr(f"INTERVAL {wait}")))
    return fingerprinted(bad.join(calls, on, "leftOuter").withColumn("message", F.col("text")))


def error_rates(observations: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Failures per fingerprint and (sliding) window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (observations.withWatermark("ts", delay).groupBy(w.alias("w"), "fingerprint").agg(F.count(F.lit(1)).alias("n"))
            .select("fingerprint", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def guard_alerts(calls: DataFrame, guards: DataFrame) -> DataFrame:
    """Incoming tool calls that repeat a guarded mistake (stream-static join)."""
    return guard_matches(calls, guards)
