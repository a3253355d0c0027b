"""Spoken commands: a state machine over each session's phrases, as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import words
from textloom.functions.text import command

MOST_CHARS = 10_000
OUTCOME = "session long, seq long, phrase string, outcome string"


def outcomes(phrases: DataFrame) -> DataFrame:
    """(session, seq, phrase, outcome) of phrases (session, seq, phrase), in order of seq: a command's name, "content" for
    the phrase after "dictate", else "no match". Empty phrases are dropped first.

    Whether a phrase is content follows from the run of "dictate" before it: inside a run every second one is content, and
    so is the phrase after a run of odd length. No state is needed, only the position in the run."""
    kept = phrases.where("trim(coalesce(phrase, '')) <> ''").withColumn("c", command(F.col("phrase")))
    order = W.partitionBy("session").orderBy("seq")
    runs = kept.withColumn("d", F.col("c") == "dictate").withColumn("i", F.row_number().over(order))
    last_other = F.max(F.when(~F.col("d"), F.col("i"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    before = F.col("i") - 1 - F.coalesce(last_other, F.lit(0))
    known = F.col("c").isin(*words.COMMANDS)
    outcome = F.when(before % 2 == 1, "content").when(known, F.col("c")).otherwise("no match")
    return runs.select("session", "seq", "phrase", outcome.alias("outcome"))


def essays(logged: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(session, essay): the content phrases since the last "clear essay", joined by spaces and cut to `most` characters."""
    order = W.partitionBy("session").orderBy("seq")
    cleared = F.coalesce(F.max(F.when(F.col("outcome") == "clear essay", F.col("seq"))).over(W.partitionBy("session")), F.lit(-1))
    live = logged.withColumn("cleared", cleared).where((F.col("outcome") == "content") & (F.col("seq") > F.col("cleared")))
    sizes = live.withColumn("upto", F.sum(F.length("phrase") + 1).over(order)).where(F.col("upto") - F.length("phrase") - 1 <= most)
    texts = sizes.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "phrase"))), lambda x: F.trim(x["phrase"])), " ").alias("essay"))
    return texts.select("session", F.substring("essay", 1, most).alias("essay"))


def outcome_stream(phrases: DataFrame) -> DataFrame:
    """The same outcomes for a stream of phrases: the state of a session is whether the next phrase is content."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple[Any, ...], frames: Iterator, state: GroupState) -> Iterator:
        import re

        import pandas as pd

        dictating = state.get[0] if state.exists else False
        frame = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, phrase in zip(frame["seq"], frame["phrase"]):
            if not (phrase or "").strip():
                continue
            name = re.sub(r"[.!?]+$", "", phrase.lower()).strip()
            outcome = "content" if dictating else name if name in words.COMMANDS else "no match"
            dictating = outcome == "dictate"
            out.append((key[0], seq, phrase, outcome))
        state.update((dictating,))
        yield pd.DataFrame(out, columns=["session", "seq", "phrase", "outcome"])

    return phrases.groupBy("session").applyInPandasWithState(step, OUTCOME, "dictating boolean", "append", GroupStateTimeout.NoTimeout)
