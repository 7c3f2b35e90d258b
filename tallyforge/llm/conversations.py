"""Conversations rebuilt from message rows.

Rows are an event log: deliveries of one turn are folded by version into its final
state (a retry changes nothing, an edit replaces, a delete removes), what is left is
ordered, and the conversations are validated.

Order and validation never gather a conversation in one task: rows are partitioned by
*ranges* of (conversation, order), each task numbers its stretch of a conversation and
sees whether roles alternate in it, and the few stretches of a conversation are then
put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint

# Characters that show nothing (Java regular expression class).
INVISIBLE = r"\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}"


def is_blank(text: Column) -> Column:
    """NULL, or nothing but white space and invisible characters."""
    return text.isNull() | ~text.rlike(f"[^{INVISIBLE}]")


def messages(df: DataFrame, carry: list[str], blanks: bool = False) -> DataFrame:
    """One row per user or assistant message with ``role`` and ``text``; system messages and blank texts are left out.

    With ``blanks``, a row without any text counts as a message of either role with a blank text: it may end a turn.
    """
    both = F.array(
        F.struct(F.lit("user").alias("role"), F.col("user_text").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.col("assistant_text").alias("text")),
    )
    said = ~is_blank(F.col("text"))
    if blanks:
        df = df.withColumn("__empty", is_blank(F.col("user_text")) & is_blank(F.col("assistant_text")))
        said = said | F.col("__empty")
    return df.select(*carry, *(["__empty"] if blanks else []), F.explode(both).alias("m")).select("*", "m.role", "m.text").filter(said).drop("m", "__empty")


def fold_turns(log: DataFrame, turn: list[str], version: list[Column] | None = None, deleted: Column | None = None) -> DataFrame:
    """The final state of each turn: its row of the greatest version, none if that one deletes it.

    Without versions, rows equal in ``turn`` count once; of their other columns any one
    row's are kept.  Aggregation is partial before the shuffle, so a turn retried in a
    third of all rows is no hot group.
    """
    others = [c for c in log.columns if c not in turn]
    if not version and not others:
        return log.groupBy(*turn).agg(F.lit(1).alias("one")).drop("one")
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    best = F.max_by(F.struct(*others, gone.alias("gone")), F.struct(*(version or [F.lit(1)]), F.xxhash64(*others)))
    folded = log.groupBy(*turn).agg(best.alias("best")).filter("not best.gone")
    return folded.select(*turn, *(F.col(f"best.{c}").alias(c) for c in others))


def _stretches(keys: list[str]):
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, place = None, 0
        for b in batches:
            if b.empty:
                continue
            same = np.ones(len(b), bool)
            for k in keys:
                v = b[k].to_numpy(dtype=object)
                before = np.concatenate([[last[k] if last is not None else None], v[:-1]])
                same &= (v == before) | (pd.isna(v) & pd.isna(before))
            same[0] &= last is not None
            roles = b["role"].to_numpy(dtype=object)
            before = np.concatenate([[last["role"] if last is not None else None], roles[:-1]])
            starts = np.flatnonzero(~same)
            at = np.arange(len(b))
            origin = np.full(len(b), -place)
            if len(starts):
                group = np.searchsorted(starts, at, "right") - 1
                origin = np.where(group >= 0, starts[group], origin)
            b["place"] = at - origin
            b["clash"] = same & (roles == before)
            place = int(b["place"].iloc[-1]) + 1
            last = b.iloc[-1].to_dict()
            yield b

    return number


def ordered_turns(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Turns with ``part`` (task), ``place`` (within the conversation's stretch of that task) and ``clash``.

    Materialised: the stretches and their turns must come from one run.
    """
    rows = turns.withColumns({"assistant": F.col("role") == "assistant", "tie": F.xxhash64("text")})
    by = [*keys, *order, "assistant", "tie"]
    if dict(turns.dtypes)["text"] == "binary":  # a digest has served its purpose once repetitions are gone
        rows = rows.drop("text")
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInPandas(_stretches(keys), f"{kinds}, place long, clash boolean")
    return checkpoint(rows.drop("assistant", "tie").withColumn("part", F.spark_partition_id()))


def conversations(ordered: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stretches with the number of turns before each, conversations with ``turns`` and ``valid``).

    Valid: user, assistant, user, assistant ... ending with assistant.
    """
    parts = ordered.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("clash").alias("clash"),
        F.min_by("role", "place").alias("first_role"),
        F.max_by("role", "place").alias("last_role"),
    )
    # A conversation has at most one stretch for each task.
    along = Window.partitionBy(*keys).orderBy("part")
    parts = parts.withColumns(
        {"offset": F.sum("n").over(along) - F.col("n"), "joint": F.coalesce(F.lag("last_role").over(along) == F.col("first_role"), F.lit(False))}
    )
    whole = parts.groupBy(*keys).agg(
        F.sum("n").alias("turns"),
        (F.max(F.col("clash") | F.col("joint")) == F.lit(False)).alias("alternates"),
        F.min_by("first_role", "part").alias("first_role"),
        F.max_by("last_role", "part").alias("last_role"),
    )
    valid = F.col("alternates") & (F.col("first_role") == "user") & (F.col("last_role") == "assistant")
    return parts.select(*keys, "part", "offset"), whole.select(*keys, "turns", valid.alias("valid"))


def rebuild(
    df: DataFrame, keys: list[str], event_id: str, created_at: str, texts: bool = True,
    version: list[str] | None = None, deleted: str | None = None, edits: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(turns of the valid conversations, every conversation with its number of turns and validity).

    Rows whose session (the second of ``keys``) is NULL or '' belong to no conversation;
    NULLs in the other keys are values like any other.  Rows equal in event id, time, role
    and text are deliveries of one turn and fold into that of the greatest ``version`` (NULL smallest); with ``edits``, rows
    equal in event id and role are versions of one turn, of which the last one gives time and text.  A turn whose last version has
    ``deleted`` true is gone, and so is one that was edited to a blank text.  A NULL time comes first; equal times go by
    event id, user before assistant, then by text.  A conversation without a message left has 0 turns and is not
    valid.  Further columns are ignored.  With ``texts`` False, texts are compared by digest
    and not returned.
    """
    named = df.filter(F.col(keys[1]) != "")
    log = [*(version or []), *([deleted] if deleted else [])]
    log = named.select(*keys, event_id, created_at, "user_text", "assistant_text", *(F.col(c).alias(f"__{i}") for i, c in enumerate(log)))
    carried = [c for c in log.columns if c.startswith("__")]
    m = messages(log, [*keys, event_id, created_at, *carried], blanks=edits)
    if not texts:
        # NULL stands for a blank text.
        m = m.withColumn("text", F.when(~is_blank(F.col("text")), F.unhex(F.md5("text"))))
    turn = [*keys, event_id, "role"] if edits else [*keys, event_id, created_at, "role", "text"]
    by = [F.col(f"__{i}") for i in range(len(version or []))]
    turns = fold_turns(m, turn, by or None, F.col(carried[-1]) if deleted else None).drop(*carried)
    if edits:
        turns = turns.filter(~is_blank(F.col("text")) if texts else F.col("text").isNotNull())
    ordered = ordered_turns(turns, keys, [created_at, event_id])
    offsets, whole = conversations(ordered, keys)
    every = named.select(*keys, F.lit(0).cast("long").alias("turns"), F.lit(False).alias("valid")).distinct()
    whole = every.unionByName(whole).groupBy(*keys).agg(F.max("turns").alias("turns"), F.max("valid").alias("valid"))
    good = whole.filter("valid").select(*(F.col(k).alias(f"w_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]
    o = offsets.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("part").alias("o_part"), "offset")
    kept = ordered.join(good, same, "left_semi").join(o, [*(F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys), F.col("part") == F.col("o_part")])
    text = ["text"] if texts else []
    return kept.select(*keys, (F.col("offset") + F.col("place")).alias("turn"), "role", *text, event_id, created_at), whole
