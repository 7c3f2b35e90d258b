"""Queries of the operators on texts and, where it can be said in SQL, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import conversations, evalleak, mixing, pairs, spampages
from tallyforge.runtime import checkpoint, table

_CONVERSATION = ["org_id", "session_id", "owner_account_id"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages")
    _, whole = conversations.rebuild(m, _CONVERSATION, "event_id", "created_at", texts=False, version=["source_seq"])
    return whole.filter("not valid").select(*_CONVERSATION)


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages")
    turns, _ = conversations.rebuild(m, _CONVERSATION, "event_id", "created_at", version=["source_seq"])
    return turns.select(*_CONVERSATION, F.col("turn").cast("bigint").alias("turn"), "role", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(table(spark, d, "conversation_records"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = evalleak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return evalleak.clean(documents, table(spark, d, "eval_items"))


def p8_left_after_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """How many leaks the cleaned documents still hold: none."""
    items = table(spark, d, "eval_items")
    documents = table(spark, d, "documents").select("doc_id", "text")
    return evalleak.find_leaks(evalleak.clean(documents, items), items).agg(F.count(F.lit(1)).alias("n"))


def _source(c: str) -> Column:
    """A source without case, outer blanks, kinds of separators and a plural's s."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), "s$", "")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(mixture, targets), documents and targets spelled by the same rule."""
    documents = table(spark, d, "documents").withColumn("source", _source("source"))
    sized = checkpoint(mixing.count_tokens(documents, "doc_id", "source"))
    # Targets that name one source in several spellings are one target.
    targets = table(spark, d, "mix_targets").groupBy(_source("source").alias("source"))
    targets = targets.agg(F.min("source").alias("named"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return mixing.mixture(sized, targets, "doc_id", "source"), targets


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's records: text and tokens, a row per copy."""
    mixed, targets = _mixed(spark, d)
    mixed = mixed.join(F.broadcast(targets.select("source", "named")), "source").select("doc_id", F.col("named").alias("source"), "tokens", "copies")
    return mixing.records(table(spark, d, "documents").select("doc_id", "text", "lang"), mixed, "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, targets = _mixed(spark, d)
    return mixing.shares_reached(mixed, targets, "source").join(F.broadcast(targets.select("source", "named")), "source").withColumn("source",
        F.col("named")).drop("named")


def p9_shares_of_a_fixed_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The report on a mixture that SQL can state: characters for tokens, one to three copies by id."""
    documents = table(spark, d, "documents").select("doc_id", _source("source").alias("source"), F.col("n_chars").alias("tokens"))
    mixed = documents.withColumn("copies", (F.pmod("doc_id", F.lit(4))).cast("int")).filter("copies > 0")
    targets = table(spark, d, "mix_targets").withColumn("source", _source("source"))
    return mixing.shares_reached(mixed, targets, "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spampages.find_spam(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_found, p6_conversations, p7_found, p8_found, p8_cleaned, p8_left_after_cleaning, p9_mixture, p9_shares,
        p9_shares_of_a_fixed_mixture, p10_found)}


_SPELLED = r"regexp_replace(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), 's$', '')"
_TURNS = r"""
named AS (SELECT * FROM conversation_messages WHERE session_id <> ''),
turns AS (
  SELECT DISTINCT org_id, session_id, owner_account_id, event_id, created_at, role, text FROM (
    SELECT *, 'user' AS role, user_text AS text FROM named UNION ALL SELECT *, 'assistant' AS role, assistant_text AS text FROM named)
  WHERE regexp_matches(text, '[^\s\pZ\pC\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]')),
numbered AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY org_id, session_id, owner_account_id) AS total
  FROM turns WINDOW w AS (PARTITION BY org_id, session_id, owner_account_id ORDER BY created_at NULLS FIRST, event_id NULLS FIRST, role DESC)),
judged AS (
  SELECT org_id, session_id, owner_account_id, bool_and((n % 2 = 1) = (role = 'user')) AND any_value(total) % 2 = 0 AS valid
  FROM numbered GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM j.{c}" for c in _CONVERSATION)
    return {
        "p6_found": f"""WITH {_TURNS} SELECT DISTINCT n.org_id, n.session_id, n.owner_account_id
            FROM named n LEFT JOIN judged j ON {same} WHERE NOT coalesce(j.valid, false)""",
        "p6_conversations": f"""WITH {_TURNS} SELECT n.org_id, n.session_id, n.owner_account_id, n.n - 1 AS turn, n.role, n.text
            FROM numbered n JOIN judged j ON {same} AND j.valid""",
        "p8_left_after_cleaning": "SELECT CAST(0 AS BIGINT) AS n",
        "p9_shares_of_a_fixed_mixture": f"""WITH mixed AS (SELECT {_SPELLED} AS source, n_chars AS tokens, CAST(doc_id % 4 AS INT) AS copies FROM documents
            WHERE doc_id % 4 > 0),
            used AS (SELECT source, count(*) AS documents, CAST(sum(tokens * copies) AS BIGINT) AS tokens, CAST(max(copies) AS BIGINT) AS most_copies FROM mixed
                GROUP BY 1),
            t AS (SELECT {_SPELLED} AS source, target_share, max_repeats FROM mix_targets)
          SELECT source, target_share, max_repeats, coalesce(documents, 0) AS documents, coalesce(tokens, 0) AS tokens, coalesce(most_copies, 0) AS most_copies,
            coalesce(CAST(tokens AS DOUBLE) / CAST(sum(tokens) OVER () AS DOUBLE), 0) AS share FROM t LEFT JOIN used USING (source)""",
    }
