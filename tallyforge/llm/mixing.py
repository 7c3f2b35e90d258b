"""Mixtures of sources with target shares of the tokens.

A document of source s is to be used r = (size x share) / (tokens of s) times: r's whole
part for certain, once more with the probability of its fraction.  The fractions are rounded
by the pivotal method: two fractional probabilities transfer mass at random until one is 0 or
1, which keeps every document's probability and, up to one document, the source's total.

A hash of its id assigns every document to a leaf of about 50,000 documents, so a source with a
third of all documents has many.  A leaf rounds its documents of a source, smallest first so that
mass moves between documents of similar size, and leaves one fraction per source; these
residuals are combined by a reduction tree, 64 to a node.  Leaves, pairs and draws depend on ids and
the number of documents alone: the mixture is the same for any partitioning and number of cores.
Only ids and sizes are shuffled for it; texts are joined to the documents that are used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAN_IN = 64
_LEAF = 50_000
_loaded: dict[str, object] = {}


def _encoding(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(documents: DataFrame, doc_id: str, source: str, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) with the tokens of the whole text under a rank file; NULL and '' have 0."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=[doc_id, source, "tokens"])

    return spread(documents.select(doc_id, source, text)).mapInArrow(count, f"`{doc_id}` {kind}, `{source}` string, tokens long")


def _uniform(seed: int, *names: object) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, names)), seed=seed) / 2**64


def _transfer(a: tuple, b: tuple, u: float) -> tuple[tuple, tuple]:
    """One step for two (id, probability) units and a draw: (settled unit, unit that may still be fractional)."""
    (i, p), (j, q) = a, b
    total = p + q
    if total < 1:
        return ((i, 0.0), (j, total)) if u * total < q else ((j, 0.0), (i, total))
    rest = total - 1
    return ((i, 1.0), (j, rest)) if u * (2 - total) < 1 - q else ((j, 1.0), (i, rest))


def _pivot(ids: list, probabilities: list[float], seed: int, names: list | None = None) -> tuple[list[tuple], tuple | None]:
    """Settled (id, 0 or 1) units, and the fractional one that is left, if any; draws go by ``names``, or else the ids."""
    name = dict(zip(ids, names if names is not None else ids, strict=True))
    settled, held = [], None
    for unit in zip(ids, probabilities, strict=True):
        if unit[1] <= 1e-12 or unit[1] >= 1 - 1e-12:
            settled.append((unit[0], float(round(unit[1]))))
        elif held is None:
            held = unit
        else:
            done, held = _transfer(held, unit, _uniform(seed, name[held[0]], name[unit[0]]))
            settled.append(done)
            if held[1] <= 1e-12 or held[1] >= 1 - 1e-12:
                settled.append((held[0], float(round(held[1]))))
                held = None
    return settled, held


def rates(sized: DataFrame, targets: DataFrame, source: str, size: int | None = None) -> DataFrame:
    """(source, share, rate, max_repeats): how often each document of a source is to be used on average.

    Shares of sources without any tokens are divided among the others in proportion.  Without
    ``size`` the mixture is as large as the repeat limits allow at exact shares; with a larger
    one, the limits bind and shares are missed, as the report then shows.
    """
    tokens = sized.groupBy(source).agg(F.sum("tokens").alias("have"))
    t = targets.select(F.col("source").alias(source), F.col("target_share").alias("share"), "max_repeats").join(tokens, source)
    everyone = Window.partitionBy(F.lit(0))  # one row per target source
    t = t.filter("have > 0 and share > 0").withColumn("share", F.col("share") / F.sum("share").over(everyone))
    largest = F.min(F.col("max_repeats") * F.col("have") / F.col("share")).over(everyone)
    whole = F.lit(float(size)) if size is not None else largest
    rate = F.least(whole * F.col("share") / F.col("have"), F.col("max_repeats").cast("double"))
    return t.select(source, "share", rate.alias("rate"), "max_repeats")


def mixture(sized: DataFrame, targets: DataFrame, doc_id: str, source: str, size: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used at least once.

    ``doc_id`` is unique.  Documents of sources without a target and with a NULL source are left
    out; an empty table, or targets without any document, give an empty mixture.  The same seed
    gives the same mixture, however the table is partitioned.
    """
    rate = rates(sized, targets, source, size)
    whole = F.floor(F.col("rate") + 1e-9)
    # The targets name their sources one by one: a list written by hand.
    rows = sized.join(F.broadcast(rate), source).select(doc_id, source, "tokens", whole.cast("int").alias("copies"), (F.col("rate") - whole).alias("up"))
    leaves = max(1, -(-sized.count() // _LEAF))
    rows = rows.withColumn("node", F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(leaves)).cast("int"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        """A node's documents of one source: all with 0 or 1 but one at most."""
        settled, left = _pivot(g.index.tolist(), g["up"].tolist(), seed, g[doc_id].tolist())
        for i, up in settled + ([left] if left else []):
            g.at[i, "up"] = up
        return g

    def leaf(g: pd.DataFrame) -> pd.DataFrame:
        return settle(g.sort_values(["tokens", doc_id], ignore_index=True))

    def inner(g: pd.DataFrame) -> pd.DataFrame:
        return settle(g.sort_values(["below", doc_id], ignore_index=True)).drop(columns="below")

    open_ = (F.col("up") > 0) & (F.col("up") < 1)
    level = checkpoint(rows.groupBy(source, "node").applyInPandas(leaf, shape))
    settled = [level.filter(~open_)]
    while leaves > 1:
        leaves = -(-leaves // _FAN_IN)
        up = level.filter(open_).withColumns({"below": F.col("node"), "node": F.floor(F.col("node") / _FAN_IN).cast("int")})
        level = checkpoint(up.groupBy(source, "node").applyInPandas(inner, shape))
        settled.append(level.filter(~open_))
    # At most one fraction is left for each source: drawn as it is.
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id, F.lit("last")), F.lit(1 << 30)) / float(1 << 30)
    whole = level.filter(open_).withColumn("up", F.when(draw < F.col("up"), 1.0).otherwise(0.0))
    for s in settled:
        whole = whole.unionByName(s)
    return whole.select(doc_id, source, "tokens", (F.col("copies") + F.col("up").cast("int")).alias("copies")).filter("copies > 0")


def records(documents: DataFrame, mixed: DataFrame, doc_id: str) -> DataFrame:
    """The mixture as records: every document with all its columns, once per copy; ``copy`` counts from 1.

    Of a column that both tables have, the mixture's is taken.
    """
    kept = [c for c in documents.columns if c == doc_id or c.lower() not in {m.lower() for m in mixed.columns}]
    joined = documents.select(*kept).join(mixed, doc_id)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def shares_reached(mixed: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """Per target source its target share, documents, tokens and share of the mixture, and its most used document's copies."""
    used = mixed.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    t = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(used, source, "left")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    return t.select(
        source, "target_share", "max_repeats",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "most_copies")),
        F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"),
    )
