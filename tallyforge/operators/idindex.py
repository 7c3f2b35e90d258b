"""Exactly one copy of every delivered message, by a persistent index of identifiers.

Identifiers are 128-bit hashes, cut by hash prefix; that any two of n different messages
share one has odds of n^2 / 2^129 (about 10^-15 for a million million messages).  The index consists of
immutable runs in the shared folder; a run holds, per prefix, one sorted array of
identifiers and, beside it, the row kept for each, its files sorted by prefix.  A batch is first reduced to its
earliest delivery per identifier (map-side first, so an identifier with a third of
all rows costs one row per task).  A small batch is broadcast: only prefixes it has are read from the
runs, searched where they are read, and no part of the index is shuffled.  A larger one meets the arrays of its
prefixes by cogroup.  Novel identifiers form the next run.

When runs have become many, the newest are merged with all older ones that are not much larger, so an
identifier is rewritten a logarithmic number of times; a prefix that has grown too large is split on the way.  A manifest
names the runs in force and the batches taken in, whose ids outlive their runs; runs that the last manifests no longer name are deleted.
"""

from __future__ import annotations

import json
from functools import reduce
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.runtime import checkpoint, shared_dir

_RUN = "prefix int, keys binary, rows binary"
_IDS_PER_PREFIX = 250_000
BROADCAST_IDS = 100_000  # 2.4 MB; larger batches meet the index by cogroup
_LISTED = 4_096
_KEPT_MANIFESTS = 3


def named(parts: list[Column]) -> Column:
    """Whether a row has an identifier: where a part is NULL it is a message of its own."""
    return reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))


def identifier(parts: list[Column]) -> tuple[Column, Column]:
    """Two 64-bit halves of an identifier's hash."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def _unpack(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(keys, dtype="<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _contains(run: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether each identifier is in the sorted run: binary search on the high half, then on ties the low one."""
    left, right = np.searchsorted(run[0], hi, "left"), np.searchsorted(run[0], hi, "right")
    found = np.zeros(len(hi), bool)
    for step in range(int((right - left).max(initial=0))):
        at = left + step
        inside = at < right
        found[inside] |= run[1][at[inside]] == lo[inside]
    return found


def _pack(prefix: int, hi: np.ndarray, lo: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((lo, hi))
    keys = np.column_stack([hi[order], lo[order]]).astype("<i8").tobytes()
    return pd.DataFrame({"prefix": [prefix], "keys": [keys], "rows": [rows[order].astype("<i8").tobytes()]})


def _novel(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    if batch.empty:
        return pd.DataFrame({"prefix": [], "keys": [], "rows": []}).astype({"prefix": "int32"})
    hi, lo, rows = (batch[c].to_numpy() for c in ("hi", "lo", "row"))
    old = np.zeros(len(hi), bool)
    for keys in runs["keys"]:
        old |= _contains(_unpack(keys), hi, lo)
    return _pack(int(batch["prefix"].iloc[0]), hi[~old], lo[~old], rows[~old])


def _split(bits: int):
    """Rows of a run with fewer prefixes, cut to ``bits``: their arrays are in the order of the finer prefixes."""

    def split(batches):
        for b in batches:
            out = []
            for keys, rows in zip(b["keys"], b["rows"] if "rows" in b else [None] * len(b), strict=True):
                hi, lo = _unpack(keys)
                if not len(hi):
                    continue
                fine = (hi.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(np.diff(fine)) + 1
                for start, stop in zip([0, *at], [*at, len(hi)], strict=True):
                    part = None if rows is None else np.frombuffer(rows, "<i8")[start:stop].tobytes()
                    out.append((int(fine[start]), np.column_stack([hi, lo])[start:stop].astype("<i8").tobytes(), part))
            yield pd.DataFrame(out, columns=["prefix", "keys", "rows"]).astype({"prefix": "int32"})

    return split


def _merged(runs: pd.DataFrame) -> pd.DataFrame:
    parts = [_unpack(k) for k in runs["keys"]]
    rows = np.concatenate([np.frombuffer(r, dtype="<i8") for r in runs["rows"]])
    return _pack(int(runs["prefix"].iloc[0]), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), rows)


def _with_id(taken: list[list[int]], batch_id: int) -> list[list[int]]:
    """Ranges of batch ids with one more; the ids of a stream follow each other and stay one range."""
    out: list[list[int]] = []
    for lo, hi in sorted([*taken, [batch_id, batch_id]]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = [out[-1][0], max(out[-1][1], hi)]
        else:
            out.append([lo, hi])
    return out


class IdentifierIndex:
    """Runs of known identifiers below ``path``, with 2**bits hash prefixes to begin with.

    :meth:`bits_for` keeps a prefix at about 250,000 identifiers, so that one task's array stays near 6 MB;
    an index that outgrows its prefixes gets more of them at its next merge.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int) -> None:
        self.spark, self.path, self.bits = spark, path, bits

    @staticmethod
    def bits_for(identifiers: int) -> int:
        return max(4, min(28, ceil(log2(max(1, identifiers) / _IDS_PER_PREFIX)) if identifiers > _IDS_PER_PREFIX else 4))

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self, name: str) -> dict:
        fs, path = self._at(f"manifest/{name}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifests(self) -> list[str]:
        fs, folder = self._at("manifest")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        return [n for n in names if n.endswith(".json")]

    def _manifest(self) -> dict:
        """The latest manifest: version, the runs in force, their ``sizes`` in bytes and ``bits``, and ``taken``, the batch ids taken in as ranges."""
        names = self._manifests()
        if not names:
            return {"version": 0, "runs": [], "taken": [], "sizes": {}, "bits": {}}
        found = {"sizes": {}, "bits": {}} | self._load(names[-1])
        if "taken" not in found:  # written before manifests named the batches: every run was in force at first
            ids = {int(r.removeprefix("run-")) for n in names for r in self._load(n)["runs"] if r.startswith("run-")}
            found["taken"] = reduce(_with_id, ids, [])
        return found

    def runs(self) -> tuple[int, list[str]]:
        """Version and names of the runs in force; the latest manifest decides."""
        found = self._manifest()
        return found["version"], found["runs"]

    def has_taken(self, batch_id: int) -> bool:
        return any(lo <= batch_id <= hi for lo, hi in self._manifest()["taken"])

    def _publish(self, found: dict, runs: list[str], taken: list[list[int]], new: str, bits: int) -> None:
        """Written aside and renamed, so that a reader sees a whole manifest or none; then what no late manifest names is deleted."""
        fs, path = self._at(new)
        sizes = {r: found["sizes"].get(r, 0) for r in runs} | {new: fs.getContentSummary(path).getLength()}
        each = {r: found["bits"].get(r, self.bits) for r in runs} | {new: bits}
        version = found["version"] + 1
        _, aside = self._at(f"manifest/{version:08d}.new")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps({"version": version, "runs": runs, "taken": taken, "sizes": sizes, "bits": each}).encode()))
        finally:
            out.close()
        final = self._at(f"manifest/{version:08d}.json")[1]
        fs.delete(final, False)
        if not fs.rename(aside, final):
            raise OSError(f"cannot publish {final}")
        self._clean(set(runs))

    def _clean(self, live: set[str]) -> None:
        names = self._manifests()
        needed = live.union(*(self._load(n)["runs"] for n in names[-_KEPT_MANIFESTS:]))
        fs, _ = self._at("manifest")
        for n in names[:-_KEPT_MANIFESTS]:
            for r in set(self._load(n)["runs"]) - needed:
                fs.delete(self._at(r)[1], True)
            fs.delete(self._at(f"manifest/{n}")[1], False)

    def read(self, runs: list[str], rows: bool = True, bits: int | None = None) -> DataFrame:
        """Rows (prefix, keys, rows) of runs; cut to ``bits`` prefix bits where a run has fewer."""
        columns = ["prefix", "keys", "rows"] if rows else ["prefix", "keys"]
        if not runs:
            return self.spark.createDataFrame([], _RUN).select(*columns)
        of = self._manifest()["bits"]
        parts = []
        for r in runs:
            part = self.spark.read.schema(_RUN).parquet(f"{self.path}/{r}").select(*columns)
            if bits is not None and of.get(r, self.bits) < bits:
                part = part.mapInPandas(_split(bits), _RUN).select(*columns)
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    def _bits_now(self, found: dict) -> int:
        """Prefix bits for new runs: at least those of all runs in force, more once a prefix has twice its identifiers."""
        bits = max([self.bits, *(found["bits"].get(r, self.bits) for r in found["runs"])])
        held = sum(found["sizes"].values()) // 24
        return self.bits_for(held) if held > 2 * _IDS_PER_PREFIX << bits else bits

    def _known(self, ids: DataFrame, n: int, live: list[str], found: dict) -> DataFrame:
        """(hi, lo) of the ids that the runs have: the ids are broadcast, each array is searched where it is read."""
        rows = ids.select("hi", "lo").toPandas()  # at most BROADCAST_IDS
        u = rows["hi"].to_numpy().view(np.uint64)
        order = np.argsort(u, kind="stable")
        shared = self.spark.sparkContext.broadcast((u[order], rows["hi"].to_numpy()[order], rows["lo"].to_numpy()[order]))

        def search(bits: int):
            def run(batches):
                u, hi, lo = shared.value
                for b in batches:
                    for prefix, keys in zip(b["prefix"], b["keys"], strict=True):
                        since = np.uint64(int(prefix) << (64 - bits))
                        a, z = np.searchsorted(u, since, "left"), np.searchsorted(u, since | np.uint64((1 << (64 - bits)) - 1), "right")
                        old = _contains(_unpack(keys), hi[a:z], lo[a:z])
                        yield pd.DataFrame({"hi": hi[a:z][old], "lo": lo[a:z][old]})

            return run

        parts = []
        for r in live:
            bits = found["bits"].get(r, self.bits)
            part = self.read([r], rows=False)
            prefixes = np.unique(u >> np.uint64(64 - bits)).tolist()
            # Files are sorted by prefix: others are skipped by their bounds.
            part = part.filter(F.col("prefix").isin(prefixes)) if len(prefixes) <= _LISTED else part
            parts.append(part.mapInPandas(search(bits), "hi long, lo long"))
        return reduce(DataFrame.unionByName, parts)

    def prepare(self, ids: DataFrame, order: list[str], name: str) -> tuple[dict, int]:
        """Write the run ``name`` with the novel ones of (hi, lo, row, order columns); in force only once published."""
        found = self._manifest()
        bits, live = self._bits_now(found), found["runs"]
        first = F.min(F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))), F.col("row")))
        reduced = ids.groupBy("hi", "lo").agg(first.alias("first"))
        reduced = reduced.select(F.shiftrightunsigned("hi", 64 - bits).cast("int").alias("prefix"), "hi", "lo", F.col("first.row").alias("row"))
        empty = pd.DataFrame({"keys": []})
        pack = lambda df: df.groupBy("prefix").applyInPandas(lambda b: _novel(b, empty), _RUN)
        if live:
            reduced = checkpoint(reduced)
            n = reduced.count()
            if n <= BROADCAST_IDS:
                novel = pack(reduced.join(self._known(reduced, n, live, found).distinct(), ["hi", "lo"], "left_anti") if n else reduced)
            else:
                known = self.read(live, rows=False, bits=bits)
                novel = reduced.groupBy("prefix").cogroup(known.groupBy("prefix")).applyInPandas(_novel, _RUN)
        else:
            novel = pack(reduced)
        novel.sortWithinPartitions("prefix").write.mode("overwrite").parquet(f"{self.path}/{name}")
        return found, bits

    def add(self, batch: DataFrame, parts: list[Column], row_id: str, order: list[str], merge_every: int = 4, batch_id: int | None = None, before=None) -> str:
        """Take in one batch; the name of the run that holds its novel identifiers and their kept rows.

        Within a batch the row with the smallest ``order`` columns (NULL last), then the
        smallest ``row_id``, is kept.  Rows without an identifier are not taken in; the caller keeps
        them all.  ``before(run)`` is called when the run is written and not yet published: what it writes
        exists before the batch counts as taken in, and is written again if that fails.  A batch id that was published
        already is not taken in twice, whether its run is still in force or was merged.
        """
        hi, lo = identifier(parts)
        ids = batch.filter(named(parts)).select(hi.alias("hi"), lo.alias("lo"), F.col(row_id).cast("long").alias("row"), *order)
        return self._add(ids, order, merge_every, batch_id, before)

    def _add(self, ids: DataFrame, order: list[str], merge_every: int, batch_id: int | None = None, before=None) -> str:
        found = self._manifest()
        name = f"run-{batch_id if batch_id is not None else found['version']:08d}"
        if batch_id is not None and any(lo <= batch_id <= hi for lo, hi in found["taken"]):
            return name
        found, bits = self.prepare(ids, order, name)
        if before is not None:
            before(name)
        live = [*found["runs"], name]
        self._publish(found, live, found["taken"] if batch_id is None else _with_id(found["taken"], batch_id), name, bits)
        if len(live) > merge_every:
            self.merge()
        return name

    def merge(self) -> None:
        """Merge the newest runs in force, and every older one of at most twice the size of those after it, into one."""
        found = self._manifest()
        live, sizes = found["runs"], found["sizes"]
        if len(live) < 2:
            return
        start, size = len(live) - 2, sizes.get(live[-1], 0) + sizes.get(live[-2], 0)
        while start and sizes.get(live[start - 1], 0) <= 2 * size:
            start -= 1
            size += sizes.get(live[start], 0)
        name, bits = f"merged-{found['version']:08d}", self._bits_now(found)
        whole = self.read(live[start:], bits=bits).groupBy("prefix").applyInPandas(_merged, _RUN)
        whole.sortWithinPartitions("prefix").write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._publish(found, [*live[:start], name], found["taken"], name, bits)

    def kept_rows(self, runs: list[str], row_id: str) -> DataFrame:
        """Row ids kept by the given runs."""
        if not runs:
            return self.spark.createDataFrame([], f"{row_id} long")

        def rows(batches):
            for b in batches:
                for r in b["rows"]:
                    yield pd.DataFrame({row_id: np.frombuffer(r, dtype="<i8")})

        return self.read(runs).select("rows").mapInPandas(rows, f"`{row_id}` long")


def deliveries(df: DataFrame, parts: list[Column], row_id: str, order: str, batches: int = 3, path: str | None = None) -> DataFrame:
    """(``row_id``, ``first``): every row, and whether it is the one delivery kept of its message.

    The earliest by ``order``, then the smallest ``row_id`` (unique, 64 bit), is kept.  The
    rows are taken in ``batches`` batches in the order of ``order``, as they would arrive.  A row
    of which a part of the identifier is NULL is a message of its own and always kept; a
    NULL ``order`` comes last.  An empty table gives no rows.  The table is read twice, at first its ``order``
    alone; an index without a ``path`` of its own is deleted at the end.
    """
    spark = df.sparkSession
    cuts = [i / batches for i in range(1, batches)]
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    n, at = df.agg(F.count(F.lit(1)), F.percentile_approx(micros, cuts or [0.5], 1000)).first()
    edges = sorted(set(at or []))[: batches - 1]
    folder = shared_dir(spark, "idindex")
    index = IdentifierIndex(spark, path or folder, IdentifierIndex.bits_for(n))
    batch = sum(((micros > e).cast("int") for e in edges), F.lit(0))
    hi, lo = identifier(parts)
    staged = df.select(hi.alias("hi"), lo.alias("lo"), F.col(row_id).cast("long").alias("row"), micros.alias("at"), named(parts).alias("named"), F.coalesce(batch,
        F.lit(len(edges))).alias("batch"))
    staged.write.partitionBy("batch").parquet(f"{folder}/staged")
    staged = spark.read.schema("hi long, lo long, row long, at long, named boolean, batch int").parquet(f"{folder}/staged")
    runs = []
    for i in range(len(edges) + 1):
        last = i == len(edges)
        # Between two batches the runs are merged, so that later ones are searched for in a merged run.
        runs.append(index._add(staged.filter((F.col("batch") == i) & F.col("named")), ["at"], merge_every=len(runs) + 2 if last else 1))
    # The runs of this call are all there are in an index of its own; in one with a past, the ones before keep other rows, too.
    kept = index.kept_rows(index.runs()[1], "row").withColumn("first", F.lit(True))
    out = staged.select("row", "named").join(kept, "row", "left")
    out = checkpoint(out.select(F.col("row").alias(row_id), (F.coalesce("first", F.lit(False)) | ~F.col("named")).alias("first")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def kept_deliveries(df: DataFrame, parts: list[Column], row_id: str, order: str, batches: int = 3, path: str | None = None) -> DataFrame:
    """The row ids (one column, ``row_id``) of the one delivery kept per message; see :func:`deliveries`."""
    return deliveries(df, parts, row_id, order, batches, path).filter("first").select(row_id)
