"""Serving tables: posting lists, token postings, incremental maintenance, overlays, generations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A posting list is cut into chunks of so many neighbouring ids, so that a frequent value makes many rows and no long one.
CHUNK = 4096


def build_postings(rows: DataFrame, kind: str, value: str, item: str = "article_id", only: list[str] | None = None) -> DataFrame:
    """(filter_kind, filter_value, chunk, ids): sorted distinct ids of each value (``only`` those given), by id range."""
    text = F.col(value).cast("string")
    src = rows.where(text.isNotNull() if only is None else text.isin(only))
    return src.groupBy(F.lit(kind).alias("filter_kind"), text.alias("filter_value"), F.floor(F.col(item) / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_set(item)).alias("ids"))


def intersect_postings(postings: DataFrame, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """Ids in some list of every group of (kind, values)."""
    spark = postings.sparkSession
    wanted = spark.createDataFrame([(i, k, v) for i, (k, vs) in enumerate(groups) for v in vs], "g int, filter_kind string, filter_value string")
    hit = postings.join(F.broadcast(wanted), ["filter_kind", "filter_value"]).select("g", F.explode("ids").alias("article_id"))
    return hit.groupBy("article_id").agg(F.count_distinct("g").alias("n")).where(F.col("n") == len(groups)).select("article_id")


def apply_posting_changes(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids join (add true) or leave lists; lists stay sorted and distinct, empty ones go."""
    keys = ["filter_kind", "filter_value", "chunk"]
    delta = changes.withColumn("chunk", F.floor(F.col("article_id") / CHUNK)).groupBy(*keys).agg(F.collect_set(F.when(F.col("add"), F.col("article_id"))).alias("plus"), F.collect_set(F.when(~F.col("add"), F.col("article_id"))).alias("minus"))
    none = F.array().cast("array<bigint>")
    x = postings.join(delta, keys, "full")
    ids = F.array_sort(F.array_union(F.array_except(F.coalesce("ids", none), F.coalesce("minus", none)), F.coalesce("plus", none)))
    return x.select(*keys, ids.alias("ids")).where(F.size("ids") > 0)


def coalesce_dirty(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """One pending row per scope: first and latest mark, and how many changes it stands for."""
    return deltas.groupBy(*keys).agg(F.min("event_id").alias("first_mark"), F.max("event_id").alias("latest_mark"), F.count(F.lit(1)).alias("changes"))


def latest_by_mark(deltas: DataFrame, key: str = "article_id", mark: str = "event_id") -> DataFrame:
    """The delta with the highest mark of each article, tombstones dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(mark))
    return deltas.withColumn("_k", F.row_number().over(w)).where("_k = 1 and not tombstone").drop("_k")


def append_once(ledger: DataFrame, incoming: DataFrame, key: str = "idempotency_key", order: str = "event_id") -> DataFrame:
    """What an append adds: the first of each key that the ledger doesn't hold."""
    w = Window.partitionBy(key).orderBy(order)
    first = incoming.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return first.join(ledger.select(key), key, "left_anti")


def high_water_marks(ledger: DataFrame, partition: str = "partition_id", order: str = "event_id") -> DataFrame:
    """A gapless mark per source partition, in arrival order."""
    return ledger.withColumn("mark", F.row_number().over(Window.partitionBy(partition).orderBy(order)).cast("long"))


#: Components that each kind of change touches.
INVALIDATES = {
    "article_added": ("base", "title_search", "counts"),
    "article_updated": ("base", "title_search"),
    "article_deleted": ("base", "title_search", "counts", "postings"),
    "llm_judged": ("llm_status", "postings", "counts", "queue"),
    "human_judged": ("human_status", "postings", "counts", "queue"),
}


def fan_out(deltas: DataFrame) -> DataFrame:
    """Each change with every component that it makes stale."""
    rules = deltas.sparkSession.createDataFrame([(k, c) for k, cs in INVALIDATES.items() for c in cs], "change_kind string, component string")
    return deltas.join(F.broadcast(rules), "change_kind")


def overlay(base: DataFrame, pending: DataFrame, key: str, value: str, now: int) -> DataFrame:
    """Read-your-write: the newest overlay that is pending and not expired wins over the base."""
    w = Window.partitionBy(key).orderBy(F.desc("written_s"))
    live = pending.where((F.col("status") == "pending") & (F.col("expires_s") > now)).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, F.col(value).alias("_o"))
    return base.join(live, key, "left").withColumn(value, F.coalesce("_o", value)).drop("_o")


def barrier(pending: DataFrame, marks: DataFrame) -> DataFrame:
    """How far each partition may advance: before its first unreconciled mark, else its last one."""
    first = pending.groupBy("partition_id").agg(F.min("mark").alias("stuck"))
    last = marks.groupBy("partition_id").agg(F.max("mark").alias("last_mark"))
    return last.join(first, "partition_id", "left").select("partition_id", F.coalesce(F.col("stuck") - 1, F.col("last_mark")).alias("may_reach"))


def claimable(work: DataFrame, now: int, lease_s: int = 900) -> DataFrame:
    """Pending work, and running or failed work whose lease has run out."""
    return work.where((F.col("status") == "pending") | (F.col("status").isin("running", "failed") & (F.col("claimed_s") < now - lease_s)))


class Generations:
    """A versioned relation: immutable Parquet directories and numbered pointers, of which the highest is active.

    All file access goes through Spark's file system layer, so the folder may be on any store. A candidate is
    staged under a name of its own; promotion creates the pointer of the next number, which fails if another writer
    has done so first, and never deletes one that readers may follow. A pointer names the folder of each part."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: dict[int, dict[str, str]] = {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.rpartition(".")[2]) for n in self._names() if n.startswith(f"{kind}."))

    def active(self) -> int | None:
        return max(self._numbers("active"), default=None)

    def parts(self, n: int | None) -> dict[str, str]:
        """Folders of a promoted generation by part; none for None."""
        return {} if n is None else json.loads(self.spark.read.text(f"{self.root}/active.{n}", wholetext=True).first()[0])

    def stage(self, df: DataFrame, by: str | None = None) -> int:
        """Write a candidate: all of it, or, cut by column ``by``, the parts that ``df`` has (the others stay as in the
        active generation)."""
        active = self.active()
        n = max([active or 0, *self._numbers("failed")]) + 1
        folder = f"generation={n}-{uuid.uuid4().hex[:12]}"
        if by is None:
            df.write.parquet(f"{self.root}/{folder}")
            self._staged[n] = {"": folder}
        else:
            df.write.partitionBy(by).parquet(f"{self.root}/{folder}")
            fs, p = self._fs(f"{self.root}/{folder}")
            own = [s.getPath().getName() for s in fs.listStatus(p) if "=" in s.getPath().getName()]
            self._staged[n] = self.parts(active) | {name.split("=")[1]: f"{folder}/{name}" for name in own}
        return n

    def _create(self, name: str, text: str) -> bool:
        """A new file; False if it is there already."""
        fs, p = self._fs(f"{self.root}/{name}")
        try:
            out = fs.create(p, False)
        except Exception as e:  # the store's own exclusive creation decides between writers
            if fs.exists(p):
                return False
            raise e
        out.write(text.encode())
        out.close()
        return True

    def promote(self, n: int, expected: int | None, checks: DataFrame | None = None) -> bool:
        """Make the staged ``n`` active if ``expected`` still is and no row of ``checks`` complains; a candidate that
        fails its checks is marked so, and its number isn't used again."""
        if n not in self._staged or self.active() != expected:
            return False
        if checks is not None and not checks.isEmpty():
            self._create(f"failed.{n}", "")
            return False
        return self._create(f"active.{n}", json.dumps(self._staged[n]))

    def states(self) -> dict[int, str]:
        """candidate, active, retired or failed, by number."""
        active, failed = self.active(), set(self._numbers("failed"))
        staged = {int(n.split("=")[1].split("-")[0]) for n in self._names() if n.startswith("generation=")}
        return {n: "failed" if n in failed else "active" if n == active else "retired" if n in self._numbers("active") else "candidate" for n in sorted(staged | failed)}

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The active generation, or those of the given parts that it has."""
        n = self.active()
        if n is None:
            raise ValueError("no active generation")
        folders = [f for part, f in self.parts(n).items() if parts is None or part in parts]
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def retain(self, keep: int = 2, pinned: tuple[int, ...] = ()) -> list[int]:
        """Delete what no kept pointer names: kept are the active one, pinned ones, the latest ``keep`` before it and
        candidates. Returns the numbers of the pointers that went."""
        have, active = self._numbers("active"), self.active()
        kept = {active, *pinned, *[n for n in have if n < (active or 0)][-keep:]}
        gone = [n for n in have if n not in kept]
        used = {f.split("/")[0] for n in have if n in kept for f in self.parts(n).values()}
        for name in [f"active.{n}" for n in gone] + [x for x in self._names() if x.startswith("generation=") and int(x.split("=")[1].split("-")[0]) <= (active or 0) and x not in used]:
            fs, p = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)
        return gone
