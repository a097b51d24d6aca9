"""An index on disk: a log of committed operations, shards of routed postings beside it, and the questions to ask of it."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.config import CommitConflict, Config, ConfigError, DataError, effective_slop
from quillmesh.operators import ops, search, stats, texts, versions
from quillmesh.sources.shared import kept_apart, removed

OPS = "op string, op_ordinal long, document_id long, start long, length long, vector array<double>, text string"
ROUTED = "document_id long, start long, length long, seq long, vector array<double>, deleted boolean, txn_id long, shard_id long"
SHARDS = "shard_id long, centroid array<double>, n long, version long"
KEY = ["document_id", "start", "length"]
#: Rows that one commit may add or remove.
MAX_ADD, MAX_REMOVE = 100_000_000, 50_000_000
#: A shard is split beyond this share of shard_size.
FULL = 0.9
#: An operation's number, odd: its commit, then its place in it. The even number before it marks the rows that it ends.
SEQ = "2 * (txn_id * 1048576 + op_ordinal) + 1"


class Index:
    """Changes are staged and become visible together, in their order, with flush(); readers see whole commits only.

    A commit is a Parquet folder commits/txn_id=N, and the log of commits is the truth: a reopened index needs no
    recovery, and a commit that another writer has taken raises CommitConflict. Beside it, each commit routes its
    postings to the shards with the nearest centroids (routed/txn_id=N/shard_id=S, where removed and replaced rows are
    marked too) and lists the shards (shards/version=N); a commit that ended between the two is routed by the next
    call that needs it. A shard over FULL of shard_size is split in two, and its rows written under their new shards.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.staged: list[DataFrame] = []

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config) -> Index:
        config.checked()
        try:
            spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/config")
        except AnalysisException as e:
            raise ConfigError(f"there is an index at {path}") from e
        return cls(spark, path, config)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        try:
            row = spark.read.text(f"{path}/config").first()
        except AnalysisException as e:
            raise ConfigError(f"there is no index at {path}") from e
        return cls(spark, path, Config.from_json(row.value))

    # changes

    def stage(self, rows: DataFrame, op: str) -> None:
        has = set(rows.columns)
        columns = [F.lit(op).alias("op"), F.lit(len(self.staged)).cast("long").alias("op_ordinal")]
        for name, kind in (x.split(" ") for x in OPS.split(", ")[2:]):
            columns.append((F.col(name) if name in has else F.lit(None)).cast(kind).alias(name))
        self.staged.append(rows.select(*columns))

    def add(self, postings: DataFrame, flush: bool = False) -> None:
        """postings(document_id, start, length, vector)"""
        self.stage(postings, "add_posting")
        if flush:
            self.flush()

    def remove(self, ids: DataFrame) -> DataFrame:
        """Remove documents(document_id); returns how many live postings each loses."""
        n = self.postings().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        self.stage(ids.select("document_id").distinct(), "remove_document")
        return ids.select("document_id").distinct().join(n, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0).cast("long")).alias("removed"))

    def store_texts(self, rows: DataFrame) -> None:
        self.stage(rows, "store_text")

    def delete_texts(self, ids: DataFrame) -> None:
        self.stage(ids, "delete_text")

    def replace_documents(self, rows: DataFrame, postings: DataFrame) -> None:
        """New texts and postings in place of the documents' old ones, in one commit. A posting's range must lie in its
        document's new text, between whole characters."""
        if not rows.groupBy("document_id").count().where("count > 1").isEmpty():
            raise DataError("a document is replaced twice in one batch")
        found = texts.snippets(rows, postings.select(*KEY)).where("fault is not null").groupBy("fault").count().collect()  # a few kinds
        if found:
            raise DataError("; ".join(f"{r['count']} x posting: {r.fault}" for r in found))
        self.store_texts(rows)
        self.stage(rows.select("document_id"), "remove_document")
        self.add(postings)
        self.flush()

    def flush(self) -> dict | None:
        """Commit what is staged; None if nothing is. What is checked is what is written: rows go to a folder of their
        own first, and become a commit from there. Returns the commit's number, its operations by kind, seconds and
        operations a second."""
        if not self.staged:
            return None
        began, at = time.monotonic(), f"{self.path}/pending/{time.time_ns()}"
        rows = ops.validated(reduce(DataFrame.unionByName, self.staged), self.config.vector_size, self.config.max_text_bytes)
        rows.write.parquet(at)
        rows = self.spark.read.parquet(at)
        found = rows.groupBy("op", "fault").count().collect()  # four operations and nine faults at most
        by_op = {op: sum(r["count"] for r in found if r.op == op) for op in sorted({r.op for r in found})}
        bad = [f"{r['count']} x {r.op}: {r.fault}" for r in found if r.fault]
        bad += [f"more than {most} x {op}" for op, most in (("add_posting", MAX_ADD), ("remove_document", MAX_REMOVE)) if by_op.get(op, 0) > most]
        txn = self.version() + 1
        try:
            if bad:
                raise DataError("; ".join(bad))
            rows.drop("fault").write.mode("errorifexists").parquet(f"{self.path}/commits/txn_id={txn}")
        except AnalysisException as e:
            raise CommitConflict(f"commit {txn} was taken") from e
        finally:
            removed(self.spark, at)
        self.staged = []
        self.route()
        seconds = time.monotonic() - began
        n = sum(by_op.values())
        return {"txn_id": txn, "operations": n, **by_op, "seconds": seconds, "operations_a_second": n / seconds}

    # shards

    def read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def routed_version(self) -> int:
        return self.read("shards", SHARDS).agg(F.max("version")).first()[0] or 0

    def shards(self) -> DataFrame:
        """(shard_id, centroid, n): the shards that hold rows now."""
        return self.read("shards", SHARDS).where(F.col("version") == self.routed_version()).where("n > 0").select("shard_id", "centroid", "n")

    def live(self, shards: DataFrame | None = None) -> DataFrame:
        """The live newest postings of all shards, or of some (with shard_id)."""
        rows = self.read("routed", ROUTED).join((self.shards() if shards is None else shards).select("shard_id"), "shard_id", "left_semi")
        return versions.latest(rows.drop("txn_id")).where("not deleted")

    def route(self) -> None:
        """Bring the shards up to the log, commit by commit."""
        for txn in range(self.routed_version() + 1, self.version() + 1):
            self.route_commit(txn)

    def route_commit(self, txn: int) -> None:
        log = self.log().where(F.col("txn_id") == txn)
        adds = ops.postings_of(log).select(*KEY, F.expr(SEQ).alias("seq"), "vector")
        gone = log.where("op = 'remove_document'").groupBy("document_id").agg(F.max(F.expr(SEQ)).alias("gone_at"))
        old, live = self.shards(), self.live()
        # rows that this commit removes or replaces are marked where they are
        stale = live.join(gone, "document_id", "left").join(adds.select(*KEY, F.col("seq").alias("new_at")), KEY, "left")
        stale = stale.where("gone_at is not null or new_at is not null").withColumn("seq", F.greatest("gone_at", "new_at") - 1)
        marks = stale.select(*KEY, "seq", "vector", F.lit(True).alias("deleted"), "shard_id")
        if old.isEmpty():
            routed = adds.withColumn("shard_id", F.lit(txn * (1 << 32)).cast("long"))
        else:
            routed = search.assigned(adds.withColumn("id", F.monotonically_increasing_id()), old).select(*adds.columns, "shard_id")
        rows = kept_apart(routed.select(*KEY, "seq", "vector", F.lit(False).alias("deleted"), "shard_id").unionByName(marks))
        # a shard's sum of vectors and number of rows follow its changes: the rows it has are not read again
        sign = F.when(F.col("deleted"), -1).otherwise(1)
        change = rows.select("shard_id", sign.alias("sign"), F.posexplode("vector").alias("i", "x")).groupBy("shard_id", "i").agg(F.sum(F.col("x") * F.col("sign")).alias("x"), F.sum("sign").alias("n"))
        held = old.select("shard_id", "n", F.posexplode("centroid").alias("i", "x")).select("shard_id", "i", (F.col("x") * F.col("n")).alias("x"), "n")
        sums = held.unionByName(change).groupBy("shard_id", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        sums = sums.groupBy("shard_id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
        now = kept_apart(sums.select("shard_id", F.expr("transform(c, y -> y.x / n)").alias("centroid"), "n"))
        # split
        most, moved, next_id = int(FULL * self.config.shard_size), None, txn * (1 << 32) + 1
        over = F.broadcast(now.where(F.col("n") > max(1, most)).select("shard_id"))  # ids of shards; rows stay where they are
        if not over.isEmpty():
            part = rows.withColumn("txn_id", F.lit(txn)).unionByName(self.read("routed", ROUTED)).join(over, "shard_id", "left_semi")
            moved = versions.latest(part.drop("txn_id")).where("not deleted").withColumn("key", F.struct(*KEY))
            while True:
                moved = kept_apart(search.split_round(moved, max(1, most), next_id))
                sizes = moved.groupBy("shard_id").count()
                if sizes.where(F.col("count") > max(1, most)).isEmpty():
                    break
                next_id = moved.agg(F.max("shard_id")).first()[0] + 1
            means = search.centroids(moved).join(sizes, "shard_id").select("shard_id", "centroid", F.col("count").alias("n"))
            now = now.join(over, "shard_id", "left_anti").unionByName(means)
            rows = rows.join(over, "shard_id", "left_anti").unionByName(moved.select(*rows.columns))
        rows.write.mode("overwrite").partitionBy("shard_id").parquet(f"{self.path}/routed/txn_id={txn}")
        now.select("shard_id", "centroid", "n").write.mode("overwrite").parquet(f"{self.path}/shards/version={txn}")

    # reads

    def log(self) -> DataFrame:
        return self.read("commits", OPS + ", txn_id long")

    def version(self) -> int:
        return self.log().agg(F.max("txn_id")).first()[0] or 0

    def postings(self) -> DataFrame:
        """The live newest postings, with the shard that each is in."""
        self.route()
        return self.live().select(*KEY, "shard_id", "seq", "vector", "deleted")

    def slop(self) -> int:
        """The breadth of a search that asks for none: what tune() found, else by the settings."""
        tuned = self.read("tuning", "slop int, n_shards long, version long")
        row = tuned.orderBy(F.desc("version")).first()
        return row.slop if row else effective_slop(self.config, self.shards().count())

    def search(self, query: list[float], k: int = 10, slop: int | None = None, metric: str = "cosine") -> DataFrame:
        """The k most similar postings of the slop shards with the nearest centroids; other shards' files are not read."""
        search.check_query(query, k, slop, self.config.vector_size, metric)
        self.route()
        near = [r.shard_id for r in search.nearest_shards(self.shards(), query, self.slop() if slop is None else slop).collect()]  # 1000 at most
        rows = self.read("routed", ROUTED).where(F.col("shard_id").isin(near)).drop("txn_id")
        return search.search(rows, query, k, max(1, len(near)), metric, self.config.policy, self.shards().where(F.col("shard_id").isin(near)))

    def recall(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(slop, recall): the share of the k postings nearest to queries(query_id, vector) by cosine that searches of
        each breadth see, against all postings."""
        self.route()
        live = kept_apart(self.live().withColumn("id", F.monotonically_increasing_id()))
        asked = queries.select("query_id", "vector").orderBy("query_id").toLocalIterator()
        best = search.search_batch(live, ((r.query_id, r.vector) for r in asked), k).join(live.select("id", "shard_id"), "id")
        return recall_by_slop(best.select("query_id", "shard_id"), queries, self.shards())

    def tune(self, queries: DataFrame, target: float = 0.9, k: int = 10) -> int:
        """Measure the recall over queries(query_id, vector), and search from now on with the smallest slop that reaches
        the target."""
        found = self.recall(queries, k).where(F.col("recall") >= target).agg(F.min("slop").alias("slop")).first().slop
        slop = min(found or 1000, 1000)
        row = self.spark.createDataFrame([(slop, self.shards().count())], "slop int, n_shards long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/tuning/version={self.version()}")
        return slop

    def texts(self) -> DataFrame:
        return ops.texts_of(self.log())

    def snippets(self, requests: DataFrame) -> DataFrame:
        return texts.snippets(self.texts(), requests)

    def stats(self) -> DataFrame:
        return stats.index_stats(self.postings(), self.config.shard_size, self.config.vector_size)


def recall_by_slop(hits: DataFrame, queries: DataFrame, shards: DataFrame) -> DataFrame:
    """(slop, recall) for hits(query_id, shard_id), the exact results' shards: the share whose shard is among the slop
    nearest of its query, up to the slop that sees all. One row a query and shard, as queries are a stated set."""
    asked = queries.select("query_id", F.col("vector").alias("q"))
    far = F.round(F.expr(search.distance("centroid", "q")), 6).alias("distance")
    ranked = asked.crossJoin(F.broadcast(shards.select("shard_id", "centroid"))).select("query_id", "shard_id", far)  # a stated query set against the shards
    ranked = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "shard_id"))).alias("order"))
    placed = ranked.select("query_id", F.posexplode("order").alias("place", "s")).select("query_id", "s.shard_id", (F.col("place") + 1).alias("slop"))
    by = hits.join(placed, ["query_id", "shard_id"]).groupBy("slop").agg(F.count(F.lit(1)).alias("n"))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    seen = by.select("slop", F.sum("n").over(search.Window.orderBy("slop")).alias("n"))  # one row a shard
    return seen.join(F.broadcast(total)).select("slop", F.round(F.col("n") / F.col("total"), 6).alias("recall"))
