"""A lexical index that stays: postings by term, kept up as pages change, read by the buckets of a question's terms only.

``postings`` (term, key, tf, version) lie in folders by a hash of the term, with one row for each page itself (term null)
that has scope, content_hash and dl. Texts are dealt by key once and cut where they then are. ``pages`` says which version of a
page counts, so postings of replaced and removed pages are passed over without being rewritten. ``terms`` has document
frequencies; an update adds what new pages have and takes off what their old versions had. Each update writes new page
and term tables under its own number; an index is as of the last number whose update ended.

One writer at a time. Numbers that an unfinished update left are written over by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evspark.functions.text import tokens

from .lexical import B, FLOOR, K1, dealt, small_enough

BUCKETS = 64


def bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class LexicalStore:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def version(self) -> int:
        """The last update that ended; 0 before the first."""
        try:
            return self.spark.read.schema("version int").json(f"{self.path}/versions").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def _read(self, table: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/version={version}")

    def pages(self) -> DataFrame:
        """key, scope, content_hash, dl and version of the pages that count."""
        return self._read("pages", self.version())

    def terms(self) -> DataFrame:
        return self._read("terms", self.version())

    def postings(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")

    def update(self, pages: DataFrame, key: str, text: Column, scope: str, removed: DataFrame | None = None) -> int:
        """Takes in pages that are new or whose text has changed, and leaves out ``removed`` keys. Says how many were cut into terms."""
        old, number = self.version(), self.version() + 1
        kept = self._read("pages", old) if old else None
        # A page's terms are counted in the partition of its key, so that only texts and then narrow postings move.
        texts = dealt(pages.select(F.col(key).alias("key"), F.col(scope).alias("scope"), text.alias("text")), "key", pages)
        hashed = texts.withColumn("content_hash", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
        if kept is not None:
            known = hashed.join(kept.select("key", F.col("content_hash").alias("_known")), "key", "left")
            hashed = known.filter(F.col("_known").isNull() | (F.col("_known") != F.col("content_hash"))).drop("_known")
        cut = hashed.withColumn("tokens", tokens(F.col("text"))).withColumn("page", F.struct("scope", "content_hash", F.size("tokens").alias("dl")))
        # Every page has a row of its own (term null) too, so that pages without terms count.
        rows = cut.select("key", "page", F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
        tf = rows.withColumn("page", F.when(F.col("term").isNull(), F.col("page"))).groupBy("key", "term", "page").agg(F.count(F.lit(1)).alias("tf"))
        part = f"{self.path}/postings/version={number}"
        tf.withColumn("bucket", bucket("term", self.buckets)).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(part)
        added = self.spark.read.schema(f"{tf.schema.toDDL()}, bucket int").parquet(part)
        new_pages = added.filter("term is null").groupBy("key").agg(F.first("page").alias("page")).select("key", "page.*").withColumn("version", F.lit(number))
        change = added.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if kept is not None:
            gone = new_pages.select("key") if removed is None else new_pages.select("key").union(removed.select(F.col(key).alias("key"))).distinct()
            stale = small_enough(kept.join(gone, "key", "left_semi").select("key", "version"))
            lost = self.postings().filter(F.col("version") <= old).filter("term is not null").join(stale, ["key", "version"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            change = self._read("terms", old).unionByName(change).unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
            new_pages = kept.join(gone, "key", "left_anti").unionByName(new_pages if removed is None else new_pages.join(removed.select(F.col(key).alias("key")), "key", "left_anti"))
        new_pages.write.mode("overwrite").parquet(f"{self.path}/pages/version={number}")
        change.write.mode("overwrite").parquet(f"{self.path}/terms/version={number}")
        taken = self._read("pages", number).filter(F.col("version") == number).count()
        self.spark.createDataFrame([(number,)], "version int").write.mode("append").json(f"{self.path}/versions")
        return taken

    def matches(self, asked: DataFrame) -> DataFrame:
        """Postings of the terms asked for (column term), of the pages that count. Only the terms' folders are read."""
        numbers = [r[0] for r in asked.select(bucket("term", self.buckets).alias("b")).distinct().collect()]  # at most ``buckets``
        found = self.postings().filter(F.col("bucket").isin(numbers)).join(small_enough(asked.select("term").distinct()), "term", "left_semi")
        # Dealt by key before anything is made of them, so that a page's sums need no further move.
        return found.select("term", "key", "tf", "version").repartition("key").join(self.pages().select("key", "scope", "dl", F.col("version").alias("_counts")), "key").filter("version = _counts").drop("_counts")

    def scores(self, questions: DataFrame, qkey: str, question: Column) -> DataFrame:
        """qkey, key, scope and score, as ``lexical.bm25_scores`` gives them over all pages that count."""
        asked = questions.select(qkey, F.explode(tokens(question)).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("times"))
        n, avgdl = self.pages().agg(F.count(F.lit(1)), F.avg("dl")).first()
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = self.terms().withColumn("raw", raw)
        mean = terms.agg(F.avg("raw")).first()[0]
        idf = F.when(F.col("raw") < 0, F.lit(FLOOR) * F.lit(mean)).otherwise(F.col("raw"))
        weights = asked.join(terms.select("term", idf.alias("idf")), "term").select(qkey, "term", (F.col("times") * F.col("idf")).alias("weight"))
        weights = small_enough(weights)
        share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        hits = self.matches(asked).select("key", "scope", "term", share.alias("share")).join(weights, "term")
        return hits.groupBy(qkey, "key", "scope").agg(F.round(F.sum(F.col("weight") * F.col("share")), 6).alias("score"))
