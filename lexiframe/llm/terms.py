"""Frequency of every distinct value or term, kept up to date by signed deltas (problem 5).

A store is a folder of Parquet tables. `entries` holds, append-only, what each record version says
(field, rec, term, occ); `counts` holds, in buckets of the term's hash, how often each term occurs
and in how many records. A batch of added, changed or deleted records is turned into signed changes
per term (new entries count plus, the replaced version's entries minus), and only the buckets that
these changes touch are merged and written anew. Records of a batch that say the same as before
cancel out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import cut, release, shared_dir

#: Least buckets of the counts, and entries of the first batch per bucket beyond; a merge rewrites only touched ones.
BUCKETS, PER_BUCKET = 32, 4_000_000
#: White space stripped at the ends of values.
EDGE = " \t\n\x0b\f\r\u00a0\u3000"

ENTRY = "field string, rec bigint, term string, occ bigint"
COUNT = "field string, term string, n_occ bigint, n_rec bigint, bucket int"


class TermStore:
    """Persistent term counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/lexiframe/terms-{uuid.uuid4().hex}"
        self.version = 0
        self.entry_paths: list[str] = []
        self.count_paths: dict[int, str] = {}
        self.buckets = BUCKETS
        if path:
            self._read_manifest()

    # Each version has a manifest of its own, made aside and then renamed, so a crash leaves the version
    # before. It names at most as many folders as there are buckets and batches.
    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read_manifest(self) -> None:
        fs, p = self._folder()
        if not fs.exists(p):
            return
        names = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("manifest-") and n.endswith(".json"))
        if names:
            said = json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0])
            self.version, self.entry_paths, self.buckets = said["version"], said["entries"], said["buckets"]
            self.count_paths = {int(k): v for k, v in said["counts"].items()}

    def _write_manifest(self) -> None:
        fs, _ = self._folder()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        aside, final = path(f"{self.path}/.manifest-{uuid.uuid4().hex}"), path(f"{self.path}/manifest-{self.version:06d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"version": self.version, "entries": self.entry_paths, "counts": self.count_paths, "buckets": self.buckets}).encode()))
        out.close()
        if not fs.rename(aside, final):
            raise OSError(f"another writer made {final}")

    def entries(self) -> DataFrame:
        """All versions of all records; deleted ones have a null term."""
        if not self.entry_paths:
            return self.spark.createDataFrame([], ENTRY + ", version int")
        return self.spark.read.schema(ENTRY + ", version int").parquet(*self.entry_paths)

    def counts(self) -> DataFrame:
        """(field, term, n_occ, n_rec) of all records as they are now."""
        if not self.count_paths:
            return self.spark.createDataFrame([], COUNT).drop("bucket")
        return self.spark.read.schema(COUNT).parquet(*self.count_paths.values()).drop("bucket")

    def apply(self, batch: DataFrame, deleted: DataFrame | None = None, records: DataFrame | None = None) -> "TermStore":
        """Takes in a batch (field, rec, term, occ), one row per term of each added or changed
        record, and deleted (field, rec). A record stands in a batch with all its terms or not at all.
        `records` (field, rec) names all records of the batch: one that has no term in it any more
        takes back those that it had.
        """
        first = not self.entry_paths
        self.version += 1
        where = f"{self.path}/entries/{self.version:06d}"
        rows = batch.select("field", F.col("rec").cast("bigint").alias("rec"), "term", F.col("occ").cast("bigint").alias("occ"))
        gone = None if deleted is None else deleted.select("field", F.col("rec").cast("bigint").alias("rec"))
        if records is not None:
            emptied = records.select("field", F.col("rec").cast("bigint").alias("rec")).join(rows, ["field", "rec"], "left_anti")
            gone = emptied if gone is None else gone.unionByName(emptied)
        gone = None if gone is None else gone.distinct()
        written = rows if gone is None else rows.unionByName(gone.withColumn("term", F.lit(None).cast("string")).withColumn("occ", F.lit(0).cast("bigint")))
        written.withColumn("version", F.lit(self.version)).write.mode("overwrite").parquet(where)
        new = self.spark.read.schema(ENTRY + ", version int").parquet(where)
        if first:
            self.buckets = max(BUCKETS, -(-new.count() // PER_BUCKET))
        plus = new.where("term is not null").select("field", "term", F.col("occ").alias("d_occ"), F.lit(1).cast("bigint").alias("d_rec"))
        if first:
            change = plus
        else:
            touched = new.select("field", "rec").distinct()
            old = self.entries().join(touched, ["field", "rec"], "left_semi")
            last = old.groupBy("field", "rec").agg(F.max("version").alias("version"))
            old = old.join(last, ["field", "rec", "version"], "left_semi").where("term is not null")
            change = plus.unionByName(old.select("field", "term", (-F.col("occ")).alias("d_occ"), F.lit(-1).cast("bigint").alias("d_rec")))
        change = change.groupBy("field", "term").agg(F.sum("d_occ").alias("d_occ"), F.sum("d_rec").alias("d_rec"))
        change = change.where("d_occ <> 0 or d_rec <> 0").withColumn("bucket", F.pmod(F.xxhash64("field", "term"), F.lit(self.buckets)).cast("int"))
        self.entry_paths.append(where)
        self._merge(change, first)
        self._write_manifest()
        return self

    def _merge(self, change: DataFrame, first: bool) -> None:
        kept = None
        if first:
            merged = change.select("field", "term", F.col("d_occ").alias("n_occ"), F.col("d_rec").alias("n_rec"), "bucket")
        else:
            kept = cut(change)
            hit = [r[0] for r in kept.select("bucket").distinct().collect()]  # at most as many as there are buckets
            paths = [self.count_paths[b] for b in hit if b in self.count_paths]
            merged = kept.select("field", "term", F.col("d_occ").alias("n_occ"), F.col("d_rec").alias("n_rec"), "bucket")
            if paths:
                merged = merged.unionByName(self.spark.read.schema(COUNT).parquet(*paths))
            merged = merged.groupBy("field", "term", "bucket").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_rec").alias("n_rec"))
        out = f"{self.path}/counts/{self.version:06d}"
        merged = merged.where("n_rec > 0")
        # the bucket stays a column of the files; the folder's name repeats it under another one
        merged.withColumn("part", F.col("bucket")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(out)
        fs, _ = self._folder()
        base = self.spark._jvm.org.apache.hadoop.fs.Path(out)
        there = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(base) if s.isDirectory() and "=" in s.getPath().getName()}
        if not first:
            for b in hit:
                self.count_paths.pop(b, None)
        for b in there:
            self.count_paths[b] = f"{out}/part={b}"
        release(kept)


def word_entries(sentences: DataFrame) -> DataFrame:
    """(field, rec, term, occ) of sentences (sent_id, words): lower-cased, stripped; a sentence
    counts once however often it is delivered; null and empty words and null ids are left out."""
    one = sentences.where("sent_id is not null and words is not null").select("sent_id", "words").dropDuplicates(["sent_id"])
    w = one.select(F.col("sent_id").cast("bigint").alias("rec"), F.explode("words").alias("w"))
    w = w.select("rec", F.btrim(F.lower("w"), F.lit(EDGE)).alias("term")).where("term <> ''")
    return w.groupBy("rec", "term").agg(F.count(F.lit(1)).alias("occ")).select(F.lit("word").alias("field"), "rec", "term", "occ")


def tag_entries(tags: DataFrame) -> DataFrame:
    """(field, rec, term, occ) of tags (sent_id, tok_idx, tag): upper-cased, stripped; repeated rows
    of a token count once; null and empty tags and null ids are left out."""
    t = tags.where("sent_id is not null and tag is not null")
    t = t.select(F.col("sent_id").cast("bigint").alias("rec"), "tok_idx", F.btrim(F.upper("tag"), F.lit(EDGE)).alias("term")).where("term <> ''")
    t = t.repartition("rec").dropDuplicates(["rec", "tok_idx", "term"])
    return t.groupBy("rec", "term").agg(F.count(F.lit(1)).alias("occ")).select(F.lit("tag").alias("field"), "rec", "term", "occ")


def marks(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Counts with `mark`: rare, common, or null for terms of use."""
    mark = F.when(F.col("n_rec") < rare_below, "rare").when(F.col("n_rec") > F.lit(common_above) * F.lit(n_records), "common")
    return counts.withColumn("mark", mark)


def count_terms(sentences: DataFrame, tags: DataFrame, late_days: int = 7) -> TermStore:
    """A store over both tables, as they arrive: the sentences that came in time, then those loaded
    more than late_days after annotation as a second batch, then the tags.

    A redelivered sentence of the second batch says what it said before and changes nothing.
    """
    store = TermStore(sentences.sparkSession)
    late = F.coalesce(F.col("loaded_at") > F.col("annotated_at") + F.expr(f"interval {int(late_days)} days"), F.lit(False))
    on_time = word_entries(sentences.where(~late)).unionByName(tag_entries(tags))
    store.apply(on_time)
    late_rows = sentences.where(late & F.col("sent_id").isNotNull())
    store.apply(word_entries(late_rows), records=late_rows.select(F.lit("word").alias("field"), F.col("sent_id").alias("rec")).distinct())
    return store
