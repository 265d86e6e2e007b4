"""Exact de-duplication as a stateful stream over digests, with full bytes checked on hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_SPACE, membership, new_folder, remove, stored, text_or_empty, with_membership, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
#: Names that no table has.
_ID, _TEXT, _ROWS, _STAYS = ("__lodestone_" + n for n in ("id", "text", "rows", "stays"))
#: A store is closed with its task: an open one holds 5 MB of an executor's disk, however small.
_UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"


def normalised(text):
    """The text without any ASCII white space."""
    return F.regexp_replace(text, f"{ASCII_SPACE}+", "")


def sha256_hex(norm):
    return F.sha2(norm, 256)


def _stream_groups(arrivals_path: str, schema, spark, files_per_batch: int) -> tuple[DataFrame, str]:
    """The state of each digest after all arrivals: how many, and the best arrival so far.

    The state is keyed by digest, lives on disk (RocksDB) and never expires.  It retains the
    digest, the survivor's stable identifier with its rank (length, then smallest id), and its
    content locator.  Each micro-batch's changed keys are written under the batch's own number,
    so a batch that is run again replaces its rows; the last change of a key is its final state.
    Returns the final states and the folder that holds the state and its changes.
    """
    root = new_folder(spark, "exact-dedup-state")
    settings = {_PROVIDER: ROCKSDB, _BOUNDED: "true", _UNLOAD: "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals_path)
        state = stream.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("low"), "locator")).alias("best"))

        def land(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")

        query = state.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kinds = "digest string, group_size long, best struct<n_points:int,low:bigint,locator:bigint>, batch int"
    changes = spark.read.schema(kinds).option("basePath", f"{root}/changes").parquet(f"{root}/changes")
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "group_size", "best")).alias("s"))
    return last.select("digest", F.bitwise_not("s.best.low").alias("keep_id"), F.col("s.best.locator").alias("keep_locator"), F.col("s.group_size").alias("group_size")), root


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, files_per_batch: int = 256) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, digest, locator.

    Texts are equal when identical without ASCII white space.  Of equal texts the row with the
    most code points stays, then the smallest id.  Arrivals (digest, id, length, locator; no text)
    are streamed through keyed state; the locator is a hash of the original text that, with the id,
    finds a row's content again.  Only then are the full bytes of groups of two or more compared:
    a filter over their locators, of bounded size, keeps all other texts where they are.
    If a digest stands for different bytes, its rows are grouped by the bytes themselves, so the
    result never rests on the digest (which a caller may choose).

    Null texts count as empty and equal one another and blank ones.  Null ids rank last.  Repeated
    rows (equal id and text) are one document twice: both are counted, and both are marked as the
    survivor.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("norm", normalised(F.col("text")))
    keyed = rows.select("doc_id", "text", "norm", digest(F.col("norm")).alias("digest"), F.xxhash64("text").alias("locator"))
    arrivals_path = new_folder(spark, "exact-dedup-arrivals")
    arrivals = keyed.select("digest", "doc_id", F.char_length("text").alias("n_points"), "locator")
    arrivals.write.parquet(arrivals_path)
    arrivals = spark.read.schema(arrivals.schema).parquet(arrivals_path)
    if arrivals.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, digest string, locator long")
    states, root = _stream_groups(arrivals_path, arrivals.schema, spark, files_per_batch)
    groups = stored(states, "exact-dedup-groups")
    remove(spark, root)
    found = stored(arrivals.join(groups, "digest"), "exact-dedup-found")
    copied = stored(found.where("group_size > 1").select("locator").distinct(), "exact-dedup-copied")
    # Only texts with copies are normalised again and leave their task, each once a task: (digest,
    # bytes) is the whole key, so a group of very many copies is no task's alone.
    texts = with_membership(docs.select(text_or_empty(text_col).alias("text")), F.xxhash64("text"), membership(copied, "locator"), "hit").where("hit")
    contents = texts.select(normalised(F.col("text")).alias("norm")).select(digest(F.col("norm")).alias("digest"), "norm").distinct()
    unequal = stored(contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "exact-dedup-unequal")
    if not unequal.isEmpty():
        apart = stored(keyed.join(unequal, "digest", "left_semi").select("digest", "norm", "doc_id", F.char_length("text").alias("n_points"), "locator"), "exact-dedup-apart")
        best = apart.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("low"), "locator")).alias("best"))
        again = apart.join(best, ["digest", "norm"]).select("digest", "doc_id", "n_points", "locator", F.bitwise_not("best.low").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
        found = found.join(unequal, "digest", "left_anti").unionByName(again)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "locator")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they were: one of each group of equal texts.

    What goes is told by id and content locator.  A survivor that occurs as several rows with an
    equal id and text is one row afterwards: the groups' own counts show which those are, and only
    those rows are made distinct.  Columns may have any names but those that begin with
    ``__lodestone_``.
    """
    found = exact_duplicates(docs, id_col, text_col)
    found = found.select(F.col("doc_id").alias(_ID), F.col("locator").alias(_TEXT), "kept")
    rows = found.groupBy(_ID, _TEXT).agg(F.count("*").alias(_ROWS), F.max("kept").alias(_STAYS))
    other = stored(rows.where((F.col(_ROWS) > 1) | ~F.col(_STAYS)), "exact-dedup-other")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(_ID)) & (F.xxhash64(text_or_empty(text_col)) == F.col(_TEXT))
    once = without(docs, other, F.xxhash64(text_or_empty(text_col)), _TEXT, same)
    several = other.where(F.col(_STAYS))
    if several.isEmpty():
        return once
    return once.unionByName(docs.join(several, same, "left_semi").dropDuplicates([id_col, text_col]))
