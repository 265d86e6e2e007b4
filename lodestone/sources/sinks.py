"""Writers.  Each takes a DataFrame; nothing is written before it is called (a dry run is the
DataFrame itself)."""

from __future__ import annotations

import json
import mimetypes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import make_folder


def csv_file(df: DataFrame, path: str, order: str | None = None) -> None:
    """One CSV file with a header; nulls are empty.  For small reports: one task writes it (see
    ``csv_parts``)."""
    (df.orderBy(order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def csv_parts(df: DataFrame, path: str, order: str) -> None:
    """A folder of CSV files, each with a header, whose names and rows follow the order; no task holds
    more than a range of it."""
    df.orderBy(order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def clean_report(df: DataFrame, path: str) -> None:
    csv_file(df.select("path", "status", "width", "height", F.col("has_exif").cast("int"), (F.col("status") == "ok").cast("int").alias("kept")), path, "path")


def survivors(df: DataFrame, path: str) -> None:
    """The kept rows; rejects are never deleted."""
    df.where("status = 'ok'").write.mode("overwrite").parquet(path)


def survivor_files(df: DataFrame, root: str, key: str = "key", content: str = "content") -> None:
    """Copies the kept rows' files below ``root``; nothing is deleted anywhere."""
    put_objects(df.where("status = 'ok'"), root, key, content)


def _document(head: str, entries: DataFrame, key: str, text, tail: str) -> DataFrame:
    """(part, key, value): the lines of one JSON document, entries in order of their key.

    ``json_file`` sorts and writes them; an entry is a line, so no row or task holds the whole.
    """
    last = entries.agg(F.max(key).alias("_last"))  # one row
    comma = F.when(F.col(key) == F.col("_last"), F.lit("")).otherwise(F.lit(","))
    lines = entries.crossJoin(F.broadcast(last)).select(F.lit(1).alias("part"), F.col(key).cast("string").alias("key"), F.concat(text, comma).alias("value"))
    ends = entries.sparkSession.createDataFrame([(0, None, head), (2, None, tail)], "part int, key string, value string")
    return ends.unionByName(lines)


def _quoted(c: str):
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def geo_index_document(cells: DataFrame, size: float) -> DataFrame:
    """The lines of the nested index: a line a slug, cells sorted within it (a slug has at most as
    many as the globe has cells)."""
    lists = cells.groupBy("slug").agg(F.array_sort(F.collect_list(F.array("clat", "clon"))).alias("cells"))
    return _document(f'{{"cell_size_deg": {float(size)}, "cells": {{', lists, "slug", F.concat(_quoted("slug"), F.lit(": "), F.to_json("cells")), "}}")


def taxonomy_document(df: DataFrame) -> str:
    """The taxonomy as JSON text, by class index; a class dimension, so it is built on the driver."""
    rows = df.orderBy("class_idx").collect()
    return json.dumps({str(r["class_idx"]): {k: v for k, v in r.asDict().items() if k != "class_idx"} for r in rows}, indent=1)


def prototypes(df: DataFrame, path: str) -> None:
    df.select("class_idx", "proto").write.mode("overwrite").parquet(path)


def prototypes_npy(df: DataFrame, root: str, name: str = "prototypes.npy") -> None:
    """A matrix of single-precision prototypes as one ``.npy`` file below ``root``; row n is class n.

    One task streams the rows in order; classes must be 0, 1, 2 ... and all vectors of one length.
    """
    from lodestone.shipping import ship

    ship(df.sparkSession)
    shape = df.agg(F.count("*").alias("n"), F.min("class_idx").alias("low"), F.max("class_idx").alias("high"), F.count_distinct("class_idx").alias("kinds"), F.min(F.size("proto")).alias("short"), F.max(F.size("proto")).alias("long")).first()
    if not shape["n"] or (shape["low"], shape["high"], shape["kinds"], shape["short"]) != (0, shape["n"] - 1, shape["n"], shape["long"]):
        raise ValueError(f"not a matrix with a row a class: {shape}")
    head = {"descr": "<f4", "fortran_order": False, "shape": (shape["n"], shape["long"])}

    def put(rows) -> None:
        import io

        import numpy as np
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(root)
        files.create_dir(at, recursive=True)
        start = io.BytesIO()
        np.lib.format.write_array_header_1_0(start, head)
        with files.open_output_stream(f"{at}/{name}") as out:
            out.write(start.getvalue())
            for row in rows:
                out.write(np.asarray(row["proto"], "<f4").tobytes())

    df.select("class_idx", "proto").coalesce(1).sortWithinPartitions("class_idx").foreachPartition(put)


def split_document(df: DataFrame, seed: int, fraction: float) -> DataFrame:
    """The lines of a pinned split: how many rows each side has, and a line a key of the "val" side."""
    n = df.agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v")).first()
    head = f'{{"seed": {json.dumps(seed)}, "val_fraction": {json.dumps(fraction)}, "n_train": {n["t"]}, "n_val": {n["v"]}, "val": ['
    return _document(head, df.where("split = 'val'").select("key").distinct(), "key", _quoted("key"), "]}")


def metrics_document(overall: DataFrame, per_class: DataFrame, label: str = "label") -> DataFrame:
    """The lines of a report: the overall rates, and a line a class."""
    head = overall.select(F.to_json(F.struct("*")).alias("j")).first()["j"]  # one row
    each = per_class.select(F.col(label).cast("string").alias("label"), F.to_json(F.struct("n", "top1", "top3")).alias("rates"))
    return _document(f'{{"overall": {head}, "per_species": {{', each, "label", F.concat(_quoted("label"), F.lit(": "), F.col("rates")), "}}")


def json_file(document: DataFrame, path: str) -> None:
    """One file with a document: a row with all of it, or lines in the order of (part, key)."""
    if "part" in document.columns:
        document = document.coalesce(1).sortWithinPartitions("part", "key").select("value")
    document.coalesce(1).write.mode("overwrite").text(path)


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def put_objects(df: DataFrame, root: str, key: str = "key", content: str = "content") -> None:
    """Writes each row's bytes under its key, from the executors, through a file system URI."""

    def put(rows) -> None:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(root)
        folder = None
        for row in rows:
            target = f"{at}/{row[key]}"
            if folder != target.rpartition("/")[0]:
                folder = target.rpartition("/")[0]
                files.create_dir(folder, recursive=True)
            with files.open_output_stream(target, metadata={"Content-Type": mimetypes.guess_type(row[key])[0] or "image/jpeg"}) as out:
                out.write(row[content])

    df.select(key, content).foreachPartition(put)


def sqlite_files(df: DataFrame, root: str, table: str, order: list[str], files: int) -> None:
    """A table as SQLite databases below ``root``, each with a range of the order's columns.

    Every task makes one in its own folder and then puts it in the shared one, so there is no server
    and no database that many write to; ``readers.sqlite_table`` reads them.
    """
    from lodestone.shipping import ship

    ship(df.sparkSession)
    make_folder(df.sparkSession, root)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    insert = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})'

    def put(batches):
        import shutil
        import sqlite3
        import tempfile
        from contextlib import closing

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(root)
        name, n = f"part-{TaskContext.get().partitionId():06d}.db", 0
        with tempfile.TemporaryDirectory() as own:
            with closing(sqlite3.connect(f"{own}/{name}")) as db:
                db.execute("PRAGMA journal_mode = OFF")  # a failed task begins anew
                db.execute("PRAGMA synchronous = OFF")
                db.execute(f'CREATE TABLE "{table}" ({columns})')
                for batch in batches:
                    db.executemany(insert, zip(*[c.to_pylist() for c in batch.columns]))
                    n += batch.num_rows
                db.commit()
            with open(f"{own}/{name}", "rb") as made, store.open_output_stream(f"{at}/{name}") as out:
                shutil.copyfileobj(made, out, 1 << 20)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    df.repartitionByRange(files, *order).mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row


def by_key(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Stores ``df`` below ``path`` in buckets of the key, sorted in each, as table ``name``; gives it back.

    Tables in as many buckets of the same key join, aggregate and de-duplicate by it without a
    shuffle, as often as they are read.
    """
    spark = df.sparkSession
    df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return spark.table(name)
