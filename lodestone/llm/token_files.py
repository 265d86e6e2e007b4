"""Token ids as flat binary files with 64-bit document offsets.

A dataset is a folder below the shared folder:

    shard-00007.ids   little-endian unsigned ids of the shard's documents, end to end: 16 bits each
                      where the vocabulary has at most 65,536 ids, else 32
    shard-00007.off   little-endian unsigned 64-bit offsets within the shard, one more than documents
    shard-00007.doc   the documents' ids as signed 64-bit integers, then a byte each: 1 if not null
    manifest.json     for each shard its documents, its tokens and its base, the prefix sum of the
                      tokens before it

Shards follow one another in ascending order of document id, so token ``base + off[i]`` of the
dataset is where document ``i`` of a shard starts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import new_folder, ship, text_or_empty
from lodestone.llm.tokenizing import encoder

END_ID = 0
_META = "shard int, docs long, tokens long, stem string, dtype string"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of ids gathered before they are written out.
_BLOCK = 8 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shard(root: str, tokenizer_path: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files, at = _fs(root)
        stem = f"{at}/shard-{shard:05d}"
        trial = f"{stem}.{uuid.uuid4().hex}"
        enc = encoder(tokenizer_path)
        width = int(enc.dtype[-1])
        end = int(end_id).to_bytes(width, "little")
        offsets, ids, valid = [0], [], []
        held: list[bytes] = []
        size = 0
        with files.open_output_stream(f"{trial}.ids") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    row = enc.encode(text.as_py()) + end
                    held.append(row)
                    size += len(row)
                    offsets.append(offsets[-1] + len(row) // width)
                    ids.append(doc_id or 0)
                    valid.append(doc_id is not None)
                    if size >= _BLOCK:
                        out.write(b"".join(held))
                        held, size = [], 0
            out.write(b"".join(held))
        if not ids:
            files.delete_file(f"{trial}.ids")
            return
        for kind, data in (("off", np.array(offsets, "<u8").tobytes()), ("doc", np.array(ids, "<i8").tobytes() + np.array(valid, "u1").tobytes())):
            with files.open_output_stream(f"{trial}.{kind}") as out:
                out.write(data)
        for kind in ("ids", "off", "doc"):  # a repeated attempt replaces equal bytes
            files.move(f"{trial}.{kind}", f"{stem}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([offsets[-1]], pa.int64()), "stem": [f"shard-{shard:05d}"], "dtype": [enc.dtype]})

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, root: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every whole text, appends ``end_id``, writes the dataset and returns its folder.

    Documents are dealt by ranges of their id, so shard order is id order, and each task streams
    its shard to disk: it holds a batch of texts, a block of ids and 17 bytes a document.  Only one
    row a shard reaches the driver, which turns the token counts into bases by a prefix sum.  A
    shard is written under another name and renamed, so lost or repeated tasks leave whole files.

    Null texts count as empty (the end id alone).  Null ids come first.  Rows with equal ids are
    ordered by text.  Other columns are ignored; an empty table gives a manifest without shards.
    """
    spark = docs.sparkSession
    ship(spark)
    root = root or new_folder(spark, "token-files")
    files, at = _fs(root)
    files.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the beginnings of texts deal rows that share an id (or have none) to several shards
    dealt = rows.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    shards = sorted(tuple(r) for r in dealt.mapInArrow(_write_shard(root, tokenizer_path, end_id), _META).collect())
    bases = [0, *accumulate(s[2] for s in shards)]
    manifest = {"dtype": shards[0][4] if shards else None, "end_id": end_id, "tokens": bases[-1], "shards": [{"stem": s[3], "docs": s[1], "tokens": s[2], "base": b} for s, b in zip(shards, bases)]}
    with files.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return root


def read_manifest(root: str) -> dict:
    files, at = _fs(root)
    with files.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """One shard: ids memory-mapped on a local or mounted disk, else read by range."""

    def __init__(self, root: str, stem: str, dtype: str):
        from pyarrow import fs

        self.files, at = _fs(root)
        self.path, self.dtype = f"{at}/{stem}", np.dtype(dtype)
        self.offsets = np.frombuffer(self._all("off"), "<u8").astype(np.int64)
        n = len(self.offsets) - 1
        raw = self._all("doc")
        self.doc_ids = np.frombuffer(raw[: 8 * n], "<i8")
        self.valid = np.frombuffer(raw[8 * n :], "u1").astype(bool)
        local = isinstance(self.files, fs.LocalFileSystem)
        self.map = np.memmap(f"{self.path}.ids", dtype=self.dtype, mode="r") if local else None
        #: Elsewhere the file is opened once and read by range.
        self.file = None if local else self.files.open_input_file(f"{self.path}.ids")

    def _all(self, kind: str) -> bytes:
        with self.files.open_input_stream(f"{self.path}.{kind}") as f:
            return f.read()

    def ids(self, i: int) -> np.ndarray:
        return self._range(int(self.offsets[i]), int(self.offsets[i + 1]))

    def _range(self, a: int, b: int) -> np.ndarray:
        if self.map is not None:
            return self.map[a:b]
        return np.frombuffer(self.file.read_at(self.dtype.itemsize * (b - a), self.dtype.itemsize * a), self.dtype)

    def runs(self, most: int = _BLOCK):
        """(first document, ids of each) for runs of documents of about ``most`` bytes, a read each."""
        a, n = 0, len(self.offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + most // self.dtype.itemsize, side="right")) - 1)
            begin = int(self.offsets[a])
            block = self._range(begin, int(self.offsets[b]))
            yield a, [block[int(self.offsets[i]) - begin : int(self.offsets[i + 1]) - begin] for i in range(a, b)]
            a = b

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _digest_shards(root: str, dtype: str):
    def read(batches):
        for batch in batches:
            for stem, base in zip(batch.column("stem").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(root, stem, dtype)
                for a, ids in shard.runs():
                    b = a + len(ids)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(shard.doc_ids[a:b], pa.int64(), mask=~shard.valid[a:b]),
                            "start": pa.array(base + shard.offsets[a:b], pa.int64()),
                            "n_tokens": pa.array(np.diff(shard.offsets[a : b + 1]), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                        }
                    )
                shard.close()

    return read


def token_file_digests(spark: SparkSession, root: str) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    manifest = read_manifest(root)
    shards = [(s["stem"], s["base"]) for s in manifest["shards"]]
    if not shards:
        return spark.createDataFrame([], _READ)
    return spark.createDataFrame(shards, "stem string, base long").repartition(len(shards)).mapInArrow(_digest_shards(root, manifest["dtype"]), _READ)
