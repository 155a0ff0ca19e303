"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches
from .encoding import encode, encoder

MANIFEST = "part int, name string, width int, n_docs long, n_null long, n_tokens long"


class Folder:
    """A folder in the shared store: the file system itself for local paths, else pyarrow's file system for the scheme."""

    def __init__(self, uri: str):
        scheme, _, rest = uri.partition("://")
        self.fs = None
        if not rest:
            self.path = uri.removeprefix("file:")
        elif scheme == "file":
            self.path = rest
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def make(self) -> None:
        if self.fs:
            self.fs.create_dir(self.path, recursive=True)
        else:
            import os

            os.makedirs(self.path, exist_ok=True)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.path}/{name}") if self.fs else open(f"{self.path}/{name}", "wb")

    def map(self, name: str, kind: str) -> np.ndarray:
        """The file as an array, memory-mapped where the store is a file system."""
        if self.fs:
            with self.fs.open_input_file(f"{self.path}/{name}") as f:
                return np.frombuffer(f.read(), kind)
        try:
            return np.memmap(f"{self.path}/{name}", kind, "r")
        except ValueError:  # an empty file can't be mapped
            return np.empty(0, kind)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending doc_id order; returns the manifest.

    A partition makes three files: ids (unsigned integers of 2 bytes if the vocabulary allows it, else 4), offsets
    (64-bit, one more than documents, within the part) and doc_ids. Documents are dealt by range of doc_id, ties by
    hash and text. Attempts write under names of their own; the manifest, one row a part, names those that count.
    Null doc_ids come first, null texts are empty; the base of a part is the sum of the parts before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, part, name = Folder(folder), TaskContext.get().partitionId(), uuid.uuid4().hex
        width = 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        out.make()
        docs = nulls = at = 0
        with out.write(f"{name}.ids") as ids, out.write(f"{name}.off") as off, out.write(f"{name}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for f in frames:
                ends = []
                for x in encode(f["text"], tokenizer):
                    ids.write(np.append(x, end_id).astype(f"<u{width}").tobytes())
                    at += len(x) + 1
                    ends.append(at)
                off.write(np.array(ends, "<u8").tobytes())
                nulls += int(f["doc_id"].isna().sum())
                doc.write(f["doc_id"].fillna(0).to_numpy("<i8").tobytes())
                docs += len(f)
        if docs:
            yield pd.DataFrame({"part": [part], "name": [name], "width": [width], "n_docs": [docs], "n_null": [nulls], "n_tokens": [at]})

    return cut(rows.drop("_h").mapInPandas(put, MANIFEST))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """The files back as rows: doc_id, start (of the whole corpus), n_tokens, ids_crc32 (of 4-byte little-endian ids)."""
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src = Folder(folder)
        for f in frames:
            for m in f.itertuples():
                ids, off, doc = src.map(f"{m.name}.ids", f"<u{m.width}"), src.map(f"{m.name}.off", "<u8").astype(np.int64), src.map(f"{m.name}.doc", "<i8")
                for a in range(0, m.n_docs, 5000):
                    b = min(a + 5000, m.n_docs)
                    crc = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    name = pd.Series(doc[a:b].astype(np.int64)).astype("Int64")
                    name[np.arange(a, b) < m.n_null] = pd.NA
                    yield pd.DataFrame({"doc_id": name, "start": off[a:b] + m.base, "n_tokens": np.diff(off[a : b + 1]), "ids_crc32": crc})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(parts, "part").mapInPandas(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder in the shared store and read them back."""
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id=end_id), folder)
