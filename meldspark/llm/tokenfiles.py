"""Documents as files of token ids, in Simple-8b blocks, written and read in order of their ids.

Documents are dealt into ranges of their ids; a task tokenises its range in order and writes one
file, block by block. A file holds: a mark, the words of its blocks, the place of each block
(words before it, unsigned 64 bits, and the end), and of each document its id (signed 64 bits),
whether it has one (a byte) and its number of ids (unsigned 64 bits); then six unsigned 64-bit
numbers, which are the numbers of documents, ids and blocks, the ids of a block, the byte where the
places begin, and the mark again. All numbers are little-endian. The manifest has a row per file, in
order: only files that it names count, so what a lost or repeated task has left is never read.

Tasks reach the folder by its URI through Arrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .segments import memo

MARK = int.from_bytes(b"TOKENS8B", "little")
#: Bytes of text that a file is made of, about.
FILE_BYTES = 64 << 20
#: Texts that are tokenised at once.
TOGETHER = 4096
#: Ids that are coded, or decoded, at once.
AT_ONCE = 1 << 20

_MANIFEST = "part long, path string, n_docs long, n_ids long, n_blocks long, n_bytes long"


class TokenFile:
    """Writes one file; the ids of a document come as little-endian unsigned 32-bit numbers."""

    def __init__(self, out) -> None:
        self.out = out
        self.bytes = 0
        self.held: list[bytes] = []
        self.waiting = 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.sizes: list[np.ndarray] = []
        self._put(np.array([MARK], "<u8"))

    def _put(self, a: np.ndarray) -> None:
        raw = a.tobytes()
        self.out.write(raw)
        self.bytes += len(raw)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= AT_ONCE:
            self._code(self.waiting // simple8b.BLOCK * simple8b.BLOCK)

    def _code(self, n: int) -> None:
        raw = b"".join(self.held)
        words, sizes = simple8b.encode(np.frombuffer(raw, "<u4", n))
        self._put(words.astype("<u8"))
        self.sizes.append(sizes)
        self.held, self.waiting = [raw[4 * n :]], self.waiting - n

    def close(self) -> tuple[int, int, int, int]:
        """(documents, ids, blocks, bytes)."""
        if self.waiting:
            self._code(self.waiting)
        sizes = np.concatenate([np.zeros(1, np.int64), *self.sizes])
        places, n = self.bytes, sum(self.counts)
        self._put(np.cumsum(sizes).astype("<u8"))
        self._put(np.array([d or 0 for d in self.docs], "<i8"))
        self._put(np.array([d is not None for d in self.docs], "u1"))
        self._put(np.array(self.counts, "<u8"))
        self._put(np.array([len(self.docs), n, len(sizes) - 1, simple8b.BLOCK, places, MARK], "<u8"))
        self.out.close()
        return len(self.docs), n, len(sizes) - 1, self.bytes


def read_file(source) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Documents of an open file in order, some at a time: their ids, and their token ids as
    little-endian unsigned 32-bit numbers. No more than ``AT_ONCE`` ids are decoded at once."""
    end = source.size()
    docs, n, blocks, block, places, mark = map(int, np.frombuffer(source.read_at(48, end - 48), "<u8"))
    if mark != MARK:
        raise ValueError("no file of token ids")
    at = places + 8 * (blocks + 1)
    place = np.frombuffer(source.read_at(8 * (blocks + 1), places), "<u8").astype(np.int64)
    ids = np.frombuffer(source.read_at(8 * docs, at), "<i8").tolist()
    has = np.frombuffer(source.read_at(docs, at + 8 * docs), "u1").tolist()
    counts = np.frombuffer(source.read_at(8 * docs, at + 9 * docs), "<u8").astype(np.int64).tolist()
    ids = [i if h else None for i, h in zip(ids, has, strict=True)]
    held, done, step = [], 0, max(1, AT_ONCE // block)
    have = 0
    for lo in range(0, blocks, step):
        hi = min(blocks, lo + step)
        words = np.frombuffer(source.read_at(8 * int(place[hi] - place[lo]), 8 + 8 * int(place[lo])), "<u8")
        held.append(simple8b.decode(words, np.diff(place[lo : hi + 1]), min(n, hi * block) - lo * block, block).astype("<u4").tobytes())
        have += len(held[-1]) // 4
        if hi < blocks and have < counts[done]:
            continue
        raw, first, used = b"".join(held), done, 0
        out = []
        while done < docs and counts[done] <= have:
            out.append(raw[used : used + 4 * counts[done]])
            used += 4 * counts[done]
            have -= counts[done]
            done += 1
        held = [raw[used:]]
        yield ids[first:done], out
    if not blocks and docs:
        yield ids, [b""] * docs


def _write(folder: str, tokenizer: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop = memo(tokenizer), b"" if end is None else np.array([end], "<u4").tobytes()
        files, root = arrow_fs.FileSystem.from_uri(folder)
        part, file, path = TaskContext.get().partitionId(), None, ""
        for b in batches:
            if file is None and b.num_rows:
                path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.s8b"
                file = TokenFile(files.open_output_stream(path))
            for lo in range(0, b.num_rows, TOGETHER):
                ids, counts = known.encode(b.column(1).slice(lo, TOGETHER).fill_null(""))
                raw, at = ids.astype("<u4").tobytes(), 0
                for doc, n in zip(b.column(0).slice(lo, TOGETHER).to_pylist(), counts.tolist(), strict=True):
                    file.add(doc, raw[at : at + 4 * n] + stop)
                    at += 4 * n
        if file is not None:
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("part", "path", "n_docs", "n_ids", "n_blocks", "n_bytes"), (part, path, *file.close()), strict=True)})

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token ids of all rows of ``docs``, each with the id ``end`` after it, into files of
    ``folder`` (a URI), and return the manifest, which is written there too: part, path, n_docs,
    n_ids, n_blocks, n_bytes.

    The order is that of doc_id, null first; rows of one id stand in order of their texts' hashes
    and lengths, equal rows in any. Null and empty texts have the end alone. Special tokens in a
    text are read as the library reads them. An empty table gives an empty manifest. Texts are
    shuffled once, in ranges of about ``FILE_BYTES``, whatever the number of rows of one id.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("number"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    order = ["doc_id", "h", "size", "number"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // FILE_BYTES)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_write(folder, tokenizer, end), _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = arrow_fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_file(path) as source:
                    for docs, ids in read_file(source):
                        sizes = np.array([len(x) // 4 for x in ids], np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of ``write_tokens``' files: doc_id, start (ids of all documents before it), ids
    (little-endian unsigned 32-bit numbers). A task reads one file, some blocks at a time."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return files.repartition(max(1, manifest.count())).mapInArrow(_read(folder), "doc_id long, start long, ids binary")


def token_digests(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 2) -> DataFrame:
    """``docs`` written to ``folder`` and read back from there: doc_id, start, n_tokens, ids_crc32."""
    write_tokens(docs, folder, tokenizer, end)
    ids = read_tokens(docs.sparkSession, folder)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
