"""Token ids of documents in files of length-delimited records, with a separate offset index.

A data file is a row of frames: length of the payload (8 bytes), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4), all little-endian. A payload is the document's id (8), a flag byte (1: the id is null) and
the ids as unsigned integers, 2 bytes each for vocabularies up to 65,536 ids and 4 beyond (flag 2). The checksum is
crc32, rotated and shifted by a constant, so that a checksum of checksummed data is not trivial. An index file has 28
bytes for each record: document id, offset, frame length, number of ids. `manifest` lists the finished files.

Documents are range-partitioned by id and sorted; the task of a partition writes its files in order. A file is written
under a name of the attempt and renamed when complete; a repeated task writes the same bytes under the same names, and
the manifest is written when all tasks are done, so a lost executor leaves no half-read file. The shared folder may be
of any kind that pyarrow.fs opens by URI (file, hdfs, s3, gs, abfs). Readers take whole files, at most `file_bytes` and
one document large, or single records by the index.

The tokenizer is the library's. Texts are cut into its pre-tokens over whole columns (`pretokens`), equal ones are encoded
once for each worker (a bounded memory of pre-tokens), and a text's ids are taken from theirs.

Cases: a null text counts as empty and still gets its end id; null ids come first; repeated rows are separate records,
ordered by text; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.lineage import scratch_path, stored
from plantlens.llm.parts import parts
from plantlens.llm.pretokens import dictionary, pre_tokenizer
from plantlens.llm.sized import small_or_shuffled

END_ID = 2
FILE_BYTES = 32 << 20
# Pre-tokens a worker remembers with their ids, some 200 bytes each, and how many are encoded at once.
MOST_PIECES = 600_000
_ENCODED_AT_ONCE = 20_000
_MASK = 0xA282EAD8
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n", "<u4")])
_encoders: dict[str, Encoder] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


class Encoder:
    """Whole-text ids as bytes, equal to the library's."""

    def __init__(self, path: str) -> None:
        self.cutter = pre_tokenizer(path)
        self.kind = np.dtype("<u2") if self.cutter.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; each is encoded when it is met first."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > MOST_PIECES:
            self.known.clear()
            new = pieces
        kind = self.kind.char
        for at in range(0, len(new), _ENCODED_AT_ONCE):
            some = new[at:at + _ENCODED_AT_ONCE]
            self.known.update(zip(some, (array(kind, e.ids).tobytes() for e in self.cutter.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        return list(map(self.known.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text: those of a part's distinct pre-tokens, taken in the order of the text."""
        width = self.kind.itemsize
        for first, last, edges, data in parts(texts):
            starts, before = self.cutter.cut(data, edges)
            values, index = dictionary(data, starts)
            found = self._ids(values.to_pylist())
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.frombuffer(b"".join(found), self.kind)
            # place of every id of the part among the ids of the distinct pre-tokens
            each = sizes[index]
            ahead = np.concatenate([[0], np.cumsum(each)])
            taken = ids[np.arange(ahead[-1]) + np.repeat(offsets[index] - ahead[:-1], each)]
            ends = ahead[before]
            for k in range(last - first):
                yield taken[ends[k]:ends[k + 1]].tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * wide) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a file's bytes; an error if a checksum does not fit."""
    at = 0
    while at < len(data):
        length, check = struct.unpack_from("<QI", data, at)
        if masked(data[at:at + 8]) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12:at + 12 + length]
        if masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, flags = struct.unpack_from("<qB", payload)
        yield None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)
        at += 16 + length


class _Files:
    """The files of one task."""

    def __init__(self, folder: str, file_bytes: int) -> None:
        self.fs, self.root = _filesystem(folder)
        self.task, self.attempt, self.most = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), file_bytes
        self.number, self.done, self.out = 0, [], None

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        if self.out is None:
            self.name = f"part-{self.task:06d}-{self.number:05d}"
            self.size, self.ids, self.index = 0, 0, []
            self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.attempt}")
        data = frame(doc_id, ids, width == 4)
        self.out.write(data)
        self.index.append((doc_id or 0, self.size, len(data), len(ids) // width))
        self.size += len(data)
        self.ids += len(ids) // width
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.attempt}.idx") as out:
            out.write(np.array(self.index, _INDEX).tobytes())
        for end, final in ((".idx", ".idx"), ("", ".rec")):
            self.fs.move(f"{self.root}/.{self.name}.{self.attempt}{end}", f"{self.root}/{self.name}{final}")
        self.done.append((self.name, len(self.index), self.ids, self.size))
        self.number, self.out = self.number + 1, None


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all documents and return the manifest: file, records, ids, bytes and the ids before the file."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, enc = _Files(folder, file_bytes), encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text"))):
                    files.add(doc_id, ids + end, enc.kind.itemsize)
        files.close()
        names, records, ids, size = zip(*files.done) if files.done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(ids, pa.int64()),
                                          pa.array(size, pa.int64())], names=["file", "records", "ids", "bytes"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ordered.mapInArrow(run, "file string, records bigint, ids bigint, bytes bigint"), "written")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            at = batch.column("ids_before")[k].as_py()
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, ids in unframe(memoryview(batch.column("content")[k].as_buffer())):
                for column, v in zip(rows, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                    column.append(v)
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, from the files of the manifest."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "ids_before")
    content = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rec").load(folder)
               .select(F.regexp_extract("path", r"(part-[0-9]+-[0-9]+)\.rec$", 1).alias("file"), "content"))
    return content.join(small_or_shuffled(manifest), "file").mapInArrow(
        _read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc_id, offset, length and n of every record, from the index files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column("content")[k].as_buffer(), _INDEX)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("file")[k].as_py()] * len(x), pa.string()),
                     *(pa.array(x[c].astype(np.int64)) for c in _INDEX.names)], names=["file", *_INDEX.names])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.idx").load(folder)
             .select(F.regexp_extract("path", r"(part-[0-9]+-[0-9]+)\.idx$", 1).alias("file"), "content"))
    return files.mapInArrow(run, "file string, doc_id bigint, offset bigint, length bigint, n bigint")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Records by rows of the index, in any order: doc_id and ids. A shuffled read passes the index ordered by a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            found: list[tuple[int | None, np.ndarray]] = []
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['file']}.rec") as f:
                    found += unframe(memoryview(f.read_at(r["length"], r["offset"])))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()),
                                              pa.array([x.astype(np.int64) for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return wanted.select("file", "offset", "length").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents to a new folder under the shared one and read the files back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    write_records(docs, tokenizer, folder, end_id)
    return read_digest(spark, folder)
