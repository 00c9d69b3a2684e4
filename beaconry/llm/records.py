"""Token ids in length-delimited binary record files with an offset index.

A record is: payload length (8 bytes), its masked checksum (4), the payload, its masked checksum (4);
all numbers little-endian. The checksum is CRC-32 as of zlib, rotated right by 15 bits plus a constant,
so that a checksum of data that hold checksums stays strong. A payload is one flag byte (1: the
document has no id, 2: ids of 32 bits), the id of the document (8 bytes) and its token ids.

Tasks write whole files under names of their own; only files that the committed index names belong
to the set, so a lost executor or a second attempt leaves nothing wrong behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import keyed_texts, slices
from beaconry.llm.tokens import default_path, encoder

#: Fixed value of the record format: what the rotation of a checksum adds.
MASK_DELTA = 0xA282EAD8
END_ID = 0
NO_ID, WIDE = 1, 2

INDEX_SCHEMA = "file_no long, file string, doc_id long, offset long, size long, n_tokens long"
TOKENS_SCHEMA = "file_no long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<Bq", NO_ID * (doc_id is None) | WIDE * wide, doc_id or 0) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frames(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record; a wrong checksum or a cut record raises."""
    while head := stream.read(12):
        size, crc = struct.unpack("<QI", head)
        if masked(head[:8]) != crc:
            raise ValueError("a record's length is damaged")
        body = stream.read(size + 4)
        payload = body[:size]
        if len(body) != size + 4 or masked(payload) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("a record's payload is damaged")
        flags, doc_id = struct.unpack_from("<Bq", payload)
        ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9)
        yield None if flags & NO_ID else doc_id, ids


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of every document (then id 0) below ``path`` in ascending doc_id order; return the index.

    ``path`` is a folder that all executors reach. Files follow one another by ``file_no`` and hold
    rising ids; rows of one id follow by hash of the text, then text, and a very frequent id is
    spread over several files. A null id comes first, a null text is empty (one end id), an empty table
    gives no file. Columns besides doc_id and text are not looked at.
    """
    tokenizer = tokenizer or default_path()
    ordered = (
        keyed_texts(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
        .select("doc_id", "text")
    )

    def write(batches):
        encode = encoder(tokenizer)
        wide, end = encode.dtype.itemsize == 4, np.asarray([END_ID], encode.dtype).tobytes()
        number = TaskContext.get().partitionId()
        name = f"{path.rstrip('/')}/files/{number:06d}-{uuid.uuid4().hex}.rec"
        store, local = fs.FileSystem.from_uri(name)
        stream, offset = None, 0
        for batch in slices(batches):
            if stream is None:
                store.create_dir(local.rpartition("/")[0], recursive=True)
                stream = store.open_output_stream(local)
            ids_of = batch.column(0).to_pylist()
            rows = []
            for doc_id, ids in zip(ids_of, encode.encode(batch.column(1).to_pylist())):
                record = frame(doc_id, ids + end, wide)
                stream.write(record)
                rows.append((offset, len(record), len(ids) // len(end) + 1))
                offset += len(record)
            n = len(rows)
            offsets, sizes, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array([name] * n), batch.column(0),
                 pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["file_no", "file", "doc_id", "offset", "size", "n_tokens"],
            )
        if stream is not None:
            stream.close()

    index = f"{path.rstrip('/')}/index"
    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(index)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read every file that the index names, from end to end, and check every record.

    One row per document: file_no, doc_id, start (ids in all records before it), n_tokens, ids_crc32
    and, if asked for, ids (bytes of 32-bit ids). Reading whole files keeps them sequential; for shuffled
    reads, take offset and size of a record from the index and pass that range to ``read_frames``.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path.rstrip('/')}/index")
    files = index.groupBy("file_no", "file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: a short list, also for very large inputs.
    files = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, local = fs.FileSystem.from_uri(row["file"])
                start, rows = row["base"], []
                with store.open_input_stream(local, buffer_size=1 << 20) as stream:
                    for doc_id, ids in read_frames(stream):
                        rows.append((doc_id, start, len(ids), crc_of_ids(ids), ids.astype("<u4").tobytes() if with_ids else None))
                        start += len(ids)
                        if len(rows) == 256:
                            yield _tokens(row["file_no"], rows)
                            rows = []
                if rows:
                    yield _tokens(row["file_no"], rows)

    return files.select("file_no", "file", "base").repartition(width, "file_no").mapInArrow(read, TOKENS_SCHEMA)


def _tokens(file_no: int, rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, crc, ids = zip(*rows)
    whole = [pa.array(x, pa.int64()) for x in ([file_no] * len(rows), doc, start, n, crc)]
    return pa.RecordBatch.from_arrays([*whole, pa.array(ids, pa.binary())], ["file_no", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])
