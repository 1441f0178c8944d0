"""Token ids as length-delimited binary records with an offset index (operator 8).

A record is

    uint64 length of the payload | uint32 masked check sum of these 8 bytes | payload | uint32 masked check sum of the payload

all little-endian; the check sum is CRC-32, rotated right by 15 bits plus a constant, so that a check sum stored inside a
payload does not check itself. The payload is one byte (bytes per id, plus 128 if there is a document id), the document id
as int64, and the ids. Ids take two bytes each where all of a document fit.

Files hold the documents in ascending order of id: file number first, then place in the file. The index is a Spark table
with one row per record, written after the records, so it names only files of tasks that succeeded; any row of it is
enough to read its record, in any order.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import fresh
from tidemark.llm.hashing import chunks
from tidemark.llm.pieces import PieceCache
from tidemark.session import scratch_path, stage

#: The id that ends every document.
END = 0
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_LABEL = struct.Struct("<Bq")
_HAS_ID = 128
INDEX = "file_no int, file string, record long, offset long, size long, doc_id long, start_in_file long, n_tokens long"
RECORD = "file_no int, start_in_file long, doc_id long, n_tokens long, ids binary, width int"


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def unframe(data: memoryview, at: int = 0) -> tuple[memoryview, int]:
    """Payload of the record at a place, and the place after it; ValueError if a check sum is wrong or bytes are missing."""
    if at + _HEAD.size > len(data):
        raise ValueError("record cut short")
    length, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"wrong check sum of a length at byte {at}")
    start, end = at + _HEAD.size, at + _HEAD.size + length
    if end + _TAIL.size > len(data):
        raise ValueError("record cut short")
    if masked(data[start:end]) != _TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"wrong check sum of a payload at byte {at}")
    return data[start:end], end + _TAIL.size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return _LABEL.pack(width | (0 if doc_id is None else _HAS_ID), doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    kind, doc_id = _LABEL.unpack_from(payload)
    return (doc_id if kind & _HAS_ID else None), np.frombuffer(payload[_LABEL.size :], dtype=f"<u{kind & ~_HAS_ID}")


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), os.path.abspath(uri))


_encoders: dict[str, tuple[PieceCache, Callable[[str], list[int]], tuple[str, ...]]] = {}


def _encoder(path: str) -> tuple[PieceCache, Callable[[str], list[int]], tuple[str, ...]]:
    """Pieces encoded by the tokenizers library, kept in this process; a whole text by the library; the added tokens.

    The pattern's matches do not influence each other.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = []
            for i in range(0, len(pieces), 10_000):  # what the library returns is large beside the ids
                found += [e.ids for e in tokenizer.encode_batch_fast(pieces[i : i + 10_000], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)

        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _encoders[path] = PieceCache(encode_pieces), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, added
    return _encoders[path]


def encode(path: str, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of all texts in one array, and where each text's ids start (one more at the end).

    Added tokens stand before the pattern: the library finds them in a text first, even without ``add_special_tokens``.
    A text that has one is therefore given to it whole, every other one by pieces.
    """
    cache, encode_whole, added = _encoder(path)
    whole = {i for i, t in enumerate(texts) if any(a in t for a in added)}
    ids, first = cache.encode(["" if i in whole else t for i, t in enumerate(texts)])
    if not whole:
        return ids, first
    own = [np.array(encode_whole(t), dtype=np.uint32) if i in whole else ids[first[i] : first[i + 1]] for i, t in enumerate(texts)]
    return np.concatenate(own), np.cumsum([0, *map(len, own)])


def write_records(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Encode every text, append ``END``, write the records below ``path`` and return the index (``INDEX``).

    One shuffle deals the texts out by ranges of the document id; each task then streams its range to one file. Documents
    without an id come first; rows that share an id stand together in the order of a hash of their texts. A null text is
    empty and has the end id alone. A retried task writes another file; the index knows the one that counted.
    """
    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        name = f"{path}/part-{number:06d}-{uuid.uuid4().hex}.rec"
        out, offset, record, start = None, 0, 0, 0
        for batch in batches:
            texts, ids_of = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in chunks(texts):
                if out is None:
                    system, place = _file_system(name)
                    system.create_dir(os.path.dirname(place), recursive=True)
                    out = system.open_output_stream(place)
                ids, first = encode(tokenizer, [t or "" for t in texts[a:b]])
                rows = []
                for i in range(b - a):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(END))
                    data = frame(pack(ids_of[a + i], own))
                    out.write(data)
                    rows.append((number, name, record, offset, len(data), ids_of[a + i], start, len(own)))
                    offset, record, start = offset + len(data), record + 1, start + len(own)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if out is not None:
            out.close()

    order = fresh("text_hash", docs)
    ranged = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
              .repartitionByRange("doc_id").withColumn(order, F.xxhash64("text")).sortWithinPartitions("doc_id", order))
    return stage(ranged.select("doc_id", "text").mapInArrow(run, INDEX), "record-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records named by rows of the index, in any order (``RECORD``), frames checked.

    Neighbouring records of a file are read at once; nothing is shuffled.
    """
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                end = at + 1
                while end < len(rows) and rows[end]["file"] == rows[at]["file"] and \
                        rows[end]["offset"] == rows[end - 1]["offset"] + rows[end - 1]["size"]:
                    end += 1
                system, place = _file_system(rows[at]["file"])
                with system.open_input_file(place) as source:
                    data = memoryview(source.read_at(sum(r["size"] for r in rows[at:end]), rows[at]["offset"]))
                place, out = 0, []
                for r in rows[at:end]:
                    payload, place = unframe(data, place)
                    doc_id, ids = unpack(payload)
                    out.append((r["file_no"], r["start_in_file"], doc_id, len(ids), ids.tobytes(), ids.dtype.itemsize))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                at = end

    return index.select("file_no", "file", "offset", "size", "start_in_file").mapInArrow(run, RECORD)


def digest(index: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    schema = "file_no int, start_in_file long, doc_id long, n_tokens long, ids_crc32 long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def check_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(np.frombuffer(x, dtype=f"<u{w}").astype("<u4"))
                    for x, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in arrow.names[:4]), pa.array(sums, pa.int64())], schema=arrow)

    # One row per file, so the running total over files is small whatever the number of documents.
    per_file = index.groupBy("file_no").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("file_no", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    return (read_records(index).mapInArrow(check_sums, schema).join(F.broadcast(bases), "file_no")
            .select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))


def write_and_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return digest(write_records(docs, scratch_path(docs.sparkSession, "records"), tokenizer))
