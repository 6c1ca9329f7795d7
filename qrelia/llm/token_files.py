"""Token ids of documents in seekable zstandard files.

A file is a run of independent zstandard frames, then a skippable frame with the document index, then the trailing
seek table of the public seekable format (a skippable frame of compressed size, decompressed size and checksum for each frame,
closed by number of frames, descriptor and magic number). A document starts a new frame and takes as many frames as its
ids need; no frame holds more than one document, so a reader decompresses the frames of the documents it wants and no
other byte. Ids are little-endian unsigned 32-bit numbers. A checksum is the low half of the XXH64 of a frame's ids, as that format says.

Spark range-partitions the documents by id; every task writes one file, streaming, into a folder that all executors
share. A file's name is new for every attempt, and only names in the written manifest count, so a lost executor leaves at most an
unused file. The start of a file is the sum of the ids of the files before it.

Order: by document id, nulls first; rows of equal id by a hash of their text. Null texts are empty and give the end id alone. Repeated rows
are written again. An empty table gives no file and an empty result. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qrelia.llm.tokens import encoded
from qrelia.session import durable, scratch_dir

END_ID = 1
FRAME_IDS = 1 << 18
LEVEL = 3
READ_DOCUMENTS = 4_096  # neighbours that one task reads
READ_IDS = 4 << 20  # read by one task, on average

# Fixed values of the public seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUM = 0x80
INDEX = 0x184D2A5D  # a skippable frame of ours: the documents
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frames", "<u4"), ("n_ids", "<u8")])
_MOST_FRAMES = (1 << 32) // _DOCUMENT.itemsize - 1  # a skippable frame's size has 32 bits


class CorruptFile(ValueError):
    """A file that is cut short, or a frame whose ids do not have the stored checksum."""


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(folder)


def open_token_file(folder: str, name: str):
    system, base = file_system(folder)
    return system.open_input_file(f"{base}/{name}")


class TokenWriter:
    """Writes one file to a binary stream; only the index is kept in memory."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.out, self.frame_ids = out, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries, self.documents = bytearray(), bytearray()
        self.n_frames = self.n_documents = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frames = 0
        for first in range(0, max(len(ids), 1), self.frame_ids):
            plain = ids[first : first + self.frame_ids].astype("<u4").tobytes()
            packed = self.compressor.compress(plain)
            self.out.write(packed)
            self.entries += struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
            frames += 1
        self.documents += struct.pack("<qBIQ", doc_id or 0, doc_id is not None, frames, len(ids))
        self.n_frames += frames
        self.n_documents += 1
        self.n_ids += len(ids)

    def full(self) -> bool:
        return self.n_frames >= _MOST_FRAMES or self.n_documents >= _MOST_FRAMES

    def close(self) -> None:
        self.out.write(struct.pack("<II", INDEX, len(self.documents)))
        self.out.write(self.documents)
        self.out.write(struct.pack("<II", SKIPPABLE, len(self.entries) + 9))
        self.out.write(self.entries)
        self.out.write(struct.pack("<IBI", self.n_frames, HAS_CHECKSUM, SEEKABLE))


class TokenFile:
    """Reads documents of one file; ``frames_read`` counts what was decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise CorruptFile("no seek table")
        begin = size - 9 - frames * _ENTRY.itemsize - 8
        self.entries = np.frombuffer(self._at(begin + 8, frames * _ENTRY.itemsize), _ENTRY)
        self.places = np.r_[0, np.cumsum(self.entries["packed"], dtype=np.int64)]
        magic, length = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if magic != INDEX or self.places[-1] + 8 + length != begin:
            raise CorruptFile("no document index")
        self.documents = np.frombuffer(self._at(int(self.places[-1]) + 8, length), _DOCUMENT)
        self.first_frame = np.r_[0, np.cumsum(self.documents["frames"], dtype=np.int64)]
        self.first_id = np.r_[0, np.cumsum(self.documents["n_ids"], dtype=np.int64)]
        self.decompressor = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def _at(self, place: int, n: int) -> bytes:
        if place < 0:
            raise CorruptFile("file is cut short")
        self.source.seek(place)
        found = self.source.read(n)
        if len(found) != n:
            raise CorruptFile("file is cut short")
        return found

    def doc_id(self, i: int) -> int | None:
        return int(self.documents["doc_id"][i]) if self.documents["known"][i] else None

    def frames(self, i: int) -> Iterator[bytes]:
        """The checked bytes of the frames of document ``i``."""
        for f in range(self.first_frame[i], self.first_frame[i + 1]):
            entry = self.entries[f]
            plain = self.decompressor.decompress(self._at(int(self.places[f]), int(entry["packed"])), max_output_size=int(entry["plain"]))
            if len(plain) != entry["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["checksum"]:
                raise CorruptFile(f"checksum of frame {f}")
            self.frames_read += 1
            yield plain

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.frames(i)), "<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write all documents below ``folder``; the manifest: file, shard, n_documents, n_ids, start, in order of ``shard``.

    ``shard`` orders the files; ``start`` is the number of ids in the files before.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # equal rows may stand in any order: their number in the table only spreads them
    keys = plain.withColumns({"h": F.xxhash64("text"), "copy": F.monotonically_increasing_id()})
    ordered = keys.repartitionByRange("doc_id", "h", "copy").sortWithinPartitions("doc_id", "h", "copy")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("task"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        writer, name, shard = None, None, 0

        def close() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            row = {"shard": shard, "file": name, "n_documents": writer.n_documents, "n_ids": writer.n_ids}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            for first, ids, at in encoded(batch.column(1), tokenizer):
                for i in range(len(at) - 1):
                    if writer is not None and writer.full():
                        yield close()
                        writer, shard = None, shard + 1
                    if writer is None:
                        shard = shard or batch.column(2)[0].as_py() << 32
                        name = f"{uuid.uuid4().hex}.zst"
                        writer = TokenWriter(system.open_output_stream(f"{base}/{name}", compression=None), frame_ids)
                    writer.add(names[first + i].as_py(), np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
        if writer is not None:
            yield close()

    written = durable(ordered.mapInArrow(write, "shard long, file string, n_documents long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def document_index(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, file, number, start, n_tokens of every document; reads the trailing tables of the files only."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_token_file(folder, file) as source:
                    tokens = TokenFile(source)
                found = tokens.documents
                n = len(found)
                columns = [
                    pa.array(found["doc_id"].astype(np.int64), mask=found["known"] == 0),
                    pa.array([file] * n, pa.string()),
                    pa.array(np.arange(n)),
                    pa.array(start + tokens.first_id[:-1]),
                    pa.array(found["n_ids"].astype(np.int64)),
                ]
                whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "number", "start", "n_tokens"])
                yield from (whole.slice(k, READ_DOCUMENTS) for k in range(0, n, READ_DOCUMENTS))

    types = "doc_id long, file string, number long, start long, n_tokens long"
    return manifest.select("file", "start").repartition("file").mapInArrow(look, types)


def read_documents(index: DataFrame, folder: str, with_ids: bool = False, tasks: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of the documents in ``index``.

    ``index`` is ``document_index`` or any rows of it, say those of wanted ids: only their frames are decompressed.
    Spark cannot see from the short rows of the index how much there is to read, so ``tasks`` can say into how many it is dealt.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    types = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    kinds = pa.schema([(n, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n in names])
    stretch = (F.col("number") / READ_DOCUMENTS).cast("long")
    rows = index.select("doc_id", "start", "file", "number", stretch.alias("stretch"))
    keys = [c for c in (tasks, "file", "stretch") if c is not None]
    ordered = rows.repartition(*keys).sortWithinPartitions("file", "number")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, tokens = None, None, None
        try:
            for batch in batches:
                out, size = [], 0
                for doc_id, start, file, number in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if file != opened:
                        if source is not None:
                            source.close()
                        source = open_token_file(folder, file)
                        opened, tokens = file, TokenFile(source)
                    crc, kept = 0, []
                    for plain in tokens.frames(number):
                        crc = zlib.crc32(plain, crc)
                        if with_ids:
                            kept.append(plain)
                    row = {"doc_id": doc_id, "start": start, "n_tokens": int(tokens.documents["n_ids"][number]), "ids_crc32": crc}
                    if with_ids:
                        row["ids"] = np.frombuffer(b"".join(kept), "<u4").astype(np.int64)
                        size += len(row["ids"])
                    out.append(row)
                    if size > FRAME_IDS:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)
        finally:
            if source is not None:
                source.close()

    return ordered.mapInArrow(read, types)


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID, **names) -> DataFrame:
    """Write ``docs`` to token files in the session's shared folder and read every document back."""
    folder = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, tokenizer, end_id, **names)
    n_ids = manifest.agg(F.sum("n_ids")).first()[0] or 0
    return read_documents(document_index(manifest, folder), folder, tasks=n_ids // READ_IDS + 1)
