import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from helpers import awkward_rows, frame
from pyarrow import fs
from tokenizers import Tokenizer

from qrelia.llm import token_files as tf

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class Source:
    """The part of a file that a reader uses, noting what was read."""

    def __init__(self, data):
        self.data, self.at, self.read_at = data, 0, []

    def size(self):
        return len(self.data)

    def seek(self, place):
        self.at = place

    def read(self, n):
        self.read_at.append((self.at, n))
        return self.data[self.at : self.at + n]


def written(documents, frame_ids=tf.FRAME_IDS):
    out = io.BytesIO()
    writer = tf.TokenWriter(out, frame_ids)
    for d, ids in documents:
        writer.add(d, np.array(ids, np.uint32))
    writer.close()
    return out.getvalue()


DOCUMENTS = [(None, [1]), (3, list(range(1000))), (3, [5, 1]), (9, []), (10, [4_000_000_000, 1]), (11, list(range(2050)))]


def test_round_trip_and_frames_read():
    tokens = tf.TokenFile(Source(written(DOCUMENTS, frame_ids=256)))
    assert [tokens.doc_id(i) for i in range(6)] == [d for d, _ in DOCUMENTS]
    assert tokens.frames_read == 0
    assert tokens.ids(4).tolist() == [4_000_000_000, 1] and tokens.frames_read == 1
    assert tokens.ids(5).tolist() == list(range(2050)) and tokens.frames_read == 1 + 9
    assert [tokens.ids(i).tolist() for i in range(6)] == [ids for _, ids in DOCUMENTS]


def test_only_wanted_bytes_are_read():
    source = Source(written(DOCUMENTS, frame_ids=256))
    tokens = tf.TokenFile(source)
    source.read_at.clear()
    tokens.ids(2)
    (place, n), = source.read_at
    assert place == tokens.places[tokens.first_frame[2]] and n == tokens.entries["packed"][tokens.first_frame[2]]


def test_a_plain_decoder_reads_the_whole_file():
    data = written(DOCUMENTS, frame_ids=256)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4").tolist() == [i for _, ids in DOCUMENTS for i in ids]
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")


def test_damaged_files_are_refused():
    data = bytearray(written(DOCUMENTS, frame_ids=256))
    tokens = tf.TokenFile(Source(bytes(data)))
    place = len(data) - 9 - 12 * len(tokens.entries) + 12 * int(tokens.first_frame[1]) + 8
    data[place] ^= 1  # the checksum of a frame of document 1
    broken = tf.TokenFile(Source(bytes(data)))
    assert broken.ids(2).tolist() == [5, 1]
    with pytest.raises(tf.CorruptFile):
        broken.ids(1)
    with pytest.raises(tf.CorruptFile):
        tf.TokenFile(Source(bytes(data[:-1])))
    with pytest.raises(tf.CorruptFile):
        tf.TokenFile(Source(bytes(data[40:])))
    data = bytearray(written([(1, [7] * 50)]))
    data[len(data) // 8] ^= 0xFF
    with pytest.raises((tf.CorruptFile, zstandard.ZstdError)):
        tf.TokenFile(Source(bytes(data))).ids(0)


def encode(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


def brute(rows):
    """doc_id, n_tokens, crc of every document, by ascending id; starts follow from these."""
    found = [(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in rows for ids in [encode(t)]]
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def check(got, rows):
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == brute(rows)


def test_files_against_the_tokenizer(spark):
    rows = awkward_rows() + [(50, "<|endoftext|> it's 3rd Ünḯ 　x y"), (12, "word"), (-4, "first")]
    check(tf.token_file_digests(frame(spark, rows).repartition(6), TOKENIZER).collect(), rows)


def test_many_equal_rows_and_frames(spark, tmp_path):
    rows = [(None, "same text")] * 300 + [(5, "")] * 50 + [(6, "long " * 400)]
    folder = tmp_path.as_uri()
    manifest = tf.write_token_files(frame(spark, rows), folder, TOKENIZER, frame_ids=64)
    assert manifest.agg({"n_documents": "sum"}).first()[0] == 351
    index = tf.document_index(manifest, folder)
    check(tf.read_documents(index, folder).collect(), rows)


def test_wanted_documents_and_unlisted_files(spark, tmp_path):
    rows = [(d, f"text number {d}") for d in range(500)]
    manifest = tf.write_token_files(frame(spark, rows), str(tmp_path), TOKENIZER)
    (tmp_path / "left-by-a-lost-task.zst").write_bytes(b"half a frame")
    index = tf.document_index(manifest, str(tmp_path))
    got = tf.read_documents(index.where("doc_id IN (3, 77, 1000)"), str(tmp_path), with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {d: encode(f"text number {d}") for d in (3, 77)}


def test_no_documents(spark, tmp_path):
    assert tf.token_file_digests(frame(spark, []), TOKENIZER).collect() == []


def test_folders():
    assert tf.file_system("file:/a/b")[1] == tf.file_system("/a/b")[1] == "/a/b"
    assert isinstance(tf.file_system("file:///a")[0], fs.LocalFileSystem)
