"""Token ids as length-delimited binary records, written and read by Spark tasks.

A part file is a sequence of frames::

    length      unsigned 64 bits, bytes of the payload
    check       unsigned 32 bits, masked CRC-32 of the eight length bytes
    payload     one byte (1: has an id), doc_id as signed 64 bits, then the ids
    check       unsigned 32 bits, masked CRC-32 of the payload

All numbers are little-endian. Ids take 16 bits where the vocabulary fits, else 32. A masked
check is the CRC turned right by 15 bits plus a constant, so that a file of checked records
can itself be checked. Beside each part lies its index, two signed 64-bit numbers a record:
where the frame starts, and how many ids it has. With it a reader takes records in any order.

``write`` deals documents to ascending ranges of doc_id and writes a part for each range. A
task names its files afresh at every attempt and the manifest, a table, lists the files of
the attempts that succeeded; those of lost executors are never read. Parts hold ascending doc_id (NULL
first, ties by text), and their numbers ascend too.

NULL text counts as empty and gives the end id alone; repeated documents are kept; an empty
table gives an empty manifest. Columns other than doc_id and text are ignored.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldwatch.llm.tables import Buckets, Memo, documents
from coldwatch.session import freeze, scratch_path

MASK = 0xA282EAD8  # fixed value: the constant that record files of this kind use
LENGTH, CHECK, HEAD = "<Q", "<I", "<Bq"
HEAD_BYTES = struct.calcsize(HEAD)
KEPT = 600_000        # parts a worker remembers in each generation
TOGETHER = 20_000     # parts per call of the library
GROUP_BYTES = 4 << 20  # texts encoded together
READ_BYTES = 8 << 20
MARKS = b".,;:!?"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


class ChunkEncoder:
    """Whole texts to ids by the tokenizers library, each distinct part encoded once while it is in use.

    For a vocabulary whose words never hold or cross white space, a text's ids are those of its
    parts between ASCII white space. The parts that a group of texts brings anew go through the library in one
    call, joined by spaces, and are told apart by their offsets; words of plain letters are what normaliser and
    pre-tokenizer leave as they are, and go straight to the library's model. Parts are remembered in two
    generations: when the young one is full it becomes the old one, and what is used again moves back, so common parts stay.
    Of a part of letters with closing punctuation, the two are separate words and remembered separately.
    Other vocabularies get whole texts.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        whole = self._whole("Ab cd.\nAB")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.by_word = (
            whole == b"".join(map(self._whole, ("ab", "cd", ".", "ab")))
            and not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added))
        self.code = "H" if self.kind == "<u2" else "I"
        self.marks = Memo(lambda marks: self._whole(marks.decode()), KEPT)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encoded(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct parts, by one call of the library for ``TOGETHER`` of them."""
        out = {}
        for begin in range(0, len(parts), TOGETHER):
            some = parts[begin:begin + TOGETHER]
            texts = [p.decode() for p in some]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            if (np.diff(starts) < 0).any():
                out.update(zip(some, map(self._whole, texts)))
                continue
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            ids = np.array(found.ids, self.kind).tobytes()
            width, first = int(self.kind[-1]), 0
            for part, last in zip(some, np.searchsorted(starts, ends).tolist()):
                out[part] = ids[first * width:last * width]
                first = last
        return out

    def _learn(self, parts: set[bytes]) -> None:
        """Brings parts into the young generation."""
        young, known, tokenize, code, others = self.young, self.old.get, self.tokenizer.model.tokenize, self.code, []
        for part in parts:
            ids = known(part)
            if ids is None:
                letters = part.rstrip(MARKS)
                if not letters.isalpha():  # of bytes: ASCII letters only
                    others.append(part)
                    continue
                word = letters.lower()
                ids = young.get(word) or known(word)
                if ids is None:
                    ids = array(code, [t.id for t in tokenize(word.decode())]).tobytes()
                young[word] = ids
                if len(letters) < len(part):
                    ids += self.marks[part[len(letters):]]
            young[part] = ids
        if others:
            young.update(self._encoded(others))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) if t else b"" for t in texts]
        parts = [t.encode().split() if t else [] for t in texts]
        distinct = set(chain.from_iterable(parts))
        if len(distinct) > KEPT // 2:  # more than fits at once
            return [b"".join([self._one(p) for p in text]) for text in parts]
        if len(self.young) + len(distinct) > KEPT:  # all of a group's parts must be there together
            self.old, self.young = self.young, {}
        new = distinct.difference(self.young)
        if new:
            self._learn(new)
        return [b"".join(map(self.young.__getitem__, text)) for text in parts]

    def _one(self, part: bytes) -> bytes:
        if part not in self.young:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self._learn({part})
        return self.young[part]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@cache
def encoder(vocabulary: str) -> ChunkEncoder:
    return ChunkEncoder(vocabulary)


def _store(path: str):
    """The file system of a path, local or remote, and the path within it."""
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Part:
    """One part file and its index, open for writing."""

    def __init__(self, folder: str, number: int):
        self.number, self.path = number, f"{folder}/part-{number:06d}-{uuid.uuid4().hex[:12]}.rec"
        self.store, inner = _store(self.path)
        self.store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.records = self.store.open_output_stream(inner)
        self.index = self.store.open_output_stream(inner[:-3] + "idx")
        self.offset = self.n_records = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        payload = struct.pack(HEAD, doc_id is not None, doc_id or 0) + ids
        length = struct.pack(LENGTH, len(payload))
        self.records.write(b"".join((length, struct.pack(CHECK, masked(length)), payload, struct.pack(CHECK, masked(payload)))))
        n = len(ids) // width
        self.index.write(struct.pack("<qq", self.offset, n))
        self.offset += len(payload) + 16
        self.n_records += 1
        self.n_tokens += n

    def close(self) -> dict:
        self.records.close()
        self.index.close()
        return {"part": self.number, "path": self.path, "n_records": self.n_records, "n_tokens": self.n_tokens}


def encoded_rows(words: ChunkEncoder, batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, bytes]]:
    """part, doc_id and ids of each row; texts become Python strings in groups of bounded size."""
    held, size = [], 0
    for row in zip(batch.column("part"), batch.column("doc_id"), batch.column("text")):
        number, doc_id, text = (value.as_py() for value in row)
        held.append((number, doc_id, text))
        size += len(text or "")
        if size >= GROUP_BYTES:
            yield from ((n, d, ids) for (n, d, _), ids in zip(held, words.encode_all([t for _, _, t in held])))
            held, size = [], 0
    yield from ((n, d, ids) for (n, d, _), ids in zip(held, words.encode_all([t for _, _, t in held])))


MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode and write every document; the manifest, one row per part file."""
    buckets = Buckets(docs.select("doc_id"), "doc_id")
    dealt = (
        docs.select(buckets.number(F.col("doc_id")).alias("part"), "doc_id", "text")
        .repartitionById(buckets.count, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "text")
    )

    def write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, done = encoder(vocabulary), None, []
        width = int(words.kind[-1])
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            for number, doc_id, ids in encoded_rows(words, batch):
                if part is None or part.number != number:
                    done += [part.close()] if part else []
                    part = Part(folder, number)
                part.add(doc_id, ids + end, width)
        done += [part.close()] if part else []
        yield pa.RecordBatch.from_pylist(done, MANIFEST)

    return freeze(dealt.mapInArrow(write_parts, "part int, path string, n_records long, n_tokens long"), "records")


def frames(stream) -> Iterator[bytes]:
    """Payloads of a part file from its start, every check confirmed."""
    data = b""
    while True:
        at = 0
        while len(data) - at >= 12:
            (length,) = struct.unpack_from(LENGTH, data, at)
            if masked(data[at:at + 8]) != struct.unpack_from(CHECK, data, at + 8)[0]:
                raise ValueError("a record's length doesn't match its check")
            if len(data) - at < length + 16:
                break
            yield checked(data[at + 12:at + 16 + length])
            at += length + 16
        more = stream.read(READ_BYTES)
        if not more:
            if len(data) > at:
                raise ValueError("a part file ends within a record")
            return
        data = data[at:] + more


def checked(framed: bytes) -> bytes:
    if masked(framed[:-4]) != struct.unpack(CHECK, framed[-4:])[0]:
        raise ValueError("a record doesn't match its check")
    return framed[:-4]


def _id(payload: bytes) -> int | None:
    has_id, doc_id = struct.unpack_from(HEAD, payload)
    return doc_id if has_id else None


DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(manifest: DataFrame, width: int) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids as 32-bit numbers, from the files.

    ``start`` counts the ids of all parts before, summed over the manifest's few rows.
    """
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = manifest.select("path", F.coalesce(before, F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, inner = _store(path)
                rows = []
                with store.open_input_stream(inner) as stream:
                    for payload in frames(stream):
                        ids = np.frombuffer(payload, f"<u{width}", offset=HEAD_BYTES)
                        rows.append((_id(payload), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGEST)], schema=DIGEST)

    return parts.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(manifest: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id and ids of every record; parts and, by their index, records in a pseudorandom order."""
    parts = manifest.select("path").repartition(
        max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path", F.lit(seed)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = _store(path)
                with store.open_input_stream(inner[:-3] + "idx") as stream:
                    index = np.frombuffer(stream.read(), "<i8").reshape(-1, 2)
                order = np.random.default_rng([seed, zlib.crc32(path.encode())]).permutation(len(index))
                with store.open_input_file(inner) as file:
                    for at in range(0, len(order), 1000):
                        rows = []
                        for offset, n in index[order[at:at + 1000]]:
                            file.seek(int(offset) + 12)
                            rows.append(checked(file.read(HEAD_BYTES + int(n) * width + 4)))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([_id(r) for r in rows], pa.int64()),
                            pa.array([np.frombuffer(r, f"<u{width}", offset=HEAD_BYTES).astype("int32") for r in rows], schema.field("ids").type),
                        ], schema=schema)

    return parts.mapInArrow(read, "doc_id long, ids array<int>")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    manifest = write(documents(spark, sf_dir), scratch_path(spark, "token-records"), vocabulary)
    return read_digests(manifest, int(encoder(vocabulary).kind[-1]))
