"""Token ids of documents in binary record files with an offset index.

Documents are range-partitioned by id; each task encodes its texts and writes record files in ascending id order.

A record file is a row of frames, all numbers little-endian:
  u64 length | u32 masked checksum of the length | payload | u32 masked checksum of the payload
The payload is i64 doc_id, u16 bytes per id (2 or 4), u16 flags (1: doc_id is NULL), then the ids. The checksum is CRC-32,
masked (rotated right by 15, plus a constant) so that checksums stored inside data do not match by chance.
The index beside it holds a u64 byte offset and a u64 count of earlier ids in the file for each record, and one more
such pair for the end. With it any range of records is read by itself, in order or shuffled.

Every attempt of a task writes files of its own name; the manifest, a Parquet table that Spark commits, lists the
files that count. Executors write through ``pyarrow.fs`` to the folder named by ``spark.checkpoint.dir``.

Cases: NULL and blank texts are the end id alone; NULL ids come first; equal ids are ordered by a key of their
text; long texts are encoded in pieces between blanks; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from jobmargin.llm.common import stored, text_key
from jobmargin.session import run_folder

END_ID = 2
FILE_BYTES = 128 << 20
RECORDS_AT_ONCE = 2048
READ_BYTES = 16 << 20  # of ids that one task reads back
WORDS_AT_ONCE = 1 << 16
ENCODED_AT_ONCE = 1000
REMEMBERED = 600_000  # words whose ids a Python worker keeps at hand
# Stretches of ASCII signs but the apostrophe, and of letters that are one character each, in either case.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e!-&(-/:;=-@\\[-`{-~]+")
RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017e]+|[^a-z\u00df-\u00f6\u00f8-\u017e]+")
SIGN = re.compile(rb"[!-@\[-`{-~]")
# Byte-level vocabularies show bytes without a printable form of their own as the characters from 256 on.
UNPRINTABLE = [*range(33), *range(127, 161), 173]
SHOWN = {byte: 256 + i for i, byte in enumerate(UNPRINTABLE)}
# Fixed value: how the known kind of tokenizer splits a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: what is added to a rotated checksum.
MASK = 0xA282EAD8
FRAME, HEAD = struct.Struct("<QI"), struct.Struct("<qHH")
ENTRY_BYTES = 16

MANIFEST = "part int, seq int, file string, records long, ids long"


class DamagedRecord(ValueError):
    """A frame whose checksum or length does not hold."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def shortcuts(tokenizer: Tokenizer) -> tuple[bool, bool]:
    """Whether a tokenizer may be fed stretch by stretch between blanks, and those run by run of letters.

    Told from its own description: it must drop white space while it splits by ``WORD_PATTERN``, and for runs of letters
    also lower-case and change nothing else of Latin letters and ASCII signs. Any other tokenizer gets whole texts.
    """
    described = json.loads(tokenizer.to_str())
    first, *others = (described["pre_tokenizer"] or {}).get("pretokenizers") or [described["pre_tokenizer"] or {}]
    by_words = (
        first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN}
        and first.get("behavior") == "Removed" and first.get("invert") is True
        and all(o.get("type") == "ByteLevel" and not o.get("add_prefix_space") and not o.get("use_regex") for o in others)
    )
    normalizer = described["normalizer"] or {}
    steps = normalizer.get("normalizers") or [normalizer]
    known = [s.get("type") in ("NFC", "Lowercase") or s.get("pattern") == {"Regex": "\\s+"} for s in steps]
    by_words = by_words and (not normalizer or all(known))
    by_letters = by_words and bool(others) and any(s.get("type") == "Lowercase" for s in steps)
    return by_words, by_letters


class Encoder:
    """Ids of whole texts as bytes.

    A tokenizer that never joins characters across ASCII blanks is fed the stretches between them, each once, and they are
    remembered. One that also lower-cases and keeps runs of letters and runs of other signs apart is fed those
    runs: a stretch of Latin letters and ASCII signs is put together from them. Stretches with digits, apostrophes or
    other characters go to the tokenizer as they are. ``shortcuts`` tells which holds; otherwise texts go to it whole.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._model = self._tokenizer.model
        self._by_words, self._by_letters = shortcuts(self._tokenizer)
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._known: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self._by_words:
            return self._bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.encode().split()
        return b"".join([self._piece(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)])

    def _piece(self, words: list[bytes]) -> bytes:
        known = self._known
        new = set(words).difference(known)
        if new:
            if len(known) + 2 * len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            runs = {}
            for word in new if self._by_letters else ():
                if word.isalpha():  # ASCII letters alone
                    low = word.lower()
                    known[word] = known.get(low) or self._letters(low)
                else:
                    stretch = word.decode()
                    if PLAIN.fullmatch(stretch):
                        runs[word] = [run.encode() for run in RUNS.findall(stretch.lower())]
            signs = {run for parts in runs.values() for run in parts if SIGN.match(run)}
            self._learn([word for word in new | signs if word not in runs and word not in known])
            for word, parts in runs.items():
                known[word] = b"".join([known.get(run) or self._letters(run) for run in parts])
        return b"".join(map(known.__getitem__, words))

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), ENCODED_AT_ONCE):
            part = words[at : at + ENCODED_AT_ONCE]
            encoded = self._tokenizer.encode_batch_fast([word.decode() for word in part], add_special_tokens=False)
            self._known.update((word, self._bytes(e.ids)) for word, e in zip(part, encoded))

    def _letters(self, run: bytes) -> bytes:
        shown = run.decode() if run.isascii() else run.decode("latin-1").translate(SHOWN)
        ids = self._bytes([token.id for token in self._model.tokenize(shown)])
        self._known[run] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)


@cache
def _encoder(tokenizer_path: str) -> Encoder:
    """One per Python worker, so that tasks after the first start with its words."""
    return Encoder(tokenizer_path)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


class _Files:
    """The record files of one task."""

    def __init__(self, folder: str, part: int, width: int) -> None:
        self._system, self._folder = _open(folder)
        self._system.create_dir(self._folder, recursive=True)
        self._part, self._width = part, width
        self.done: list[tuple[int, int, str, int, int]] = []
        self._out = None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._out is None:
            self._name = f"part-{self._part:06d}-{len(self.done):04d}-{uuid.uuid4().hex}"
            self._out = self._system.open_output_stream(f"{self._folder}/{self._name}.records")
            self._index, self._at, self._ids = [], 0, 0
        payload = HEAD.pack(doc_id or 0, self._width, doc_id is None) + ids
        length = struct.pack("<Q", len(payload))
        frame = b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))
        self._out.write(frame)
        self._index.append((self._at, self._ids))
        self._at += len(frame)
        self._ids += len(ids) // self._width
        if self._at >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self._out is None:
            return
        self._out.close()
        with self._system.open_output_stream(f"{self._folder}/{self._name}.index") as out:
            out.write(np.array([*self._index, (self._at, self._ids)], "<u8").tobytes())
        self.done.append((self._part, len(self.done), self._name, len(self._index), self._ids))
        self._out = None


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes record files into ``folder``; the stored manifest (part, seq, file, records, ids) in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        files = _Files(folder, TaskContext.get().partitionId(), encoder.width)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                files.add(doc_id.as_py(), encoder(text.as_py() or "") + end)
        files.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "seq", "file", "records", "ids"), row)) for row in files.done],
            pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]),
        )

    order = ["doc_id", "llm__key"]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("llm__key"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_frames(stream, first: int, offsets: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(record number, doc_id, ids) of the records ``first`` to ``first + len(order) - 1``, in the given order."""
    for k in order:
        at, after = int(offsets[k]), int(offsets[k + 1])
        stream.seek(at)
        frame = stream.read(after - at)
        length, crc = FRAME.unpack_from(frame)
        payload = frame[FRAME.size : -4]
        if crc != masked_crc(frame[:8]) or length != len(payload) or struct.unpack("<I", frame[-4:])[0] != masked_crc(payload):
            raise DamagedRecord(f"record {first + k} at byte {at}")
        doc_id, width, flags = HEAD.unpack_from(payload)
        yield first + int(k), None if flags & 1 else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


def _scan(manifest: DataFrame, folder: str, columns: str, row: Callable[[np.ndarray], tuple], shuffle_seed: int | None) -> DataFrame:
    """Reads all records, a stretch of one file at a time: doc_id, start, then what ``row`` makes of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), *_ARROW[columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            for task in batch.to_pylist():
                name, first, last = f"{path}/{task['file']}", task["first"], task["last"]
                with system.open_input_file(f"{name}.index") as stream:
                    stream.seek(first * ENTRY_BYTES)
                    index = np.frombuffer(stream.read((last - first + 1) * ENTRY_BYTES), "<u8").reshape(-1, 2).astype(np.int64)
                order = np.arange(last - first)
                if shuffle_seed is not None:
                    order = np.random.default_rng([shuffle_seed, first]).permutation(order)
                rows = []
                with system.open_input_file(f"{name}.records") as stream:
                    for number, doc_id, ids in read_frames(stream, first, index[:, 0], order):
                        rows.append((doc_id, task["before"] + int(index[number - first, 1]), *row(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # One row per file; the running total over files is the only thing that is not read in parallel.
    files = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    started = manifest.withColumn("before", F.coalesce(F.sum("ids").over(files), F.lit(0)))
    stretches = started.withColumn("first", F.explode(F.expr(f"sequence(0L, records - 1, {RECORDS_AT_ONCE}L)")))
    stretches = stretches.withColumn("last", F.least(F.col("first") + RECORDS_AT_ONCE, "records"))
    # A stretch is a few bytes here and megabytes in its file, so the number of tasks is told, not left to be measured.
    ids = manifest.agg(F.sum("ids")).first()[0] or 0
    tasks = -(-4 * ids // READ_BYTES) or 1
    return stretches.repartition(tasks, "file", "first").mapInArrow(run, f"doc_id long, start long, {columns}")


_ARROW = {
    "ids array<int>": [("ids", pa.list_(pa.int32()))],
    "n_tokens long, ids_crc32 long": [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())],
}


def read_records(manifest: DataFrame, folder: str, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all records before) and ids; with a seed, stretches are read in shuffled order."""
    return _scan(manifest, folder, "ids array<int>", lambda ids: (ids.astype(np.int32),), shuffle_seed)


def record_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as unsigned 32-bit numbers, from the files."""

    def digest(ids: np.ndarray) -> tuple[int, int]:
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return _scan(manifest, folder, "n_tokens long, ids_crc32 long", digest, None)


def token_records(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes all documents, reads them back, and gives the digest of each record."""
    folder = run_folder(docs.sparkSession, "records")
    return record_digests(write_records(docs, tokenizer_path, folder), folder)
