"""Repeated passages: content-defined chunks of lines, and every stretch of over ``PASSAGE_WORDS`` words.

Chunks: each line is hashed, and a rolling hash over the last ``WINDOW`` line hashes ends a chunk after every line where it is
divisible by ``MODULUS``. So where a passage of several lines occurs in two documents, chunks inside it begin and end at
the same lines, whatever stands before it. Chunks of two worded lines or more whose hash occurs more than once
are compared byte by byte: equal bytes keep their first place, by document id (NULL first), text key and place,
and are removed everywhere else.

Passages: lines are cut at sentence ends into pieces. From each piece on, and up to each piece, the shortest run of
pieces with over ``PASSAGE_WORDS`` words is a window; every repeated stretch of that many words is covered by windows
that lie in it, wherever it starts and however few lines it has. Windows with equal digests (two 64-bit sums over the
two halves of the pieces' 128-bit hashes; white space between pieces does not count) keep their first place, in the
order of the chunks, and their pieces are removed everywhere else; places in one document that overlap the first are
left alone. A stretch counts by whole pieces: words at its ends that share a piece with foreign words stay.

Chunks and windows, the marks, come from one pass over the texts. Texts are moved twice more, keyed by document: to
cut the suspected chunks, and to take out what is repeated. Marks are moved as digests and places. Hashes that occur more
than once, and the first places, are tables of their own, smaller than the marks: a join with them is a broadcast
where they are small, and else one that adaptive execution splits where a passage fills a large part of the corpus.
A chunk without a boundary ends after ``MOST_LINES`` lines, so long runs of equal lines are cut from their start.

Cases: NULL and blank texts have no chunks or windows and come back as they are; equal rows are one document and keep
and lose the same lines; a line that loses only some of its pieces stays as a shorter line, and does not count as
removed; long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobmargin.llm.common import stored, text_key, text_of

WINDOW = 2
MODULUS = 3
MOST_LINES = 64
BASE = 0x9E3779B97F4A7C15
PASSAGE_WORDS = 50

# Fixed value: a sentence end, its closing marks and the blanks after it.
SENTENCE_END = re.compile(rb"""[.!?]+["')\]]*[ \t]+""")


def chunks_of(text: str | None) -> list[tuple[int, int, int]]:
    """(first line, lines, hash) of the chunks with at least two lines that hold a word."""
    lines = (text or "").encode().split(b"\n")
    return [(first, last - first + 1, digest) for _, first, last, digest in _chunks([lines])]


def _chunks(texts: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
    """(text, first line, last line, hash) of the chunks of some texts, given as lines."""
    lines = [line for text in texts for line in text]
    starts = [0, *accumulate(len(text) for text in texts)]
    hashes = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64)
    place = np.arange(len(lines)) - np.repeat(starts[:-1], [len(text) for text in texts])
    rolling = np.zeros(len(lines), np.uint64)
    for back in range(WINDOW):
        earlier = hashes[: len(lines) - back] * np.uint64(pow(BASE, back, 1 << 64))
        rolling[back:] += np.where(place[back:] >= back, earlier, np.uint64(0))
    rolling ^= rolling >> np.uint64(32)
    is_end = rolling % np.uint64(MODULUS) == 0
    is_end[np.array(starts[1:]) - 1] = True
    ends = np.flatnonzero(is_end) + 1
    found, first = [], 0
    for end, text in zip(ends.tolist(), (np.searchsorted(starts, ends, "left") - 1).tolist()):
        while first < end:
            after = min(end, first + MOST_LINES)
            if after - first >= 2 and sum(bool(line.split()) for line in lines[first:after]) >= 2:
                digest = xxhash.xxh64_intdigest(b"\n".join(lines[first:after]))
                found.append((text, first - starts[text], after - 1 - starts[text], digest - (1 << 63)))
            first = after
    return found


def _keyed(docs: DataFrame) -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))


def _frequent(marks: DataFrame) -> DataFrame:
    """The marks whose hash occurs more than once.

    Each such hash is one row, so a task's share of them is a hash table; the marks need not be sorted for the join.
    """
    twice = marks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hash").alias("twice"))
    return marks.join(stored(twice, "twice").hint("shuffle_hash"), F.col("hash") == F.col("twice")).drop("twice")


def repeated_chunks(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(doc, first, lines) of the chunks to remove; ``doc`` holds id and text key."""
    marks = stored(marks_of(docs), "marks") if marks is None else marks
    chunks = marks.where("chunk").select("doc_id", "text_key", "first", F.expr("last - first + 1 as lines"), "hash").distinct()
    doc = F.struct("doc_id", "text_key").alias("doc")
    suspects = _frequent(stored(chunks, "chunks")).select(doc, F.struct("first", "lines", "hash").alias("chunk"))
    by_doc = suspects.groupBy("doc").agg(F.collect_list("chunk").alias("chunks"))
    texts = docs.select(_keyed(docs).alias("doc"), text_of().alias("text"))
    passage = "array_join(slice(all_lines, c.first + 1, c.lines), '\\n')"
    of_text = f"transform(chunks, c -> struct(c.first as first, c.lines as lines, c.hash as hash, {passage} as passage))"
    # Cut before they are taken apart, so that a text is split once and not copied for each of its chunks.
    passages = f"flatten(transform(array(split(text, '\\n')), all_lines -> {of_text}))"
    cut = texts.join(by_doc, "doc").select("doc", F.expr(f"inline({passages})"))
    cut = stored(cut, "passages")
    # The bytes are compared here: a passage is its own key, the hash only spreads and orders.
    place = F.struct("doc", "first")
    kept = cut.groupBy("hash", "passage").agg(F.min(place).alias("keeper"), F.max(place).alias("last")).where("keeper <> last")
    kept = stored(kept.select(F.col("hash").alias("of_hash"), F.col("passage").alias("of_passage"), "keeper"), "chunk-keepers")
    later = cut.join(kept.hint("shuffle_hash"), F.expr("hash = of_hash and passage = of_passage")).where(place != F.col("keeper"))
    return later.select("doc", "first", "lines")


def pieces_of(text: str | None) -> list[list[bytes]]:
    """The pieces of each line; joined, they are the line."""
    return _pieces((text or "").encode().split(b"\n"))


def _pieces(all_lines: list[bytes]) -> list[list[bytes]]:
    lines = []
    for line in all_lines:
        cuts = [0, *(m.end() for m in SENTENCE_END.finditer(line)), len(line)]
        lines.append([line[a:b] for a, b in zip(cuts, cuts[1:]) if a < b] or [line])
    return lines


# Powers of two odd numbers and of their inverses modulo 2**64; longer texts make them longer.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: list[np.ndarray] = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def _powers(count: int) -> list[np.ndarray]:
    if _POWERS[0].shape[1] < count:
        size = max(count, 2 * _POWERS[0].shape[1], 4096)
        for k, factors in enumerate((_FACTORS, [pow(f, -1, 1 << 64) for f in _FACTORS])):
            steps = np.ones((2, size), np.uint64)
            steps[:, 1:] = np.array(factors, np.uint64)[:, None]
            _POWERS[k] = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _POWERS


def windows_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Text, first piece, last piece, hash and check of the shortest runs with over ``PASSAGE_WORDS`` words.

    The texts are given as pieces. Pieces are numbered through a text; those without words are numbered, but are no
    part of a digest.
    """
    pieces = [piece for text in texts for piece in text]
    sizes = [len(text) for text in texts]
    counts = np.array([len(piece.split()) for piece in pieces], np.int64)
    at = np.flatnonzero(counts)
    total = np.concatenate([[0], np.cumsum(counts[at])])
    # Runs are sought in all texts at once; those that reach into another text are dropped.
    text_of_piece = np.repeat(np.arange(len(texts)), sizes)
    text = text_of_piece[at]
    begins, ends = np.searchsorted(text, np.arange(len(texts)), "left"), np.searchsorted(text, np.arange(len(texts)), "right")
    after = np.searchsorted(total, total[:-1] + PASSAGE_WORDS, "right")  # the shortest run from each piece on
    begun = np.flatnonzero(after <= ends[text]) if len(at) else at
    before = np.searchsorted(total, total[1:] - PASSAGE_WORDS, "left") - 1  # and up to each piece
    ended = np.flatnonzero(before >= begins[text]) if len(at) else at
    width = len(total) + 1
    runs = np.unique(np.concatenate([begun * width + after[begun], before[ended] * width + ended + 1]))
    if not len(runs):
        return []
    first, after = np.divmod(runs, width)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(pieces[i].strip()) for i in at.tolist()]), "<u8").reshape(-1, 2)
    powers, inverse = _powers(len(total))
    sums = np.zeros((2, len(total)), np.uint64)
    np.cumsum(digests.T * powers[:, : len(at)], axis=1, dtype=np.uint64, out=sums[:, 1:])
    hashes = ((sums[:, after] - sums[:, first]) * inverse[:, first]).view(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return [text[first], at[first] - starts[text[first]], at[after - 1] - starts[text[first]], hashes[0], hashes[1]]


def marks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, chunk, first, last, hash, check): chunks by their lines, windows by their pieces."""
    names = ["doc_id", "text_key", "chunk", "first", "last", "hash", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                texts = [text.split(b"\n") for text in part.column(2).to_pylist()]
                chunks, windows = _chunks(texts), windows_of([[p for line in _pieces(lines) for p in line] for lines in texts])
                found = [np.array([(*chunk, 0) for chunk in chunks], np.int64).reshape(-1, 5).T]
                found += [np.stack(windows)] if windows else []
                row, first, last, digest, check = np.concatenate(found, axis=1)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row), part.column(1).take(row), pa.array(np.arange(len(row)) < len(chunks)),
                        pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(digest), pa.array(check),
                    ],
                    names,
                )

    narrow = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_of().cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_key long, chunk boolean, first int, last int, hash long, check long")


def repeated_passages(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(doc, first, last): the windows to remove, by their pieces; ``doc`` holds id and text key."""
    marks = stored(marks_of(docs), "marks") if marks is None else marks
    suspects = stored(_frequent(marks.where("not chunk").drop("chunk")), "suspects")
    place = F.struct("doc_id", "text_key", "first", "last")
    kept = suspects.groupBy("hash", "check").agg(F.min(place).alias("keeper"), F.max(place).alias("latest")).where("keeper <> latest")
    kept = stored(kept.select(F.col("hash").alias("of_hash"), F.col("check").alias("of_check"), "keeper"), "keepers")
    overlaps = F.expr("doc_id <=> keeper.doc_id and text_key = keeper.text_key and first <= keeper.last")
    later = suspects.join(kept.hint("shuffle_hash"), F.expr("hash = of_hash and check = of_check")).where(~overlaps)
    return later.select(F.struct("doc_id", "text_key").alias("doc"), "first", "last")


def _without(text: bytes, gone: list[tuple[bool, int, int]]) -> tuple[bytes, int]:
    """The text without what ``gone`` lists as (whole lines, first, last), and the number of lines taken out whole."""
    lines = _pieces(text.split(b"\n"))
    out = np.zeros(sum(len(line) for line in lines), bool)
    starts = [0, *accumulate(len(line) for line in lines)]
    for whole_lines, first, last in gone:
        if whole_lines:
            out[starts[first] : starts[last + 1]] = True
        else:
            out[first : last + 1] = True
    out = out.tolist()
    stay, removed = [], 0
    for line, start in zip(lines, starts):
        left = [piece for i, piece in enumerate(line, start) if not out[i]]
        if not left:
            removed += 1
        else:
            rest = b"".join(left)
            stay.append(rest.rstrip(b" \t") if out[start + len(line) - 1] else rest)
    return b"\n".join(stay), removed


def without_passages(docs: DataFrame) -> DataFrame:
    """``doc_id``, the cleaned ``text`` and ``llm__removed``: repeated chunks and repeated passages are taken out."""
    marks = stored(marks_of(docs), "marks")
    lines = repeated_chunks(docs, marks).select("doc", F.lit(True).alias("whole_lines"), "first", (F.col("first") + F.col("lines") - 1).alias("last"))
    pieces = repeated_passages(docs, marks).select("doc", F.lit(False).alias("whole_lines"), "first", "last")
    gone = lines.union(pieces).groupBy("doc").agg(F.collect_set(F.struct("whole_lines", "first", "last")).alias("gone"))
    joined = docs.join(gone.withColumnRenamed("doc", "llm__doc"), _keyed(docs) == F.col("llm__doc"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts that lose nothing stay in Arrow; only the others become Python objects.
            sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
            rows = np.flatnonzero(sizes)
            spans = list(zip(*(field.to_pylist() for field in batch.column(2).flatten().flatten())))
            ends = np.cumsum(sizes)
            cleaned, removed = [None] * len(sizes), np.zeros(len(sizes), np.int64)
            for i, text in zip(rows.tolist(), batch.column(1).take(pa.array(rows)).cast(pa.binary()).to_pylist()):
                cleaned[i], removed[i] = _without(text, spans[ends[i] - sizes[i] : ends[i]])
            texts = pc.if_else(pa.array(sizes > 0), pa.array(cleaned, pa.binary()).cast(pa.string()), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(removed)], ["doc_id", "text", "llm__removed"])

    return joined.select(F.col("doc_id").cast("long"), "text", "gone").mapInArrow(run, "doc_id long, text string, llm__removed long")


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, lines, removed lines, characters and checksum of the text that stays."""
    cleaned = without_passages(docs.select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.size(F.split(text_of(), "\n")).cast("long").alias("n_lines_kept"),
        F.col("llm__removed").cast("long").alias("n_lines_removed"),
        F.length(text_of()).cast("long").alias("n_chars_kept"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
