"""Resampling of documents by importance for a target distribution.

Features are all runs of 1 to ``order`` consecutive words, joined by one space; a
feature's bucket is the unsigned CRC-32 of its UTF-8 bytes modulo ``buckets``. A bucket's
gain is ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` from its share among
the target's features (t of T) and the documents' (s of S). A document weighs the
sum of its features' gains; Gumbel noise from its id makes the scores of a draw
without replacement, whose highest ones are drawn.

CRC is linear up to a constant that the length alone decides, so the checksums of
all features come from a table ``byte x distance from the end``: contributions of the
bytes are combined by one ``bitwise_xor.reduceat`` over the spans. Spans longer than
the table are cut into blocks of its size from the end; neighbouring blocks are folded
two by two, the left one moved on by the bytes to its right.

Counts and draws cover all rows. Only bucket counts (``buckets`` numbers) pass through
the driver; the ranking is by range partitions, with a table of their sizes.

Cases: null and empty texts have no feature and weight 0. A null id has a null
score and is never drawn, nor are texts of fewer than ``least`` words. Repeated rows
are counted and ranked one by one. An empty target or table gives all buckets
smoothed counts alone. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunks import CHUNK, ROWS_PER_CHUNK, with_chunk
from ..operators.keep import keep
from .common import slices

BUCKETS, ORDER, LEAST = 10_000, 1, 20
PERCENT, SEED = 10, 2024
BLOCK = 64
"""Distances from a span's end that the table holds."""

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """contribution[distance, byte] and zeros[length], the checksum of so many zero bytes."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    rows = [one]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ one[rows[-1] & np.uint32(255)])
    return np.stack(rows), np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


_CONTRIBUTION, _ZEROS = _tables()


def _moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Register values moved on; ``by[k, byte]`` is where byte k of a register goes."""
    out = by[0][x & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ by[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _move_by_block() -> np.ndarray:
    one = _CONTRIBUTION[0]
    by = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(BLOCK):
        by = (by >> np.uint32(8)) ^ one[by & np.uint32(255)]
    return by


def span_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of a byte array, all at once. Spans may overlap and are not empty."""
    if not len(start):
        return np.zeros(0, np.uint32)
    # Each byte of each span, with its distance from the span's end.
    total = np.cumsum(length)
    place = np.arange(total[-1])
    left = np.repeat(total, length) - 1 - place
    byte = data[np.repeat(start - (total - length), length) + place]
    blocks = (length + BLOCK - 1) // BLOCK
    if blocks.max() == 1:
        linear = np.bitwise_xor.reduceat(_CONTRIBUTION[left, byte], total - length)
        return linear ^ _ZEROS[length]
    span = np.repeat(np.arange(len(start)), blocks)
    before = np.cumsum(blocks) - blocks
    number = np.arange(len(span)) - before[span]  # of a block in its span, from the left
    first = (total - length)[span] + np.where(number > 0, length[span] - (blocks[span] - number) * BLOCK, 0)
    value = np.bitwise_xor.reduceat(_CONTRIBUTION[left % BLOCK, byte], first)
    behind = blocks[span] - 1 - number  # blocks to the right
    by = _move_by_block()
    while behind.any():
        value = np.where(behind % 2 == 1, _moved(value, by), value)
        behind = behind // 2
        edge = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (behind[1:] != behind[:-1])])
        value, span, behind = np.bitwise_xor.reduceat(value, edge), span[edge], behind[edge]
        by = _moved(by, by)
    constant = _ZEROS[np.minimum(length, BLOCK)]
    for k in np.flatnonzero(length > BLOCK):
        constant[k] = zlib.crc32(bytes(int(length[k])))
    return value ^ constant


def feature_buckets(texts: list[str], buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, the text of each, and each text's number of words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(raw).lower() + b"\0", np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[data], prepend=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    own = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")
    words = np.bincount(own, minlength=len(texts))
    if order == 1:
        return (span_crcs(data, start, length) % np.uint32(buckets)).astype(np.int64), own, words
    # Words with one space between them, so that a feature is one span.
    at = np.cumsum(length + 1) - (length + 1)
    place = np.repeat(start - at, length + 1) + np.arange(int((length + 1).sum()))
    packed = data[np.minimum(place, len(data) - 1)].copy()
    packed[at + length] = 0x20
    found, texts_of = [], []
    for n in range(1, order + 1):
        first = np.arange(max(0, len(at) - n + 1))
        first = first[own[first] == own[first + n - 1]]
        last = first + n - 1
        found.append(span_crcs(packed, at[first], at[last] + length[last] - at[first]) % np.uint32(buckets))
        texts_of.append(own[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(texts_of), words


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """The features of all rows by bucket; each task sends what it has counted."""

    def work(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                counts += np.bincount(feature_buckets(texts, buckets, order)[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["bucket", "n"])

    counted = rows.select(F.col(text).alias("text")).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source, target)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches):
        gain = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch, "text"):
                bucket, own, words = feature_buckets(texts, len(gain), order)
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, own, gain[bucket])
                mine = ids.slice(first, len(texts))
                score = [None if i is None else int(w) + noise(i, seed) for i, w in zip(mine.to_pylist(), weight)]
                yield pa.RecordBatch.from_arrays([mine, pa.array(words), pa.array(np.bincount(own, minlength=len(texts))), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def draw(weighed: DataFrame, percent: int = PERCENT, least: int = LEAST, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows that may be drawn."""
    weighed = keep(weighed, "weighed")
    may = f"score is not null and n_words >= {least}"
    wanted = weighed.where(may).count() * percent // 100
    order = ["down", "doc_id", "n_features", "weight"]
    cut = with_chunk(weighed.where(may).withColumn("down", -F.col("score")), [], *order, rows=rows)
    sizes = cut.groupBy(CHUNK).agg(F.count("*").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    ranked = cut.withColumn("inside", inside).join(sizes.select(CHUNK, ahead.alias("ahead")), CHUNK)
    rank = (F.col("ahead") + F.col("inside")).cast("long")
    ranked = ranked.select(*weighed.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(weighed.where(f"not ({may})").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, order: int = ORDER, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``, drawn to resemble ``target``."""
    gain = gains(bucket_counts(docs, text, buckets, order), bucket_counts(target, target_text, buckets, order))
    return draw(weigh(docs, gain, doc_id, text, order, seed), percent, least)
