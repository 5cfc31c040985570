"""Best-fit packing by a configuration linear program over the length histogram.

1. Every document is tokenised whole and cut into pieces of at most CAPACITY ids.
2. Spark counts the pieces per length class (GRAIN ids wide): at most
   CAPACITY / GRAIN numbers, whatever the corpus.
3. On those numbers the driver solves the covering program "use as few
   configurations as cover each class" by multiplicative weights: a knapsack
   dynamic program prices the best configuration under the present weights, the
   configuration is taken for a fraction of the class it covers fastest, and the
   weights of what it covers fall exponentially.
4. Multiplicities are rounded down; the rest of the histogram is placed by
   best fit, longest class first.
5. The result is a table of (configuration, class, slots). Pieces are numbered
   within their class by two-level counting, so no class meets in one task, and
   a range lookup gives each its sequence; offsets are a running sum within one
   sequence of at most CAPACITY ids.

Cases: null and empty texts are one piece of one id. Repeated rows are packed
one by one. No row gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keep import keep

CAPACITY = 4096
END_ID = 1
GRAIN = 4
"""Ids per length class; lengths are rounded up, never down."""
STEP = 0.5
"""Share of a class that one round may cover at most."""
ETA = 3.0
"""How fast a covered class loses weight."""
SPREAD = 64
"""Sub-counts per length class when pieces are numbered."""
CACHE = 400_000
"""Distinct chunks that a worker remembers."""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """(tokenizer, whether an id ends a word, ids of known chunks)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())])
    return tokenizer, ends, {}


_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not _WORD[c] and c != 0x27]] = True  # an apostrophe may belong to a contraction
SPECIAL = b"<|"


def chunks(text: bytes) -> list[bytes]:
    """Parts of the text that the vocabulary encodes independently of each other.

    It drops white space, lower-cases, and never joins a letter or digit with a
    punctuation mark beside it. Only ASCII is judged here. A text that may hold a
    special token's string is split at white space alone.
    """
    if SPECIAL in text:
        return text.split()
    a = np.frombuffer(text, np.uint8)
    word, mark = _WORD[a], _MARK[a]
    cut = np.flatnonzero(word[:-1] & mark[1:] | mark[:-1] & word[1:]) + 1
    return (np.insert(a, cut, 0x20).tobytes() if len(cut) else text).lower().split()


def _encode_chunks(new: list[bytes], path: str) -> dict[bytes, bytes]:
    tokenizer, ends, _ = _tokenizer(path)
    many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    texts = [c.decode("utf-8", "replace") for c in new]
    # Chunks of plain Latin letters are one word each: they go as one text, whose ids are split at the words' ends.
    words = [k for k, t in enumerate(texts) if t.isalpha() and max(t) < "\u0130"]
    out: dict[bytes, bytes] = {}
    if words:
        ids = np.array(many([" ".join([texts[k] for k in words])], add_special_tokens=False)[0].ids, "<u4")
        edge = [0, *(4 * (np.flatnonzero(ends[ids]) + 1)).tolist()]
        if len(edge) == len(words) + 1:
            packed = ids.tobytes()
            out = {new[k]: packed[a:b] for k, a, b in zip(words, edge[:-1], edge[1:])}
    rest = [k for k, c in enumerate(new) if c not in out]
    coded = many([texts[k] for k in rest], add_special_tokens=False)
    return out | {new[k]: array("I", c.ids).tobytes() for k, c in zip(rest, coded)}


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit values.

    Each distinct chunk is encoded once and remembered; a text is the
    concatenation of its chunks.
    """
    known = _tokenizer(path)[2]
    parts = [chunks(t.encode("utf-8", "surrogatepass")) for t in texts]
    used = set().union(*parts)
    new = list(used.difference(known))
    if new:
        if len(known) + len(new) > CACHE:  # go on with what this slice uses
            kept = {c: known[c] for c in used.intersection(known)}
            known.clear()
            known.update(kept)
        for at in range(0, len(new), 20_000):
            known.update(_encode_chunks(new[at : at + 20_000], path))
    return [b"".join(map(known.__getitem__, p)) for p in parts]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = path or vocabulary()
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[doc_id].dataType.simpleString()
    most = 4 * CAPACITY

    def cut(batches):
        from .common import slices

        for batch in batches:
            for first, texts in slices(batch, "text"):
                row, piece, length, crc = [], [], [], []
                for k, ids in enumerate(encode(texts, path)):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), most)):
                        part = ids[at : at + most]
                        row.append(first + k)
                        piece.append(p)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(row)), "piece": piece, "start": piece.astype(np.int64) * CAPACITY, "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)})

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the program over the histogram -------------------------------------------


def price(size: np.ndarray, weight: np.ndarray, capacity: int) -> np.ndarray:
    """The best configuration (count per class) under the weights: unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(int(size[0]), capacity + 1):
        value = best[c - size[: fits[c]]] + weight[: fits[c]]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], took[c] = value[k], k
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(len(size), np.int64), capacity
    while c >= size[0]:
        if took[c] < 0:
            c -= 1
        else:
            count[took[c]] += 1
            c -= size[took[c]]
    return count


def solve(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(configuration, multiplicity) covering every demand fractionally."""
    covered, used = np.zeros(len(size)), []
    open_ = np.ones(len(size), bool)
    while open_.any():
        k = np.flatnonzero(open_)
        done = covered[k] / demand[k]
        weight = size[k] * np.exp(-ETA * (done - done.min()))
        count = np.zeros(len(size), np.int64)
        count[k] = price(size[k], weight, capacity)
        hit = np.flatnonzero(count)
        left = (demand - covered)[hit] / count[hit]
        step = min(left.min(), max(STEP * (demand[hit] / count[hit]).min(), 1e-3))
        covered[hit] += step * count[hit]
        open_[hit] = demand[hit] - covered[hit] > 1e-9
        used.append((count, step))
    return used


def best_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole configurations for what is left, longest class first, each item into the fullest sequence it fits."""
    room: dict[int, list[int]] = {}
    bins: list[np.ndarray] = []
    for k in range(len(size) - 1, -1, -1):
        for _ in range(int(left[k])):
            fit = min((r for r in room if r >= size[k]), default=None)
            if fit is None:
                bins.append(np.zeros(len(size), np.int64))
                at, fit = len(bins) - 1, capacity
            else:
                at = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            bins[at][k] += 1
            room.setdefault(int(fit - size[k]), []).append(at)
    alike: dict[bytes, list] = {}
    for b in bins:
        alike.setdefault(b.tobytes(), [b, 0])[1] += 1
    return [(b, n) for b, n in alike.values()]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole configurations (count per class in ascending order) that hold every item of the histogram."""
    size = np.array(sorted(histogram))
    if not len(size):
        return []
    demand = np.array([histogram[s] for s in size])
    left, out = demand.copy(), []
    merged: dict[bytes, list] = {}
    for count, y in solve(size, demand.astype(float), capacity):
        merged.setdefault(count.tobytes(), [count, 0.0])[1] += y
    for count, y in merged.values():
        n = min(int(y + 1e-9), int((left[count > 0] // count[count > 0]).min()))
        if n:
            left -= n * count
            out.append((count, n))
    return out + best_fit(size, left, capacity)


# --- pieces to sequences ------------------------------------------------------


def pack(cut: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``."""
    spark = cut.sparkSession
    cut = keep(cut, "pieces")
    cut = cut.withColumn("class", F.expr(f"cast((length + {GRAIN - 1}) div {GRAIN} as int)")).withColumn("sub", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {SPREAD}) as int)"))
    counts = keep(cut.groupBy("class", "sub").agg(F.count("*").alias("n")), "counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    size, rows, first = sorted(histogram), [], 0
    taken = dict.fromkeys(size, 0)
    for number, (count, n) in enumerate(plan(histogram, CAPACITY // GRAIN)):
        for k in np.flatnonzero(count):
            s, a = size[k], int(count[k])
            rows.append((int(s), taken[s], taken[s] + n * a, a, first))
            taken[s] += n * a
        first += n
    slots = spark.createDataFrame(rows, "class int, low long, high long, per long, first long")
    offset = Window.partitionBy("class").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("class", "sub", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("class", "sub").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("rank", rank).join(before, ["class", "sub"]).withColumn("rank", F.col("rank") + F.col("before"))
    # Classes with their slots in order: the slot of a rank is the last that begins at or below it.
    tables = slots.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("low", "high", "per", "first"))).alias("slots"))
    placed = ranked.join(F.broadcast(tables), "class").withColumn("slot", F.expr("filter(slots, s -> s.low <= rank and rank < s.high)[0]"))
    placed = placed.withColumn("sequence_id", F.expr("slot.first + (rank - slot.low) div slot.per"))
    within = Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
