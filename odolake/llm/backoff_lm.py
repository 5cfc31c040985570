"""Language-model scores from a weighted backoff automaton over words.

Model: smoothed unigrams ``p1(v) = (c(v) + 0.5) / (N + 0.5 (V + 1))`` at the root.
States are the empty history, the begin of a text, every word and every word pair
of the training texts. A state s seen c(s) times fails with weight
``gamma(s) = K / (K + sqrt(c(s)))`` to s', which is s without its first word, and has
an arc for every word v seen behind it,
``p(v | s) = (1 - gamma(s)) c(s v) / c(s) + gamma(s) p(v | s')``. Where there is no
arc, the failure arc is taken: ``gamma(s) p(v | s')``. A text is read from left to
right from the begin state; the state carried after a token is the longest history
that exists, and the log-probabilities of the arcs taken add up.

Size: every word, pair and triple of the training texts is a part of the automaton,
at every size of the corpus; nothing is broadcast. The texts are packed into blocks.
A block asks for the counts of its distinct words, pairs and triples, with its own
counts of them; the requests are dealt by hash, met and added up there, and the sums
go back to the block. So each block gets the states and arcs that its texts can
reach, and a word of a third of all tokens is one request a block.

Words are 64-bit hashes, of which a request carries the bucket and 50 bits more;
pairs and triples carry 42 bits more. A bucket holds a bounded number of keys, so
the chance that an arc gets a foreign count, about one in a million, does not grow.

Cases: null and empty texts are the end token alone. Rows with a null id are
scored, not learned from. Repeated rows are scored and counted each. Without
training rows every unigram has probability 1. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keep import keep
from .common import held_out, mix, slices, word_hashes

END = np.uint64(0xE7D0E7D0E7D0E7D0)
BEGIN = np.uint64(0xBE61BE61BE61BE61)
FAILURE = (8.0, 2.0)
"""K of word states and of pair states."""
BLOCK_CHARS = 1 << 23
CHARS_PER_BUCKET = 1 << 24
BITS = (50, 42, 42)
"""Bits behind the bucket that tell words, pairs and triples apart."""


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each closed by END, and where each text starts (one more)."""
    h, at = word_hashes(texts)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def grams(h: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | slice]]:
    """(keys, the tokens they end at) of words, pairs and triples. A text's first pair starts with BEGIN; it has no first triple."""
    before = np.r_[BEGIN, h[:-1]]
    before[at[:-1]] = BEGIN
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + h)
    later = np.ones(len(h), bool)
    later[at[:-1]] = False
    ends = np.flatnonzero(later)
    triple = mix(pair[ends - 1] * np.uint64(0xD6E8FEB86659FD93) + h[ends])
    return [(h, slice(None)), (pair, slice(None)), (triple, ends)]


# --- blocks of texts ----------------------------------------------------------


def _blocks(rows: DataFrame) -> DataFrame:
    """block, chars, packed: the rows (doc_id, held_out, text) in compressed blocks; a longer text is a block of its own."""

    def pack(batches):
        task, made, chars, held = TaskContext.get().partitionId(), 0, 0, []

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([chars], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "chars", "packed"])

        for batch in batches:
            for first, texts in slices(batch, "text"):
                held.append(batch.slice(first, len(texts)))
                chars += sum(map(len, texts))
                if chars >= BLOCK_CHARS:
                    yield packed()
                    made, chars, held = made + 1, 0, []
        if held:
            yield packed()

    return keep(rows.mapInArrow(pack, "block long, chars long, packed binary"), "blocks")


def _unpacked(packed: pa.Scalar) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]:
    """(rows, token hashes, where each text starts, whether it is learned from) of a block."""
    batches = pa.ipc.open_stream(packed.as_buffer()).read_all().to_batches()
    read = [tokens(texts) for batch in batches for _, texts in slices(batch, "text")]
    at = np.cumsum(np.concatenate([[0], *(np.diff(at) for _, at in read)]))
    learned = np.concatenate([~b["held_out"].to_numpy(zero_copy_only=False) & b["doc_id"].is_valid().to_numpy(zero_copy_only=False) for b in batches])
    return batches, np.concatenate([h for h, _ in read]), at, learned


# --- counts -------------------------------------------------------------------


def _bytes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, compressed byte by byte, all lowest bytes first: their number, their width, the bytes."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(raw: pa.Scalar) -> np.ndarray:
    raw = raw.as_buffer()
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd"), np.uint8)
    numbers = np.zeros((n, 8), np.uint8)
    numbers[:, :width] = planes.reshape(width, n).T
    return numbers.view("<u8").ravel()


def _requests(blocks: DataFrame, power: int) -> DataFrame:
    """kind, bucket, block, keys, own: a block's distinct grams by bucket of 2**power (keys as ascending steps) and how often it learns from each."""

    def ask(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, h, at, learned = _unpacked(packed)
                learned = np.repeat(learned, np.diff(at))
                for kind, (keys, ends) in enumerate(grams(h, at)):
                    keys, inverse = np.unique(keys, return_inverse=True)
                    own = np.bincount(inverse, learned[ends], len(keys))
                    bucket = (keys >> np.uint64(1)) >> np.uint64(63 - power)
                    short = (keys << np.uint64(power)) >> np.uint64(64 - BITS[kind])
                    edge = np.searchsorted(bucket, np.arange((1 << power) + 1, dtype=np.uint64))
                    used = np.flatnonzero(np.diff(edge))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(used), kind), pa.int32()),
                            pa.array(used, pa.int32()),
                            pa.array(np.full(len(used), block), pa.int64()),
                            pa.array([_bytes(np.diff(short[edge[b] : edge[b + 1]], prepend=np.uint64(0))) for b in used], pa.binary()),
                            pa.array([_bytes(own[edge[b] : edge[b + 1]]) for b in used], pa.binary()),
                        ],
                        names=["kind", "bucket", "block", "keys", "own"],
                    )

    return blocks.select("block", "packed").mapInArrow(ask, "kind int, bucket int, block long, keys binary, own binary")


def _answers(requests: DataFrame) -> DataFrame:
    """kind, bucket, block, other: what other blocks add to the own counts; total, types: words of the bucket, in its first row."""

    def meet(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_numbers(k), dtype=np.uint64) for k in table["keys"]]
        own = np.concatenate([_numbers(c) for c in table["own"]]).astype(np.int64)
        edge = np.cumsum([0, *map(len, keys)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, own).astype(np.int64)
        other = sums[inverse] - own
        word = table["kind"][0].as_py() == 0
        first = lambda x: pa.array(np.r_[x if word else 0, np.zeros(len(keys) - 1, np.int64)], pa.int64())
        answer = pa.array([_bytes(other[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())
        return pa.table({"kind": table["kind"], "bucket": table["bucket"], "block": table["block"], "other": answer, "total": first(sums.sum()), "types": first((sums > 0).sum())})

    met = requests.groupBy("kind", "bucket").applyInArrow(meet, "kind int, bucket int, block long, other binary, total long, types long")
    return keep(met, "counts")


# --- scoring ------------------------------------------------------------------


class Automaton:
    """The part of the automaton that a block's texts reach: at every token the counts of its word, of the
    pair and the triple that end there, and of the two histories before it."""

    def __init__(self, total: int, types: int, at: np.ndarray, counts: list[np.ndarray]):
        self.total, self.types, self.at = total, types, at
        self.word, self.pair, self.triple = counts
        self.before1 = np.r_[0, self.word[:-1]]
        self.before1[at[:-1]] = self.word[at[1] - 1]  # every text begins once and ends once
        self.before2 = np.r_[0, self.pair[:-1]]
        self.before2[at[:-1]] = 0

    @staticmethod
    def step(k: float, state: np.ndarray, arc: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """The weight of the arc, or of the failure arc and what follows it; a state never seen fails for nothing."""
        gamma = k / (k + np.sqrt(state))
        return (1 - gamma) * arc / np.maximum(state, 1) + gamma * shorter

    def root(self) -> np.ndarray:
        return (self.word + 0.5) / (self.total + 0.5 * (self.types + 1))

    def weights(self) -> np.ndarray:
        """The probability of every token, read from left to right."""
        one = self.step(FAILURE[0], self.before1, self.pair, self.root())
        return self.step(FAILURE[1], self.before2, self.triple, one)

    def read(self) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score."""
        total = lambda x: np.add.reduceat(x, self.at[:-1])
        return np.diff(self.at), total((self.word > 0).astype(np.int64)), total(np.log10(self.root())), total(np.log10(self.weights()))


def _automaton(h: np.ndarray, at: np.ndarray, learned: np.ndarray, answers: pa.Table, total: int, types: int) -> Automaton:
    learned = np.repeat(learned, np.diff(at))
    answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds = answers["kind"].to_numpy()
    counts = []
    for kind, (keys, ends) in enumerate(grams(h, at)):
        keys, inverse = np.unique(keys, return_inverse=True)
        own = np.bincount(inverse, learned[ends], len(keys)).astype(np.int64)
        a, b = np.searchsorted(kinds, [kind, kind + 1])
        other = np.concatenate([np.zeros(0, np.int64), *(_numbers(x).astype(np.int64) for x in answers["other"].slice(a, b - a))])
        count = np.zeros(len(h), np.int64)
        count[ends] = (own + other)[inverse]
        counts.append(count)
    return Automaton(total, types, at, counts)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).selectExpr("doc_id", f"{held_out('doc_id', 5, 1)} as held_out", "text")
    blocks = _blocks(rows)
    chars = blocks.agg(F.sum("chars")).first()[0] or 0
    answers = _answers(_requests(blocks, max(0, chars // CHARS_PER_BUCKET).bit_length()))
    total, types = (int(x or 0) for x in answers.agg(F.sum("total"), F.sum("types")).first())

    def read(packed: pa.Table, answers: pa.Table) -> pa.Table:
        parts, h, at, learned = _unpacked(packed["packed"][0])
        n, known, base, full = _automaton(h, at, learned, answers, total, types).read()
        own = pa.Table.from_batches(parts).select(["doc_id", "held_out"])
        columns = {"n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total), "base_score": base, "score": full}
        return pa.table({"doc_id": own["doc_id"], "held_out": own["held_out"], **{name: pa.array(x) for name, x in columns.items()}})

    kind = docs.schema[doc_id].dataType.simpleString()
    both = blocks.select("block", "packed").groupBy("block").cogroup(answers.select("block", "kind", "bucket", "other").groupBy("block"))
    return both.applyInArrow(read, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
