"""SentencePiece encoding and decoding by suffix-array matching.

The new chunks of a slice of texts are concatenated and indexed by a suffix array
(suffixes compared as far as the longest piece). Every vocabulary piece is found
by binary search as a range of suffixes; the ranges become edges (start, end,
piece), which are sorted by position and relaxed from left to right.

The public vocabulary is a byte-pair one, whose encoding is not a best-scored path.
Relaxing therefore keeps, for each position, the last piece of the encoding of
the text up to there: an edge is taken if merging its piece after the piece that
ends at its start leaves both as they are. Exactly one edge into a position
passes, and the path through those edges is the byte-pair encoding.

A text is cut wherever two neighbouring characters stand side by side in no piece,
for no edge can cross there; each distinct chunk between cuts is worked on once.
Edges are relaxed for all chunks of a slice together, by their place in the chunk.

Cases: null and empty texts have no ids. Repeated rows are encoded one by one.
Characters without a piece become their bytes. Texts are read whole. Decoding
drops the leading mark's space; a mark that the text itself holds decodes to a
space, as in the library. Only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
CACHE = 400_000
"""Distinct chunks, and piece pairs, that a worker remembers."""
BEGIN, UNKNOWN = -1, -2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, merge order and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.texts[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.id = {self.texts[i]: i for i in plain}
        self.score = {t: model.get_score(i) for t, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.plain = np.array(plain)
        self.lengths = np.ones(size, np.int64)
        self.lengths[plain] = [len(self.texts[i]) for i in plain]
        self.codes = np.zeros((len(plain), self.longest), np.uint32)  # code points, 0 behind the end
        for row, i in enumerate(plain):
            self.codes[row, : len(self.texts[i])] = [ord(x) for x in self.texts[i]]
        # Which characters stand side by side in a piece.
        left, right = self.codes[:, :-1].ravel(), self.codes[:, 1:].ravel()
        left, right = left[right > 0], right[right > 0]
        joined = np.unique(np.r_[left, right])
        self.number = np.zeros(0x110000, np.int32)  # 0: in no piece of two characters or more
        self.number[joined] = np.arange(1, len(joined) + 1)
        self.beside = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        self.beside[self.number[left], self.number[right]] = True
        self.valid: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding by its definition: again and again the best pair, the leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                v = self.score.get(s[k] + s[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def stay(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece, put behind the one before it, is encoded as just these two.

        Behind BEGIN or an UNKNOWN character, with which nothing merges: as just itself.
        """
        key, inverse = np.unique((before + 2) * len(self.texts) + piece, return_inverse=True)
        if len(self.valid) > CACHE:
            self.valid.clear()
        found = [self.valid.get(k) for k in key.tolist()]
        for n, k in enumerate(key.tolist()):
            if found[n] is None:
                a, b = k // len(self.texts) - 2, k % len(self.texts)
                pair = [self.texts[a], self.texts[b]] if a >= 0 else [self.texts[b]]
                found[n] = self.valid[k] = self.merge("".join(pair)) == pair
        return np.array(found, bool)[inverse]


@functools.lru_cache(maxsize=1)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_edges(c: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece id) of every occurrence of every piece in the code points c; NUL is in no piece."""
    letters, rank = np.unique(np.r_[np.uint32(0), c], return_inverse=True)
    width, kind = vocabulary.longest, ">u2" if len(letters) < 0xFFFF else ">u4"
    padded = np.zeros(len(c) + width, kind)
    padded[: len(c)] = rank[1:]
    item = padded.dtype.itemsize
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(c)]).view(f"S{width * item}").ravel()
    suffixes = np.argsort(windows, kind="stable")
    windows = windows[suffixes]
    number = np.zeros(0x110000, kind)
    number[letters] = np.arange(len(letters))
    coded, inside = number[vocabulary.codes], vocabulary.codes > 0
    fits = ~(inside & (coded == 0)).any(1)
    coded, inside, ids = coded[fits], inside[fits], vocabulary.plain[fits]
    first = np.searchsorted(windows, np.ascontiguousarray(coded).view(windows.dtype).ravel(), "left")
    coded[~inside] = np.iinfo(kind).max
    last = np.searchsorted(windows, np.ascontiguousarray(coded).view(windows.dtype).ravel(), "right")
    count = last - first
    which = np.repeat(np.arange(len(ids)), count)
    start = suffixes[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(which))]
    return start, start + vocabulary.lengths[ids[which]], ids[which]


def relax(chunks: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each chunk, packed."""
    text = "\0".join(chunks) + "\0"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in chunks])
    base = np.cumsum(np.r_[0, size[:-1] + 1])
    start, end, piece = suffix_edges(c, vocabulary)
    origin = np.repeat(base, size + 1)[start]
    order = np.lexsort((start, end - origin))  # by position in the chunk
    start, end, piece, origin = start[order], end[order], piece[order], origin[order]
    step = np.flatnonzero(np.diff(end - origin, prepend=0))
    last = np.full(len(c) + 1, UNKNOWN, np.int64)  # the last piece of the encoding up to here
    for a, b in zip(step, np.r_[step[1:], len(end)]):
        s, t = start[a:b], piece[a:b]
        ok = vocabulary.stay(np.where(s == origin[a:b], BEGIN, last[s]), t)
        last[end[a:b][ok]] = t[ok]
    # Back from the end of all chunks at once.
    at, open_, found = base + size, np.arange(len(chunks)), []
    while len(open_):
        p = at[open_]
        t = last[p]
        found.append((open_, t, p))
        at[open_] = p - np.where(t < 0, 1, vocabulary.lengths[t])
        open_ = open_[at[open_] > base[open_]]
    chunk, ids, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, chunk))
    chunk, ids, place = chunk[order], ids[order], place[order]
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):  # the bytes of a character without a piece
        coded = [chr(x).encode("utf-8", "replace") for x in c[place[unknown] - 1].tolist()]
        times = np.ones(len(ids), np.int64)
        times[unknown] = [len(x) for x in coded]
        chunk, ids = np.repeat(chunk, times), np.repeat(ids, times)
        ids[ids < 0] = [vocabulary.byte[b] for x in coded for b in x]
    packed, edge = ids.astype("<u4").tobytes(), 4 * np.searchsorted(chunk, np.arange(len(chunks) + 1))
    return [packed[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def cut(texts: list[str], vocabulary: Vocabulary) -> list[list[str]]:
    """The chunks of each text: cut where no piece has the two characters side by side."""
    marked = [(MARK + t).replace(" ", MARK) if t else "" for t in texts]
    whole = "".join(marked)
    n = vocabulary.number[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.cumsum([0, *map(len, marked)])
    apart = np.ones(len(n) + 1, bool)
    apart[1:-1] = ~vocabulary.beside[n[:-1], n[1:]]
    apart[at] = True
    edge = np.flatnonzero(apart)
    first, edge = np.searchsorted(edge, at), edge.tolist()
    parts = [whole[a:b] for a, b in zip(edge[:-1], edge[1:])]
    return [parts[a:b] for a, b in zip(first[:-1], first[1:])]


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each text as unsigned 32-bit values."""
    parts = cut(texts, vocabulary)
    known = vocabulary.known
    new = set().union(*parts).difference(known)
    if len(known) + len(new) > CACHE:
        known.clear()
        new = set().union(*parts)
    known["\0"] = array("I", [vocabulary.byte[0]]).tobytes()  # a character that no piece has
    new = list(new - {"\0"})
    if new:
        known.update(zip(new, relax(new, vocabulary)))
    return [b"".join(map(known.__getitem__, p)) for p in parts]


def decode_ids(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of packed ids: runs of byte pieces are read as UTF-8, marks become spaces, the first one goes."""
    out, run = [], bytearray()
    texts, byte_of = vocabulary.texts, vocabulary.byte_of
    for i in array("I", ids):
        b = byte_of.get(i)
        if b is not None:
            run.append(b)
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run = bytearray()
        if i not in vocabulary.silent:
            out.append(texts[i])
    if run:
        out.append(run.decode("utf-8", "replace"))
    text = "".join(out)
    return text.removeprefix(MARK).replace(MARK, " ")


# --- on documents -------------------------------------------------------------


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and its ids as an array of int."""
    path, kind = path or vocabulary(), docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        v = load(path)
        for batch in batches:
            for first, texts in slices(batch, "text"):
                coded = encode_texts(texts, v)
                at = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; null ids give a null text."""
    path, kind = path or vocabulary(), coded.schema[doc_id].dataType.simpleString()

    def work(batches):
        v = load(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(array("I", x).tobytes(), v) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(work, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_sha256 of every row."""
    path, kind = path or vocabulary(), docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        v = load(path)
        for batch in batches:
            for first, texts in slices(batch, "text"):
                coded = encode_texts(texts, v)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(c) // 4 for c in coded], pa.int64()),
                        pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                        pa.array([hashlib.sha256(decode_ids(c, v).encode("utf-8", "surrogatepass")).hexdigest() for c in coded]),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string")
