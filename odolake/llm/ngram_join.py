"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles, each a 64-bit hash. The
shingles are ordered from rare to frequent by a count sketch of fixed size over
all documents. Two sets of Jaccard similarity t share at least l of the first
``n - ceil(t n) + l`` shingles of each, for any l. Each document chooses its l from
the estimated cost of its candidates: where the lists of its prefix are long it
takes a longer prefix and asks for more matches; a pair goes by the smaller l of
the two.

1. One pass makes the set's size and hash of every document, and the sketch.
2. One pass posts the prefixes, packed by shingle; equal sets within a batch post
   once. Tasks sort their shingles and keep the lists of two sets or more. A shingle
   that the sketch shows to be very frequent is dealt over several tasks.
3. Star round: the centre of a list is the set that starts rarest. Each set is
   tried with the TRIES centres it shares most lists with. Exact verification and
   connected components then contract the lists, so a group of copies never meets
   pairwise.
4. Exact round: pairs of different components that meet in the prefixes that a
   pair of just their sizes needs, and share enough of all they posted, are
   verified. Nothing is capped.

Equal sets are one node, the set's 64-bit hash; a doc_id is looked up at the end.
Only counts, the sketch and bitmaps of fixed size pass through the driver. Tables of
a round are deleted once the next one is written.

Cases: null, empty and blank texts have no shingle and are linked with nothing;
fewer words than five make one shingle. A null doc_id keeps its row, is linked
with nothing and has a null component. Repeated rows share a set, hence a
component. Rows that repeat a doc_id with different texts are sets of their own; the
id names every component that one of them is in. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keep import discard, keep
from .common import mix, slices, word_hashes

WORDS = 5
PERCENT = 75
SLICE = 1 << 18
"""Characters whose words a task holds at a time, a longer text excepted."""
SKETCH = 1 << 20
CHUNK = 1 << 14
LEVELS = 4
"""Most shared prefix shingles that a document may ask for."""
VERIFY_COST, POST_COST = 50.0, 2.0
"""Costs of verifying a candidate and of posting a shingle, in reads of a list's entry."""
PER_BUCKET = 1 << 18
BITMAP = 1 << 24
TRIES = 3
"""Centres that a set is tried with."""
MEMBERS = 512
"""Sets that one task compares with one centre at a time."""
HOT = 1 << 18
"""Estimated posts of a shingle that one task lists."""
PART = 1 << 12
"""Entries of a list that one task joins with the whole list."""
SPREAD = 16
"""Parts that the sets of a component are named in."""

_WORD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts)
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        run += h[j : j + len(run)] * _WORD[j]
    run = mix(run)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _WORD[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A hash of the set as a signed 64-bit number."""
    return int(mix(np.array([mix(s ^ np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _first_seen(texts: list[str], seen: set[int]):
    """(key, set) of the sets that are not empty and not in ``seen`` yet."""
    for s in shingle_sets(texts):
        if len(s):
            key = set_key(s)
            if key not in seen:
                seen.add(key)
                yield key, s


# --- pass 1 -------------------------------------------------------------------

_PASS1 = "doc_id long, h long, n long, k long, part int, chunk int, counts binary"


def _describe(batches):
    counts = np.zeros(SKETCH, np.uint32)
    empty, names = pa.nulls, ["doc_id", "h", "n", "k", "part", "chunk", "counts"]
    for batch in batches:
        seen: set[int] = set()
        for first, texts in slices(batch, "text", SLICE):
            sets = shingle_sets(texts)
            keys = [set_key(s) for s in sets]
            new = [s for s, k in zip(sets, keys) if len(s) and not (k in seen or seen.add(k))]
            if new:
                counts += np.bincount((np.concatenate(new) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            m = len(texts)
            own = [batch.column(c).slice(first, m) for c in ("doc_id", "h")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), empty(m, pa.int32()), empty(m, pa.int32()), empty(m, pa.binary())], names=names)
    if counts.any():
        blobs = [zlib.compress(counts[a : a + CHUNK].tobytes(), 1) for a in range(0, SKETCH, CHUNK)]
        m, part = len(blobs), TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays([*(empty(m, pa.int64()) for _ in range(4)), pa.array([part] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(blobs, pa.binary())], names=names)


def _add_up(key, table):
    total = sum(np.frombuffer(zlib.decompress(b.as_py()), np.uint32).astype(np.uint64) for b in table["counts"])
    blob = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
    return pa.table({"chunk": pa.array([key[-1].as_py()], pa.int32()), "counts": pa.array([blob], pa.binary())})


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed sketch, SKETCH numbers, in two levels of partial sums."""
    rows = described.where("chunk is not null").select("part", "chunk", "counts")
    rows = rows.groupBy("part", "chunk").applyInArrow(_add_up, "chunk int, counts binary")
    rows = rows.groupBy("chunk").applyInArrow(_add_up, "chunk int, counts binary")
    out = np.zeros(SKETCH, np.uint32)
    for r in rows.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out


# --- pass 2: prefixes to lists ------------------------------------------------


def least_overlap(n, percent: int = PERCENT):
    """ceil(t n): what a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def choose_level(estimate: np.ndarray, n: int) -> int:
    """The l of least estimated cost, given the list lengths of the ordered shingles."""
    tau = least_overlap(n)
    base = n - tau + 1
    read = np.cumsum(estimate[: min(n, base + LEVELS - 1)])
    level = np.arange(1, min(LEVELS, tau) + 1)
    length = base + level - 1
    return int(level[np.argmin(read[length - 1] * (1 + VERIFY_COST / level) + POST_COST * length)])


def prefix(s: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[np.ndarray, int, np.ndarray]:
    """The shingles to post, rarest first, the level, and how often each is estimated to occur."""
    count = sketch[(s % np.uint64(len(sketch))).astype(np.int64)]
    s = s[np.lexsort((s, count))]
    count.sort()
    estimate = np.maximum(0.0, count - noise - 1)
    level = choose_level(estimate, len(s))
    length = len(s) - least_overlap(len(s)) + level
    return s[:length], level, estimate[:length]


_RECORD = np.dtype([("token", "<u8"), ("k", "<i8"), ("n", "<u4"), ("place", "<u4")])
_TOKEN_BYTES = 6
_POSTS = "bucket int, tokens binary, keys binary, sizes binary"
_LISTS = "list long, k long, n long, pos long, level int, ck long, cn long, cl int"


def _pack(r: np.ndarray, whole: bool) -> tuple[bytes, bytes, bytes]:
    """Shingles (the low bytes alone where the bucket is known from the high ones), keys, and sizes byte by byte."""
    tokens = np.ascontiguousarray(r["token"]).view(np.uint8).reshape(-1, 8)
    sizes = np.stack([r["n"], r["place"]], axis=1).view(np.uint8).reshape(-1, 8)
    return tokens[:, : 8 if whole else _TOKEN_BYTES].tobytes(), r["k"].tobytes(), zlib.compress(sizes.T.tobytes(), 1)


def _unpack(tokens: bytes, keys: bytes, sizes: bytes) -> np.ndarray:
    r = np.empty(len(keys) // 8, _RECORD)
    wide = np.zeros((len(r), 8), np.uint8)
    own = np.frombuffer(tokens, np.uint8).reshape(len(r), -1)
    wide[:, : own.shape[1]] = own
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(sizes), np.uint8).reshape(8, -1).T).view(np.uint32)
    r["token"], r["k"], r["n"], r["place"] = wide.view(np.uint64)[:, 0], np.frombuffer(keys, np.int64), both[:, 0], both[:, 1]
    return r


def _poster(shared, buckets: int):
    def post(batches):
        sketch = shared.value
        noise = 1.2 * float(sketch.mean()) + 3 * math.sqrt(float(sketch.mean()) + 1)
        for batch in batches:
            seen: set[int] = set()
            parts, frequent = [], []
            for _, texts in slices(batch, "text", SLICE):
                for key, s in _first_seen(texts, seen):
                    tokens, level, estimate = prefix(s, sketch, noise)
                    r = np.empty(len(tokens), _RECORD)
                    r["token"], r["k"], r["n"], r["place"] = tokens, key, len(s), np.arange(len(tokens)) * 8 + level
                    parts.append(r)
                    frequent.append(estimate // HOT)
            if not parts:
                continue
            r, shares = np.concatenate(parts), np.concatenate(frequent).astype(np.uint64)
            bucket = ((r["token"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            # The sets of a hot shingle go to as many tasks as its share asks for, numbered below zero.
            part = mix(r["k"].view(np.uint64)) % (shares + np.uint64(1))
            bucket = np.where(shares > 0, -1 - ((mix(r["token"] ^ part) % np.uint64(buckets)).astype(np.int64)), bucket)
            order = np.argsort(bucket, kind="stable")
            r, bucket = r[order], bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            packed = [_pack(r[a:b], bucket[a] < 0) for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*packed))], names=["bucket", "tokens", "keys", "sizes"])

    return post


def _lists(key, table):
    """The lists of two different sets or more, each entry with the list's centre (least place, then least key).

    Entries of hot shingles all stay, under the shingle's own (negative) number and without a centre.
    """
    bucket = key[0].as_py()
    r = np.concatenate([_unpack(t.as_py(), k.as_py(), z.as_py()) for t, k, z in zip(table["tokens"], table["keys"], table["sizes"])])
    r = r[np.lexsort((r["k"], r["place"] >> 3, r["token"]))]
    fresh = np.ones(len(r), bool)  # equal sets of different batches posted the same entries
    fresh[1:] = (r["token"][1:] != r["token"][:-1]) | (r["k"][1:] != r["k"][:-1]) | (r["place"][1:] != r["place"][:-1])
    r = r[fresh]
    start = np.flatnonzero(np.r_[True, r["token"][1:] != r["token"][:-1]])
    size = np.diff(np.r_[start, len(r)])
    if bucket < 0:
        number, many = r["token"].astype(np.int64) | np.int64(-1 << 63), np.ones(len(r), bool)
    else:
        number, many = (np.int64(bucket) << 36) + np.repeat(np.arange(len(start)), size), np.repeat(size, size) > 1
    centre = r[np.repeat(start, size)[many]]
    r = r[many]
    columns = {
        "list": number[many],
        "k": np.ascontiguousarray(r["k"]),
        "n": r["n"].astype(np.int64),
        "pos": (r["place"] >> 3).astype(np.int64),
        "level": (r["place"] & 7).astype(np.int32),
    }
    centres = {"ck": np.ascontiguousarray(centre["k"]), "cn": centre["n"].astype(np.int64), "cl": (centre["place"] & 7).astype(np.int32)}
    return pa.table(columns | {c: pa.array(v, mask=np.full(len(r), bucket < 0)) for c, v in centres.items()})


def _centred(lists: DataFrame) -> DataFrame:
    """``lists`` with the centres of hot shingles, found by partial minima."""
    hot = lists.where("list < 0")
    best = hot.groupBy("list").agg(F.min(F.struct("pos", F.col("k").alias("ck"), F.col("n").alias("cn"), F.col("level").alias("cl"))).alias("c"))
    hot = hot.drop("ck", "cn", "cl").join(best, "list").select("list", "k", "n", "pos", "level", "c.ck", "c.cn", "c.cl")
    return lists.where("list >= 0").unionByName(hot)


# --- verification -------------------------------------------------------------


def _bitmap(keys: DataFrame, at: str = "k") -> np.ndarray:
    """BITMAP bits, set for (at least) the values that the SQL expression ``at`` has in ``keys``."""
    at = keys.selectExpr(f"pmod({at}, {BITMAP}) as at")
    words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(BITMAP // 64, np.int64)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _among(table: DataFrame, keys: DataFrame, at: str) -> DataFrame:
    """``table`` with ``hit``: whether the value of ``at`` is among those of ``keys``, or (seldom) only seems so."""
    shared = table.sparkSession.sparkContext.broadcast(_bitmap(keys, at))

    def test(batches):
        for batch in batches:
            at = batch.column("hit").to_numpy()
            hit = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1
            yield batch.set_column(batch.schema.get_field_index("hit"), "hit", pa.array(hit.astype(bool)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.withColumn("hit", F.expr(f"pmod({at}, {BITMAP})")).mapInArrow(test, f"{kinds}, hit boolean")


def _sets_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """k and set (bytes) of every distinct set whose key is among ``keys``, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def fetch(batches):
        bits = shared.value
        for batch in batches:
            seen: set[int] = set()
            for _, texts in slices(batch, "text", SLICE):
                found = []
                for key, s in _first_seen(texts, seen):
                    at = key % BITMAP
                    if bits[at >> 3] >> (at & 7) & 1:
                        found.append((key, s.tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["k", "set"])

    return docs.select("text").mapInArrow(fetch, "k long, set binary").dropDuplicates(["k"])


def _compare(batches):
    """Rows come as a centre (b null) and then its members; yields the pairs that link."""
    centre, key = None, None
    for batch in batches:
        a_out, b_out = [], []
        for a, b, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), batch.column("set")):
            s = np.frombuffer(blob.as_py(), np.uint64)
            if b is None:
                centre, key = s, a
                continue
            if a != key:
                raise ValueError("a centre is missing")
            small, large = (s, centre) if len(s) <= len(centre) else (centre, s)
            both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if 100 * both >= PERCENT * (len(s) + len(centre) - both):
                a_out.append(a)
                b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets link, by exact comparison."""
    pairs = keep(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k")))
    salts = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {MEMBERS}) as int)").alias("salts"))
    members = pairs.join(salts, "a").selectExpr("b as k", "a", "cast(pmod(xxhash64(b), salts) as int) as salt", "b")
    centres = salts.selectExpr("a as k", "a", "explode(sequence(0, salts - 1)) as salt", "cast(null as bigint) as b")
    # One join sends each set to all the places that compare it.
    wanted = members.unionByName(centres).join(_sets_of(docs, ends), "k").select("a", "salt", "b", "set")
    both = wanted.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    links = keep(both.mapInArrow(_compare, "a long, b long"), "links")
    discard(pairs)
    return links


# --- components ---------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """k and root (the least key of its component) of every key in ``links`` but the roots, by alternating star contractions."""
    edges = keep(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v")).distinct()
        new = keep(small, "edges")
        digest = [e.selectExpr("count(*) as n", "bit_xor(xxhash64(u, v)) as h").first() for e in (edges, new)]
        discard(edges)
        edges = new
        if digest[0] == digest[1]:
            return edges.selectExpr("u as k", "v as root")


# --- rounds -------------------------------------------------------------------


def _rooted(lists: DataFrame, rooted: DataFrame) -> DataFrame:
    """The lists with the root of each entry and the parts that a list is dealt over; those of one component only are left out.

    ``rooted``: k, root of the sets that link with another one, but the roots.
    """
    entries = _among(lists.select("list", "k", "n", "pos", "level"), rooted.select("k"), "k")
    known = entries.where("hit").join(rooted, "k", "left").selectExpr("list", "k", "n", "pos", "level", "coalesce(root, k) as root")
    # Written, so that no task holds two Python workers.
    both = keep(known.unionByName(entries.where("not hit").selectExpr("list", "k", "n", "pos", "level", "k as root")), "labelled")
    found = both.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y")
    open_ = keep(found.selectExpr("list", f"cast(ceil(size / {PART}) as int) as parts"), "open")
    rooted = keep(_among(both, open_, "xxhash64(list)").where("hit").drop("hit").join(open_, "list"), "lists")
    discard(open_, both)
    return rooted


def _needed(n: str, level: str, m: str, other: str) -> str:
    """SQL: prefix shingles that two sets of n and m share at least if they link.

    One of the two prefixes is known to its end on both sides. Behind it that set
    has ``least_overlap(n) - level`` shingles, so the rest must lie within it.
    """
    overlap = f"ceil({PERCENT} * ({n} + {m}) / {100 + PERCENT})"
    behind = [f"ceil({PERCENT} * {x} / 100) - {y}" for x, y in ((n, level), (m, other))]
    return f"({overlap} - greatest({', '.join(behind)}))"


_SIZES = f"100 * least(n, cn) >= {PERCENT} * greatest(n, cn)"


def _stars(lists: DataFrame) -> DataFrame:
    """Each set with the centres it shares most lists with.

    A centre need not be one in all lists that two sets share, so half of what a
    link needs will do here; what this leaves out is left to the exact round.
    """
    pairs = lists.where("k <> ck").where(_SIZES).groupBy("k", "n", "level", "ck", "cn", "cl").agg(F.count("*").alias("shared"))
    pairs = pairs.where(f"2 * shared >= {_needed('n', 'level', 'cn', 'cl')}")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("shared"), "ck"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= TRIES).selectExpr("ck as a", "k as b")


def _exact(rooted: DataFrame) -> DataFrame:
    """All pairs of different components that can still link.

    Sets of n and m shingles that share ``overlap`` of them share one of their
    first ``n - overlap + 1`` and ``m - overlap + 1``; the lists are joined on those.
    A pair found so must then share as many of all posted shingles as its levels
    ask for.
    """
    x = rooted.selectExpr("list", "cast(pmod(xxhash64(k), parts) as int) as part", "k as a", "n as na", "pos as pa", "root as ra")
    y = rooted.selectExpr("list as t", "explode(sequence(0, parts - 1)) as p", "k as b", "n as nb", "pos as pb", "root as rb")
    overlap = f"ceil({PERCENT} * (na + nb) / {100 + PERCENT})"
    met = x.join(
        y,
        F.expr(
            f"list = t and part = p and ra <> rb and (na < nb or na = nb and a < b) and 100 * na >= {PERCENT} * nb"
            f" and pa <= na - {overlap} and pb <= nb - {overlap}"
        ),
    )
    pairs = keep(met.select("a", "b").distinct(), "met")
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k")))
    posted = _among(rooted.select("list", "k", "n", "level"), ends, "k").where("hit").groupBy("k", "n", "level").agg(F.collect_list("list").alias("lists"))
    posted = keep(posted, "posted")
    both = pairs.join(posted.selectExpr("k as a", "n", "level", "lists"), "a").join(posted.selectExpr("k as b", "n as m", "level as other", "lists as others"), "b")
    found = keep(both.where(f"size(array_intersect(lists, others)) >= {_needed('n', 'level', 'm', 'other')}").select("a", "b"), "found")
    discard(pairs, posted)
    return found


def _links(docs: DataFrame, described: DataFrame) -> DataFrame:
    """k, root of all sets that link with another one, but the roots."""
    rows = described.where("chunk is null")
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(described))
    total = rows.where("n > 0").agg(F.sum(F.expr(f"n * {100 - PERCENT} / 100 + 2"))).first()[0] or 0
    buckets = max(1, math.ceil(total / PER_BUCKET))
    posted = docs.where("doc_id is not null").select("text").mapInArrow(_poster(shared, buckets), _POSTS)
    lists = keep(posted.groupBy("bucket").applyInArrow(_lists, _LISTS), "lists")
    links = verify(docs, _stars(_centred(lists)))
    rooted = _rooted(lists, components(links))
    discard(lists)
    links = links.union(verify(docs, _exact(rooted)))
    discard(rooted)
    return components(links)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, h (hash of the text), n, k of every row, and k, root of the sets that link (but the roots); k is null without a shingle or an id."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    described = keep(docs.mapInArrow(_describe, _PASS1), "described")
    rows = described.where("chunk is null").selectExpr("doc_id", "h", "n", "case when n > 0 and doc_id is not null then k end as k")
    return rows, _links(docs, described)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, linked = classes(docs, doc_id, text)
    sets = rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"))
    linked = linked.unionByName(linked.selectExpr("root as k", "root").distinct()).join(sets, "k").withColumn("part", F.expr(f"cast(pmod(k, {SPREAD}) as int)"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    named = sets.join(linked.join(least, ["root", "part"]).select("k", "component_id"), "k", "left").selectExpr("k", "coalesce(component_id, least) as component_id")
    known = rows.where("k is not null").join(named, "k").selectExpr("doc_id", "n as n_shingles", "component_id")
    return known.unionByName(rows.where("k is null").selectExpr("doc_id", "n as n_shingles", "doc_id as component_id"))


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row for each component: that of its smallest doc_id, ties by the hash of the text.

    Rows that link with nothing stay, equal ones once; rows with a null id all stay.
    """
    rows, linked = classes(docs)
    rooted = rows.where("k is not null").join(linked, "k", "left").withColumn("root", F.coalesce("root", "k"))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("f.doc_id", "f.h")
    alone = rows.where("k is null and doc_id is not null").select("doc_id", "h").distinct()
    i, h, own = (_unused(c, docs.columns) for c in ("first_id", "first_hash", "own_hash"))
    chosen = first.union(alone).toDF(i, h)
    hashed = docs.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(chosen, (hashed["doc_id"] == chosen[i]) & (hashed[own] == chosen[h]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own).unionByName(docs.where("doc_id is null"))
