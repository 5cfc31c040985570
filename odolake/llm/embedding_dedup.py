"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the axes of the table's second
moments, strongest first. Equal vectors of a label are one node with a count. The
nodes are range-partitioned by label and their places along the first axes and cut
into tiles of TILE; a tile knows the box that its nodes lie in. Only tiles of one label
whose boxes come within the distance that the threshold allows are compared.

Two tiles are compared block by block. The products of the leading axes are added
up first; what the others can add is at most the product of the two suffix norms.
Rows and columns without a pair that can still reach the threshold fall out, and a
pair of blocks without any stops. Pairs that are left are decided by the cosine of
the original vectors in double precision.

No pair leaves a task: a task sends each node's number of links and, of its links, a
forest (at most one edge a node). The components of all forests are the classes.

Cases: a vector that is null, empty, zero or holds null or non-finite components links
with nothing, nor does one without a label or an id; it keeps its row, without links
and as its own component (null without an id). Only vectors of equal length meet.
Rows that repeat an id are rows of their own and link like others; a component is
named by the smallest id. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keep import keep
from .ngram_join import components
from .vector_blocks import matrix

THRESHOLD = 0.98
TILE, BLOCK = 4096, 512
"""Nodes of a tile, and of a block of it."""
COMPONENTS = 1 << 19
"""Components of a tile at most, so that long vectors make smaller tiles."""
LEADING = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
"""Axes after which the bound is looked at."""
BOX_AXES, CELL_AXES = 16, 3
"""Axes of a tile's box, and of the cells that the nodes are ordered by."""
PARTNERS = 16
"""Tiles that a task compares with one tile at a time."""
ROWS_PER_PART = 65_536
TILES_PER_GROUP = 1024
"""Tiles of a label that one task matches with all others of the label."""
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows by their largest component, so that no square overflows or vanishes."""
    return x / np.abs(x).max(axis=1, keepdims=True)


# --- axes ---------------------------------------------------------------------


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length the axes (columns), strongest first. ``rows``: dim, v."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                x = unit(scaled(matrix(table.filter(pa.array(dims == dim)), "v", dim).astype(np.float64)))
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], names=["dim", "axis", "s"])

    def add(key, table):
        total = matrix(table, "s", key[0].as_py()).sum(0)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "axis": pa.array([key[1].as_py()], pa.int32()), "s": pa.array([total], pa.list_(pa.float64()))})

    schema = "dim int, axis int, s array<double>"
    summed: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(moments, schema).groupBy("dim", "axis").applyInArrow(add, schema).collect():
        summed.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["axis"]] = r["s"]
    return {dim: np.linalg.eigh((s + s.T) / 2)[1][:, ::-1].copy() for dim, s in summed.items()}


# --- tiles --------------------------------------------------------------------

_PER_NODE = ["copies", "least", "k1", "k2"]
_TILES = "tile long, n int, label {label}, dim int, lo array<double>, hi array<double>, axes binary, vectors binary, copies binary, least binary, k1 binary, k2 binary"


def tiles(nodes: DataFrame, axes, reach: float, label: str, tile: int) -> DataFrame:
    """One row per tile: its nodes' turned and original vectors, copies and least ids, and its box.

    ``nodes``: label, dim, v, copies, least, k1, k2. A node's number is its tile's times ``tile`` plus its place.
    """
    kind = nodes.schema["v"].dataType.simpleString()
    cells = ["c0", "c1", "c2"][:CELL_AXES]

    def turn(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim))
                z = unit(scaled(matrix(part, "v", dim).astype(np.float64))) @ axes.value[dim]
                place = [np.floor(z[:, k] / reach) if k < dim else np.zeros(len(z)) for k in range(CELL_AXES)]
                for k, c in enumerate(cells):
                    part = part.append_column(c, pa.array(place[k]))
                yield from part.append_column("z", pa.array(z[:, 0])).combine_chunks().to_batches()

    turned = nodes.mapInArrow(turn, f"label {label}, dim int, v {kind}, copies long, least long, k1 long, k2 long, {', '.join(c + ' double' for c in cells)}, z double")
    order = ["label", "dim", *cells, "z", "least"]
    parts = max(1, -(-nodes.count() // ROWS_PER_PART))
    ordered = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*nodes.columns)

    def pack(batches):
        number = TaskContext.get().partitionId() << 24
        held: list[pa.Table] = []

        def packed(table: pa.Table):
            nonlocal number
            label_, dim = table["label"].slice(0, 1), table["dim"][0].as_py()
            v = matrix(table, "v", dim)
            z = unit(scaled(v.astype(np.float64))) @ axes.value[dim]
            number += 1
            box = z[:, :BOX_AXES]
            return pa.table(
                {
                    "tile": pa.array([number - 1], pa.int64()),
                    "n": pa.array([len(z)], pa.int32()),
                    "label": label_,
                    "dim": pa.array([dim], pa.int32()),
                    "lo": pa.array([box.min(0)], pa.list_(pa.float64())),
                    "hi": pa.array([box.max(0)], pa.list_(pa.float64())),
                    "axes": pa.array([z.astype(np.float32).tobytes()], pa.binary()),
                    "vectors": pa.array([v.tobytes()], pa.binary()),
                    **{c: pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in _PER_NODE},
                }
            ).to_batches()

        def full(last: bool):
            """Tiles of what is held; the rows of an open one stay."""
            nonlocal held
            table = pa.concat_tables(held).combine_chunks()
            keys = list(zip(table["label"].to_pylist(), table["dim"].to_pylist()))
            edge = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            held = []
            for a, b in zip(edge, edge[1:]):
                most = min(tile, max(BLOCK, COMPONENTS // keys[a][1]))
                while b - a >= most or (b > a and (last or b < len(keys))):
                    n = min(most, b - a)
                    yield from packed(table.slice(a, n))
                    a += n
                if b > a:
                    held = [table.slice(a, b - a)]

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                if sum(t.num_rows for t in held) >= tile:
                    yield from full(False)
        if held:
            yield from full(True)

    return keep(ordered.mapInArrow(pack, _TILES.format(label=label)), "tiles")


def near_tiles(made: DataFrame, reach: float) -> DataFrame:
    """a and b (a <= b): tiles of one label and length whose boxes are no farther apart than ``reach``."""
    boxes = made.select("tile", "label", "dim", "lo", "hi")
    most = boxes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-most // TILES_PER_GROUP))
    a = boxes.selectExpr("tile as a", "label", "dim", "lo as alo", "hi as ahi", f"cast(pmod(xxhash64(tile), {groups}) as int) as part")
    b = boxes.selectExpr("tile as b", "label", "dim", "lo as blo", "hi as bhi", f"explode(sequence(0, {groups - 1})) as part")
    gap = "zip_with(zip_with(alo, bhi, (x, y) -> x - y), zip_with(blo, ahi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    apart = f"aggregate({gap}, 0D, (s, x) -> s + x * x)"
    return a.join(b, ["label", "dim", "part"]).where("a <= b").where(f"{apart} <= {reach * reach + SLACK}").select("a", "b")


# --- comparison ---------------------------------------------------------------


class Side:
    """The nodes of a tile, cut into blocks, with the norms of what lies behind each number of leading axes."""

    def __init__(self, axes: np.ndarray, vectors: np.ndarray):
        self.z = axes
        self.x = unit(scaled(vectors.astype(np.float64)))
        self.stops = [k for k in LEADING if k < axes.shape[1]] + [axes.shape[1]]
        square = axes.astype(np.float64) ** 2
        self.behind = {k: np.sqrt(square[:, k:].sum(1)) for k in self.stops}

    def blocks(self) -> list[np.ndarray]:
        return [np.arange(a, min(a + BLOCK, len(self.z))) for a in range(0, len(self.z), BLOCK)]


def linked(a: Side, rows: np.ndarray, b: Side, cols: np.ndarray, threshold: float, counters: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place in a, place in b) of two blocks whose cosine reaches the threshold.

    Turned vectors are single precision, hence the margin of the bound.
    """
    margin = threshold - 1e-5
    product = np.zeros((len(rows), len(cols)), np.float32)
    done = 0
    for stop in a.stops:
        product += a.z[rows, done:stop] @ b.z[cols, done:stop].T
        if counters is not None:
            counters["products"] = counters.get("products", 0) + product.size * (stop - done)
        done = stop
        alive = product + np.outer(a.behind[stop][rows], b.behind[stop][cols]) >= margin
        r, c = alive.any(1), alive.any(0)
        if not r.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if 2 * r.sum() * c.sum() < alive.size:
            rows, cols, product, alive = rows[r], cols[c], product[np.ix_(r, c)], alive[np.ix_(r, c)]
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    good = np.concatenate([np.einsum("ij,ij->i", a.x[i[k : k + 65536]], b.x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)])
    return i[good], j[good]


class Forest:
    """Components of the nodes that a task sees, by numbers of its own."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


_RESULT = "node long, links long, root long"


def compare(members: pa.Table, threshold: float, tile: int) -> pa.Table:
    """Links of one tile (the row without a partner) with itself and others: node, links (with copies counted), root."""
    places = {b: k for k, b in enumerate(members["b"].to_pylist())}
    if None not in places:
        raise ValueError("a tile is missing")
    dim = members["dim"][0].as_py()

    def side(k: int) -> tuple[Side, np.ndarray]:
        n = members["n"][k].as_py()
        vectors = members["vectors"][k].as_py()
        kind = np.float32 if len(vectors) == 4 * n * dim else np.float64
        z = np.frombuffer(members["axes"][k].as_py(), np.float32).reshape(n, dim)
        return Side(z, np.frombuffer(vectors, kind).reshape(n, dim)), np.frombuffer(members["copies"][k].as_py(), np.int64)

    own, weight = side(places.pop(None))
    me = members["a"][0].as_py()
    order = sorted(places)
    sizes = [len(weight), *(members["n"][places[b]].as_py() if b != me else 0 for b in order)]
    at = np.cumsum([0, *sizes])
    links = np.zeros(at[-1], np.int64)
    forest = Forest(at[-1])
    for slot, b in enumerate(order, 1):
        other, copies, base = (own, weight, 0) if b == me else (*side(places[b]), at[slot])
        for x, rows in enumerate(own.blocks()):
            for y, cols in enumerate(other.blocks()):
                if b == me and y < x:
                    continue
                i, j = linked(own, rows, other, cols, threshold)
                if b == me and x == y:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, base + j, weight[i])
                    forest.add(i, base + j)
    hit = np.flatnonzero(links)
    number = np.concatenate([np.arange(len(weight)) + me * tile, *(np.arange(n) + b * tile for b, n in zip(order, sizes[1:]))])
    return pa.table({"node": number[hit], "links": links[hit], "root": number[forest.root[hit]]})


# --- the operator -------------------------------------------------------------


def _nodes(table: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as id, v (null where they link with nothing), k1, k2 (a hash of label and vector), and the nodes."""
    kind = table.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    whole = "size(x) > 0 and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(x, c -> c <> 0)"
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast(kind).alias("x"))
    rows = rows.selectExpr("id", "label", f"case when id is not null and label is not null and {whole} then x end as v").withColumn("dim", F.size("v"))
    rows = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64("v", "label"))})
    nodes = rows.where("v is not null").groupBy("label", "dim", "v", "k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    return rows.drop("label"), nodes.select("label", "dim", "v", "copies", "least", "k1", "k2")


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = table.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows, nodes = _nodes(table, vec_id, vector, label)
    nodes = keep(nodes, "nodes")
    axes = spark.sparkContext.broadcast(principal_axes(nodes.select("dim", "v")))
    made = tiles(nodes, axes, reach, table.schema[label].dataType.simpleString(), tile)
    pairs = keep(near_tiles(made, reach), "near")
    salts = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {PARTNERS}) as int)").alias("salts"))
    body = ["n", "dim", "axes", "vectors", "copies"]
    salted = pairs.join(salts, "a").selectExpr("a", "cast(pmod(xxhash64(b), salts) as int) as salt", "b")
    partners = salted.join(made.select("tile", *body), salted["b"] == made["tile"]).select("a", "salt", "b", *body)
    own = salts.join(made.select("tile", *body), salts["a"] == made["tile"]).select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(None).cast("long").alias("b"), *body)
    # A tile that is its own partner needs no second copy of its vectors.
    slim = partners.withColumns({c: F.when(F.col("a") != F.col("b"), F.col(c)) for c in ("axes", "vectors", "copies")})
    found = keep(slim.unionByName(own).groupBy("a", "salt").applyInArrow(lambda t: compare(t, threshold, tile), _RESULT), "links")
    links = found.where("node <> root").selectExpr("node as a", "root as b")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = named_nodes(made, tile).join(components(links), F.expr("node = k"), "left").withColumn("root", F.coalesce("root", "node"))
    named = keep(named.join(counted, "node", "left"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").selectExpr("k1", "k2", "copies - 1 + coalesce(links, 0) as n_links", "component_id")
    known = rows.where("v is not null").select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").selectExpr("id", "0L as n_links", "id as component_id")
    return known.unionByName(alone).selectExpr("id as vec_id", "n_links", "component_id", "id = component_id as kept")


def named_nodes(made: DataFrame, tile: int) -> DataFrame:
    """node, copies, least, k1, k2: the nodes of all tiles with their numbers."""

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                columns = [np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in range(1, 5)]
                node = batch.column(0)[k].as_py() * tile + np.arange(len(columns[0]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node, *columns)], names=["node", *_PER_NODE])

    return made.select("tile", *_PER_NODE).mapInArrow(unpack, "node long, copies long, least long, k1 long, k2 long")
