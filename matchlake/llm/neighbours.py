"""Approximate nearest neighbours by largest inner product: an NN-descent graph built
with Spark joins, searched greedily.

Copies. Equal vectors are one node, named by its smallest id; the result is
dealt out to the ids of a node at the end. A node needs no more than its
``top + 1`` smallest ids for that.

Index. The graph links every node to the ``k`` nodes of largest inner product
found so far, the same measure that the search uses: a query that is indexed so
starts from its own best list, and vectors of very different norms need no
detour by another metric. A node is one row with its vector, its list, and the
``k // 2`` best nodes that hold it in theirs. It starts from the nodes beside it
in the order of some random projections (near ones) and in a hash order (random
ones, which keep the graph in one piece), and from the best nodes of a fixed
sample. Then NN-descent rounds join the graph with itself: every node sends its
vector to the nodes of its list (it asks them) and to those that hold it (it is
a link of them). There the askers meet the links, the node itself and the ``k``
best askers as two blocks of vectors whose products are one matrix product, for
pairs of which one side is new since the last round; what beats the worst
neighbour of either side is a candidate, the ``GAIN`` best of each block for each
node. Each node keeps its ``k`` best. Rounds stop when fewer than ``stop`` of all
edges change. Every round is written with ``checkpoint()`` to the shared folder.
Candidates travel as one row per node and task, so a round is a join of few rows
in two exchanges, beside the count of askers.

No step pairs up the members of a group whose size depends on the data: a node
answers with a fixed number of others, and a node with very many askers is
dealt out by ``ASKERS`` of them.

Search. Each query's pool starts from its own lists and from the ``entries`` best
nodes of the sample (the ``SAMPLE`` vectors of largest norm and as many in a hash
order: fixed in number, it reaches groups without a link to the query's). Every
round expands the pool members not yet expanded and keeps the ``beam`` best, until
no member is left unexpanded. Nodes stand in hash buckets of about ``BUCKET``: a
query asks a bucket once for the links of all members there, and once for the
scores of all links found there that are not in its pool, so its vector travels
once a bucket and no node's does. The pool is then scored
with the exact double inner product of the original vectors, and the ``top``
best are returned, ties to the smaller id.

Defined results: rows with a null id, or a vector that is null, of another
length than ``dim``, all zero, or with a null, NaN or infinite component take
no part, as queries or candidates; an id that occurs more than once takes part
once, with the smallest of its vectors; a query is never its own candidate;
with fewer than ``top`` candidates all are returned; an empty table gives no
rows; extra input columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import checkpointed, ship

# Fixed values of the contract: queries are the ids divisible by EVERY; TOP results each.
EVERY, TOP, DIM = 20, 20, 64
# Parameters of the index and the search.
K, BEAM, ENTRIES, ROUNDS, STOP, SEED, BUCKET_ROWS = 32, 192, 32, 10, 0.02, 7, 64
SAMPLE, PROJECTIONS, GAIN, ASKERS, BUCKET = 1024, 3, 24, 1024, 2048

Batches = Iterator[pa.RecordBatch]
# A node (v with its vector, list w and holders h, each with scores, and new where the last round found them), or
# candidates for it (without a vector).
_LISTS = {"w": ("s", "new"), "h": ("hs", "hnew")}
_ROWS = "v long, y binary, w array<long>, s array<float>, new array<boolean>, h array<long>, hs array<float>, hnew array<boolean>"
# A node of a bucket (side 0) or what a query asks of it (side 1).
_BUCKETS = "b long, side int, id long, y binary, least float, ids array<long>"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, z: acc + z)


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id, x: array<double>) of the rows that take part, one row per id."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    some = F.exists(x, lambda c: c != 0)
    kept = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) == dim) & fine & some)
    rows = kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of packed float vectors."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(len(values), -1)


def _packed(vectors: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(vectors, dtype=np.float32)], pa.binary())


Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def _joined(parts: list[Edges]) -> Edges:
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    v, w, s = (np.concatenate(part) for part in zip(*(none + parts), strict=True))
    return v, w, s


def _best(v: np.ndarray, w: np.ndarray, s: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each v, every w once, and new only if it came as new alone; in order of v and rank."""
    at = np.lexsort((-s, new, w, v))
    at = at[np.append(True, (v[at][1:] != v[at][:-1]) | (w[at][1:] != w[at][:-1]))[: len(at)]]
    at = at[np.lexsort((w[at], -s[at], v[at]))]
    starts = np.flatnonzero(np.append(True, v[at][1:] != v[at][:-1])[: len(at)])
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[rank < k]


def _listed(owners: np.ndarray, v: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list of the values for each owner; ``v`` and ``owners`` are in order."""
    offsets = np.append(np.searchsorted(v, owners), len(v)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _rows(owners: np.ndarray, y: list | None, lists: dict[str, tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool))
    columns = [pa.array(owners, pa.int64()), pa.array(y if y is not None else [None] * len(owners), pa.binary())]
    names = ["v", "y"]
    for name, others in _LISTS.items():
        v, *values = lists.get(name, none)
        columns += [_listed(owners, v, x, t) for x, t in zip(values, (pa.int64(), pa.float32(), pa.bool_()), strict=True)]
        names += [name, *others]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _found(parts: list[Edges], k: int, held: list[Edges] = (), least: int = 0) -> pa.RecordBatch:
    """Rows of candidates, the ``k`` best of each node; ``held`` has holders, the ``least`` best of each node."""
    lists = {}
    for name, edges, most in (("w", parts, k), ("h", list(held), least)):
        v, w, s = _joined(edges)
        at = _best(v, w, s, np.ones(len(v), bool), most)
        lists[name] = (v[at], w[at], s[at], np.ones(len(at), bool))
    owners = np.unique(np.concatenate([lists["w"][0], lists["h"][0]]))
    return _rows(owners, None, lists)


def _packer(scale: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(x)], names=["id", "y"])

    return run


def pack(points: DataFrame) -> DataFrame:
    """(id, y): the vectors as packed floats, divided by the largest component so that all products are finite."""
    ship(points.sparkSession)
    biggest = points.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("m")).first()["m"] or 1.0
    return checkpointed(points.select("id", "x").mapInArrow(_packer(biggest), "id long, y binary"))


def pick_sample(points: DataFrame, packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and packed vectors of the ``SAMPLE`` rows of largest norm and the first ``SAMPLE`` in a hash order."""
    norm = dot(F.col("x"), F.col("x"))
    long = points.orderBy(F.desc(norm), "id").limit(SAMPLE).select("id")
    some = points.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).select("id")
    rows = packed.join(F.broadcast(long.union(some).distinct()), "id").orderBy("id").collect()
    return np.array([r["id"] for r in rows], dtype=np.int64), np.array([np.frombuffer(r["y"], dtype=np.float32) for r in rows])


def _by_sample(sample, count: int) -> Callable[[Batches], Batches]:
    """Candidates: the ``count`` best of the sample. ``sample``: broadcast variable."""

    def run(batches: Batches) -> Batches:
        ids, vectors = sample.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            score = _matrix(batch.column(1)) @ vectors.T
            score[own[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :count]
            s = np.take_along_axis(score, best, 1)
            row, col = np.nonzero(np.isfinite(s))
            yield _found([(own[row], ids[best[row, col]], s[row, col])], count)

    return run


def _placed(planes: np.ndarray, middle: np.ndarray, bits: int) -> Callable[[Batches], Batches]:
    """Each vector with its place in each order: signs of all but the last of a turn's planes, then the last one; at last by draw."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            turns = []
            for turn, own in enumerate(planes):
                side = (_matrix(batch.column(1)) - middle) @ own.T
                code = ((side[:, :bits] > 0) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(side))
                turns.append((turn, code, side[:, bits]))
            turns.append((len(planes), np.zeros(batch.num_rows), batch.column(2).to_numpy()))
            for turn, code, key in turns:
                place = [np.full(batch.num_rows, turn, np.int32), code.astype(np.int64), key.astype(np.float64)]
                columns = [batch.column(0), batch.column(1), *map(pa.array, place)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "turn", "code", "key"])

    return run


def _beside(reach: int, k: int) -> Callable[[Batches], Batches]:
    """Candidates, both ways, between rows of a partition and turn up to ``reach`` places apart."""

    def run(batches: Batches) -> Batches:
        ids, turns, rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = len(ids)
            fresh = _matrix(batch.column(1))
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            turns = np.concatenate([turns, batch.column(2).to_numpy()])
            rows = fresh if rows is None else np.concatenate([rows, fresh])
            parts = []
            for apart in range(1, min(reach, len(ids) - 1) + 1):
                at = np.arange(max(last, apart), len(ids))
                at = at[(turns[at] == turns[at - apart]) & (ids[at] != ids[at - apart])]
                s = np.einsum("ij,ij->i", rows[at], rows[at - apart])
                parts += [(ids[at], ids[at - apart], s), (ids[at - apart], ids[at], s)]
            if parts:
                yield _found(parts, k)
            ids, turns, rows = ids[-reach:], turns[-reach:], rows[-reach:]

    return run


def _merger(k: int, holders: int) -> Callable[[Batches], Batches]:
    """Nodes with the ``k`` best of their lists and candidates and the ``holders`` best that hold them; rows stand by v."""

    def merged(table: pa.Table) -> pa.RecordBatch:
        v = table.column("v").to_numpy()
        ys = table.column("y").combine_chunks()
        node = ys.is_valid().to_numpy(zero_copy_only=False)
        lists = {}
        for (name, (score, _)), most in zip(_LISTS.items(), (k, holders), strict=True):
            column = table.column(name).combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            owner, new = np.repeat(v, sizes), np.repeat(~node, sizes)
            w, s = column.flatten().to_numpy(), table.column(score).combine_chunks().flatten().to_numpy()
            at = _best(owner, w, s, new, most)
            lists[name] = (owner[at], w[at], s[at], new[at])
        at = np.flatnonzero(node)
        at = at[np.argsort(v[at], kind="stable")]
        return _rows(v[at], ys.take(pa.array(at)), lists)

    def run(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                v = table.column("v").to_numpy()
                cut = int(np.searchsorted(v, v[-1]))
                if cut:
                    yield merged(table.slice(0, cut))
                held = table.slice(cut)
        if held is not None:
            yield merged(held)

    return run


def _merge(nodes: DataFrame, found: DataFrame, k: int, holders: int = 0) -> DataFrame:
    """The nodes after a round: every node is in ``nodes``, candidates for others are not."""
    rows = nodes.unionByName(found).repartition("v").sortWithinPartitions("v")
    return checkpointed(rows.mapInArrow(_merger(k, holders), _ROWS))


def _bare(packed: DataFrame) -> DataFrame:
    """Nodes with empty lists."""
    empty = {f.split()[0]: F.array().cast(f.split()[1]) for f in _ROWS.split(", ")[2:]}
    return packed.select(F.col("id").alias("v"), "y", *(x.alias(name) for name, x in empty.items()))


def _start(packed: DataFrame, n: int, k: int, seed: int, sample) -> DataFrame:
    """First lists: neighbours in the orders of some random projections and in a hash order, and the best of the sample."""
    _, vectors = sample.value
    bits = max(0, min(16, int(np.log2(max(n, 1) / BUCKET_ROWS)))) if n else 0
    reach = max(1, k // (2 * PROJECTIONS + 2))
    middle = vectors.mean(axis=0) if len(vectors) else np.zeros(1, dtype=np.float32)
    planes = np.array([
        np.random.RandomState(seed + turn).standard_normal((bits + 1, len(middle))).astype(np.float32) for turn in range(PROJECTIONS)
    ])
    drawn = packed.select("id", "y", F.xxhash64("id", F.lit(seed + 1)).alias("draw"))
    placed = drawn.mapInArrow(_placed(planes, middle, bits), "id long, y binary, turn int, code long, key double")
    order = ["turn", "code", "key", "id"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ordered.select("id", "y", "turn").mapInArrow(_beside(reach, k), _ROWS)
    return _merge(_bare(packed), found.unionByName(packed.mapInArrow(_by_sample(sample, max(1, k // 4)), _ROWS)), k)


def _answers(k: int) -> Callable[[Batches], Batches]:
    """Candidates of the blocks (u, chunk) of links (side 0) and askers (side 1, with their score) that stand in order.

    Askers get the links that beat their ``least`` score, and links the askers; the ``k`` best askers are links too.
    """

    def block(side, ids, y, least, new, score):
        links = int(np.searchsorted(side, 1))
        v = np.arange(links, len(side))
        if not len(v) or not (new.any()):
            return []
        best = v[np.argsort(-score[v], kind="stable")[:k]]
        w = np.concatenate([np.arange(links), best])
        s = y[v] @ y[w].T
        open_ = (new[v][:, None] | new[w][None, :]) & (ids[v][:, None] != ids[w][None, :])
        out = []
        for axis, floor in ((1, least[v][:, None]), (0, least[w][None, :])):
            wins = open_ & (s > floor)
            if wins.shape[axis] > GAIN:
                wins &= s >= np.partition(np.where(wins, s, -np.inf), -GAIN, axis=axis).take([-GAIN], axis=axis)
            row, col = np.nonzero(wins)
            asker, link = ids[v][row], ids[w][col]
            out.append((asker, link, s[row, col]) if axis else (link, asker, s[row, col]))
        return out

    def blocks(table: pa.Table, final: bool):
        u, chunk, side, ids, least, new, score = (table.column(c).to_numpy() for c in ("u", "chunk", "side", "id", "least", "new", "s"))
        cuts = np.flatnonzero((u[1:] != u[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        bounds = [0, *cuts.tolist(), *([len(u)] if final else [])]
        y = _matrix(table.column("y"))
        spans = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
        parts = [p for x in spans for p in block(side[x], ids[x], y[x], least[x], new[x], score[x])]
        asks = np.flatnonzero(side[: bounds[-1]] == 1)
        return _found(parts, k, [(u[asks], ids[asks], score[asks])], max(1, k // 2)), table.slice(bounds[-1])

    def run(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                found, held = blocks(table if held is None else pa.concat_tables([held, table]), False)
                yield found
        if held is not None and held.num_rows:
            yield blocks(held, True)[0]

    return run


def _least(k: int) -> Column:
    """The score to beat, that of the k-th best, or none with fewer."""
    return F.when(F.size("s") >= k, F.array_min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("least")


def _asked(graph: DataFrame, k: int) -> DataFrame:
    """Candidates that the nodes of the graph get from the nodes they ask, and the holders of those.

    Askers of a node are dealt out by about ``ASKERS``, each part with all links of the node.
    """
    many = graph.select(F.explode("w").alias("u")).groupBy("u").agg(F.ceil(F.count("*") / F.lit(ASKERS)).alias("chunks")).where(F.col("chunks") > 1)
    sent = [F.arrays_zip(F.col(c).alias("u"), F.col(s).alias("s"), F.col(n).alias("new")) for c, s, n in (("w", "s", "new"), ("h", "hs", "hnew"))]
    kind = "array<struct<u:long,s:float,new:boolean,side:int>>"
    sides = [F.transform(x, lambda e, i=i: F.struct(e["u"], e["s"], e["new"], F.lit(i))).cast(kind) for x, i in zip(sent, (1, 0), strict=True)]
    itself = F.array(F.struct(F.col("v"), F.lit(0), F.lit(False), F.lit(0))).cast(kind)
    rows = graph.select(F.col("v").alias("id"), "y", _least(k), F.inline(F.concat(*sides, itself)))
    parts = F.coalesce("chunks", F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("id"), parts)
    chunk = F.explode(F.when(F.col("side") == 1, F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.join(many, "u", "left").select("u", chunk.alias("chunk"), "side", "id", "y", "least", "new", "s")
    rows = rows.repartition("u", "chunk").sortWithinPartitions("u", "chunk", "side", "id")
    return rows.mapInArrow(_answers(k), _ROWS)


def _fresh(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0


def build_graph(packed: DataFrame, sample, k: int = K, rounds: int = ROUNDS, stop: float = STOP, seed: int = SEED) -> DataFrame:
    """The NN-descent graph: each packed vector with its ``k`` best found neighbours, and the ``k // 2`` best that hold it."""
    n = packed.count()
    graph = _start(packed, n, k, seed, sample)
    for _ in range(rounds):
        graph = _merge(graph, _asked(graph, k), k, max(1, k // 2))
        if _fresh(graph) <= stop * n * k:
            break
    return graph


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _bucketed(owner, y, least, ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of what each owner asks of each bucket. ``owner``: place in y and least of each of the ids."""
    b = _bucket(ids, buckets)
    at = np.lexsort((ids, owner[1], b))
    b, place, who, ids = b[at], owner[0][at], owner[1][at], ids[at]
    starts = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (who[1:] != who[:-1]))[: len(b)])
    offsets = np.append(starts, len(ids)).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(b[starts]), pa.array(np.ones(len(starts), np.int32)), pa.array(who[starts]),
            y.take(pa.array(place[starts])) if y is not None else pa.nulls(len(starts), pa.binary()),
            pa.array(least[place[starts]] if least is not None else np.zeros(len(starts)), pa.float32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int64())),
        ],
        names=["b", "side", "id", "y", "least", "ids"],
    )


def _flat(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a list column."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False)


def _dealt(buckets: int) -> Callable[[Batches], Batches]:
    """Nodes with their bucket and links."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            v = batch.column(0).to_numpy()
            side = pa.array(np.zeros(len(v), np.int32))
            columns = [pa.array(_bucket(v, buckets)), side, batch.column(0), batch.column(1), pa.nulls(len(v), pa.float32()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "side", "id", "y", "least", "ids"])

    return run


def _asks(buckets: int) -> Callable[[Batches], Batches]:
    """What each pool (v, w, new) asks: the links of its members not expanded yet."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            row, w = _flat(batch, "w")
            new = _flat(batch, "new")[1].astype(bool)
            row, w = row[new], w[new]
            yield from _bucketed((row, batch.column("v").to_numpy()[row]), None, None, w, buckets)

    return run


def _in_buckets(answer: Callable) -> Callable[[Batches], Batches]:
    """``answer`` to the asks of each bucket, given its nodes; rows stand by bucket and side."""

    def run(batches: Batches) -> Batches:
        now, nodes = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, side = batch.column("b").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if side[lo] == 0:
                    nodes = pa.concat_tables([nodes, part]) if now == b[lo] and nodes is not None else part
                    now = b[lo]
                elif now == b[lo]:
                    yield answer(nodes, part)

    return run


def _linked(nodes: pa.Table, asks: pa.Table) -> pa.RecordBatch:
    """The links of the nodes asked for: rows of candidates without scores."""
    ids = nodes.column("id").to_numpy()
    order = np.argsort(ids)
    row, asked = _flat(asks, "ids")
    at = order[np.minimum(np.searchsorted(ids, asked, sorter=order), len(ids) - 1)]
    row, at = row[ids[at] == asked], at[ids[at] == asked]
    links = nodes.column("ids").combine_chunks()
    begins, links = links.offsets.to_numpy().astype(np.int64), links.values.to_numpy()
    sizes = np.diff(begins)[at]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[at] - ends + sizes, sizes)
    pairs = np.unique(np.stack([np.repeat(asks.column("id").to_numpy()[row], sizes), links[places]]), axis=1)
    zeros = np.zeros(pairs.shape[1])
    return _rows(np.unique(pairs[0]), None, {"w": (pairs[0], pairs[1], zeros.astype(np.float32), zeros.astype(bool))})


def _scored(beam: int) -> Callable:
    """Candidates: the nodes asked for that beat the worst of the asker's pool, at most ``beam`` a bucket."""

    def answer(nodes: pa.Table, asks: pa.Table) -> pa.RecordBatch:
        ids = nodes.column("id").to_numpy()
        order = np.argsort(ids)
        row, asked = _flat(asks, "ids")
        at = order[np.minimum(np.searchsorted(ids, asked, sorter=order), len(ids) - 1)]
        row, at = row[ids[at] == asked], at[ids[at] == asked]
        own, others = _matrix(asks.column("y")), _matrix(nodes.column("y"))
        s = np.concatenate([np.zeros(0, np.float32), *(
            np.einsum("ij,ij->i", own[row[i : i + 65536]], others[at[i : i + 65536]]) for i in range(0, len(at), 65536)
        )])
        wins = s > asks.column("least").to_numpy()[row]
        return _found([(asks.column("id").to_numpy()[row][wins], ids[at][wins], s[wins])], beam)

    return answer


def _wanted(buckets: int) -> Callable[[Batches], Batches]:
    """What each pool asks to be scored: the links found that are not in it. Rows stand by v, pools (with y) and links."""

    def wanted(table: pa.Table):
        v, ys = table.column("v").to_numpy(), table.column("y").combine_chunks()
        pool = ys.is_valid().to_numpy(zero_copy_only=False)
        row, w = _flat(table, "w")
        at = np.lexsort((~pool[row], w, v[row]))
        at = at[np.append(True, (v[row[at]][1:] != v[row[at]][:-1]) | (w[at][1:] != w[at][:-1]))[: len(at)]]
        at = at[~pool[row[at]] & (w[at] != v[row[at]])]
        pools = np.flatnonzero(pool)
        pools = pools[np.argsort(v[pools], kind="stable")]
        place = pools[np.searchsorted(v[pools], v[row[at]])]
        return _bucketed((place, v[place]), ys, table.column("least").to_numpy(), w[at], buckets)

    def run(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                v = table.column("v").to_numpy()
                cut = int(np.searchsorted(v, v[-1]))
                if cut:
                    yield from wanted(table.slice(0, cut))
                held = table.slice(cut)
        if held is not None:
            yield from wanted(held)

    return run


def search(packed: DataFrame, graph: DataFrame, queries: DataFrame, sample, beam: int = BEAM, entries: int = ENTRIES) -> DataFrame:
    """Greedy graph search; (q, c), the ``beam`` best nodes found for each of the queries (id)."""
    buckets = max(1, packed.count() // BUCKET)
    linked = graph.select("v", "y", F.array_union("w", "h").alias("ids"))
    nodes = checkpointed(linked.mapInArrow(_dealt(buckets), _BUCKETS))
    ask = packed.join(queries.select("id"), "id", "left_semi")
    own = graph.join(queries.select(F.col("id").alias("v")), "v", "left_semi")
    empty, none = _bare(ask), F.lit(None).cast("binary")
    lists = own.select("v", none.alias("y"), F.concat("w", "h").alias("w"), F.concat("s", "hs").alias("s"), F.concat("new", "hnew").alias("new"))
    lists = lists.select("*", *(F.array().cast(t).alias(c) for c, t in (("h", "array<long>"), ("hs", "array<float>"), ("hnew", "array<boolean>"))))
    # ``new`` marks the members not expanded yet.
    pool = _merge(empty, lists.unionByName(ask.mapInArrow(_by_sample(sample, entries), _ROWS)), beam)

    def answers(asks: DataFrame, part: DataFrame, answer: Callable) -> DataFrame:
        rows = part.unionByName(asks).repartition("b").sortWithinPartitions("b", "side")
        return rows.mapInArrow(_in_buckets(answer), _ROWS)

    while _fresh(pool):
        asks = pool.select("v", "w", "new").mapInArrow(_asks(buckets), _BUCKETS)
        links = answers(asks, nodes.withColumn("y", none), _linked).select("v", "y", "w", F.lit(0).cast("float").alias("least"))
        pools = pool.select("v", "y", "w", _least(beam))
        rows = pools.unionByName(links).repartition("v").sortWithinPartitions("v")
        scores = answers(rows.mapInArrow(_wanted(buckets), _BUCKETS), nodes.withColumn("ids", F.array().cast("array<long>")), _scored(beam))
        pool = _merge(pool, scores, beam)
    return pool.select(F.col("v").alias("q"), F.explode("w").alias("c"))


def nearest(
    vectors: DataFrame,
    every: int = EVERY,
    top: int = TOP,
    dim: int = DIM,
    k: int = K,
    beam: int = BEAM,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by ``every``) against all indexed rows."""
    rows = checkpointed(valid_vectors(vectors, id_col, vec_col, dim))
    points = checkpointed(rows.groupBy("x").agg(F.min("id").alias("id")).select("id", "x"))
    members = checkpointed(rows.join(points.select(F.col("id").alias("c"), "x"), "x").select("id", "c"))
    packed = pack(points)
    sample = points.sparkSession.sparkContext.broadcast(pick_sample(points, packed))
    graph = build_graph(packed, sample, k)
    asked = members.where(F.pmod(F.col("id"), F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("c").alias("q"))
    found = search(packed, graph, asked.select(F.col("q").alias("id")).distinct(), sample, beam)

    x_q, x_c = points.select(F.col("id").alias("q"), F.col("x").alias("xq")), points.select(F.col("id").alias("c"), F.col("x").alias("xc"))
    itself = asked.select("q", F.col("q").alias("c")).distinct()
    scored = found.unionByName(itself).join(x_q, "q").join(x_c, "c").select("q", "c", dot(F.col("xq"), F.col("xc")).alias("score"))
    # Every other node has one id to give at least, so the first ``top`` of them and the query's own node are enough.
    ahead = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("c"))
    scored = scored.withColumn("r", F.row_number().over(ahead)).where((F.col("r") <= top + 1) | (F.col("q") == F.col("c")))
    first = Window.partitionBy("c").orderBy("id")
    ids = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1).select("c", F.col("id").alias("vec_id"))
    pairs = asked.join(scored.drop("r"), "q").join(ids, "c").where(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
    return best.select("query_id", "rank", "vec_id", "score")
