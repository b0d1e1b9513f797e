"""Near-duplicate documents by b-bit minwise signatures and a multi-index Hamming join.

A signature has ``symbols`` 16-bit minima, in ``chunks`` chunks. Two signatures
that differ in at most ``distance`` symbols differ in at most ``errors`` symbols
of one chunk (pigeonhole), so they share one of its keys: a key is a chunk with
one choice of ``errors`` symbols left out. The layout is sized by the threshold:
for 0.85 and more, 20 symbols in 4 chunks, where a pair at 0.85 differs in more
than ``distance`` symbols once in 200,000 pairs; from 0.80, 25 symbols in 5
chunks (1.4 times in 100,000 pairs at 0.80). More similar pairs are missed far
more seldom.

Copies of a shingle set are one node from the start. Rows of a key are linked to
its smallest document; connected rows form clusters, whose full sets meet in one
task (large clusters in blocks). There, pairs within the signature distance and
not yet connected are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import checkpointed, ship
from matchlake.llm.graph import connected_components
from matchlake.llm.hashing import mix, shingle_sets

SHINGLE = 5
PERCENT = 85
# The lowest similarity (percent) the signature is made for.
LOWEST = 80
# Documents and shingles of a cluster that meet in one task; larger clusters are compared block by block.
BLOCK_DOCS = 4096
BLOCK_SHINGLES = 6_000_000



class Layout:
    """``symbols`` 16-bit minima in ``chunks`` chunks; a key leaves ``errors`` symbols of its chunk out."""

    def __init__(self, symbols: int, chunks: int, errors: int):
        self.symbols = symbols
        self.distance = chunks * (errors + 1) - 1
        width = symbols // chunks
        rng = np.random.default_rng(20)
        self.xor = rng.integers(0, 2**63, symbols, dtype=np.uint64)
        self.times = rng.integers(0, 2**62, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.choices = [
            [chunk * width + i for i in kept] for chunk in range(chunks) for kept in combinations(range(width), width - errors)
        ]


# Signature layouts by the lowest similarity (percent) each is made for.
LAYOUTS = {PERCENT: Layout(20, 4, 2), LOWEST: Layout(25, 5, 2)}


def layout_for(percent: int) -> Layout:
    return LAYOUTS[max(p for p in LAYOUTS if p <= percent)]


def signature(shingles: np.ndarray, layout: Layout = LAYOUTS[PERCENT]) -> np.ndarray:
    """The 16-bit symbols of a non-empty set of shingle hashes."""
    low = np.empty(layout.symbols, dtype=np.uint64)
    for k in range(layout.symbols):
        low[k] = ((shingles ^ layout.xor[k]) * layout.times[k]).min()
    return mix(low) >> np.uint64(48)


def index_keys(symbols: np.ndarray, layout: Layout = LAYOUTS[PERCENT]) -> np.ndarray:
    """Keys of each signature (row): every chunk with each choice of ``errors`` symbols left out."""
    keys = np.empty((len(symbols), len(layout.choices)), dtype=np.uint64)
    for n, kept in enumerate(layout.choices):
        key = np.full(len(symbols), n + 1, dtype=np.uint64)
        for column in kept:
            key = (key << np.uint64(16)) | symbols[:, column]
        keys[:, n] = mix(key)
    return keys


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


_SIGNED = "doc long, n long, d1 long, d2 long, keys array<long>"


def _signer(layout: Layout):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch.column(1)), SHINGLE)
            size, digest, symbols = [], [], []
            for shingles in sets:
                size.append(len(shingles))
                digest.append((shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles)) if len(shingles) else 0))
                symbols.append(signature(shingles, layout) if len(shingles) else np.zeros(layout.symbols, dtype=np.uint64))
            digests = np.array(digest, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            keys = index_keys(np.array(symbols).reshape(-1, layout.symbols), layout).view(np.int64)
            offsets = np.arange(0, keys.size + 1, len(layout.choices), dtype=np.int32)
            columns = [
                batch.column(0),
                pa.array(size, pa.int64()),
                pa.array(digests[:, 0]),
                pa.array(digests[:, 1]),
                pa.ListArray.from_arrays(offsets, keys.ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "d1", "d2", "keys"])

    return sign


def _expander(layout: Layout):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(_texts(batch.column(1)), SHINGLE))
            symbols = [signature(s, layout).astype("<u2").tobytes() if len(s) else b"" for s in sets]
            columns = [batch.column(0), pa.array(symbols, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "symbols", "shingles"])

    return expand


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    common = int(np.isin(a, b, assume_unique=True, kind="sort").sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _links(percent: int, layout: Layout):
    """Pandas function: a cluster's rows in, confirmed links out; pairs already connected are not compared."""

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc", ignore_index=True)
        docs, side = rows["doc"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        symbols = np.array([np.frombuffer(s, dtype="<u2") for s in rows["symbols"]])
        size = np.array([len(s) for s in sets])
        group = np.arange(len(rows))
        left, right = [], []
        for i in range(len(rows)):
            # Sizes alone rule out a similarity of percent; the rest is the signature distance.
            open_ = (group != group[i]) & (side != side[i] if side.any() else True)
            open_ &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            others = np.flatnonzero(open_)
            others = others[(symbols[others] != symbols[i]).sum(axis=1) <= layout.distance] if len(others) else others
            for j in others:
                if group[j] != group[i] and similar(sets[i], sets[j], percent):
                    left.append(docs[i])
                    right.append(docs[j])
                    group[group == group[j]] = group[i]
        return pd.DataFrame({"a": np.array(left, dtype=np.int64), "b": np.array(right, dtype=np.int64)})

    return confirm


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest linked id) and ``kept``.

    A document's set is its distinct shingles of five words (ASCII white space
    splits, A-Z lower-cased), the whole sequence where it has fewer words. Null
    or wordless texts are linked with nothing. Documents with equal sets are
    one node from the start, told equal by their size and two 64-bit digests of
    the set rather than by the full sets. Rows with one id are one document. A row with a null id is linked with nothing and kept; its
    component is null. Other columns are ignored, whatever their names.
    ``percent`` may be 80 or more; less needs a wider signature.
    """
    if percent < LOWEST:
        raise ValueError(f"the signature is made for {LOWEST} percent or more")
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    layout = layout_for(percent)
    signed = checkpointed(texts.mapInArrow(_signer(layout), _SIGNED))
    nodes = signed.where((F.col("n") > 0) & F.col("doc").isNotNull())
    nodes = nodes.groupBy("d1", "d2", "n").agg(F.min("doc").alias("node"), F.first("keys").alias("keys"))
    nodes = checkpointed(nodes)

    indexed = nodes.select("node", F.explode("keys").alias("key"))
    shared = indexed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.where(F.col("low") < F.col("high")).select("key", "low")
    stars = indexed.join(shared, "key").where(F.col("node") != F.col("low"))
    clusters = connected_components(stars.select(F.col("node").alias("a"), F.col("low").alias("b")))
    clusters = checkpointed(clusters)

    full = texts.join(clusters.select(F.col("node").alias("doc")), "doc", "left_semi").mapInArrow(
        _expander(layout), "doc long, symbols binary, shingles binary"
    )
    full = full.where(F.length("symbols") > 0)
    sized = clusters.join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    share = F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)
    members = sized.groupBy("component").agg(F.ceil(share).cast("int").alias("n_blocks"))
    placed = clusters.join(members, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    # A block meets itself and every other block of its cluster once; side tells the two apart.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda o: F.struct(
            F.least(o, F.col("block")).alias("x"),
            F.greatest(o, F.col("block")).alias("y"),
            F.when(o < F.col("block"), 1).otherwise(0).alias("side"),
        ),
    )
    placed = placed.select(F.col("node").alias("doc"), "component", F.explode(meets).alias("m"))
    placed = placed.select("doc", "component", "m.x", "m.y", "m.side")
    links = placed.join(full, "doc").groupBy("component", "x", "y").applyInPandas(_links(percent, layout), "a long, b long")
    linked = connected_components(links)

    roots = nodes.select("d1", "d2", "n", "node").join(linked, "node", "left")
    roots = roots.select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc", "n", "d1", "d2").withColumn("known", F.col("doc").isNotNull() & (F.col("n") > 0))
    out = out.withColumn("d1", F.when(F.col("known"), F.col("d1"))).join(roots, ["d1", "d2", "n"], "left")
    component = F.coalesce("component", "doc")
    return out.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"),
    )
