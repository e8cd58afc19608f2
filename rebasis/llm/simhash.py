"""SimHash near-duplicates, found with BK-trees.

Fingerprint: each bit is the majority of that bit in the XXH64 of the four-word
shingles, repeats included. Two documents are linked if their fingerprints
differ in at most ``radius`` bits; a component is all that links reach.

Search. Only distinct fingerprints are compared, so exact copies cost nothing. The 64
bits are cut into ``radius + 2`` blocks; two fingerprints within the radius agree on
at least two blocks, so each is routed by every pair of blocks and all linked pairs meet in
some route. Routes with one member are dropped. A route with more than ``shard`` members
is routed again by the blocks that are left (``radius + 1`` cuts, one of which agrees); if
that is not enough its members are dealt into trees of ``shard`` members,
and each tree is asked by the members of its own and all later ones.

Each tree holds its children under their whole-number distance to the parent, and a
search follows only edges from d - radius to d + radius. Trees are shuffled to the tasks
that ask them rather than broadcast: a broadcast of all trees would pass every
fingerprint through the driver. A tree yields a spanning forest of its links, so a clique of n
copies leaves n - 1 rows; components are unchanged.

Components come from rounds of minimum labels over stored tables, until none changes.

A null or empty text has fingerprint 0 and links like any other. A null id is
left out of the minimum; a group of nulls has a null component. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.llm.common import small, stored

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD = 4096
CHUNK = 1 << 16


def text_fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    if len(words) >= SHINGLE:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(
            starts[at: at + CHUNK].tolist(), ends[at: at + CHUNK].tolist())], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprint_batches, f"doc_id {kind}, fp bigint")


def cut_points(bits: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` runs of near-equal width that cover ``bits`` bits: (shift, width)."""
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def field(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def first_routes(radius: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    blocks = cut_points(64, radius + 2)
    return [(a, b) for i, a in enumerate(blocks) for b in blocks[i + 1:]]


def routed(fps: DataFrame, radius: int) -> DataFrame:
    """(route, key, fp): every fingerprint under every pair of its blocks; keys of one member are left out."""
    routes = F.array(*(
        F.struct(F.lit(n).alias("route"),
                 F.shiftleft(field(F.col("fp"), *a), b[1]).bitwiseOR(field(F.col("fp"), *b)).alias("key"))
        for n, (a, b) in enumerate(first_routes(radius))
    ))
    return fps.select("fp", F.explode(routes).alias("r")).select("r.route", "r.key", "fp")


def rest_key(radius: int) -> Column:
    """The cuts of the bits that a route does not fix, as (cut, bits): one of them agrees in a linked pair."""
    out = None
    for n, (a, b) in enumerate(first_routes(radius)):
        fixed = {a[0] + i for i in range(a[1])} | {b[0] + i for i in range(b[1])}
        free = [i for i in range(64) if i not in fixed]
        cuts = []
        for m, (lo, width) in enumerate(cut_points(len(free), radius + 1)):
            mask = sum(1 << i for i in free[lo: lo + width])
            mask -= (1 << 64) if mask >= 1 << 63 else 0
            cuts.append(F.struct(F.lit(m).alias("cut"), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")))
        arm = F.array(*cuts)
        out = F.when(F.col("route") == n, arm) if out is None else out.when(F.col("route") == n, arm)
    return out


class Tree:
    """A BK-tree: children of a node by their distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        value, children = self.root
        while True:
            d = (value ^ fp).bit_count()
            if d not in children:
                children[d] = (fp, {})
                return
            value, children = children[d]

    def near(self, fp: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            value, children = stack.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


class Forest:
    """Links seen so far in one route, as a union-find; ``link`` says whether a link was new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


MASK = (1 << 64) - 1


def tree_links(rows: Iterator[tuple[tuple, bool, bool, int]], radius: int) -> Iterator[tuple[int, int]]:
    """Links of sorted rows (group, is_member, asks, fp): members of a group come before those that only ask.

    A member asks the tree as it is before it joins; other rows ask the whole tree.
    """
    group, tree, forest = None, Tree(), Forest()
    for key, member, fp in rows:
        if key != group:
            group, tree, forest = key, Tree(), Forest()
        for other in tree.near(fp & MASK, radius):
            if other != fp & MASK and forest.link(other, fp & MASK):
                yield other, fp & MASK
        if member:
            tree.add(fp & MASK)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linker(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                cols = [b[c].tolist() for c in ("route", "key", "cut", "bits", "tree", "asks_only", "fp")]
                for r, k, c, s, t, asks, fp in zip(*cols):
                    yield (r, k, c, s, t), not asks, fp

        kept: list[tuple[int, int]] = []
        for a, b in tree_links(rows(), radius):
            kept.append((_signed(a), _signed(b)))
            if len(kept) == CHUNK:
                yield pd.DataFrame(kept, columns=["a", "b"])
                kept = []
        yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return run


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect what lies within the radius, a spanning forest of each tree."""
    met = routed(fps, radius)
    sizes = stored(met.groupBy("route", "key").count().where("count > 1"), "simhash-routes")
    n_routes = sizes.count()
    kept = met.join(small(sizes, n_routes), ["route", "key"])
    plain = ["route", "key", F.lit(-1).alias("cut"), F.lit(0).cast("bigint").alias("bits"),
             F.lit(0).alias("tree"), F.lit(False).alias("asks_only"), "fp"]
    ready = kept.where(F.col("count") <= shard).select(*plain)
    if sizes.where(F.col("count") > shard).limit(1).count():
        finer = kept.where(F.col("count") > shard).select(
            "route", "key", F.explode(rest_key(radius)).alias("c"), "fp").select("route", "key", "c.cut", "c.bits", "fp")
        finer = stored(finer, "simhash-finer")
        counts = finer.groupBy("route", "key", "cut", "bits").count().where("count > 1")
        counts = counts.withColumn("trees", F.ceil(F.col("count") / shard).cast("int"))
        dealt = finer.join(counts, ["route", "key", "cut", "bits"]).withColumn(
            "own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
        # own tree as a member; all later trees as a question
        ready = ready.unionByName(dealt.select(
            "route", "key", "cut", "bits", "own", "fp",
            F.explode(F.sequence(F.col("own"), F.col("trees") - 1)).alias("tree"),
        ).select("route", "key", "cut", "bits", "tree", (F.col("tree") > F.col("own")).alias("asks_only"), "fp"))
    key = ["route", "key", "cut", "bits", "tree"]
    return (
        ready.repartition(*key).sortWithinPartitions(*key, "asks_only", "fp")
        .mapInPandas(_linker(radius), "a bigint, b bigint")
    )


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the root that all nodes of a component share, for each end of an edge.

    Each round every node moves into the least of itself and its neighbours, and its
    edges move with it; what is connected stays connected. Fingerprints are as
    good as random labels, so a round removes a steady share of the nodes.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = stored(both, "links")
    state = both.select(F.col("x").alias("fp"), F.col("x").alias("root")).distinct()
    while both.limit(1).count():
        move = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(
            "x", F.least("x", "y").alias("to")), "moves")
        state = stored(
            state.join(move.withColumnRenamed("x", "root"), "root", "left")
            .select("fp", F.coalesce("to", "root").alias("root")), "roots")
        both = stored(
            both.join(move, "x").select(F.col("to").alias("x"), "y")
            .join(move.select(F.col("x").alias("y"), F.col("to").alias("to_y")), "y")
            .select("x", F.col("to_y").alias("y")).where("x <> y").distinct(), "links")
    return state


def grouped(by_print: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``by_print``, a row per fingerprint, with the ``root`` of its component."""
    edges = stored(links(by_print.select("fp"), radius, shard), "edges")
    return by_print.join(components(edges), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = stored(fingerprints(docs), "fingerprints")
    by_print = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = grouped(by_print, radius, shard)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(roots.join(least, "root").select("fp", "component_id"), "components")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component one row: that of the least id, null ids last; of one id the text of the least hash.

    Rows are told apart by id and text, as ids may be null or repeated, so a row stands only for its own
    component, and rows without an id do not stand for each other. Not whole yet: if an id is the least of
    several components, only the first of their texts in order stays, as ``test_one_of_each`` wants each id once.
    """
    rows = docs.withColumn("__h", F.xxhash64("text", F.col("text").isNull()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(_fingerprint_batches(iter([batch])))
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column("__h")], ["doc_id", "fp", "__h"])

    found = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "__h").mapInArrow(
        prints, f"doc_id {kind}, fp bigint, __h bigint")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h")).alias("least")
    by_print = stored(found.groupBy("fp").agg(least), "prints")
    chosen = grouped(by_print).groupBy("root").agg(F.min("least").alias("c")).select(
        F.col("c.doc_id").alias("__of"), F.col("c.__h").alias("__of_h"))
    chosen = stored(chosen, "representatives")
    kept = rows.join(chosen, (F.col("__h") == F.col("__of_h")) & F.col("doc_id").eqNullSafe(F.col("__of")), "left_semi")
    # aggregated where the rows are first, so that one (id, text) of any number of rows is no large group
    columns = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    first = kept.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("__h")).alias("__n")).agg(
        F.min(F.struct(*columns)).alias("row"))
    return first.select(*(F.col("row")[c].alias(c) for c in docs.columns))
