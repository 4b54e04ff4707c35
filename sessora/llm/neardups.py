"""MinHash near-duplicates: SuperMinHash signatures, bands, checked links, union-find groups.

Two documents are linked if their shingle sets have a Jaccard similarity of at least num / den; a group
is what links connect. Documents with equal sets are one node from the start, so that copies cost
nothing more. Nodes that share a band are candidates:

1. In each bucket every node is checked against the bucket's smallest id, on full sets.
2. Buckets whose nodes now lie in one group are done. In the others, nodes of small groups become
   leaders and are checked against all nodes of other groups, a block of leaders a round. Nodes stream
   past the leaders; no pairs are written but links. Large buckets are cut, leaders go to each cut.
3. A leader leaves its bucket after its round, so that the rounds end. Nothing is capped: every pair
   that shares a bucket is checked, or known to be in one group.

Null and empty texts, and texts without words, have no set and are linked with nothing; so are rows
without an id, whose component is null. Rows that repeat an id count as one document. Texts are read
whole. Ties do not occur: a component is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sessora.llm.common import bound_batches, checkpointed, map_texts, texts_of
from sessora.llm.shingles import banding, bands, jaccard_parts, shingle_sets, signatures

BROADCAST_IDS = 1_000_000  # 8 MB; beyond it a shuffle join
LEADERS = 256  # a bucket in the second round; four times as many in each further one
CUT_ROWS = 1_000  # nodes of a bucket that stream through one task, past its leaders
_MATRIX = 8_000_000  # cells of a block of leaders


def sketches(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, n_shingles, key (a digest of the set, null if empty), bands."""
    count, rows = banding(similarity)

    def start() -> Callable:
        def step(found, part):
            sets = shingle_sets(found, width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return {
                "n_shingles": [len(s) for s in sets],
                "key": keys,
                "bands": list(bands(signatures(sets, count * rows), count, rows)),
            }

        return step

    return map_texts(texts, "n_shingles long, key binary, bands array<long>", start)


def _few(ids: DataFrame, size: int) -> DataFrame:
    return F.broadcast(ids) if size <= BROADCAST_IDS else ids


def _sets(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and `set` (sorted hashes as bytes) of the given nodes, computed once."""
    nodes = checkpointed(nodes.distinct())
    wanted = texts.join(_few(nodes.withColumnRenamed("node", "doc_id"), nodes.count()), "doc_id")

    def start() -> Callable:
        return lambda found, part: {"set": [s.tobytes() for s in shingle_sets(found, width)]}

    sets = map_texts(wanted, "set binary", start).withColumnRenamed("doc_id", "node")
    return checkpointed(sets)


def _checked(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    num, den = threshold.numerator, threshold.denominator
    both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            kept = []
            rows = zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b"))
            for i, (a, set_a, set_b) in enumerate(rows):
                if a != last:
                    last, own = a, np.frombuffer(set_a.as_buffer(), np.uint64)
                shared, union = jaccard_parts(own, np.frombuffer(set_b.as_buffer(), np.uint64))
                if den * shared >= num * union:
                    kept.append(i)
            if kept:
                yield batch.select(["a", "b"]).take(pa.array(kept))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


# --- union-find ----------------------------------------------------------------


def _united(edges: DataFrame) -> DataFrame:
    """Edges of each task replaced by its own union-find forest: (child, parent), the parent smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())],
                names=["child", "parent"],
            )

    return edges.mapInArrow(run, "child long, parent long")


def groups(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b) but the smallest of each group, which is comp.

    Rounds of: forests per task; every child keeps its smallest parent, its other parents become that
    one's children; children of a child move up. They end when each child has one parent, a root.
    """
    forest = _united(edges.repartition("a"))
    while True:
        least = forest.groupBy("child").agg(F.min("parent").alias("least"))
        spread = forest.join(least, "child")
        hooked = (
            spread.select("child", F.col("least").alias("parent"))
            .unionByName(
                spread.where("parent <> least").select(
                    F.col("parent").alias("child"), F.col("least").alias("parent")
                )
            )
            .distinct()
        )
        up = least.select(F.col("child").alias("parent"), F.col("least").alias("above"))
        moved = hooked.join(up, "parent", "left").select(
            "child", F.coalesce(F.least("parent", "above"), "parent").alias("parent"), F.col("parent").alias("old")
        )
        moved = moved.select("child", "parent").unionByName(
            moved.where("old <> parent").select(F.col("old").alias("child"), "parent")
        )
        forest = checkpointed(_united(moved.where("child <> parent").distinct().repartition("parent")))
        children = forest.select(F.col("child").alias("parent"))
        sizes = forest.agg(F.count("*").alias("n"), F.countDistinct("child").alias("children")).first()
        if sizes.n == sizes.children and forest.join(children, "parent", "left_semi").isEmpty():
            return forest.select(F.col("child").alias("node"), F.col("parent").alias("comp"))


# --- rounds --------------------------------------------------------------------


def _grouped(live: DataFrame, comps: DataFrame) -> DataFrame:
    """live rows (bucket, node) with the group of the node."""
    return live.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets in which more than one group is left."""
    mixed = (
        rows.groupBy("bucket")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low <> high")
    )
    return rows.join(mixed.select("bucket"), "bucket", "left_semi")


def _leader_round(rows: DataFrame, sets: DataFrame, threshold: Fraction, leaders: int) -> tuple[DataFrame, DataFrame]:
    """Links between `leaders` nodes of each bucket and its nodes of other groups; the rows that stay."""
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    ranked = rows.join(sizes, ["bucket", "comp"])
    order = Window.partitionBy("bucket").orderBy("size", "comp", "node")
    chosen = checkpointed(
        ranked.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= leaders)
        .select("bucket", "node", "comp")
    )
    cuts = F.ceil(F.col("rows") / CUT_ROWS).cast("int")
    rest = rows.join(chosen.select("bucket", "node"), ["bucket", "node"], "left_anti")
    rest = checkpointed(rest.select("bucket", "node", "comp"))
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    known = buckets.select("bucket", cuts.alias("cuts"))
    first = chosen.join(known, "bucket").withColumn(
        "cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    )
    others = rest.join(known, "bucket").withColumn("cut", cut)
    columns = ["bucket", "cut", "node", "comp"]
    dealt = first.select(*columns, F.lit(0).alias("role")).unionByName(
        others.select(*columns, F.lit(1).alias("role"))
    )
    streamed = (
        dealt.join(sets, "node")
        .repartition("bucket", "cut")
        .sortWithinPartitions("bucket", "cut", "role", "node")
        .select("bucket", "cut", "role", "node", "comp", "set")
    )
    links = streamed.mapInArrow(_stream(threshold), "a long, b long").distinct()
    return checkpointed(links), rest


class _Leaders:
    """A block of leaders as an incidence matrix over their shingles."""

    def __init__(self, nodes: list[int], comps: list[int], sets: list[np.ndarray]):
        self.nodes, self.comps = np.array(nodes), np.array(comps)
        self.sizes = np.array([len(s) for s in sets])
        self.shingles, where = np.unique(np.concatenate(sets), return_inverse=True)
        self.matrix = np.zeros((len(self.shingles), len(nodes)), np.uint8)
        self.matrix[where, np.repeat(np.arange(len(nodes)), self.sizes)] = 1

    def linked(self, own: np.ndarray, comp: int, num: int, den: int) -> np.ndarray:
        """Leaders of other groups that are similar to a set."""
        at = np.searchsorted(self.shingles, own)
        at = at[(at < len(self.shingles)) & (self.shingles[np.minimum(at, len(self.shingles) - 1)] == own)]
        shared = self.matrix[at].sum(0, dtype=np.int64)
        union = self.sizes + len(own) - shared
        return self.nodes[(den * shared >= num * union) & (self.comps != comp)]


def _stream(threshold: Fraction) -> Callable:
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, waiting, filled = None, [], [], 0
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            nonlocal waiting, filled
            if waiting:
                blocks.append(_Leaders(*map(list, zip(*waiting))))
                waiting, filled = [], 0

        def check(node: int, comp: int, own: np.ndarray) -> None:
            for block in blocks:
                for other in block.linked(own, comp, num, den):
                    a.append(min(node, int(other)))
                    b.append(max(node, int(other)))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "cut", "role", "node", "comp")]
            for *key, role, node, comp, data in zip(*columns, batch.column("set")):
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if key != at:
                    at, blocks, waiting, filled = key, [], [], 0
                if role == 0:
                    if (filled + len(own)) * (len(waiting) + 1) > _MATRIX:
                        close()
                    check(node, comp, own)  # against full blocks; its own block follows
                    for other, group, theirs in waiting:
                        shared, union = jaccard_parts(own, theirs)
                        if group != comp and den * shared >= num * union:
                            a.append(min(node, other))
                            b.append(max(node, other))
                    waiting.append((node, comp, own))
                    filled += len(own)
                else:
                    close()
                    check(node, comp, own)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []

    return run


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    threshold = Fraction(num, den)
    texts = texts_of(docs)
    found = checkpointed(sketches(texts, width, float(threshold)))
    usable = found.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    nodes = usable.groupBy("key").agg(
        F.min("doc_id").alias("node"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("rows"), F.min(F.struct("node", "n")).alias("first"))
        .where("rows > 1")
        .select("bucket", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"))
    )
    live = checkpointed(rows.join(shared, "bucket"))
    small, large = F.least("n", "leader_n"), F.greatest("n", "leader_n")
    pairs = (
        live.where((F.col("node") != F.col("leader")) & (den * small >= num * large))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    pairs = checkpointed(pairs)
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    links = checkpointed(_checked(pairs, _sets(texts, involved, width), threshold))
    comps = groups(links)
    rows = live.where("node <> leader").select("bucket", "node")
    rows = checkpointed(_open(_grouped(rows, comps)))
    leaders, sets = LEADERS, None
    while not rows.isEmpty():
        if sets is None:
            sets = _sets(texts, rows.select("node"), width)
        more, rows = _leader_round(rows, sets, threshold, leaders)
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = groups(links)
        rows = checkpointed(_open(_grouped(rows.select("bucket", "node"), comps)))
        leaders *= 4
    return _named(found, usable, comps)


def _named(found: DataFrame, usable: DataFrame, comps: DataFrame) -> DataFrame:
    """Each row with the smallest id of its group."""
    of_key = usable.groupBy("key").agg(F.min("doc_id").alias("node"))
    of_key = of_key.join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("group_id"))
    named = found.select("doc_id", "n_shingles", "key").join(of_key, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id"))
    return named.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The same columns, one row for each group; rows without an id stay.

    Of rows that repeat an id and a text one stays, the first by all its columns as JSON; texts without words
    count as one text. Rows of one id with other texts stay each, if one of them is kept.
    """
    bound_batches(docs.sparkSession)
    found = checkpointed(near_duplicates(docs, **options))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = checkpointed(ids.where(~F.col("kept")).select("doc_id"))
    size = gone.count()
    kept = docs.join(_few(gone, size), "doc_id", "left_anti") if size else docs
    again = found.where("doc_id is not null and kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = checkpointed(again.select("doc_id"))
    size = again.count()
    if not size:
        return kept
    repeated = _few(again, size)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    words = F.rtrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    first = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", F.when(words != "", F.col("text")))
    first = first.agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(first)
