"""A Merkle manifest of a table: a root over all rows, and for each row a proof that leads to it.

Each row is a leaf, a digest of its columns. The leaves of a source, by id, form a tree in which runs of
three become one node; the tops of these trees, by source, form a tree likewise, whose top is the root.

All of it is joins and grouped sums, no Python:

1. *Places.* Leaf digests are range-partitioned by (source, id) and numbered inside each partition; one
   small row for each partition carries the numbers on, so no task sees more than its range, and a
   source of any size spans many.
2. *Levels.* Each level groups the one before by (tree, place div 3); it has a third of its nodes.
3. *Proofs by pointer jumping.* Each node holds the siblings that lead to its parent. A self-join on
   the ancestor appends the ancestor's segment and takes over its pointer, which doubles the distance:
   after k rounds a node holds the siblings of 2^k levels. A proof over 10^11 rows takes five rounds.
   Only inner nodes take part, half as many as leaves; the leaves join their parent once, at the end.
4. *Verification* folds a proof, level by level, onto a leaf of the row as it is now.

In round k an ancestor is met by 3^(2^k) nodes at most. From the fourth round on there are few of them,
so they are broadcast when counted below :data:`FEW` (some 6 MB); beyond that the join shuffles, which
in a fifth round takes more than 10^11 rows. The table of partitions has a row for each and is read by the driver.

Nulls: a null value counts as `-`; a null id sorts first and is never tampered with; a null source is a
source, the first. Rows that are equal in id and digest are leaves of their own, in any order, which
no result depends on. Text may be empty or of any length. An empty table gives an empty result. Further
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessora.llm.common import stored

#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Rows of one range of leaves.
RANGE_ROWS = 1_000_000

#: Nodes of the largest tree from which on levels are not stored one by one but computed with their users.
STORED_NODES = 10_000

#: Ancestors that are broadcast in one round.
FEW = 5_000

_KEY = ("tree", "level", "place")
_UP = ("up_tree", "up_level", "up_place")
#: The tree over the sources.
_TOP = -1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: each value with its length in bytes, or `-`."""

    def part(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[part(columns[f].cast("string")) for f in FIELDS])


def tampered(rows: DataFrame) -> Column:
    """The text as it is found later: without line breaks in the rows whose id has an even checksum."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))


def leaves(rows: DataFrame, later: Column | None = None) -> DataFrame:
    """doc_id, source, leaf of each row, and `now`: its leaf with the text `later`, null if that is the same."""
    own = {f: F.col(f) for f in FIELDS}
    now = F.lit(None).cast("binary")
    if later is not None:
        changed = ~F.col("_later").eqNullSafe(F.col("text"))
        now = F.when(changed, F.unhex(leaf(own | {"text": F.col("_later")})))
    used = rows.select(
        *[F.col(f).cast("long" if f in ("doc_id", "n_chars") else "string").alias(f) for f in FIELDS],
        *([later.alias("_later")] if later is not None else []),
    )
    return used.select(
        "doc_id",
        "source",
        F.unhex(leaf(own)).alias("leaf"),
        now.alias("now"),
        F.monotonically_increasing_id().alias("row"),
    )


# --- places


def placed(found: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with `tree`, the number of their source in order, and `place`, that of the row in it; from 0.

    Also the number of trees and the size of the largest.
    """
    count = found.count()
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    keys = ("source", "doc_id", "leaf", "row")  # `row` lets equal rows be cut apart
    ranged = stored(found.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sources = ranged.groupBy("part", "source").agg(F.count("*").alias("n"))
    in_part = Window.partitionBy("part").orderBy("source")
    sources = stored(sources.withColumn("nth", F.row_number().over(in_part) - 1))
    ends = sources.groupBy("part").agg(
        F.min_by(F.struct("source", "n"), "nth").alias("first"),
        F.max_by(F.struct("source", "n"), "nth").alias("last"),
        F.count("*").alias("sources"),
    )
    starts, tree, ahead, before = [], 0, 0, None
    largest = sources.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    for r in ends.orderBy("part").collect():  # one row for each partition
        if before is not None and r.first.source == before.source:
            tree -= 1  # goes on with the source of the partition before
        else:
            ahead = 0
        starts.append((r.part, tree, ahead))
        ahead = r.last.n + (ahead if r.sources == 1 else 0)
        tree, before = tree + r.sources, r.last
    starts = spark.createDataFrame(starts, "part int, first_tree long, ahead long")
    # both windows share the exchange by part
    nth = F.dense_rank().over(Window.partitionBy("part").orderBy("source")) - 1
    local = F.row_number().over(Window.partitionBy("part", "source").orderBy(*keys[1:])) - 1
    numbered = ranged.withColumn("nth", nth).withColumn("local", local)
    rows = numbered.join(F.broadcast(starts), "part").select(
        "doc_id",
        "leaf",
        "now",
        (F.col("first_tree") + F.col("nth")).alias("tree"),
        (F.col("local") + F.when(F.col("nth") == 0, F.col("ahead")).otherwise(0)).alias("place"),
    )
    return rows, tree, largest


# --- levels


def _text(value: Column) -> Column:
    """A digest as hex text."""
    return F.lower(F.hex(value))


def runs(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Each run of three consecutive nodes of a tree, its members in order.

    A first run of one member is a whole tree: more nodes would fill it.
    """
    member = F.struct("place", "digest", *extra)
    return (
        nodes.groupBy("tree", "level", F.expr("place div 3").alias("run"))
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .withColumn("whole", (F.col("run") == 0) & (F.size("members") == 1))
    )


def _parents(found: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("members", lambda m: _text(m["digest"])), "")
    return found.where("not whole").select(
        "tree",
        (F.col("level") + 1).alias("level"),
        F.col("run").alias("place"),
        F.unhex(digest(joined)).alias("digest"),
    )


def _others(name: str = "members") -> tuple[Column, Column]:
    """Of the member at `_at`: its siblings' digests, and how many stand left and right, as one digit."""
    at = F.col("_at")
    left, right = at, F.size(name) - at - 1
    sides = F.filter(F.col(name), lambda m, i: i != at)
    # binary values of an array have no concatenation of their own; there are two at most
    both = [F.coalesce(F.get(sides, F.lit(i))["digest"], F.lit(b"")) for i in range(2)]
    return F.concat(*both), (left * 3 + right).cast("string")


def _nodes(found: DataFrame, spread: Sequence[str] = ()) -> DataFrame:
    """A row for each member of runs that have a parent: siblings, sides, pointer to the parent."""
    rows = found.where("not whole").select(
        "tree", "level", "run", "members", F.posexplode("members").alias("_at", "_member")
    )
    siblings, sides = _others()
    return rows.select(
        "tree",
        "level",
        F.col("_member.place").alias("place"),
        F.col("_member.digest").alias("digest"),
        *[F.col(f"_member.{c}").alias(c) for c in spread],
        siblings.alias("siblings"),
        sides.alias("sides"),
        F.col("tree").alias("up_tree"),
        (F.col("level") + 1).alias("up_level"),
        F.col("run").alias("up_place"),
    )


def _grow(nodes: DataFrame, size: int, extra: Sequence[str] = ()) -> list[DataFrame]:
    """The runs of all levels; `size` is that of the largest tree. Small levels share one plan."""
    levels = [stored(runs(nodes, extra))]
    while size > 1:
        size = -(-size // 3)
        found = runs(_parents(levels[-1]))
        levels.append(stored(found) if size > STORED_NODES else found)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The top node of every tree."""
    tops = None
    for level in levels:
        own = level.where("whole").select("tree", "level", F.get("members", F.lit(0))["digest"].alias("digest"))
        tops = own if tops is None else tops.unionByName(own)
    return stored(tops)


# --- proofs


def jumped(nodes: DataFrame) -> DataFrame:
    """Nodes whose segment reaches the root: pointers jump to the ancestor's ancestor until none is left."""
    while True:
        going = nodes.where("up_tree is not null")  # all jump to ancestors twice as far as the last ones
        wanted = going.select(*_UP).distinct()
        count = wanted.count()
        if not count:
            return nodes
        ahead = nodes.select(
            *[F.col(k).alias(u) for k, u in zip(_KEY, _UP)],
            F.col("siblings").alias("more_siblings"),
            F.col("sides").alias("more_sides"),
            F.col("subroot").alias("more_subroot"),
            *[F.col(u).alias(f"next_{u}") for u in _UP],
        )
        if count <= FEW:
            ahead = F.broadcast(ahead.join(F.broadcast(wanted), list(_UP), "left_semi"))
        longer = going.join(ahead, list(_UP)).select(
            *_KEY,
            F.concat("siblings", "more_siblings").alias("siblings"),
            F.concat("sides", "more_sides").alias("sides"),
            F.coalesce("subroot", "more_subroot").alias("subroot"),
            *[F.col(f"next_{u}").alias(u) for u in _UP],
        )
        nodes = stored(nodes.where("up_tree is null").select(*longer.columns).unionByName(longer))


def _paths(levels: list[DataFrame], top: list[DataFrame]) -> DataFrame:
    """Siblings and sides from every inner node and every subroot up to the root."""
    columns = [*_KEY, "siblings", "sides", "subroot", *_UP]
    none = F.lit(None).cast("binary").alias("subroot")
    inner = None
    for level in levels[1:]:
        own = _nodes(level).select(*_KEY, "siblings", "sides", none, *_UP)
        inner = own if inner is None else inner.unionByName(own)
    for number, level in enumerate(top):
        if number == 0:  # a subroot goes by its place in its own tree
            own = _nodes(level, ("source_tree", "source_level")).select(
                F.col("source_tree").alias("tree"),
                F.col("source_level").alias("level"),
                F.lit(0).cast("long").alias("place"),
                "siblings",
                "sides",
                F.col("digest").alias("subroot"),
                *_UP,
            )
        else:
            own = _nodes(level).select(*_KEY, "siblings", "sides", none, *_UP)
        inner = own if inner is None else inner.unionByName(own)
    # the root is an end without siblings; it is the one subroot if there is one source only
    root = top[-1].where("whole").select("members", "level")
    single = F.lit(len(top) == 1)
    member = F.get("members", F.lit(0))
    end = root.select(
        *(
            [member["source_tree"].alias("tree"), member["source_level"].alias("level")]
            if len(top) == 1
            else [F.lit(_TOP).cast("long").alias("tree"), F.col("level")]
        ),
        F.lit(0).cast("long").alias("place"),
        F.lit(b"").alias("siblings"),
        F.lit("").alias("sides"),
        F.when(single, member["digest"]).alias("subroot"),
        *[F.lit(None).cast(t).alias(u) for t, u in zip(("long", "int", "long"), _UP)],
    )
    return stored(inner.select(*columns).unionByName(end.select(*columns)))


def folded(start: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf (hex text) and its proof lead to; `siblings` as hex text."""
    steps = F.filter(F.split(sides, ""), lambda s: s != "")

    def up(state: Column, step: Column) -> Column:
        number = step.cast("int")
        left, right = F.floor(number / 3).cast("int"), number % 3
        end = state["at"] + (left + right) * 64
        joined = F.concat(
            F.substring(siblings, state["at"], left * 64),
            state["digest"],
            F.substring(siblings, state["at"] + left * 64, right * 64),
        )
        return F.struct(digest(joined).alias("digest"), end.alias("at"))

    first = F.struct(start.alias("digest"), F.lit(1).alias("at"))
    return F.aggregate(steps, first, up, lambda state: state["digest"])


def manifest(rows: DataFrame, later: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings and sides (the proof), folded_root of every row, as hex text.

    `later` gives the text as it is when the proofs are checked; the same as now if not given.
    """
    found, trees, largest = placed(stored(leaves(rows, later)))
    base = found.select(
        "tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest"), "doc_id", "now"
    )
    levels = _grow(base, largest, ("doc_id", "now"))
    subroots = _tops(levels)
    top = _grow(
        subroots.select(
            F.lit(_TOP).cast("long").alias("tree"),
            F.lit(0).alias("level"),
            F.col("tree").alias("place"),
            "digest",
            F.col("tree").alias("source_tree"),
            F.col("level").alias("source_level"),
        ),
        trees,
        ("source_tree", "source_level"),
    )
    paths = jumped(_paths(levels, top))
    root = _tops(top).select(_text(F.col("digest")).alias("root")).first()  # the only one
    # a whole run is a subroot itself and goes by its own key, other leaves by that of their parent
    of_run = levels[0].select(
        "tree",
        F.when(F.col("whole"), F.col("level")).otherwise(F.col("level") + 1).alias("level"),
        F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("run")).alias("place"),
        "members",
        "whole",
    )
    joined = of_run.join(paths.select(*_KEY, "siblings", "sides", "subroot"), list(_KEY)).select(
        "members", "whole", "siblings", "sides", "subroot", F.posexplode("members").alias("_at", "_member")
    )
    siblings, sides = _others()
    proofs = joined.select(
        F.col("_member.doc_id").alias("doc_id"),
        _text(F.col("_member.digest")).alias("leaf"),
        _text(F.coalesce("_member.now", "_member.digest")).alias("now"),
        _text(F.col("subroot")).alias("subroot"),
        _text(F.concat(siblings, F.col("siblings"))).alias("siblings"),
        F.when(F.col("whole"), F.col("sides")).otherwise(F.concat(sides, F.col("sides"))).alias("sides"),
    )
    checked = proofs.withColumn("folded_root", folded(F.col("now"), F.col("siblings"), F.col("sides")))
    whole = F.lit(root.root if root else None).cast("string").alias("root")
    return checked.select("doc_id", "leaf", "subroot", whole, "siblings", "sides", "folded_root")


def report(found: DataFrame) -> DataFrame:
    """Per row its digests, that of its proof, and whether the row as it is now leads to the root."""
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(F.col("siblings")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
