"""Shards, conversation repair and manifests against plain forms of the whole result."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest
from samples import bag, clashing, docs
from pyspark.sql import functions as F

from sessora.llm import dialogues, manifests, oracles, queries, shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- shards


def plain_shards(rows, parts=8):
    raw = lambda t: (t or "").encode()
    rows = sorted(
        ((hashlib.md5(raw(t)).digest(), d is not None, d or 0, len(raw(t)) + 1, zlib.crc32(raw(t)), d) for d, t in rows),
        key=lambda r: r[:3],
    )
    total, at, places, extents = sum(r[3] for r in rows), 0, [], {}
    for r in rows:
        places.append(at)
        extents[r[0]] = (extents.get(r[0], (at,))[0], at + r[3])
        at += r[3]
    cuts = []
    for part in range(1, parts):
        byte = -(-part * total // parts)
        for low, high in extents.values():
            if low < byte < high:
                near = low if byte - low <= high - byte else high
                byte = near if abs(near - byte) * parts <= shards.SLACK * total else byte
                break
        cuts.append(byte)
    slots, out = Counter(), []
    for r, at in zip(rows, places):
        part = sum(c <= at + r[3] // 2 for c in cuts)
        out.append((r[5], r[3], r[4], part, slots[part]))
        slots[part] += 1
    return sorted(map(str, out))


def dealt(frame):
    found = frame.select("doc_id", "size", "text_crc32", "shard", "slot")
    return sorted(str(tuple(r)) for r in found.collect())


def pairs(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


def test_shards_of_the_whole_table(spark, table):
    found = queries.op11_sharding(spark, SF)
    assert dealt(found) == plain_shards(pairs(table))
    sizes = [r.s for r in found.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * max(sizes) + 2 * 130_000
    assert {r.law for r in found.select("law").distinct().collect()} == {"bytes"}


@pytest.mark.parametrize("samples", [1, 16])
def test_hot_groups_are_cut_and_small_groups_stay(spark, monkeypatch, samples):
    monkeypatch.setattr(shards, "SAMPLES", samples)  # a poor sample makes overfull ranges
    rng = random.Random(4)
    rows = [(rng.choice([None, i]), rng.choice(["hot " * 30, None, "", f"t{i}" * 40]), None, None, 0) for i in range(400)]
    rows += [(3, "same", None, None, 0)] * 900
    frame = docs(spark, rows)
    assert dealt(shards.shard(frame)) == plain_shards(pairs(frame))


def test_shards_awkward(spark):
    assert dealt(shards.shard(docs(spark, []))) == []
    frame = clashing(docs(spark), "size", "digest", "key", "range", "shard", "kept")
    assert dealt(shards.shard(frame)) == plain_shards(pairs(frame))
    kept = shards.shard(frame, keep=["text", "shard"]).select("doc_id", "kept.text", "kept.shard")
    assert bag(kept) == bag(frame.select("doc_id", "text", "shard"))


# --- conversations

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    seen = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{seen(conv)}:{seen(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else seen(role), seen(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return by


def plain_repair(rows):
    """Cost, edits and rows by trying every edit at every row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        text_end = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not text_end else "duplicate" if (role, text) in seen else ""
        faults.append(fault or ("truncated" if text_end[-1] not in ".!?" else ""))
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, end, inserted):
        options = []
        if i == len(rows) and end in ("", "a"):
            options.append((0, "", ()))
        new = after[end]

        def put(cost, letter, line, rest):
            options.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if i < len(rows):
            _, role, text = rows[i]
            put(2, "D", (), best(i + 1, end, 0))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                put(1 + extra, "R", (f"{names[new]}:{text}",), best(i + 1, new, 0))
                if role[:1] == new or (role[:1] == "s" and not end):
                    put(extra, "K", (f"{role}:{text}",), best(i + 1, role[0], 0))
        if inserted < 3:
            put(5, "I", (f"{names[new]}:",), best(i, new, inserted + 1))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    first = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_reports(rows):
    return sorted(str((conv, *plain_repair(own))) for conv, own in plain_damage(rows).items())


def random_conversations(seed, longest):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["", "a.", "b", "c! ", "a. \n", None, " \t", "d?", "é。"]
    for conv in [*range(150), None]:
        for _ in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_repair_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    found = queries.op12_conversation_repair(spark, SF)
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_reports([tuple(r) for r in rows.collect()])


@pytest.mark.parametrize("block_rows", [dialogues.BLOCK_ROWS, 3])
def test_repair_of_damaged_rows(spark, block_rows):
    """With blocks of three rows most conversations leave blocks; results are the same."""
    rows = random_conversations(8, 14)
    frame = clashing(spark.createDataFrame(rows, CONVERSATIONS), "block", "cost", "fault", "dropped", "nth")
    damaged = dialogues.damaged(frame)
    found = dialogues.repair(damaged, block_rows)
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_reports(rows)
    lines = defaultdict(list)
    for r in dialogues.repaired(damaged, found).orderBy("conv_id", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256


def test_a_long_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rng = random.Random(6)
        rows = [(1, t, rng.choice(["user", "assistant"]), f"{t}{rng.choice('.x')}") for t in range(300)]
        rows += [(2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "long. " * 50_000)]
        frame = spark.createDataFrame(rows, CONVERSATIONS)
        found = dialogues.repair(frame, 64).orderBy("conv_id").collect()
        for r, conv in zip(found, (1, 2)):
            assert tuple(r)[1:] == plain_repair([x[1:] for x in rows if x[0] == conv])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repair_of_nothing(spark):
    assert dialogues.repair(dialogues.damaged(spark.createDataFrame([], CONVERSATIONS))).collect() == []
    gone = spark.createDataFrame([(7, 1, "user", "a.", True)], CONVERSATIONS + ", dropped boolean")
    (r,) = dialogues.repair(gone).collect()
    assert tuple(r) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_few_steps_are_ever_computed():
    """Costs beyond the cheapest are bounded, so the steps of any conversation are few."""
    fronts, todo = {dialogues.FIRST}, [dialogues.FIRST]
    while todo:
        front = todo.pop()
        for initial in ("s", "u", "a", ""):
            for fault in range(4):
                new = dialogues.step(front, initial, fault).front
                if new not in fronts:
                    fronts.add(new)
                    todo.append(new)
    assert len(fronts) < 3000


# --- manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def plain_manifest(rows):
    by, out = defaultdict(list), []
    for r in rows:
        by[r[1]].append((r[0], plain_leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [plain_tree([x[1] for x in by[s]]) for s in sources]
    top = plain_tree([t[-1][0] for t in trees]) if trees else []
    for j, s in enumerate(sources):
        for i, (doc_id, own, r) in enumerate(by[s]):
            proof = [*plain_proof(trees[j], i), *plain_proof(top, j)]
            if doc_id is not None and r[4] is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                r = (*r[:4], r[4].replace("\n", ""))
            now = plain_leaf(r)
            for left, right in proof:
                now = sha(*left, now, *right)
            root = top[-1][0]
            digest = sha(*[x for left, right in proof for x in left + right])
            out.append((doc_id, own, trees[j][-1][0], root, digest, now, now == root))
    return sorted(map(str, out))


def checked(frame):
    found = manifests.report(manifests.manifest(frame, manifests.tampered(frame)))
    return sorted(str(tuple(r)) for r in found.collect())


def fields(frame):
    return [tuple(r) for r in frame.select(*manifests.FIELDS).collect()]


def test_manifest_of_the_whole_table(spark, table):
    found = sorted(str(tuple(r)) for r in queries.op13_merkle_manifest(spark, SF).collect())
    assert found == plain_manifest(fields(table))


def test_manifest_equals_its_sql():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = connection.execute(f"SELECT {', '.join(manifests.FIELDS)} FROM documents").fetchall()
    assert sorted(str(r) for r in connection.execute(oracles.MANIFEST).fetchall()) == plain_manifest(rows)


@pytest.mark.parametrize("few", [0, 5_000])
def test_manifest_of_odd_sources(spark, monkeypatch, few):
    """Trees of all sizes, single rows, null and odd names, equal rows; with and without broadcasts."""
    monkeypatch.setattr(manifests, "FEW", few)
    rng = random.Random(3)
    names = [None, "", "a", "é", "b", "\U0001f600", "￿", "a"]
    rows = [
        (rng.choice([None, i, i, 5]), rng.choice([None, "", "a\nb", "xé\n"]), rng.choice([None, "en"]), rng.choice(names), None)
        for i in range(200)
    ]
    rows += [(7, "t", "en", f"lone{i}", 1) for i in range(11)] + [(9, "same\n", "en", "a", 1)] * 5
    frame = clashing(docs(spark, rows), "tree", "digest", "place", "root", "leaf", "siblings", "_later")
    assert checked(frame) == plain_manifest(fields(frame))


@pytest.mark.parametrize("rows", [0, 1, 3, 4, 28])
def test_manifest_of_one_source(spark, rows):
    frame = docs(spark, [(i, "a\n", "en", "s", 2) for i in range(rows)])
    assert checked(frame) == plain_manifest(fields(frame))


def test_manifest_awkward(spark):
    assert checked(docs(spark)) == plain_manifest(fields(docs(spark)))
