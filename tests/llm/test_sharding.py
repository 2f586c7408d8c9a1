import heapq
import random
import zlib

from wavequarry.llm.sharding import assign_shards, lpt_classes


def plain_loads(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    given = {}
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        given.setdefault(s, [0] * shards)[k] += 1
        heapq.heappush(heap, (load + s, k))
    return given


def test_classes_are_dealt_as_single_groups_are():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 7, 50, 51, 1000]) for _ in range(rng.randrange(0, 400))] + [rng.randrange(1, 5000) for _ in range(rng.randrange(5))]
        classes = [(s, sizes.count(s)) for s in set(sizes)]
        for shards in (1, 2, 8):
            assert lpt_classes(classes, shards) == plain_loads(sizes, shards)
    assert lpt_classes([], 3) == {}


def check(rows, docs, shards):
    shard_of, slots = {}, {}
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)
    for r in rows:
        assert shard_of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_groups_stay_and_loads_match_the_plain_schedule(spark):
    docs = [(k, f"text {k % 137} " * (1 + k % 11)) for k in range(600)] + [(7, "again")] * 50 + [(None, "again")] * 30
    groups = {}
    for _, t in docs:
        groups[t] = groups.get(t, 0) + len(t) + 1
    want = [0] * 4
    for size, given in plain_loads(list(groups.values()), 4).items():
        want = [x + size * g for x, g in zip(want, given)]
    for per_bucket in (65_536, 7):
        rows = assign_shards(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 4, per_bucket=per_bucket).collect()
        check(rows, docs, 4)
        loads = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)]
        assert loads == want


def test_odd_documents(spark, odd_docs, no_docs):
    rows = assign_shards(odd_docs, 8).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 8)
    assert assign_shards(no_docs).count() == 0


def test_one_text_holds_a_third(spark):
    docs = [(k, "copy" if k % 3 == 0 else f"t{k}") for k in range(300)]
    check(assign_shards(spark.createDataFrame(docs, "doc_id bigint, text string"), 8).collect(), docs, 8)
