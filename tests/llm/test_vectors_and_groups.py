import math
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("shelfsight.llm")

from pyspark.sql import functions as F  # noqa: E402

from shelfsight.llm import bits, components, history, neighbours, overlap, splits, topn  # noqa: E402


def brute_lists(rows, k=5, least=0.9):
    """{id: [(similarity, neighbour)]} by all comparisons."""
    ok = [(i, g, np.array(v, np.float64)) for i, g, v in rows if i is not None and g is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, g, v in ok:
        near = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, h, w in ok if j != i and h == g]
        out[i] = [(j, -s) for s, j in sorted(x for x in near if -x[0] >= least)[:k]]
    return out


def got_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append((r[1], r[2]))
    return {i: sorted(x, key=lambda y: (-y[1], y[0])) for i, x in out.items()}


def vectors(n, d, seed, groups=("a", "b")):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6 + 1, d))
    rows = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.standard_normal(d) * 0.25
        rows.append((i, groups[i % len(groups)], np.float32(v).tolist()))
    return rows


def test_nearest_with_dirt_and_copies(spark):
    rows = vectors(150, 16, 1)
    rows += [(500, "a", None), (501, "a", [0.0] * 16), (502, "a", [float("nan")] * 16), (503, "b", [float("inf")] + [1.0] * 15), (504, None, [1.0] * 16), (None, "a", [1.0] * 16)]
    rows += [(600 + i, "a", rows[0][2]) for i in range(20)]  # more copies than a list holds
    rows += [(700, "a", [x * 3 for x in rows[0][2]])]
    df = spark.createDataFrame(rows, "vector_id bigint, grp string, value array<float>").withColumn("near", F.lit("clash")).repartition(3)
    expected = {i: x for i, x in brute_lists(rows).items() if x}
    assert got_lists(neighbours.nearest_lists(df)) == expected
    pairs = {(r[0], r[1]) for r in neighbours.similar_pairs(neighbours.nearest_lists(df)).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i, x in expected.items() for j, _ in x}


def test_nearest_of_none(spark):
    df = spark.createDataFrame([], "vector_id bigint, grp string, value array<float>")
    assert neighbours.nearest_lists(df).collect() == []


def test_hot_list_in_tiles_is_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_LIST", 200)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    rows = vectors(400, 12, 2, groups=("a",))
    rows += [(1000 + i, "a", rows[7][2]) for i in range(200)]  # a third of all are copies
    df = spark.createDataFrame(rows, "vector_id bigint, grp string, value array<float>").repartition(4)
    got, expected = got_lists(neighbours.nearest_lists(df, probes=9)), {i: x for i, x in brute_lists(rows).items() if x}
    assert got == expected  # all lists are probed


def test_recall_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_LIST", 64)
    rows = vectors(1500, 32, 3, groups=("a",))
    df = spark.createDataFrame(rows, "vector_id bigint, grp string, value array<float>").repartition(4)
    expected = {(i, j) for i, x in brute_lists(rows).items() for j, _ in x}
    got = {(i, j) for i, x in got_lists(neighbours.nearest_lists(df)).items() for j, _ in x}
    assert len(expected & got) >= 0.95 * len(expected)


def test_scan_abandons_no_near_one():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 48))
    x[150:] = x[:150] + 0.1 * rng.standard_normal((150, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {(int(i), int(j)) for a, b, _ in neighbours.scan_list(x, x, 6, 0.9) for i, j in zip(a, b, strict=True)}
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.8999995), strict=True)}


def test_top_per_sku(spark):
    nan = float("nan")
    c = [(1, "i1", 0.5), (1, "i1", 0.5), (2, "i1", 0.5), (3, "i2", 0.5), (4, "i1", nan), (5, None, 0.9), (6, "zz", 0.9), (7, "i2", None), (8, "i2", 1.5), (9, "i3", 0.1), (10, "i2", 0.9), (11, "i1", -0.0), (12, "i1", 0.0)]
    r = [("i1", " a1 "), ("i1", " a1 "), ("i2", "A1"), ("i3", "b"), (None, "c"), ("i4", None)]
    cand = spark.createDataFrame(c, "candidate_id bigint, image_id string, score double").withColumn("sku", F.lit("clash"))
    refs = spark.createDataFrame(r, "image_id string, sku string").withColumn("score", F.lit(1))
    got = topn.top_per_sku(cand, refs, 5).orderBy("sku", "rank").select("sku", "candidate_id").collect()
    assert [tuple(x) for x in got] == [("A1", 10), ("A1", 1), ("A1", 2), ("A1", 3), ("A1", 11), ("B", 9)]
    assert topn.top_per_sku(cand.where("false"), refs, 5).collect() == []
    plan = topn.top_per_sku(cand, refs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def hashes(rng, n):
    return [f"{rng.getrandbits(256):064x}" for _ in range(n)]


def photos(seed, n):
    """Records (id, hash, dhash, group) with copies, close codes, dirt and a hot group."""
    rng = random.Random(seed)
    hs, codes = hashes(rng, n // 3), [rng.getrandbits(64) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        h = rng.choice([rng.choice(hs), rng.choice(hs).upper(), f" {rng.choice(hs)} ", None, "", "xyz"])
        code = rng.choice(codes)
        for _ in range(rng.choice([0, 0, 1, 4, 5])):
            code ^= 1 << rng.randrange(64)
        d = rng.choice([f"{code:016x}", f" {code:016X}", None, "0" * 16, "12", "g" * 16])
        g = rng.choice(["hot", "Hot ", f"g{rng.randrange(n)}", None, "", "unknown-session", "Unknown-Session "])
        rows.append((i, h, d, g))
    return rows


def clean(row):
    i, h, d, g = row
    h, d, g = (x.strip(" ").lower() if x is not None else None for x in (h, d, g))
    ok = lambda x, k: x if x is not None and len(x) == k and set(x) <= set("0123456789abcdef") else None
    d = ok(d, 16)
    return i, ok(h, 64), int(d, 16) if d and d != "0" * 16 else None, g if g not in (None, "", "unknown-session") else None


COLUMNS = "photo_hash string, dhash string, capture_group string"


def test_overlaps_by_brute_force(spark, monkeypatch):
    pool = photos(1, 150)
    ev, fb = pool[:60], [(r[0] - 60, *r[1:]) for r in pool[60:]]
    a = spark.createDataFrame(ev + ev[:5], f"eval_id bigint, {COLUMNS}").withColumn("word", F.lit("clash"))
    b = spark.createDataFrame([(i + 1000, *r) for i, *r in fb], f"feedback_id bigint, {COLUMNS}").withColumn("key", F.lit(1))
    expected = set()
    for x in map(clean, ev):
        for y in map(clean, fb):
            kinds = (x[1] is not None and x[1] == y[1], x[2] is not None and y[2] is not None and (x[2] ^ y[2]).bit_count() <= 4, x[3] is not None and x[3] == y[3])
            if any(kinds):
                expected.add((x[0], y[0] + 1000, *kinds))
    assert len({k[2:] for k in expected}) >= 4
    monkeypatch.setattr(overlap, "SHARD_PATTERNS", 100)
    pairs = overlap.overlaps(a, b)
    assert {tuple(r) for r in pairs.collect()} == expected
    assert overlap.overlaps(a, b.where("false")).collect() == []
    assert overlap.overlaps(a.where("false"), b).collect() == []
    cover = {r["eval_id"]: r for r in overlap.coverage(a, pairs).collect()}
    assert len(cover) == 60
    assert all((r["coverage"] is None) == (r["chars"] == 0) and r["matched"] <= r["chars"] and (r["spans"] > 0) == (r["matched"] > 0) for r in cover.values())


def test_scan_finds_words_only_whole():
    text = "\nab\nabc\nb\n"
    found = overlap.scan(overlap.automaton(["ab", "b"]), text)
    assert [p for _, _, p in found] == ["ab", "b"] and all(text[lo:hi] == p for lo, hi, p in found)
    assert overlap.scan(overlap.automaton([]), text) == []


def brute_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, k in links:
        a, b = find(r), find(("k", k))
        parent[b if isinstance(b, tuple) else a] = a if isinstance(b, tuple) else b
    sets = {}
    for r, _ in links:
        sets.setdefault(find(r), []).append(r)
    return {r: min(s) for s in sets.values() for r in s}


def test_components_chain_and_hot_key(spark):
    links = [(i, f"c{i // 2}") for i in range(40)] + [(i + 1, f"d{i // 2}") for i in range(39)]  # a chain of 40
    links += [(100 + i, "hot") for i in range(60)] + [(200, "alone"), (None, "x"), (300, None)]
    rng = random.Random(5)
    links += [(1000 + rng.randrange(80), f"r{rng.randrange(70)}") for _ in range(90)]
    df = spark.createDataFrame(links, "eval_id bigint, key string")
    got = {r[0]: r[1] for r in components.connected(df, "eval_id", "key").collect()}
    assert got == brute_components([x for x in links if None not in x])
    assert components.connected(df.where("false"), "eval_id", "key").collect() == []


def test_splits_keep_sets_and_proportions(spark):
    rng = random.Random(6)
    rows = [(i, f"{rng.getrandbits(256):064x}" if i % 3 else None, None, f"g{rng.randrange(300)}" if i % 5 else None, [rng.choice("abc")] if i % 7 else []) for i in range(900)]
    rows += [(2000 + i, None, None, "hot", ["a"]) for i in range(100)]
    df = spark.createDataFrame(rows, f"eval_id bigint, {COLUMNS}, tags array<string>")
    sets = splits.tied_sets(df)
    labels = df.select("eval_id", F.explode("tags").alias("label"))
    got = splits.stratified_splits(sets, labels, proportions={"train": 0.6, "validation": 0.2, "test": 0.2}).collect()
    assert len(got) == 1000
    by_set = {}
    for r in got:
        by_set.setdefault(r["first"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_set.values())
    share = {s: sum(r["split"] == s for r in got) / 1000 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.6) < 0.05 and abs(share["test"] - 0.2) < 0.05 and abs(share["validation"] - 0.2) < 0.05
    tag = dict((r[0], r[4]) for r in rows)
    for label in "abc":
        own = [r["split"] for r in got if label in tag[r["eval_id"]]]
        assert abs(own.count("train") / len(own) - 0.6) < 0.08
    assert splits.stratified_splits(sets.where("false"), labels.where("false")).collect() == []


def test_shares_are_those_of_one_by_one():
    rng = random.Random(8)
    for _ in range(300):
        need = [rng.choice([rng.uniform(-5, 40), float(rng.randrange(20))]) for _ in range(rng.randrange(1, 5))]
        weight, m = rng.randrange(1, 6), rng.randrange(1, 30)
        left, got = [round(n * 10**6) for n in need], [0] * len(need)
        for _ in range(m):
            s = max(range(len(need)), key=lambda s: (left[s], -s))
            got[s] += 1
            left[s] -= weight * 10**6
        assert splits.shares(need, weight, m) == got


def test_balance_of_no_record(spark):
    none = spark.createDataFrame([], "eval_id bigint, first bigint, label string")
    placed = splits.stratified_splits(none.select("eval_id", "first"), none.select("eval_id", "label"))
    assert splits.balance(none.select("eval_id", "label"), placed).collect() == []


def brute_history(refs, rows):
    """rows: (id, batch, hash, code) -> ids that are not new."""
    seen = {}
    for i, b, h, c in rows:
        seen[i] = min(seen.get(i, (b, i, h, c)), (b, i, h, c), key=lambda x: x[0])
    hs, cs, out = set(), [], set()
    for _, i, h, c in sorted(seen.values(), key=lambda x: x[:2]):
        if (h is not None and (h in refs or h in hs)) or (c is not None and any((c ^ x).bit_count() <= 4 for x in cs)):
            out.add(i)
        else:
            hs |= {h} - {None}
            cs += [c] if c is not None else []
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_history(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(1, 8), h, d) for i, h, d, _ in photos(seed, 160)]
    rows += [(i, b + 3, h, d) for i, b, h, d in rows[:10]]
    refs = [(r[2],) for r in rows[:12]] + [(None,), ("bad",)]
    feedback = spark.createDataFrame(rows, "feedback_id bigint, batch_no int, photo_hash string, dhash string").withColumn("hash", F.lit("clash"))
    table = spark.createDataFrame(refs, "photo_hash string")
    tidy = [(i, b, clean((i, h, d, None))[1], clean((i, h, d, None))[2]) for i, b, h, d in rows]
    expected = brute_history({clean((0, h, None, None))[1] for (h,) in refs} - {None}, tidy)
    for options in ({}, {"appends": 2, "rows_per_bucket": 100, "popular": 3}):  # the second compacts into more buckets and cuts keys finer
        got = [r[0] for r in history.duplicates_by_batch(feedback, table, **options).collect()]
        assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("one_task", [0, 300, history.ONE_TASK])
def test_a_delivery_costs_few_executions(spark, one_task):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 4), h, d) for i, h, d, _ in photos(3, 160)]
    chain = [(1000 + i, 2, None, f"{(1 << 3 * i) - 1:016x}") for i in range(1, 7)]  # each within 4 bits of the one before
    feedback = spark.createDataFrame(rows + chain, "feedback_id bigint, batch_no int, photo_hash string, dhash string")
    expected = brute_history(set(), [(i, b, clean((i, h, d, None))[1], clean((i, h, d, None))[2]) for i, b, h, d in rows + chain])
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    got = history.duplicates_by_batch(feedback, spark.createDataFrame([], "photo_hash string"), one_task=one_task)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executions = store.executionsCount() - before
    assert sorted(r[0] for r in got.collect()) == sorted(expected)
    if one_task == history.ONE_TASK:
        assert executions <= 8 + 3 * 3  # links, order and append; the start and the list of batches come first


@pytest.mark.parametrize("rows_in_a_batch", [1, 3, 100])
def test_links_in_order(rows_in_a_batch):
    links = [(history.FIRST, None, None, "hx"), (1, "x", None, "hx"), (1, None, 5, "c5"), (2, None, 5, "c5"), (2, None, None, "5~6"), (3, None, 6, "c6"), (3, None, None, "5~6"), (4, None, 5, "c5"), (5, "y", None, "hy")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("id", "hash", "code", "key"), x, strict=True)) for x in links[i : i + rows_in_a_batch]], schema=pa.schema([("id", pa.int64()), ("hash", pa.string()), ("code", pa.int64()), ("key", pa.string())])) for i in range(0, len(links), rows_in_a_batch)]
    assert [(r["id"], r["key"]) for b in history._in_order(batches) for r in b.to_pylist()] == [(2, "c5"), (2, "5~6"), (5, "hy")]
    assert list(history._in_order([])) == []


def test_history_of_nothing(spark):
    feedback = spark.createDataFrame([], "feedback_id bigint, batch_no int, photo_hash string, dhash string")
    table = spark.createDataFrame([], "photo_hash string")
    assert history.duplicates_by_batch(feedback, table).collect() == []


@pytest.mark.parametrize("popular", [1, 5, 1000])
def test_close_codes_under_popular_keys(spark, popular):
    rng = random.Random(9)
    base = [0, 0xFF, (1 << 63) | 3] + [rng.getrandbits(64) for _ in range(5)]
    codes = set()
    for i in range(300):
        c = base[i % len(base)]
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(64)
        codes.add(c - (1 << 64) if c >> 63 else c)
    df = spark.createDataFrame([(c,) for c in codes] + [(None,)], "code bigint")
    got = {tuple(r) for r in bits.pairs(bits.keyed(df, "code", "a"), bits.keyed(df, "code", "b"), "a", "b", popular).collect()}
    assert got == {(a, b) for a in codes for b in codes if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
