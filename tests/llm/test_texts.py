import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("shelfsight.llm")

import regex  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shelfsight.llm import leakage, spans, tokens  # noqa: E402

ODD = ["", " ", "\n\n\t", "a", "<|endoftext|> is plain", "\x00\x1c\x1d control ​ ", "naïve Straße ǅ İ", "日本語の文章です。", "👩‍👩‍👧‍👦🏽 é é", "don't we'll I'VE", "1234567 ½ ² Ⅷ", "x" * 3000, "ab" * 1500, "\U00010ffff"[:1]]


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


def test_rank_queue_is_a_priority_queue():
    rng = random.Random(1)
    queue, stored = tokens.RankQueue(50_000), []
    for _ in range(3000):
        if stored and rng.random() < 0.5:
            assert queue.pop() == min(stored)
            stored.remove(min(stored))
        else:
            entry = (rng.choice([rng.randrange(50_000), rng.randrange(40)]), rng.randrange(1000))
            queue.push(*entry)
            stored.append(entry)
    while stored:
        assert queue.pop() == min(stored)
        stored.remove(min(stored))
    assert queue.pop() is None


def test_ids_as_two_other_libraries_give(encoder):
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab é'1\n 字") for _ in range(rng.randrange(400))) for _ in range(200)]
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    third = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    third.encode_special_tokens = True
    for t in texts:
        ids = encoder.encode(t)
        assert ids == other.encode_ordinary(t) == third.encode(t, add_special_tokens=False).ids
        assert other.decode_bytes(ids) == t.encode()


def test_very_long_pretoken_takes_about_linear_time(encoder):
    import time

    def seconds(n):
        piece = "".join(random.Random(n).choice("abc") for _ in range(n)).encode()
        start = time.perf_counter()
        encoder.merge(piece)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.005)


def test_encode_table(spark, encoder):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r[0], r[1]) for r in tokens.encode_texts(df).collect()), key=str)
    assert got == sorted(((i, encoder.encode(t) if t else []) for i, t in rows), key=str)
    assert tokens.encode_texts(df.where("false")).collect() == []
    assert tokens.encode_texts(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.lower()) if text else []


def brute_leaks(docs, items, run=12):
    grams = lambda t: {tuple(w[i : i + run]) for w in [words(t)] for i in range(len(w) - run + 1)}
    by_item = [(j, grams(t)) for j, t in items]
    return {(d, j) for d, t in docs for j, g in by_item if d is not None and j is not None and grams(t) & g}


def test_leaks_by_brute_force(spark):
    rng = random.Random(3)
    lexicon = [f"w{i}" for i in range(60)] + ["Größe", "İstanbul", "ΣΊΣΥΦΟΣ", "ⅷ"]
    sentence = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [(i, sentence(rng.choice([3, 11, 12, 13, 40]))) for i in range(30)]
    items += [(40, items[4][1]), (41, ["again"] * 30)]  # copies and repeats
    docs = []
    for i in range(120):
        w = sentence(rng.randrange(5, 80))
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1]
            n = rng.choice([8, 11, 12, 20])
            at = rng.randrange(max(1, len(source) - n + 1))
            w += source[at : at + n] + sentence(2)
        docs.append((i, rng.choice([" ", "  \n", " - ", "_"]).join(rng.choice([x, x.upper()]) for x in w)))
    docs += [(500, None), (501, ""), (502, " \x00"), (None, " ".join(items[4][1])), (503, " ".join(["again"] * 100))]
    rows = [(j, " ".join(w)) for j, w in items] + [(90, None), (91, ""), (None, " ".join(items[4][1]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    p = spark.createDataFrame(rows + rows[:3], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    found = leakage.leaks(d, p).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["run"] >= 12} == brute_leaks(docs, rows)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
    assert leakage.leaks(d.where("false"), p).collect() == []
    assert leakage.leaks(d, p.where("false")).collect() == []


def test_edited_copies_score(spark):
    rng = random.Random(4)
    item = [f"word{rng.randrange(1000)}" for _ in range(60)]
    edited = [w for i, w in enumerate(item) if i % 9 != 8]  # every ninth word is missing, so no run of 12 is left
    d = spark.createDataFrame([(1, " ".join(["before"] * 30 + edited + ["after"] * 30)), (2, "nothing of it")], "doc_id bigint, text string")
    p = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    (row,) = leakage.leaks(d, p).collect()
    assert (row["doc_id"], row["item_id"]) == (1, 7) and row["run"] < 12 and 0.6 < row["score"] < 1


def test_edited_copies_score_beside_whole_ones(spark):
    rng = random.Random(6)
    item = [f"word{i}" for i in range(24)]
    whole = " ".join(item)
    edited = " ".join(w for i, w in enumerate(item) if i % 8 != 7)
    other = " ".join("changed" if i % 4 == 3 else w for i, w in enumerate(item))  # no four words in a row are left
    noise = " ".join(f"word{rng.randrange(24)}" for _ in range(200))
    rows = [(1, whole), (2, edited), (3, "before " * 40 + other + " after" * 40), (4, noise), (5, " ".join(item[:8]))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = spark.createDataFrame([(7, whole)], "item_id bigint, text string")
    found = {r["doc_id"]: (r["run"], r["score"]) for r in leakage.leaks(d, p).collect()}
    assert set(found) == {1, 2, 3} and found[1] == (24, 1.0) and found[2][0] == 7 and found[3][0] == 3


def test_scores_by_brute_force():
    rng = random.Random(7)
    for least in (0.2, 0.4, 0.5, 0.8):  # the first by single words
        rows = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(12, 30)))) for i in range(8)]
        items = leakage.Items(rows, least)
        edit = lambda w: rng.choice([[], [w], [w], [w], [w, "x"], [f"w{rng.randrange(12)}"]])
        docs = [["x"] * rng.randrange(50) + [y for w in rng.choice(rows)[1].split() for y in edit(w)] for _ in range(40)]
        texts = [np.array([items.vocabulary.get(w, 0) for w in doc], np.int64) for doc in docs]
        expected = {(t, i) for t, ids in enumerate(texts) for i, own in enumerate(items.words) if leakage.align([(own, ids)])[0][0] >= 2 * least * len(own)}
        batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([" ".join(doc) for doc in docs])], names=["doc_id", "text"])
        got = [r for b in leakage._score(SimpleNamespace(value=items), least)(iter([batch])) for r in b.to_pylist()]
        assert {(r["doc_id"], r["item_id"]) for r in got if r["score"] >= least} == expected


def test_alignment_by_plain_dynamic_programming():
    rng = random.Random(5)
    for _ in range(30):
        a, b = ([rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (leakage.MATCH if x == y else leakage.MISMATCH), table[i - 1, j] - leakage.GAP, table[i, j - 1] - leakage.GAP)
        runs = [k for i in range(len(a)) for j in range(len(b)) for k in range(1, 12) if len(a[i : i + k]) == k and a[i : i + k] == b[j : j + k]]
        (score,), (run,) = leakage.align([(np.array(a), np.array(b))])
        assert (score, run) == (table.max(), max(runs, default=0))
        many = leakage.align([(np.array(a), np.array(b)), (np.array([1, 2]), np.array([0, 1, 2, 3])), (np.array(a), np.array([], int))])
        assert many[0].tolist() == [score, 4, 0] and many[1].tolist() == [run, 2, 0]


def brute_spans(docs, span):
    where = {}
    for d, t in docs:
        if d is not None and t is not None:
            for i in range(len(t) - span + 1):
                where.setdefault(t[i : i + span], set()).add(d)
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        shared = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                shared[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], shared]).astype(int)))
        out |= {(d, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_by_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n, alphabet="abcdefgh é字😀\n": "".join(rng.choice(alphabet) for _ in range(n))
    parts = [text(n) for n in (40, 41, 45, 60, 39, 200)]
    docs = []
    for i in range(60):
        t = text(rng.randrange(120))
        for _ in range(rng.randrange(4)):
            x = rng.choice(parts)
            t += rng.choice([x, x[: rng.randrange(len(x))], x.upper()]) + text(rng.randrange(30))
        docs.append((i, t))
    docs += [(100 + i, docs[5][1] + parts[5]) for i in range(30)]  # a third are copies
    docs += [(200, None), (201, ""), (202, "aa" * 200), (203, "aa" * 180), (204, "x" * 39), (205, "ab" * 100 + parts[0]), (None, parts[5])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("pos", F.lit("clash")).repartition(3)
    got = {tuple(r) for r in spans.shared_spans(df, span=40, seed=20).collect()}
    assert got == brute_spans(docs, 40)
    share = {r["doc_id"]: r for r in spans.shared_share(df, spans.shared_spans(df, span=40, seed=20)).collect()}
    assert share[200]["share"] is None and share[100]["share"] == 1.0
    assert spans.shared_spans(df.where("false")).collect() == []


def test_seeds_are_common_to_equal_stretches():
    rng = random.Random(6)
    shared = "".join(rng.choice("abcd") for _ in range(240))
    a, b = ("".join(rng.choice("abcd") for _ in range(n)) for n in (300, 77))
    sets = [set(spans.seeds(spans.code_points(t))[1].tolist()) for t in (a + shared + b, b + shared + a)]
    assert sets[0] & sets[1]
    at, _ = spans.seeds(spans.code_points(a + shared + b))
    assert any(300 <= x <= 300 + 120 for x in at)
