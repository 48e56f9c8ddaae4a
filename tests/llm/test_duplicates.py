"""Near-duplicate and repeat operators against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldwatch.llm import minhash, suffixes, vectors
from coldwatch.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def linked_documents(rows, size):
    """rows in ascending doc_id: (doc_id, n, component, kept)."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    groups, where = Union(len(rows)), defaultdict(list)
    for k, own in enumerate(sets):
        shared = Counter(j for s in own for j in where[s])
        for s in own:
            where[s].append(k)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                groups.join(k, j)
    return [(rows[k][0], len(s), rows[groups.find(k)][0], groups.find(k) == k) for k, s in enumerate(sets)]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_near_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted_rows(QUERIES["op2_minhash"](spark, small)) == sorted(linked_documents(rows, 2), key=str)


def family(draw, words, edits):
    """A text and copies of it with a few words changed."""
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    while True:
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(words)] = f"x{draw.randrange(9000)}"
        yield " ".join(copy)


def test_large_groups(spark, monkeypatch):
    """Groups far beyond a small node, chains of neighbours, and groups that share nodes without being linked."""
    draw = random.Random(3)
    copies, apart = family(draw, 60, 3), family(draw, 60, 14)
    texts = [next(copies) for _ in range(260)] + [next(apart) for _ in range(200)]
    chain = [f"c{i}" for i in range(40)]
    for i in range(40):
        chain = [*chain[1:], f"c{40 + i}"]
        texts.append(" ".join(chain))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(minhash, "SMALL", 20)
    monkeypatch.setattr(minhash, "SIFTED", 60)  # larger nodes go to blocks unsifted
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    want = linked_documents(rows, 2)
    assert Counter(r[2] for r in want).most_common(1)[0][1] > 200
    assert sorted_rows(got) == sorted(want, key=str)


@pytest.mark.parametrize("rows, columns", [(1, 5), (9, 7)])
def test_common_values(monkeypatch, rows, columns):
    monkeypatch.setattr(minhash, "COLUMNS", 3)  # counted in several parts
    draw = random.Random(rows)
    sets, others = ([{draw.randrange(40) for _ in range(draw.randint(1, 30))} for _ in range(n)] for n in (rows, columns))
    arrays, other_arrays = ([np.array(sorted(s), np.uint64) for s in group] for group in (sets, others))
    assert minhash.common(arrays, other_arrays).tolist() == [[len(a & b) for b in others] for a in sets]


def test_short_texts_at_the_limit(spark):
    """Sets of 4 to 20 shingles that share exactly 0.8, or one less: none is lost, none too many."""
    rows = []
    for k in range(400):
        n = (4, 8, 12, 16, 20)[k % 5]
        shared = [f"s{k}x{i}" for i in range(n)]
        rows += [(len(rows), " ".join(shared)), (len(rows) + 1, " ".join([*shared, *(f"t{k}x{i}" for i in range(n // 4 + (k % 2)))]))]
    got = sorted_rows(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1))
    assert got == sorted(linked_documents(rows, 1), key=str)


def missed(agree, trees, depth):
    """How many pairs with these agreeing tokens meet in no node of this depth."""
    draw = np.random.default_rng(8)
    one = draw.integers(0, 1 << 32, agree.shape, np.uint32)
    other = np.where(agree, one, draw.integers(0, 1 << 32, agree.shape, np.uint32))
    (row, node), (row_2, node_2) = (minhash.descended(t, *minhash.roots(range(trees), len(t)), depth) for t in (one, other))
    keys, keys_2 = (minhash.mixed(r.astype(np.uint64)) ^ n for r, n in ((row, node), (row_2, node_2)))
    return len(agree) - len(np.unique(row[np.isin(keys, keys_2)]))


@pytest.mark.parametrize("depth", [3, 4, 6, 9])
def test_recall_at_depth(depth):
    """Pairs at exactly the limit meet at each depth that large nodes are branched to, given that depth's trees."""
    agree = np.random.default_rng(7).random((6000, minhash.TOKENS)) < 0.8
    assert missed(agree, minhash.TREES[depth - minhash.DEPTH], depth) <= 2


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, " one "), (6, "a b"), (7, "a b"), (7, "a b"), (8, "b a"), (None, "a b"), (9, "É é"), (10, "é É")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n int, node string")
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(df, 2).collect()}
    assert got == {(1, 1, True, 0), (2, 2, True, 0), (3, 3, True, 1), (4, 3, False, 1), (5, 3, False, 1), (6, 6, True, 1), (7, 6, False, 1),
                   (8, 8, True, 1), (None, None, True, 1), (9, 9, True, 1), (10, 10, True, 1)}
    assert minhash.near_duplicates(df.limit(0), 2).count() == 0
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 8, 9, 10]


def repeats(rows):
    texts, length = [(t or "").encode() for _, t in rows], suffixes.LENGTH
    seen = Counter(b[s:s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        covered = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                covered[s] += 1
                covered[s + length] -= 1
        covered = np.cumsum(covered)[:len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        out.append((doc_id, len(b), len(b) - len(kept), len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted_rows(QUERIES["op8_suffix_dedup"](spark, small)) == repeats(rows)


def test_passage_in_most_documents(spark):
    """One passage amid different words: its suffixes agree on a side far beyond a few bytes, and are still dealt to many buckets."""
    draw = random.Random(9)
    text = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))
    passage = text(160)
    rows = [(i, f"{text(60)} {passage} {text(60)}" if i % 10 else text(150)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = suffixes.identified(df)
    anchors = suffixes.found_regions(known).groupBy("anchor").count().where("count > 300").select("anchor")
    every = suffixes.found_regions(known).join(anchors, "anchor").withColumn("single", F.lit(True))
    found = suffixes.suffixes(every.dropDuplicates(["anchor", "content"]), known)
    for side in suffixes.SIDES:
        sizes = [r["count"] for r in suffixes.dealt(found, side).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3 * sum(sizes) / max(12, suffixes.partitions(spark))
    assert sorted_rows(suffixes.without_repeats(df)) == repeats(rows)


@pytest.mark.parametrize("stretch", [1 << 21, 700])
def test_planted_repeats(spark, monkeypatch, stretch):
    monkeypatch.setattr(suffixes, "AT_ONCE", stretch)
    draw = random.Random(3)
    text = lambda n: " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(n))
    shared = [text(draw.randint(60, 300)) for _ in range(6)] + ["ab" * 400, "x" * 900]
    rows = [(1, None), (2, ""), (3, "short"), (None, shared[0]), (4, "y" * 399), (5, "y" * 399), (6, "z" * 401)]
    for i in range(10, 110):
        body = text(draw.randint(0, 80))
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(shared)
            a = draw.randint(0, len(p) // 3)
            body += " " + p[a:len(p) - draw.randint(0, len(p) // 3)] + " " + text(draw.randint(0, 5))
            if draw.random() < 0.3:
                at = draw.randrange(len(body))
                body = body[:at] + "Z" + body[at + 1:]
        rows.append((i, body))
    rows += [rows[12], (500, rows[14][1]), (11, text(200))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, anchor int, first int")
    assert sorted_rows(suffixes.without_repeats(df)) == repeats(rows)


def test_windows_shared_by_regions_apart_in_both_orders(spark):
    """Texts share a core of 380 bytes and, with a first one, some bytes before and behind it that add up to about 20: the nearest in one order
    agree too little on the other side, and the partner of a window is no neighbour in either."""
    draw = random.Random(21)
    text = lambda n: "".join(draw.choice("abcdefghijkl") for _ in range(n))
    rows = []
    for _ in range(4):
        core, left, right = text(380), text(60), text(60)
        for k in range(60):
            before = draw.randint(0, 22)
            behind = max(0, draw.randint(17, 22) - before)
            rows.append((len(rows), text(200) + left[60 - before:] + core + right[:behind] + text(200)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(suffixes.without_repeats(df)) == repeats(rows)


def test_no_task_takes_all_regions_of_an_anchor(spark, monkeypatch):
    """A line of one letter in all documents: neither the regions of its anchor nor those found repeated meet in one task."""
    draw = random.Random(33)
    text = lambda n: "".join(draw.choice("abcdefghijkl") for _ in range(n))
    rows = [(i, text(100) + "-" * 700 + text(100)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    largest = {}

    def share(df):
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        return max(counts, default=0) / max(1, sum(counts))

    def frozen(df, label, freeze=suffixes.freeze):
        largest[label] = share(df)
        return freeze(df, label)

    monkeypatch.setattr(suffixes, "freeze", frozen)
    monkeypatch.setattr(suffixes, "FREQUENT", 50, raising=False)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = suffixes.repeated(suffixes.identified(df))
        assert largest["regions"] < 0.5
        assert share(found) < 0.5
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    monkeypatch.undo()
    assert sorted_rows(suffixes.without_repeats(df)) == repeats(rows)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_frequent_keys_meet_what_the_others_meet(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    rows = spark.createDataFrame([(k, i) for k in range(8) for i in range(k)], "anchor long, i int")
    keys = spark.createDataFrame([(k, k, f"of {k}") for k in range(2, 10)], "anchor long, n long, of string")
    met = suffixes.met(rows, keys, ["anchor"]).select("anchor", "i", "of")
    assert sorted_rows(met) == sorted(((k, i, f"of {k}") for k in range(2, 8) for i in range(k)), key=str)
    assert suffixes.met(rows, keys.limit(0), ["anchor"]).count() == 0


def test_buckets_grow_with_the_suffixes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PER_BUCKET", 10)
    found = spark.range(1000).selectExpr("id AS anchor", "encode(string(id), 'UTF-8') AS before", "encode(string(id), 'UTF-8') AS behind")
    assert suffixes.dealt(found, "behind").rdd.getNumPartitions() == 100


def test_session_stays_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    suffixes.without_repeats(spark.createDataFrame([(1, "a" * 900)], "doc_id long, text string")).count()
    assert spark.conf.get(key, None) == before


def test_no_repeats(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert suffixes.without_repeats(df.limit(0)).count() == 0
    assert suffixes.without_repeats(df).first().n_removed == 0


def linked_vectors(rows, cosine):
    groups, n = Union(len(rows)), [0] * len(rows)
    fine = lambda r: r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    groups.join(i, j)
                    n[i] += 1
                    n[j] += 1
    return [(r[0], n[k], rows[groups.find(k)][0], groups.find(k) == k) for k, r in enumerate(rows)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    draw = np.random.default_rng(2)
    rows = []
    for c in range(6):
        centre = draw.normal(size=12)
        rows += [((centre + draw.normal(size=12) * s).astype("f4").tolist(), c % 2) for s in draw.uniform(0, 0.25, 60)]
    rows += [rows[0], rows[0], rows[70], ([0.0] * 12, 1), (None, 1), (rows[0][0], None), ([float("nan")] * 12, 1), ([None] * 12, 1), ([1e30] + [0.0] * 11, 1), ([1.0] * 5, 1), ([2.0] * 5, 1)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, list int, own string")
    want = linked_vectors(rows, 0.98)
    assert sum(r[1] for r in want) > 500
    assert sorted_rows(vectors.near_duplicates(df)) == sorted(want, key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vector_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    assert sorted_rows(QUERIES["op3_vectors"](spark, small)) == sorted(linked_vectors(rows, 0.98), key=str)
