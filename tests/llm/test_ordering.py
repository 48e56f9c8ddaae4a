"""Resampling, the prefix trie and sharding, against plain Python and SQL."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from check_oracles import compare, open_tables
from coldwatch.llm import prefix_trie, resampling, sharding
from coldwatch.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_resampling", "op12_prefix_trie", "op13_sharding"])
def test_equals_sql(spark, small, name):
    assert compare(spark, open_tables(small), name, QUERIES[name], ORACLES[name], small) is None


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_resampling(docs, target, percent=25, least=20):
    def feats(text):
        words = WORD.findall(lowered(text))
        return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(feats(text)[1])
    for text in target:
        wanted.update(feats(text)[1])
    S, T = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (S + 10_000) / ((raw[b] + 1.0) * (T + 10_000)))) for b in raw}
    rows = []
    for doc_id, text in docs:
        words, held = feats(text)
        weight = sum(gain[b] for b in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


def odd_docs(seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "be-ta", "gämma", "δέλτα", "42", "x" * 70, "zeta eta", "q"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 19, 20, 60])))) for i in range(150)]
    rows += [(None, "a b " * 15), (7, None), (7, ""), (8, "!?"), (9, "same text " * 20), (9, "same text " * 20), (-3, "z" * 30_000 + " " + "y " * 9_000)]
    rows += [(500 + i % 5, "copy of one text " * 8) for i in range(60)]  # many rows of the same few scores
    return rows


def test_resampling_of_odd_documents(spark):
    docs, target = odd_docs(), ["alpha be ta 42", None, "gämma δέλτα alpha"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, run int").repartition(5)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(df, wanted).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_resampling(docs, target)


def test_resampling_ranks_need_no_even_segments(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS_PER_SEGMENT", 7)
    monkeypatch.setattr(resampling, "SAMPLES", 640)
    rows = [(i % 3, 1, 0, i % 2) for i in range(400)] + [(None, 2, 1, 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(9)
    got, n = resampling.ranked(df)
    got = sorted(got.collect(), key=lambda r: r["rank"])
    assert n == 405 and [r["rank"] for r in got] == list(range(1, 406))
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(empty, target).collect() == []
    only = spark.createDataFrame([(1, None), (2, "word " * 30)], "doc_id long, text string")
    assert {(r.doc_id, r.n_features, r["rank"]) for r in resampling.resampled(only, target, percent=100).collect()} == {(1, 0, None), (2, 59, 1)}


def test_pair_checksums():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcäß9", k=rng.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(500)]
    (n, got), = resampling.bucket_numbers([" ".join(words)], 1 << 16)
    expect = [zlib.crc32(w.encode()) & 0xFFFF for w in words] + [zlib.crc32(f"{a} {b}".encode()) & 0xFFFF for a, b in zip(words, words[1:])]
    assert n == 500 and got.tolist() == expect


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[:d - 1])].add(tuple(path[:d]))
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(node)))).encode()).hexdigest())
        for node, m in members.items()), key=repr)


def talk(seed, conversations, depth, kinds):
    rng, rows = random.Random(seed), []
    for c in conversations:
        for turn in range(rng.randint(1, depth)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(kinds)))
    return rows


CASES = {
    "few texts, deep": lambda: talk(1, range(300), 14, ["a", "bb"]),
    "one text": lambda: [(c, t, "u", "x") for c in range(250) for t in range(c % 19)] + [(c, 0, "u", "x") for c in range(250)],
    "nulls, negatives, repeats": lambda: talk(2, [*range(-150, 20), 1000, 10**12], 9, [None, "", "ü", "x" * 5000])
    + [(None, 0, "user", "a"), (5, None, None, None), (5, None, "a", None), (6, 0, "user", "twice"), (6, 0, "user", "twice")],
    "long": lambda: [(700, t, "u", str(t % 7)) for t in range(3000)] + [(701, t, "u", str(t % 7)) for t in range(2500)] + talk(4, range(702, 790), 6, ["0", "1"]),
    "caterpillar": lambda: [(100 * c, t, "u", "y" if t == 40 - c else "x") for c in range(40) for t in range(41 - c)],
}


@pytest.mark.parametrize("case", CASES)
def test_trie(spark, case, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    monkeypatch.setattr(prefix_trie, "IDS_PER_RANGE", 10)
    rows = CASES[case]()
    random.Random(9).shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(6)
    ties = {r[:2] for r, n in Counter((r[0], r[1]) for r in rows).items() for r in [r] if n > 1}
    got = sorted(map(tuple, prefix_trie.trie(df).collect()), key=repr)
    want = plain_trie(rows)
    if case == "nulls, negatives, repeats":  # ties of different turns are ordered by digest, not by text
        got, want = ([r for r in side if r[0] != 5 or r[1] == 0] for side in (got, want))
        assert ties
    assert len(got) == len(want)
    if case != "nulls, negatives, repeats":
        assert got == want
    else:
        assert [r[:5] for r in got] == [r[:5] for r in want]


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).collect() == []
    only_null = spark.createDataFrame([(None, 1, "a", "b")], empty.schema)
    assert prefix_trie.trie(only_null).collect() == []


@pytest.mark.parametrize("bits, axes", [(1, 3), (2, 2), (3, 3), (4, 2), (2, 4)])
def test_curve_steps_to_neighbours(spark, bits, axes):
    cells = spark.range((1 << bits) ** axes).select(F.array(*(F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int") for i in range(axes))).alias("c"))
    path = [r.c for r in cells.orderBy(sharding.hilbert(F.col("c"), axes, bits)).collect()]
    assert sorted(r.h for r in cells.select(sharding.hilbert(F.col("c"), axes, bits).alias("h")).collect()) == list(range(len(path)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def odd_rows():
    rng = random.Random(11)
    rows = [(i, "wörd " * rng.randint(0, 300), rng.choice(["en", "de", None]), f"src{rng.randint(0, 30)}") for i in range(500)]
    return rows + [(None, None, None, None), (3, None, "en", "hot"), (3, "", "en", "hot"), (4, "l" * 400_000, "en", "hot")] + [(900 + i % 2, "copy", "en", "hot") for i in range(250)]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOC + ", place int, shard int").repartition(7)
    results = []
    for per_chunk in (20, 10**6):  # chunks change nothing
        monkeypatch.setattr(sharding, "ROWS_PER_CHUNK", per_chunk)
        got, own = sharding.sharded(df, law=law)
        assert own == "_place" and got.columns == [*df.columns, own]
        results.append(sorted((tuple(r) for r in got.select("doc_id", "text", "lang", "source", f"{own}.*").collect()), key=repr))
    assert results[0] == results[1]
    assert Counter(r[:4] for r in results[0]) == Counter(rows)
    shards = defaultdict(list)
    for *_, text, _, _, size, crc, index, shard, slot in results[0]:
        assert size == len((text or "").encode()) + 8 and crc == zlib.crc32((text or "").encode())
        shards[shard].append((slot, index, size))
    ends = []
    for shard in sorted(shards):
        held = sorted(shards[shard])
        assert [s for s, _, _ in held] == list(range(len(held))) and 0 <= shard < 24
        assert [i for _, i, _ in held] == sorted(i for _, i, _ in held)
        ends.append((held[0][1], held[-1][1]))
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    if law == "rows":
        counts = [len(shards[s]) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    else:
        total, longest = sum(s for held in shards.values() for _, _, s in held), max(len((r[1] or "").encode()) + 8 for r in rows)
        assert all(sum(s for _, _, s in held) <= total / 24 + longest for held in shards.values())


def test_sharding_of_nothing(spark):
    got, own = sharding.sharded(spark.createDataFrame([], DOC))
    assert got.collect() == []
    one, own = sharding.sharded(spark.createDataFrame([(1, None, None, None)], DOC), law="bytes")
    assert one.select(f"{own}.shard", f"{own}.slot", f"{own}.size").collect() == [(12, 0, 8)]
    with pytest.raises(ValueError):
        sharding.sharded(one, law="key")


def test_shards_as_files(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOC)
    bounds = sharding.write(df, str(tmp_path / "shards"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(map(tuple, back.select("doc_id", "text", "lang", "source").collect())) == Counter(rows)
    for wanted, keeps in (({"lang": "de"}, lambda r: r[2] == "de"), ({"lang": None}, lambda r: r[2] is None),
                          ({"source": "src7", "size": (0, 500)}, lambda r: r[3] == "src7" and len((r[1] or "").encode()) + 8 <= 500)):
        named = sharding.matching(bounds, **wanted)
        inside = back.where(F.col("shard").isin(named)).collect()
        assert Counter((r.doc_id, r.text, r.lang, r.source) for r in inside if keeps((r.doc_id, r.text, r.lang, r.source))) == Counter(r for r in rows if keeps(r))
        assert len(named) < 24  # a filter on any dimension leaves shards out


def test_sharding_has_no_python(spark, small):
    plan = QUERIES["op13_sharding"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
