"""Mixing, secrets, fingerprints, languages and the pipeline."""
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coldwatch.llm import fingerprints, languages, minhash, mixing, secrets
from coldwatch.llm.queries import QUERIES
from coldwatch.session import freeze

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def fair_targets(sizes, weights=(5, 2, 1)):
    """By passing on what is above, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    held = set()
    for _ in range(1000):
        excess = sum(max(0, target[s] - 3 * sizes[s]) for s in names)
        held |= {s for s in names if target[s] >= 3 * sizes[s]}
        for s in names:
            if s in held:
                target[s] = min(target[s], 3 * sizes[s])
        free = sum(weight[s] for s in names if s not in held)
        if excess < 1e-9 or not free:
            break
        for s in names:
            if s not in held:
                target[s] += excess * weight[s] / free
    return target


def mixed_as_asked(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = fair_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_mixing(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = QUERIES["op1_mixing"](spark, small).collect()
    mixed_as_asked(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op1_mixing"](spark, small).collect()))


def test_odd_mixing(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "empty"), (4, "w " * 5000, "hot"), (5, "w " * 700, "Ünder"), (5, "w " * 700, "Ünder"), (None, "q r", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, block int")
    mixed_as_asked(rows, mixing.mixture(df).collect())
    assert mixing.mixture(df.limit(0)).count() == 0
    assert mixing.mixture(df.where("doc_id = 3")).first().taken == 0
    copies = mixing.copies(df)
    assert copies.columns == df.columns
    assert max(Counter((r.doc_id, r.source) for r in copies.collect()).values()) <= 6


@pytest.mark.parametrize("count", [1, 2, 7, 100])
def test_permutation(spark, count):
    place, key = F.col("id"), F.lit(3).cast("long")
    rows = spark.range(count).select("id", mixing.permuted(place, F.lit(count).cast("long"), key).alias("to")).select(
        "id", "to", mixing.permuted(F.col("to"), F.lit(count).cast("long"), key, back=True).alias("back")).collect()
    assert sorted(r.to for r in rows) == list(range(count))
    assert all(r.back == r.id for r in rows)


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)]


def test_secrets(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op6_secret_scan"](spark, small).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(","))


def test_odd_secrets(spark):
    draw = random.Random(4)
    parts = ["token", "=", ":", " ", "api_key", "APIKEY", "ſecret", "secret", "AKIA", "ABCD1234EFGH", "0a1b2c3d4e5f6a7b", "'", '"', "é", "😀", "-", "\n", "x"]
    rows = [(0, None), (1, ""), (2, 'token: secret: abcdefgh12 pässword = "abcdefghi" AKIAAKIA1234 ' + "ab" * 16 + "😀" + "f" * 40)]
    rows += [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for i in range(3, 200)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows += [(i, f"see {''.join(draw.choice(letters) for _ in range(44))} there") for i in range(200, 300)]
    rows += [(400, "see " + "F" * 30 + " and " + "aB3" * 9)]
    names = ["Hello", "World", "file", "Name", "Index", "2", "Config", "Reader", "Some"]
    rows += [(i, f"see {''.join(draw.choice(names) for _ in range(9))} there") for i in range(301, 400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int")
    got = {r.doc_id: r for r in secrets.secrets(df).select("doc_id", secrets.written(F.col("base")).alias("base"), secrets.written(F.col("spans")).alias("spans")).collect()}
    assert all(got[i].base == ",".join(base(t)) for i, t in rows)
    assert sum("random" in got[i].spans for i in range(200, 300)) > 85
    assert not any("random" in got[i].spans for i in range(301, 401))
    clean = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert clean[0] is None and clean[1] == "" and "abcdefghi" in clean[2] and "ab" * 16 not in clean[2] and "f" * 40 not in clean[2] and clean[2].startswith("token: secret: abcdefgh12 ")
    assert secrets.redacted(df).columns == df.columns
    assert secrets.secrets(df.limit(0)).count() == 0


def test_secrets_of_other_encodings(spark):
    """Random base 32, letters of one case with digits, and letters without digits are found; long words and names aren't."""
    draw = random.Random(6)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [upper + "234567", lower + "234567", lower + "0123456789", upper + "0123456789", lower + upper]
    rows = [(i, f"see {''.join(draw.choice(kinds[i % 5]) for _ in range(72))} there") for i in range(500)]
    words = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would".split()
    rows += [(i, f"see {''.join(draw.choice(words) for _ in range(20))} there") for i in range(500, 600)]
    rows += [(i, f"see {'_'.join(draw.choice(words).upper() for _ in range(12))} there") for i in range(600, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in secrets.secrets(df).where("exists(spans, s -> s.kind = 'random')").collect()}
    assert [sum(i % 5 == kind for i in got if i < 500) > 85 for kind in range(5)] == [True] * 5
    assert not any(i >= 500 for i in got)


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark, small):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, small).collect()}
    off, prints = [], {}
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited, r = text[:len(text) - half] + following[:half], got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        off.append(abs(r.near_edited - len(a & b) / max(1, len(a | b))))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert sum(off) / len(off) < 0.06
    assert len(got) == len(rows)


def test_odd_fingerprints(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (None, "x y z", 0), (4, "word " * 9000, 0), (4, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int")
    got = fingerprints.edited(df).select("doc_id", "text", "edited", fingerprints.likeness(F.col("hashes"), F.col("next_hashes")).alias("near")).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 6
    assert by[3, "a b"].edited == "a a" and by[None, "x y z"].edited == "x y"
    assert by[1, ""].near == 1.0 and by[2, ""].near == 0.0
    assert fingerprints.edited(df.limit(0)).count() == 0


def test_languages(spark, small):
    sf = small.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_language_id"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and 0.15 < len(held) / len(got) < 0.35
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_foreign_texts(spark):
    """Random letters, base 64 and Latin-script languages that weren't learnt are rejected; clean documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train(languages.learnt_from(docs))
    draw = random.Random(2)
    noise = lambda n: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n))
    italian = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era e cosa dura "
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
    blob = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))
    foreign = [noise(100), noise(1000), italian * 8, finnish * 8, blob]
    rows = spark.createDataFrame([*enumerate(foreign)], "doc_id long, text string")
    assert [r.rejected for r in languages.predict(rows, model).orderBy("doc_id").collect()] == [True] * len(foreign)
    assert languages.predict(docs.where(languages.held_out()), model).where(
        "rejected AND size(array_distinct(split(text, ' '))) >= 10").count() == 0  # others repeat a word or two throughout


def test_odd_languages(spark):
    good = [(i, "the cat and the dog " * 20, "en") for i in range(1, 60)] + [(i, "le chat et la souris " * 20, "fr") for i in range(60, 120)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 34 !", "fr"), (None, "the cat and the dog", "en"), (903, "щука и карась " * 300, None), (904, "the dog", None)]
    df = spark.createDataFrame(good + odd, "doc_id long, text string, lang string")
    model = languages.train(languages.learnt_from(df))
    got = {r.doc_id: r for r in languages.predict(df, model).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[903].rejected and not got[904].rejected and got[904].lang_pred == "en"
    nothing = languages.train(df.limit(0))
    assert {r.lang_pred for r in languages.predict(df, nothing).collect()} == {"und"}


def test_pipeline(spark, small):
    """Each stage's rows against what its input says, in plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.freeze(stage(spark, seen[-1], small), name))
    rows = [df.collect() for df in seen]
    assert all(df.columns == docs.columns for df in seen[:-1])
    assert all(any(c.isalpha() for c in r.text) for r in rows[1])
    assert {r.doc_id for r in rows[0] if r.text and len(r.text) > 200} <= {r.doc_id for r in rows[1]}
    from tests.llm.test_duplicates import linked_documents

    kept = {r[0] for r in linked_documents([(r.doc_id, r.text) for r in sorted(rows[1], key=lambda r: r.doc_id)], 5) if r[3]}
    assert {r.doc_id for r in rows[2]} == kept and len(rows[2]) == len(kept)
    for before, after in zip(sorted(rows[2]), sorted(rows[3])):
        assert before.doc_id == after.doc_id and (before.text == after.text) == (not base(before.text))
    counts, sizes = Counter(r.doc_id for r in rows[4]), {r.doc_id: r.source for r in rows[3]}
    assert max(counts.values()) <= 3 and counts.keys() <= sizes.keys()
    taken, words = Counter(), Counter()
    for r in rows[3]:
        n = len(WORD.findall(r.text or ""))
        words[r.source] += n
        taken[r.source] += n * counts[r.doc_id]
    assert sum(taken.values()) == pytest.approx(sum(words.values()), rel=0.25)
    from coldwatch.llm import pieces

    library = pieces.encoder(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)).library
    assert sorted((r.doc_id, r.decoded) for r in rows[5]) == sorted((r.doc_id, r.text) for r in rows[4])
    assert all(r.ids == [*library.encode(r.decoded), 2] for r in rows[5])
    assert corpus_pipeline.run(spark, small).count() == len(rows[5])
    assert minhash.deduplicated(docs.limit(0)).count() == 0


CLASHING = ["rejected", "score", "lang_pred", "judged", "guess", "key", "spans", "gone", "words", "size", "copy", "rate", "taken", "node"]


def test_stages_keep_columns_of_any_name(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    wide = freeze(docs.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHING if c not in docs.columns)), "wide")
    own = [c for c in CLASHING if c not in docs.columns]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, wide, small)
        assert rows.columns == wide.columns, name
        for row in rows.select("doc_id", *own).collect():
            assert all(row[c] == f"{c} {row.doc_id}" for c in own), name
