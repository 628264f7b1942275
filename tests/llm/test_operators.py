"""Results against plain versions, on a fixture of odd rows: nulls, empty and long texts, ties, repeats, other scripts."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, langid, lm, mixing, quality, rlz, similar, simhash, toxicity, weak_rules
from tessera.llm.eliasfano import EliasFano

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block int, x string"
RANDOM = random.Random(3)
WORDS = ["".join(RANDOM.choice("abcdeéß漢") for _ in range(RANDOM.randint(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def texts():
    passage, long = prose(60), prose(6000)
    odd = [None, "", " \n\t ", "a", "one two", "A-Z  double   spaces \n\n  and more ", "don't  I'll\tWE'RE 123456 !!! ##", "\n".join(["same line here"] * 30), " lead", "trail ", "x y   z", "🙂🙂 é"]
    out = odd + [long, long, long + " tail", prose(40) + " " + passage + " " + prose(50), passage, passage.upper(), prose(13), prose(12)]
    out += [prose(RANDOM.randint(1, 80)) for _ in range(40)]
    return out + [out[-1], out[-2]]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(texts())]
    return out + [(None, "a null id with some words to keep"), (None, None), out[-1], (7, out[20][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, RANDOM.choice(["en", "fr", None]), RANDOM.choice(["src0", "src1", None]), None, None, 1, "c") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want, columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_simhash(docs, rows, empty):
    same(simhash.near_duplicates(docs), brute.near_duplicates(rows), ["doc_id", "fingerprint", "component_id"])
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_groups(spark, docs, rows, empty):
    """Exact groups on the fixture; near copies with changed words, few and in a crowd that shares its keys; no id, no word: no row."""
    want = brute.similar_groups([(i, t) for i, t in dict(rows).items() if i is not None and i != 7 and brute.WORD.search(t or "")])
    assert {tuple(r) for r in similar.similar_groups(docs.where("doc_id <> 7")).collect()} == set(want.items())
    assert similar.similar_groups(empty).count() == 0
    base, few = prose(400).split(), [prose(150).split() for _ in range(20)]

    def changed(words, n):
        out = list(words)
        for at in RANDOM.sample(range(len(out)), n):
            out[at] = "changed" + str(RANDOM.random())
        return " ".join(out)

    crowd = [(i, changed(base, 2)) for i in range(200)]
    pairs = [(1000 + 2 * i + j, changed(w, j)) for i, w in enumerate(few) for j in (0, 1)]
    clean = [(2000 + i, prose(100)) for i in range(50)]
    got = dict(map(tuple, similar.similar_groups(spark.createDataFrame(crowd + pairs + clean, "doc_id long, text string").repartition(4)).collect()))
    assert got == {i: 0 for i, _ in crowd} | {i: i - i % 2 for i, _ in pairs} | {i: i for i, _ in clean}


def test_links_of_dense_groups(spark):
    """A third of all fingerprints near one centre: components, not pairs, and none lost."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))}
    far = {int(x) for x in rng.integers(0, 2**63, 800)}
    values = sorted(near | far)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "x long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    assert len(links) < 2 * simhash.HOT * len(values)

    def groups(pairs):
        top = {v: v for v in values}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[find(a)] = find(b)
        out = {}
        for v in values:
            out.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    every = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert groups(links) == groups(every)


def test_thresholds_add_up():
    y = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    bits = np.unpackbits(y.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    plan = simhash.Plan(len(y), 4, bits.T @ bits)
    z = plan.arranged(y)
    assert (plan.restored(z) == y).all() and sorted(plan.order) == list(range(64))
    plan.learn([np.bincount(plan.cut(z, a, w).astype(int), minlength=1 << w).astype(float) for _, a, w in plan.parts])
    assert (plan.thresholds(z).sum(axis=0) == 5).all()


def test_bpe(spark, docs, rows, empty):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    out = out.withColumn("back", bpe.decode_column(spark, ranks, F.col("ids")))
    got = [(r["doc_id"], len(r["ids"]), brute.sha(",".join(map(str, r["ids"])).encode()), brute.sha(bytes(r["back"]))) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.bpe(rows, ranks, public_tokenizers.PATTERN)))
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("window", [13, 5])
def test_substrings(docs, rows, empty, window):
    out = rlz.dedupe(docs, window).withColumn("kept", F.sha2(F.col("text").cast("binary"), 256))
    same(out, brute.substrings(rows, window), ["doc_id", "n_words", "n_removed", "kept"])
    for r in out.collect():
        assert all(f["length"] >= window and (r["doc_id"] is None or f["ref_doc"] < r["doc_id"]) for f in r["factors"])
    assert rlz.dedupe(empty).count() == 0


def test_layout_is_kept(docs, rows):
    out = {(r["doc_id"], r["n_removed"]): r["text"] for r in rlz.dedupe(docs, layout=True).collect()}
    assert all(out[i, 0] == (t or "") for i, t in rows if (i, 0) in out and i is not None and i != 7)


def test_lm(docs, rows, empty):
    held = lambda i: brute.crc(i) % 5 == 1
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 != 1
    got = sorted(map(tuple, lm.score(docs, train).select("doc_id", (~F.col("train")), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    want = sorted(brute.lm(rows, held), key=repr)
    by = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6)))
    for a, b in zip(by(got), by(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) <= 0.04 * b[2]
    assert lm.score(empty, train).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, universe in ((0, 10), (1, 1), (1000, 1001), (3000, 1 << 50), (500, 500 << 3)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        own = EliasFano.of(values, universe)
        if n:
            assert (own.get(np.arange(n)) == values).all()
        asked = rng.integers(0, universe, 700).astype(np.uint64)
        assert (own.successor(asked) == np.searchsorted(values, asked)).all()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400, [0.0] * 8), (401, None), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [1.0, 2.0]), (None, [1.0] * 8), (450, [2.0, 4.0])]
    rows += [(500 + i, rows[50][1]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    want = sorted(brute.nearest(rows))
    assert [x[:3] for x in got if x[0] != 50] == [x[:3] for x in want if x[0] != 50]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rules(docs, rows, empty):
    out = weak_rules.judged(docs)
    same(out, [(i, *brute.statistics(t)) for i, t in rows], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    assert out.where("posterior is null or posterior < 0 or posterior > 1").count() == 0
    assert weak_rules.judged(empty).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_estimate_finds_bad_patterns():
    n = len(weak_rules.RULES)
    good, bad = (1,) * n, (1, 1, -1, -1, -1) + (1,) * (n - 5)
    prior, a, b = weak_rules.estimate([(good, 900), (bad, 100)])
    assert weak_rules.posterior(good, prior, a, b) > 0.9 > 0.1 > weak_rules.posterior(bad, prior, a, b)


def test_water_fills_siblings_first():
    assert mixing.water(10, [1, 1], [2, 100]) == [2, 8]
    out = mixing.budgets({("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}, {}, 200, 1)
    assert out == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    assert mixing.budgets({("a", "x"): 10, ("b", "x"): 1000}, {}, 200, 2) == {("a", "x"): 20, ("b", "x"): 180}


def test_mix(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 4)  # many ranges in a leaf
    args = dict(levels=[F.col("lang"), F.col("source")], tokens=F.length("text"), weights={("*", "src0"): 3.0}, share=1.4, epochs=2, seed=9)
    out = [tuple(r) for r in mixing.mix(docs, **args).select("doc_id", "path", "tokens", "epoch").collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, (tuple(r) for r in mixing.mix(docs.repartition(5), **args).select("doc_id", "path", "tokens", "epoch").collect())))
    table = docs.select("doc_id", F.coalesce("lang", F.lit("(none)")).alias("l"), F.coalesce("source", F.lit("(none)")).alias("s"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), *(F.shiftrightunsigned(F.xxhash64(F.lit(9), F.lit(e), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1).alias(f"h{e}") for e in (0, 1))).collect()
    leaves = {}
    for r in table:
        leaves[r["l"], r["s"]] = leaves.get((r["l"], r["s"]), 0) + r["n"]
    plan, want = mixing.budgets(leaves, args["weights"], 1.4 * sum(leaves.values()), 2), []
    for leaf, total in leaves.items():
        left = plan[leaf]
        for e in (0, 1):
            order = sorted((r for r in table if (r["l"], r["s"]) == leaf), key=lambda r: (r[f"h{e}"], r["doc_id"] is not None, r["doc_id"] or 0, r["n"]))
            taken = 0
            if not total or left <= 0:
                break
            for r in order:
                taken += r["n"]
                if taken > left:
                    break
                want.append((r["doc_id"], list(leaf), r["n"], e))
            left -= total
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert mixing.mix(empty, **args).count() == 0


def test_language(spark, empty):
    a, b = (["xa yo zu " * 5 + str(i) for i in range(30)], ["qwer tyui " * 5 + str(i) for i in range(30)])
    data = spark.createDataFrame([(t, "aa") for t in a] + [(t, "bb") for t in b] + [(None, "aa"), ("text", None)], "text string, lang string")
    model = langid.train(data)
    asked = spark.createDataFrame([(1, "yo zu xa"), (2, "tyui qwer"), (3, "123 !"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in asked.select("doc_id", langid.language_column(spark, model, F.col("text")).alias("p")).collect()}
    assert [got[i]["lang"] for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"]
    assert all(0 <= got[i]["score"] <= 1 for i in got)
    none = langid.train(empty)
    assert {r["p"]["lang"] for r in asked.select(langid.language_column(spark, none, F.col("text")).alias("p")).collect()} == {"und"}


def test_classifiers(spark, docs, empty):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(240)]
    data = [(i, t + (" awfulword" if i % 3 == 0 else "") if i % 2 else t + " ### $$$ ###" * (i % 3 == 0)) for i, t in enumerate(clean)]
    df = spark.createDataFrame([(i, t, "en") for i, t in data], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int("###" not in t), int("awfulword" in t)) for i, t in data] + [(None, 1, 1), (9999, None, 5)], "doc_id long, quality int, toxic int")
    machine, net = quality.train(df, marks), toxicity.train(df, marks)
    got = df.select("doc_id", quality.quality_column(spark, machine, F.col("text")).alias("q"), toxicity.toxicity_column(spark, net, F.col("text")).alias("t")).join(marks, "doc_id").toPandas()
    assert brute.auc(got.q.values, got.quality.values) > 0.95 and brute.auc(got.t.values, got.toxic.values) > 0.95
    both = docs.select(quality.quality_column(spark, machine, F.col("text")).alias("q"), toxicity.toxicity_column(spark, net, F.col("text")).alias("t"))
    assert both.where("q between 0 and 1 and t between 0 and 1").count() == docs.count()
    assert empty.select(quality.quality_column(spark, quality.train(empty, marks), F.col("text"))).count() == 0
    assert empty.select(toxicity.toxicity_column(spark, toxicity.train(empty, marks), F.col("text"))).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    place, value = np.array([3, 7, 20, 21]), rng.normal(size=4)
    pairs = sum(m.factors[a] @ m.factors[b] * x * y for i, (a, x) in enumerate(zip(place, value)) for b, y in zip(place[i + 1 :], value[i + 1 :]))
    assert np.isclose(m.raw(place, value, np.array([0, 4]))[0][0], 0.3 + m.linear[place] @ value + pairs)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "encoding"]
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encoding":
            assert out.columns == columns
            counts.append(out.count())
        got = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "near_duplicates":
            worded = [(i, t) for i, t in rows.items() if brute.WORD.search(t or "")]
            gone = {i for i, c in brute.similar_groups(worded).items() if i != c}
            assert got == set(rows) - gone and gone
        if name == "repeated_passages":
            want = {i: h for i, n, g, h in brute.substrings(list(rows.items())) if g < n or not n}
            assert {r["doc_id"]: brute.sha(" ".join(brute.WORD.findall(r["text"] or "")).encode()) for r in out.collect()} == want
        if name == "encoding":
            ranks = bpe.load_ranks(corpus_pipeline.RANKS)
            want = {(i, n, h) for i, n, h, _ in brute.bpe(list(rows.items()), ranks, public_tokenizers.PATTERN)}
            assert {(r["doc_id"], r["n_tokens"], brute.sha(",".join(map(str, r["ids"])).encode())) for r in out.collect()} == want
        docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0


def varied(base, n, tag):
    """The words of base, n of them (at evenly spread places) replaced."""
    out = list(base)
    for j, at in enumerate(np.linspace(7, len(base) - 8, n).astype(int) if n else []):
        out[at] = f"{tag}v{j}"
    return out


def jaccard(x, y, k=5):
    s, u = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (x, y))
    return len(s & u) / len(s | u)


def groups_of(spark, texts):
    data = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return dict(map(tuple, similar.similar_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()))


def test_every_pair_at_the_threshold_is_met(spark):
    """600 pairs of a similarity of 0.80 to 0.85: all of them, none left to luck."""
    rng = random.Random(11)
    out = []
    for i in range(600):
        base = [f"w{i}x{rng.randrange(10**6)}" for _ in range(400)]
        out += [base, varied(base, 7 + i % 2, f"t{i}")]
    assert all(0.8 <= jaccard(a, b) < 0.85 for a, b in zip(out[::2], out[1::2]))
    assert groups_of(spark, out) == {i: i - i % 2 for i in range(1200)}


def scattered(rng, base, n, tag):
    """The words of base, n of them (anywhere, at least six words apart) replaced."""
    while True:
        places = sorted(rng.sample(range(5, len(base) - 5), n))
        if all(b - a > 5 for a, b in zip(places, places[1:])):
            break
    out = list(base)
    for at in places:
        out[at] = f"{tag}v{at}"
    return out


def test_texts_of_one_template_stay_apart(spark):
    """300 variants whose similarities are all under 0.79, mostly 0.70 to 0.79: none is a near-duplicate."""
    rng, base = random.Random(5), [f"w{i}" for i in range(400)]
    out, sets, most = [], [], []
    while len(out) < 300:
        words = scattered(rng, base, 6, f"t{len(out)}x")
        own = {hash(tuple(words[i : i + 5])) for i in range(len(words) - 4)}
        near = [len(own & s) / len(own | s) for s in sets]
        if max(near, default=0) < 0.79:
            out.append(words)
            sets.append(own)
            most += near
    assert 0.70 < sorted(most)[len(most) // 2] < 0.79
    assert groups_of(spark, out) == {i: i for i in range(300)}


def test_crowded_copies_of_an_original_are_found(spark):
    """300 copies of 0.80 to 0.84 to their original, further from each other."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    out = [base, *(scattered(rng, base, 7 + i % 2, f"t{i}x") for i in range(300))]
    assert all(0.8 <= jaccard(base, w) < 0.84 for w in out[1:])
    assert groups_of(spark, out) == dict.fromkeys(range(301), 0)


def test_short_texts_are_compared_by_shingles(spark):
    """300 pairs of eight and nine words, four shingles of five shared: a similarity of exactly 0.8."""
    out = []
    for i in range(300):
        base = [f"w{i}x{j}" for j in range(9)]
        out += [base, base[:8]]
    assert {jaccard(a, b) for a, b in zip(out[::2], out[1::2])} == {0.8}
    assert groups_of(spark, out) == {i: i - i % 2 for i in range(600)}


def test_pipeline_near_duplicates_go_through_simhash(spark, monkeypatch):
    """Pairs within 4 bits come from SimHash alone, if their shingles are alike; those that 64 bits miss come from the join."""
    import corpus_pipeline

    rng, texts = random.Random(12), []
    for i in range(40):  # every other pair: one word changed; the others: similarities of 0.80 to 0.85
        base = [f"w{i}x{rng.randrange(10**6)}" for _ in range(400)]
        texts += [base, varied(base, 7 if i % 2 else 1, f"t{i}")]
    for i in range(5):  # a line thirty times, tails of their own: few bits, but few common shingles
        line = [f"line{i}x{j}" for j in range(20)] * 30
        texts += [[*line, *(f"{tail}{i}x{j}" for j in range(30))] for tail in "ab"]
    prints = [brute.fingerprint(" ".join(w)) for w in texts]
    pairs = [(i, i + 1) for i in range(0, len(texts), 2)]
    close = {b for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 4}
    alike = {b for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8}
    assert close & alike and close - alike and len(alike - close) > 10
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    asked, linked, prefixes = [], simhash.links, similar.prefixes

    def spied(distinct, t, *more):
        asked.append(({r["x"] % 2**64 for r in distinct.collect()}, t))
        return linked(distinct, t, *more)

    def gone():
        return set(range(len(texts))) - {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}

    monkeypatch.setattr(simhash, "links", spied)
    assert gone() == alike and asked == [(set(prints), 4)]
    monkeypatch.setattr(similar, "prefixes", lambda *args: (prefixes(*args)[0].limit(0), spark.range(0)))
    assert gone() == alike & close


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark):
    """Stages that filter decide row by row: other texts under the same or no id stay, copies go whatever their id."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")

    def kept(stage, rows):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], schema).repartition(3)
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, df, "").collect()), key=repr)

    clean = [(1, one), (1, two), (None, three), (None, four), (None, None), (None, None), (5, " "), (5, "")]
    got = kept(corpus_pipeline.drop_near_duplicates, [*clean, (1, one), (2, two + " tail"), (None, one), (None, three)])
    assert got == sorted(clean, key=repr)
    tail = "some words of its own at the end"
    got = kept(corpus_pipeline.drop_repeated_passages, [*clean, (1, one), (2, two + " " + tail), (None, one)])
    bare = lambda rows: sorted(((i, (t or "").strip()) for i, t in rows), key=repr)
    assert bare(got) == bare([*clean, (1, one), (2, tail)])
    for doc_id in (None, 7):
        rows = [(doc_id, f"row {i} of ten words that all differ by number {i}") for i in range(100)]
        got = kept(corpus_pipeline.mix_sources, rows)
        assert len(got) == len(set(got)) == 80 and set(got) < set(rows)
