"""What each method promises beyond its results: independence of neighbours, what travels, plain versions of models."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, features, langid, lm, quality, rlz, toxicity, weak_rules
from tessera.llm.common import seen_again, shared_dir, unpack, word_codes, word_hashes
from tessera.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
RANDOM = random.Random(8)
WORDS = ["".join(RANDOM.choice("abcdeéß漢") for _ in range(RANDOM.randint(1, 6))) for _ in range(200)]
ODD = [None, "", " \n ", "A-Z a", "### $$$ !!! 12", "same line\n" * 30, "x" * 5000, "é 漢 🙂 e"]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


# Language identification.


def test_language_by_plain_bayes(spark):
    """Production buckets, whole texts of a small table, repeats and odd texts included, against sums written out."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1000 + i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)] + rows[:2]
    docs = spark.createDataFrame([(i, t, g, "clash", 0.5) for i, t, g in rows], "doc_id long, text string, lang string, p string, score double").repartition(3)
    model = langid.train(docs)
    got = docs.select("doc_id", "text", langid.language_column(spark, model, F.col("text")).alias("q")).collect()
    want = brute.bayes([(t, g) for _, t, g in rows], [r["text"] for r in got], langid.BUCKETS)
    assert [r["q"]["lang"] for r in got] == [x for x, _ in want]
    assert all(abs(r["q"]["score"] - x) < 1e-4 for r, (_, x) in zip(got, want))


def test_language_score_ignores_neighbours(spark):
    docs = spark.createDataFrame([(prose(30), "aa"), ("qwert zuiop " * 9, "bb"), ("mnb vcx " * 7, "cc")], "text string, lang string")
    model = langid.train(docs)
    texts = [t.encode() for t in ["a", "", "qw", "漢", *(prose(RANDOM.randint(1, 40)) for _ in range(60)), "zuiop"]]
    names, sure = model.predict(texts)
    for k in (1, 7, 40):
        parts = [model.predict(texts[:k]), model.predict(texts[k:])]
        assert parts[0][0] + parts[1][0] == names and (np.concatenate([parts[0][1], parts[1][1]]) == sure).all()
    backwards = model.predict(texts[::-1])
    assert backwards[0][::-1] == names and (backwards[1][::-1] == sure).all()


# Byte-level BPE.


def test_pre_tokens_of_odd_white_space():
    """The pre-tokens themselves, not only the ids: every way of mixing white space between words."""
    find = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(400):
        texts = ["".join(rng.choice([" ", " ", " ", "\n", "\t", "\r", " ", " ", "\x1c", "\x85", "a", "b", "'s", "1", "!", "é"]) for _ in range(rng.randint(0, 14))).encode() for _ in range(50)]
        codes, offsets, flat, units, tokens = bpe.cut(texts, find)
        for d, text in enumerate(texts):
            own = [tokens[t] for c in codes[offsets[d] : offsets[d + 1]] for t in flat[units[c] : units[c + 1]]]
            assert own == find.findall(text.decode()), text


def test_decoding_raises_for_unknown_ids(spark):
    ranks = {bytes([b]): b for b in range(256)}
    df = spark.createDataFrame([([72, 105],), ([],), (None,)], "ids array<int>")
    assert [r["b"] if r["b"] is None else bytes(r["b"]) for r in df.select(bpe.decode_column(spark, ranks, F.col("ids")).alias("b")).collect()] == [b"Hi", b"", None]
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([72, 300],)], "ids array<int>").select(bpe.decode_column(spark, ranks, F.col("ids"))).collect()


# Substring dedup.


def test_a_hot_passage_is_sent_once(monkeypatch):
    """However often a batch's documents hold a passage, the reference blocks get its segments once."""
    passage = prose(200)

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(rlz, "TaskContext", Task)

    def asked(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([passage.encode()] * n, pa.binary())], ["doc_id", "text"])
        kept = pa.Table.from_batches(list(rlz._batch(4, 13, None)([batch])))
        shard = kept.column("shard").to_numpy()
        repeated = pa.Table.from_batches(list(seen_again(kept.filter(pa.array(shard >= 0)).sort_by("shard").to_batches())))
        out = rlz._ask(4, 13)(kept.filter(pa.array(shard < 0)), repeated).to_pylist()
        return sum(len(unpack(r["payload"])[0]) for r in out if r["shard"] >= 0)

    assert asked(1) == 0 < asked(2) == asked(100) == asked(1000)


def test_factors_are_greedy_and_at_least_a_window(spark):
    """A factor goes on while text and reference go on alike, also where another document holds what follows; windows
    over its end are looked up again."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(1, " ".join(a)), (2, " ".join(a[10:30] + b)), (3, " ".join(c[:5] + a[:36] + b[:20] + c[5:])), (4, " ".join(a[:12] + c[:12] + b[:12]))]
    out = {r["doc_id"]: r for r in rlz.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {i: [(f["start"], f["length"], f["ref_doc"], f["ref_start"]) for f in r["factors"]] for i, r in out.items()}
    assert spans == {1: [], 2: [(0, 20, 1, 10)], 3: [(5, 36, 1, 0), (41, 20, 2, 20)], 4: []}
    words = {i: t.split() for i, t in rows}
    for i, own in spans.items():
        for start, n, doc, at in own:
            assert n >= 13 and words[i][start : start + n] == words[doc][at : at + n]


def test_equal_hashes_of_other_words():
    text = np.array([1, 2, 3, 9, 9, 4, 5, 6, 9, 9, 1, 2, 3], dtype=np.int32)
    kind = rlz.alike(text, np.array([0, 5, 10]), np.array([7, 7, 7], dtype=np.uint64), 3)
    assert kind[0] == kind[2] != kind[1]


def test_long_runs_of_one_word(spark):
    rows = [(1, "x " * 3000), (2, "y " + "x " * 500 + "z"), (3, "x " * 12), (None, "x " * 40)]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n_words int, factors string")
    got = sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["text"].encode())) for r in rlz.dedupe(docs).collect())))
    assert got == sorted(map(repr, brute.substrings(rows)))


# Language model.


def test_model_scores_texts_it_was_not_made_from(spark):
    learned, other = [(i, prose(60)) for i in range(80)], [(500 + i, prose(25) + " neverseen") for i in range(20)] + [(700, None), (None, "漢")]
    schema = "doc_id long, text string"
    model = lm.train(spark.createDataFrame([(i, t, 1, 2) for i, t in learned], f"{schema}, block long, shard int").repartition(3))
    asked = spark.createDataFrame([(i, t, "k") for i, t in other], f"{schema}, payload string").repartition(2)
    for _ in range(2):  # the model stays
        got = {r["doc_id"]: r for r in lm.score_texts(asked, model).collect()}
        want = {r[0]: r for r in brute.lm(learned + other, lambda i: i is None or i >= 500) if r[1]}
        for i, t in other:
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == want[i][2:5]
            assert abs(got[i]["base_score"] - want[i][5]) < 1e-6 and abs(got[i]["score"] - want[i][6]) <= 0.04 * want[i][2]
    assert model.tries.count() > 1


def test_trigrams_are_learned(spark):
    """`b` is followed by c after a and by e after d: only the third order knows which."""
    docs = spark.createDataFrame([(i, "a b c x" if i % 2 else "d b e x") for i in range(200)], "doc_id long, text string")
    model = lm.train(docs)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame([(1, "a b c x"), (2, "a b e x")], "doc_id long, text string"), model).collect()}
    assert got[1] > got[2] + 1


def test_hot_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lm, "shards_for", lambda df, size: 16)
    rows = [(i, " ".join(x for _ in range(20) for x in ("the", RANDOM.choice(WORDS)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.col("doc_id") % 5 != 1).collect()}
    assert all(abs(got[r[0]] - r[6]) <= 0.04 * r[2] for r in brute.lm(rows, lambda i: i % 5 == 1))


# Nearest neighbours.


def test_nearest_of_very_large_and_small_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 5))
    rows = [(i, (v * 10.0 ** (200 if i % 3 == 0 else -200 if i % 3 == 1 else 0)).tolist(), 1, "k") for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int, name string").repartition(2)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    for q, r, i, s in brute.nearest([(i, v.tolist()) for i, v in enumerate(base)]):
        assert got[q, r][0] == i and abs(got[q, r][1] - s) < 1e-12
    plan = ann.nearest(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().toString()
    assert "binary" not in plan  # no vector is shuffled or broadcast


def test_equal_vectors_by_the_thousand(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, -1.0]) for i in range(3000)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    hot = [x for x in got if x[0] % 3]
    assert len(got) == 300 and {x[2] for x in hot if x[1] == 1} == {1}
    assert all(x[2] == [1, 2, 4, 5, 7][x[1] - 1] for x in hot)


# Classifiers and rules, against plain versions of what they compute.


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, prose(RANDOM.randint(5, 60)) + (" vileword" if i % 7 == 0 else "") + (" ### $$ !!" * (i % 5 == 0)), "en" if i % 2 else "fr") for i in range(160)] + [(900 + i, t, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, 0.5, 1, "k") for r in rows], "doc_id long, text string, lang string, score double, y int, place string").repartition(3).cache()
    marks = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i, *_ in rows] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, marks


def test_quality_score_pair_by_pair(spark, labelled):
    rows, docs, marks = labelled
    machine = quality.train(docs, marks)
    got = {r["doc_id"]: r["q"] for r in docs.select("doc_id", quality.quality_column(spark, machine, F.col("text")).alias("q")).collect()}
    for i, text, _ in rows:
        data = (text or "").encode()
        codes, _, vocabulary = word_codes([data])
        own = dict(enumerate(features.structure(data, codes, features.odd_words(vocabulary))))
        counts: dict[int, int] = {}
        for w in brute.WORD.findall(text or ""):
            b = int(word_hashes([brute.lower(w).encode()])[0]) % quality.BUCKETS + quality.DENSE
            counts[b] = counts.get(b, 0) + 1
        size = sum(counts.values()) ** 0.5
        own |= {b: n**0.5 / size for b, n in counts.items()}
        assert abs(got[i] - brute.machine_score(machine.bias, machine.linear, machine.factors, own)) < 1e-3


def test_toxicity_score_place_by_place(spark, labelled):
    rows, docs, marks = labelled
    net = toxicity.train(docs, marks)
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", toxicity.toxicity_column(spark, net, F.col("text")).alias("t")).collect()}
    for i, text, _ in rows:
        words = [w.encode() for w in brute.WORD.findall(text or "")]
        embedded = [net.embedding[b].sum(axis=0) for b in toxicity.word_buckets(words)] if words else []
        assert abs(got[i] - brute.network_score(net, embedded, toxicity.WIDTHS, toxicity.PAD)) < 1e-3


def test_labelled_rows_don_t_grow_with_repeats(spark, labelled):
    _, docs, marks = labelled
    one = quality.labelled(docs, marks, "quality", 50)
    many = quality.labelled(docs.union(docs).union(docs), marks.union(marks), "quality", 50)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(many) and one.count() == 50
    assert 0 < sum(len(r["text"]) for r in quality.labelled(docs, marks, "quality", 5000, 2000).collect()) <= 2000
    other = docs.where("doc_id = 5").withColumn("text", F.lit("another text of the same id"))
    assert quality.labelled(docs.union(other), marks, "quality", 5000).where("doc_id = 5").count() == 1


def test_rules_keep_what_plain_expectation_maximisation_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    rows = [tuple(r) for r in docs.collect()] + [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "## $$ " * 40), (5000, prose(20))]
    df = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, good int, posterior double")
    got = sorted((repr((r["doc_id"], r["n_words"], r["word_chars"])), r["posterior"]) for r in weak_rules.judged(df).collect())
    want = sorted((repr((i, *brute.statistics(t)[:2])), p) for (i, t), p in zip(rows, brute.judged([t for _, t in rows])))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_quality_rules_query_by_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    for (i, t), p in zip(rows, brute.judged([t for _, t in rows])):
        n, _, _, _, repeats = brute.statistics(t)
        failed = n < 10 or 100 * repeats > 20 * n
        assert got[i] == (failed, not failed and p >= 0.5)


def test_a_shared_folder_must_be_set_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_pipeline_stages_with_clashing_names_and_empty_tables(spark):
    import corpus_pipeline

    names = ["tessera_text", "tessera_score", "TESSERA_KEY", "tessera_content", "k", "component_id", "with space", "row", "path"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, docs, SF), stage(spark, wide, SF)
        keys = ["doc_id", *(["text"] if "text" in plain.columns else [])]
        assert sorted(map(tuple, plain.select(*keys).collect())) == sorted(map(tuple, out.select(*keys).collect()))
        if name != "encoding":
            assert out.columns == wide.columns
            assert all(out.select(*(F.col(f"`{n}`") for n in names)).distinct().first()[i] == f"own {n}" for i, n in enumerate(names))
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_components_in_few_queries(spark, monkeypatch):
    """What tasks contract by themselves takes two queries, not four: each query costs the driver memory. What tasks hold
    apart (a few edges at a time, no partitions put together) is connected all the same."""
    from tessera.llm import components as module

    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(-60, 60)]
    crowd = [(5000, rng.randrange(5001, 6000)) for _ in range(800)]
    edges = [*chain, *crowd, (1 << 62, -(1 << 62)), (7000, 7000), (8002, 8001), (8001, 8002), *((rng.randrange(9000, 9400), rng.randrange(9000, 9400)) for _ in range(220))]
    rng.shuffle(edges)
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    want = {x: find(x) for x in top}
    linked = {x for a, b in edges if a != b for x in (a, b)}

    def got():
        found = [tuple(r) for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert len(found) == len(dict(found))
        return {x: dict(found).get(x, x) for x in linked}

    assert got() == {x: want[x] for x in linked}
    store = spark._jsparkSession.sharedState().statusStore()
    table = spark.createDataFrame(edges, "a long, b long")
    before = store.executionsCount()
    module.components(table)
    assert store.executionsCount() - before <= 2
    monkeypatch.setattr(module, "HELD", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got() == {x: want[x] for x in linked}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert module.components(spark.createDataFrame([], "a long, b long")).collect() == []
