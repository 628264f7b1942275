"""Fixtures of the array operators, round trips, and every query against its SQL."""

import math
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import blocks, hof
from tessera.operators import codebooks, codec, cubes, entropy, search
from tessera.operators.select import order_statistic
from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES
from tessera.sources import files, parameters, raw

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_cdf97_documented(spark):
    a = array(7, 2, 3, 4, 5, 3, 1, 5, 7, 1, 9, 2, 4, 8, 2, 6)
    want = [7.00224, 3.52709, 6.82547, 2.87912, 7.34827, 7.39307, 6.14146, 6.57857, 2.33178, -0.122068, -0.136087, -1.33848, 5.86312, 3.64358, -4.18374, -2.92383]
    assert np.allclose(value(spark, hof.forward(a, 16, 1, "cdf97")), want, atol=1e-5)
    assert np.allclose(value(spark, hof.forward(a, 16, 3, "cdf97"))[:4], [9.874857, 12.223914, 0.977558, -0.257414], atol=1e-5)


def test_haar_documented(spark):
    want = [30.759145, 3.181981, 7, 6.5, 2.12132, -10.606602, 9.899495, -6.363961]
    assert np.allclose(value(spark, hof.forward(array(17, 14, 1, 16, 20, 6, 2, 11), 8, 3)), want, atol=1e-6)


@pytest.mark.parametrize("wavelet", ["haar", "cdf97", "CDF_2.2", "CDF_2.4", "CDF_2.6", "CDF_4.4", "VS_7.9"])
def test_inverse_restores(spark, wavelet):
    x = np.random.default_rng(1).normal(size=64)
    for shape, steps in (((64, 1, 1), (4, 0, 0)), ((8, 8, 1), (2, 3, 0)), ((4, 4, 4), (1, 2, 1))):
        a = hof.transform(hof.transform(array(*x), shape, steps, wavelet), shape, steps, wavelet, back=True)
        assert np.allclose(value(spark, a), x, atol=1e-6)


def test_lengths(spark):
    assert [hof.padded_length(*c) for c in ((4, 1), (5, 1), (5, 2), (6, 1), (6, 2), (3, 0, True), (4, 0, True), (5, 0, True))] == [4, 6, 8, 6, 8, 4, 4, 8]
    assert [hof.steps_most(n) for n in (1, 2, 3, 4, 5, 8, 9, 511, 512, 513)] == [0, 1, 2, 2, 3, 3, 4, 9, 9, 10]
    got = value(spark, F.array(*(hof.leading_zeros(F.lit(n).cast("long")) for n in (0, 1, 2, 3, 0x7FFFFFFF, 0xFFFFFFFF))))
    assert got == [32, 31, 30, 30, 1, 0]
    assert value(spark, F.array(*(hof.mirrored(F.lit(i), 3) for i in range(-5, 5)))) == [1, 0, 1, 2, 1, 0, 1, 2, 1, 0]
    assert value(spark, hof.pad(array(17, 14, 1, 16, 20), 5, 8, "reflect")) == [17, 14, 1, 16, 20, 16, 1, 14]


def test_quantizers(spark):
    points = [0, 0.5, 1, -0.5, -1, 1.1, -1.1, 3, -3, 4.9, -4.9, 5, -5, 5.1, -10, 20]
    both = F.array(*(F.struct(hof.quant_log(F.lit(float(x)), 100, 1, 5).alias("l"), hof.quant_uniform(F.lit(float(x)), 100, 1, 5).alias("u")) for x in points))
    got = [(r["l"], r["u"]) for r in value(spark, both)]
    assert got == [(49, 49)] * 5 + [(53, 51), (45, 47), (83, 74), (15, 24), (98, 97), (1, 2), (99, 99), (0, 0), (99, 99), (0, 0), (99, 99)]
    bounds = [0.1, 0.2, 0.5, 1, 2, 2, 2, 10]
    assert value(spark, F.array(*(hof.quant_codebook(F.lit(float(x)), bounds) for x in (0, 0.2, 0.5, 1, 2, 10, 20)))) == [0, 1, 2, 3, 4, 8, 8]
    for q, d in ((hof.quant_log, hof.dequant_log), (hof.quant_uniform, hof.dequant_uniform)):
        again = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: q(d(i, 100, 1, 5), 100, 1, 5))
        assert [i for i, x in enumerate(value(spark, again)) if x != i] in ([], [49], [48, 50], [48], [50])


def test_lloyd_and_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    book, partition, rounds = codebooks.lloyd(df, F.col("v"), [-5.0, -1.0, 1.0, 5.0])
    assert (book, partition, rounds) == ([0.5, 2.5, 5.0, 8.5], [1.5, 3.5, 6.5], 8)
    df = spark.createDataFrame([(i / 100,) for i in range(100)], "v double")
    bounds, values = codebooks.equal_population(df, F.col("v"), 2, 0.4)
    assert (bounds, values) == ([0.41, 0.6, 0.79], [0.0, 0.5, 0.69, 0.89])


def test_order_statistic(spark, monkeypatch):
    monkeypatch.setattr("tessera.operators.select.FEW", 20)
    x = np.random.default_rng(3).integers(0, 200, 3000) ** 3 / 7
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    assert [order_statistic(df, F.col("v"), k) for k in (0, 17, 1500, 2999)] == [sorted(x)[k] for k in (0, 17, 1500, 2999)]
    assert order_statistic(df, F.col("v"), 3000) is None


def test_codes():
    counts = {0: 5, 1: 2, 2: 10, 3: 12, 4: 2}
    own = entropy.lengths(counts)
    assert sorted(own.items()) == [(0, 3), (1, 4), (2, 2), (3, 1), (4, 4)]
    assert entropy.encoded_bytes(counts, own) == 8
    assert entropy.lengths({7: 3}) == {7: 1}
    done = {n: (s, len(e)) for n in (8, 9, 16, 17, 205, 1025, 3000) for s, e in [entropy.escapes(n)]}
    assert done == {8: (8, 0), 9: (1, 1), 16: (0, 1), 17: (1, 1), 205: (5, 3), 1025: (1, 1), 3000: (8, 7)}
    assert entropy.to_words([b >> j & 1 for b in (3, 5, 7, 15) for j in range(8)]).hex() == "0305070f"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 40)), min_size=1, max_size=20))
def test_code_round_trip(parts):
    symbols = [s for s, n in parts for _ in range(n)]
    counts = {s: symbols.count(s) for s in set(symbols)} | {9: 1, 2: symbols.count(2) + 1}
    book = entropy.codes(entropy.lengths(counts))
    assert math.isclose(sum(2.0 ** -n for _, n in book.values()), 1) or len(book) == 1
    assert entropy.decode_symbols(entropy.encode_symbols(symbols, book, 2, 9), len(symbols), book, 2, 9) == symbols


def test_files(spark, tmp_path):
    files.register(spark)
    rows = [(100, 101, 102, 4, 5, 6, "FLOAT32", [i * 0.25 for i in range(120)]), (200, 201, 202, 7, 8, 9, "INT32", [float(i) for i in range(504)])]
    df = spark.createDataFrame(rows, "x_off int, y_off int, z_off int, width int, height int, depth int, data_type string, payload array<double>").coalesce(1)
    df.write.format("cubelets").mode("append").save(f"{tmp_path}/cubes")
    back = spark.read.format("cubelets").load(f"{tmp_path}/cubes")
    assert sorted(map(tuple, back.select(df.columns).collect())) == rows
    meta = spark.read.format("cubelets").option("metadata", "true").load(f"{tmp_path}/cubes")
    assert {(r["byte_count"], r["payload"]) for r in meta.collect()} == {(480, None), (2016, None)}
    (one,) = (str(p) for p in (tmp_path / "cubes").glob("*.cube"))
    index = files.read_index(one)
    assert [(r["width"], r["data_type"], r["byte_count"]) for r in index] == [(4, "FLOAT32", 480), (7, "INT32", 2016)]
    assert [files.payload_at(r)["payload"] for r in index] == [r[7] for r in rows]
    row = dict(zip(df.columns, (1, 2, 3, 2, 1, 1, "UINT8", [7.0, 300.0])))
    files.append_cubelets(one, [row])
    assert [r["payload"] for r in files.read_cubelets(one)] == [r[7] for r in rows] + [[7.0, 255.0]]
    assert files.read_index(one) == list(files.read_cubelets(one, payload=False)) and len(files.read_index(one)) == 3
    files.append_cubelets(one, [row], index=False)
    assert files.read_index(one) is None and [r["byte_count"] for r in files.read_cubelets(one, payload=False)] == [480, 2016, 2, 2]
    (tmp_path / "cubes" / ".hidden.cube").write_bytes(b"unfinished")
    df.limit(1).write.format("cubelets").option("index", "false").mode("overwrite").save(f"{tmp_path}/cubes")
    assert spark.read.format("cubelets").load(f"{tmp_path}/cubes").count() == 1
    x = np.random.default_rng(0).random((3, 5)).round(5)
    for k, binary in enumerate((True, False)):
        files.write_matrix(f"{tmp_path}/m{k}.data", x, binary)
        got = spark.read.format("datamatrix").load(f"{tmp_path}/m{k}.data").orderBy("row", "col").collect()
        assert np.allclose([r["value"] for r in got], x.reshape(-1), atol=1e-6)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set enable_progress_bar=false")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert re.fullmatch(r"\w+", name) and len(got.columns)
    want = duck.sql(ORACLES[name]).df()  # every query has its SQL
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(repr, x[columns].itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("wavelet", ["haar", "cdf97", "CDF_2.2", "CDF_2.4", "CDF_2.6", "CDF_4.4", "VS_7.9"])
def test_blocks_equal_column_kernels(spark, wavelet):
    """The numpy kernels against the expressions, forward and back, and the inverse restores; nulls and mixed lengths."""
    x = np.random.default_rng(2).normal(size=(5, 64)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(9, None)], "i int, a array<double>")
    a = F.col("a")
    one, two = blocks.transform(a, (4, 4, 4), (2, 1, 2), wavelet), hof.transform(a, (4, 4, 4), (2, 1, 2), wavelet)
    for r in df.select("i", "a", one.alias("x"), two.alias("y"), blocks.transform(one, (4, 4, 4), (2, 1, 2), wavelet, back=True).alias("z")).collect():
        assert (r["x"] is None) == (r["a"] is None)
        assert r["a"] is None or np.allclose(r["x"], r["y"], atol=1e-9) and np.allclose(r["z"], r["a"], atol=1e-6)
    mixed = spark.createDataFrame([(1, [1.0] * 8), (2, None), (3, [2.0] * 4), (4, []), (5, [3.0] * 8)], "i int, a array<double>")
    got = {r["i"]: r["b"] for r in mixed.select("i", blocks.forward(a, 1, wavelet).alias("b")).collect()}
    assert [len(got[i]) if got[i] is not None else None for i in (1, 2, 3, 4, 5)] == [8, None, 4, 0, 8]


def test_alternating_and_daubechies_restore():
    x = np.random.default_rng(3).normal(size=(2, 8, 8))
    assert np.allclose(blocks.alternate(blocks.alternate(x, 3), 3, back=True), x)
    assert np.allclose(blocks.along(blocks.along(x, 2, "d4"), 2, "d4", back=True), x)
    assert np.isclose((blocks.along(x, 3, "d4") ** 2).sum(), (x**2).sum())


def test_few_bins_and_nulls(spark):
    for q, d in ((hof.quant_uniform, hof.dequant_uniform), (hof.quant_log, hof.dequant_log)):
        for bins in (1, 2, 3, 4, 5, 16):
            df = spark.createDataFrame([(x,) for x in (None, 0.0, 0.5, 2.0, -2.0, 9.0, -9.0, 100.0, -100.0)], "v double")
            rows = df.select("v", q(F.col("v"), bins, 1.0, 10.0).alias("q"), d(q(F.col("v"), bins, 1.0, 10.0), bins, 1.0, 10.0).alias("b")).collect()
            assert all((r["q"] is None) == (r["v"] is None) == (r["b"] is None) for r in rows)
            assert all(0 <= r["q"] < bins for r in rows if r["v"] is not None)
    assert value(spark, hof.quant_codebook(F.lit(None).cast("double"), [1.0, 2.0])) is None


def test_ties_fill_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 10 + [5] * 40 + list(range(6, 56))], "v double")
    bounds, values = codebooks.equal_population(df, F.col("v"), 3, 0.5)
    assert len(bounds) == 7 and len(values) == 8 and bounds == sorted(bounds) and len(set(bounds)) == 7
    constant = spark.createDataFrame([(3.0,)] * 20, "v double")
    assert codebooks.equal_population(constant, F.col("v"), 2, 1.0)[0][0] == 3.0
    assert codebooks.equal_population(df.limit(0), F.col("v"), 2, 1.0) == ([0.0] * 3, [0.0] * 4)


def test_search_counts_as_direct_quantising(spark):
    x = np.random.default_rng(5).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    for kind, q, d in (("uniform", hof.quant_uniform, hof.dequant_uniform), ("log", hof.quant_log, hof.dequant_log)):
        rows = search.trials(df, F.col("v"), [0.3, 0.9], [3, 4, 17, 200], kind).collect()
        assert len(rows) == 8
        for r in rows:
            bin_ = q(F.col("v"), r["bins"], r["threshold"], float(np.abs(x).max()))
            own = df.where("v is not null").select(bin_.alias("q"), ((d(bin_, r["bins"], r["threshold"], float(np.abs(x).max())) - F.col("v")) ** 2).alias("e"))
            counts = entropy.frequencies(own, "q")
            assert (r["used"], r["size_bytes"]) == (len(counts), entropy.encoded_bytes(counts, entropy.lengths(counts)))
            assert np.isclose(r["mse"], own.agg(F.avg("e")).first()[0])
    assert search.trials(df.limit(0), F.col("v"), [0.5], [8]).count() == 0


def test_decode_table_and_truncation():
    book = entropy.codes(entropy.lengths({0: 5, 1: 2, 2: 10, 3: 12, 4: 2}))
    table = entropy.decode_table(book)
    assert len(table) == 2 * (2 * len(book) - 1) and sorted(table[2 * i + 1] for i in range(len(table) // 2) if table[2 * i] == 0) == [0, 1, 2, 3, 4]
    data = entropy.encode_symbols([0, 2, 3, 4, 2, 3, 1, 1, 1], book)
    assert entropy.decode_symbols(data, 9, table) == [0, 2, 3, 4, 2, 3, 1, 1, 1]
    with pytest.raises(ValueError, match="ends"):
        entropy.decode_symbols(data, 900, table)
    assert entropy.decode_symbols(entropy.encode_symbols([7] * 5, {7: (0, 1)}), 5, entropy.decode_table({7: (0, 1)})) == [7] * 5


@pytest.mark.parametrize("quantizer", ["log", "uniform", "lloyd"])
def test_cubelets_compressed_to_a_file_and_back(spark, tmp_path, quantizer):
    """Mixed shapes and types in one table, through a file, against the original; a constant cubelet; several settings."""
    files.register(spark)
    rng = np.random.default_rng(1)
    smooth = lambda *shape: sum(np.add.outer(np.add.outer(np.sin(np.arange(shape[2]) / 3), np.cos(np.arange(shape[1]) / 4)), np.arange(shape[0]) / 9).reshape(-1) * k for k in (1.0,))
    shapes = [(5, 6, 7, "FLOAT32"), (16, 16, 1, "FLOAT32"), (9, 1, 1, "FLOAT32"), (8, 8, 8, "UINT8"), (4, 4, 2, "INT32")]
    rows = [(k, k, 0, 3, w, h, d, kind, 255, (smooth(w, h, d) if kind == "FLOAT32" else rng.integers(0, 200, w * h * d).astype(float)).tolist()) for k, (w, h, d, kind) in enumerate(shapes)]
    rows.append((9, 9, 9, 9, 4, 4, 4, "FLOAT32", 255, [2.0] * 64))
    df = spark.createDataFrame(rows, "cube_id long, x_off int, y_off int, z_off int, width int, height int, depth int, data_type string, max_value int, payload array<double>")
    for k, s in enumerate((codec.Settings(fraction=0.05, bins=1000, quantizer=quantizer), codec.Settings((1, 1, 1), "haar", fraction=0.02, bins=600, quantizer=quantizer), codec.Settings((2, 2, 0), layers=True, fraction=0.0, bins=900, quantizer=quantizer))):
        codec.compressed(df, s).write.format("cubelets").mode("append").save(f"{tmp_path}/c{k}")
        back = codec.restored(spark.read.format("cubelets").load(f"{tmp_path}/c{k}")).collect()
        assert len(back) == len(rows)
        want = {r[1]: r for r in rows}
        for r in back:
            a, b = np.array(want[r["x_off"]][9]), np.array(r["payload"])
            assert tuple(r[c] for c in codec.META[1:]) == want[r["x_off"]][1:9] and len(a) == len(b)
            assert ((a - b) ** 2).sum() <= 0.02 * max((a**2).sum(), 1e-9), (r["x_off"], s)
    assert codec.compressed(df.limit(0)).count() == 0


def test_raw_numbers(spark, tmp_path):
    raw.register(spark)
    df = spark.createDataFrame([("b", 1.0), ("a", 260.0), ("a", -1.0)], "file string, value double").coalesce(1)
    df.write.format("rawnumbers").option("kind", "u1").mode("append").save(f"{tmp_path}/n")
    assert (tmp_path / "n/a").read_bytes() == b"\x04\xff" and (tmp_path / "n/b").read_bytes() == b"\x01"
    (tmp_path / "odd").write_bytes(b"\x10\x00\x20\x01\x05")
    got = spark.read.format("rawnumbers").option("kind", "u2").option("split", "2").load(f"{tmp_path}/odd")
    assert got.rdd.getNumPartitions() == 2 and [tuple(r)[1:] for r in got.orderBy("pos").collect()] == [(0, 16.0), (1, 288.0)]
    (frame,) = raw.frames(spark, f"{tmp_path}/odd", 2, 2).collect()
    assert (frame["payload"], frame["data_type"], frame["z_off"], frame["max_value"]) == ([1.0, 18.0, 0.0, 0.0], "INT32", 0, 4095)
    (cube,) = raw.byte_cubelet(spark, f"{tmp_path}/odd", 2, 1, 2).collect()
    assert (cube["payload"], cube["height"], cube["depth"], cube["data_type"]) == ([16.0, 0.0, 32.0, 1.0], 1, 2, "UINT8")
    (tmp_path / "t").write_text("1 2.5\n\n  x -3e2 ")
    assert [r[0] for r in raw.numbers(spark, f"{tmp_path}/t").collect()] == [1.0, 2.5, None, -300.0]
    for bad in (spark.createDataFrame([(None,)], "value double"), df.union(df).orderBy("value").coalesce(1)):
        with pytest.raises(Exception, match="null is no number|side by side"):
            bad.write.format("rawnumbers").mode("append").save(f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").iterdir() if p.name[0] not in "._"]
    assert raw.with_random(df, 3).where("random >= 0 and random < 1").count() == 3


def test_parameters():
    words = ["plain", "two words", 'a "quote"', "tab\there", "line\nbreak", "a=b", "[x]", "", "c:\\new dir", "é, ü"]
    assert parameters.parse_list(parameters.format_list(words)) == words
    values = {w or "none": w[::-1] for w in words}
    assert parameters.parse_map(parameters.format_map(values)) == values
    text = parameters.format_parameters(values)
    assert parameters.parse_parameters(text + "after=the end\n") == values
    first, _, rest = text.partition("\n")
    assert first == f"Param {len(rest.encode())}"
    assert parameters.parse_parameters("Param 9\n no sign\n= no name\n a = b c \n") == {"a": "b c"}
    assert parameters.parse_list(" [ a , b c]") == ["a", "b c"] and parameters.parse_list("[]") == [""]
    assert [parameters.parse_list(x) for x in ("a", "[a", "")] == [None] * 3 and [parameters.parse_map(x) for x in ("{a}", "{a=1", "x")] == [None] * 3
    assert parameters.format_float(0.1 + 0.2) == "0.3"


def test_cubelet_steps(spark, tmp_path):
    """Compressed cubelets are refused where values are needed; the first plain one; bins as dumped are those encoded."""
    files.register(spark)
    x = np.random.default_rng(4).random((4, 2, 6))
    df = spark.createDataFrame([(0, 0, 0, 0, 6, 2, 4, "FLOAT32", 0, x.reshape(-1).tolist())], "cube_id long, x_off int, y_off int, z_off int, width int, height int, depth int, data_type string, max_value int, payload array<double>")
    s = codec.Settings((1, 1, 1), "haar", fraction=0.1, bins=40)
    packed = codec.compressed(df, s)
    with pytest.raises(Exception, match="compressed cubelet at 0,0,0"):
        cubes.plain(packed).collect()
    packed.coalesce(1).write.format("cubelets").mode("append").save(f"{tmp_path}/c")
    (path,) = (str(p) for p in (tmp_path / "c").glob("*.cube"))
    files.append_cubelets(path, [dict(zip(df.columns, df.first())) | {"x_off": 9}])
    (first,) = cubes.first_plain(spark.read.format("cubelets").load(path)).collect()
    assert first["x_off"] == 9 and np.allclose(first["payload"], x.reshape(-1))
    (c,), (q,) = codec.dumped(df, s).collect(), codec.dumped(df, s, bins=True).collect()
    assert (c["width"], c["height"], c["depth"], c["data_type"], q["data_type"]) == (6, 2, 4, "FLOAT32", "INT32")
    assert np.allclose(np.reshape(c["payload"], (4, 2, 6)), blocks.cube(x, (1, 1, 1), "haar"))
    p = codec.unpack_parameters(packed.first()["params"])
    stream = entropy.decode_symbols(packed.first()["raw"], 48, p["table"], p["run_value"], p["run_key"])
    assert np.reshape(q["payload"], (4, 2, 6)).transpose(2, 1, 0).reshape(-1).astype(int).tolist() == list(stream)
