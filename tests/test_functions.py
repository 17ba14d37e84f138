import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwork.functions import binning, labels, minhash, sequences
from strandwork.operators import errors, metrics


def test_window_label(spark):
    frame = spark.createDataFrame([(30.0,), (30.1,), (60.0,), (59.9,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in frame.select(labels.window_label(F.col("x"), 30, 60)).collect()]
    assert got == [0, None, 1, None, None, None]


def test_window_label_overlapping_thresholds(spark):
    frame = spark.createDataFrame([(50.0,)], "x double")
    assert frame.select(labels.window_label(F.col("x"), 60, 30)).first()[0] == 1


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_kgrams(spark, k):
    texts = ["", "ab", "abc", "abcabc", "éxé𝒳yz", "aaaaaaa"]
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = frame.select(sequences.kgrams(F.col("s"), k).alias("g"), sequences.gram_codes(F.col("s"), k).alias("c"))
    for text, row in zip(texts, rows.collect()):
        expected = {text[i : i + k] for i in range(len(text) - k + 1)}
        assert set(row.g) == expected and len(row.g) == len(expected) == len(set(row.c))


def test_normalized(spark):
    frame = spark.createDataFrame([("MUAZ",), ("M",), ("",)], "s string")
    assert [r[0] for r in frame.select(sequences.normalized(F.col("s"))).collect()] == ["X A X", "", ""]
    assert frame.select(sequences.normalized(F.col("s"), drop_first=False)).first()[0] == "M X A X"


def test_path_prefix(spark):
    frame = spark.createDataFrame([("  a  b\tc ",), ("a",), (None,)], "s string")
    assert [r[0] for r in frame.select(sequences.path_prefix(F.col("s"), 1)).collect()] == ["a b", "a", None]


def test_argmax(spark):
    frame = spark.createDataFrame([([1.0, 3.0, 3.0],), ([float("nan"), 9.0],)], "a array<double>")
    assert [r[0] for r in frame.select(labels.argmax(F.col("a"))).collect()] == [1, 0]


def test_encoding_truncates_and_pads(spark):
    frame = spark.createDataFrame([(["A", "?", "C", "A"],), (["C"],)], "w array<string>")
    vocabulary = F.create_map(F.lit("A"), F.lit(5), F.lit("C"), F.lit(6))
    rows = frame.select(sequences.encoded(F.col("w"), vocabulary, length=5, start=2, end=3).alias("e")).collect()
    assert rows[0].e.input_ids == [2, 5, 1, 6, 3] and rows[0].e.attention_mask == [1] * 5
    assert rows[1].e.input_ids == [2, 6, 3, 0, 0] and rows[1].e.attention_mask == [1, 1, 1, 0, 0]


def test_bins_equal_numpy_on_edges(spark):
    rng = np.random.default_rng(0)
    edges = np.linspace(0.1, 7.3, 20)
    x = np.concatenate([edges, rng.uniform(0.1, 7.3, 500)])
    frame = spark.createDataFrame(pd.DataFrame({"x": x}))
    cut = binning.label_edges(frame, "x", 20)
    got = binning.digitize(frame, "x", cut, 20).toPandas()
    np.testing.assert_array_equal(got.bin, np.digitize(got.x, edges))


def test_bins_of_a_constant_column(spark):
    frame = spark.createDataFrame([(4.0,), (4.0,), (float("nan"),)], "x double")
    got = binning.digitize(frame, "x", binning.label_edges(frame, "x", 5), 5)
    assert [r.bin for r in got.collect()] == [5, 5, None]


@pytest.mark.parametrize("scale", [100.0, 0.004])
def test_profile_bins_equal_pandas_cut(spark, scale):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"t": np.round(rng.normal(5, 2, 400), 1) * scale, "e": rng.normal(0, 1, 400)})
    bins = pd.cut(data["t"], bins=10)
    expected = data.groupby(bins.apply(lambda x: x.mid), observed=False)["e"].agg(["mean", "std", "count"])
    got = errors.error_profile(spark.createDataFrame(data), "t", "e").orderBy("bin").toPandas()
    np.testing.assert_allclose(got.mid, expected.index.astype(float), rtol=1e-9)
    np.testing.assert_array_equal(got.n, expected["count"])
    np.testing.assert_allclose(got.mean_error.astype(float), expected["mean"], rtol=1e-9)
    np.testing.assert_allclose(got.std_error.astype(float), expected["std"], rtol=1e-9)


def test_overlap_probability_edge_rows(spark):
    row = (1, 2, 5.0, 0.0, 1.0, 0.0, 1.0)
    schema = "low_bin int, high_bin int, dT double, low_mean double, low_std double, high_mean double, high_std double"
    frame = spark.createDataFrame(
        [row, (1, 3, 5.0, 0.0, None, 0.0, 1.0), (1, 1, 0.0, 0.0, 1.0, 0.0, 1.0), (1, 4, 1.0, 3.0, 1.0, -3.0, 2.0)], schema
    )
    got = {r.high_bin: r for r in errors.overlap_probability(frame).collect()}
    assert set(got) == {2, 4}
    assert got[2].crossing == 2.5 and got[2].overlap_probability == pytest.approx(2 * 0.006209665325776, abs=1e-12)
    assert got[4].is_fallback and got[4].crossing == 1.0


def test_spearman_constant_and_ties(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 4.0), ("b", 2.0, 3.0)], "g string, t double, p double")
    got = {r.g: r.spearman for r in metrics.spearman(frame, "t", "p", ["g"]).collect()}
    expected = pd.Series([1.0, 2.0, 2.0]).rank().corr(pd.Series([1.0, 4.0, 3.0]).rank())
    assert got["a"] is None and got["b"] == pytest.approx(expected)


def test_band_layouts():
    # Threshold, permutations, bands, rows.
    for threshold, perms, count, rows in [(0.6, 100, 16, 6), (0.85, 100, 6, 16), (0.95, 100, 3, 33), (0.6, 50, 10, 5)]:
        assert minhash.choose_bands(threshold, perms) == (count, rows)


def test_signature_estimates_jaccard(spark):
    a, b = "abcdefghijklmnopqrstuvwxyz" * 2, "abcdefghijklmnopqrstuvwxyz" + "zyxwvutsrqponmlkjihgfedcba"
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    grams = [{s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b)]
    exact = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    sig = [minhash.signature(F.col(c), num_perm=1000) for c in "ab"]
    same = frame.select(sig[0].alias("x"), sig[1].alias("y")).select(minhash.agreement(F.col("x"), F.col("y"))).first()[0]
    assert abs(same / 1000 - exact) < 0.06


def test_nan_never_wins_a_step(spark):
    from strandwork.operators.history import once_per_step

    rows = [("r", "m", 1, 0.5), ("r", "m", 1, float("nan")), ("r", "m", 1, 0.9)]
    assert once_per_step(spark.createDataFrame(rows, "run string, metric string, step int, value double")).first().value == 0.9


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_signatures_permute_a_shared_gram_once(spark, monkeypatch, block):
    """Rows that come together are worked off as one block; the minima are those of each row by itself."""
    from strandwork.functions import minhash

    monkeypatch.setattr(minhash, "BLOCK", block)
    sizes = []
    permuted = minhash.permuted
    monkeypatch.setattr(minhash, "permuted", lambda prints, *family: sizes.append(len(prints)) or permuted(prints, *family))
    a, b = minhash.family(5)
    texts = [None, "", "ab", "abcdefgh", "abcdefghi", "\U0001f600bcdefgh", "abc" * 9]
    kept = {}
    monkeypatch.setattr(minhash.F, "pandas_udf", lambda kind: lambda f: kept.update(f=f) or (lambda column: column))
    minhash.signature(None, num_perm=5)
    got = kept["f"](minhash.pd.Series(texts, dtype=object))

    def one(text):
        grams = {text[i : i + 3] for i in range(len(text) - 2)}
        prints = [(ord(g[0]) * minhash.BASE**2 + ord(g[1]) * minhash.BASE + ord(g[2])) % minhash.PRIME for g in grams]
        return [min((x * h + y) % minhash.PRIME for h in prints) for x, y in zip(a, b)] if grams else None

    assert [None if g is None else g.tolist() for g in got] == [one(t or "") for t in texts]
    assert sum(sizes) < 25 if block > 7 else max(sizes) <= 7
