"""The text operators against brute force on small tables with every odd case."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from strandwork.llm import decontam, lm, mixing, pages, rules, shards, simhash, suffixes, tokens, toxicity

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use inside
        *[T.StructField(name, T.StringType()) for name in ("bits", "n", "size", "copy", "kept", "chunk", "host")],
    ]
)
PROSE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
TEXTS = [
    (1, PROSE, "b"),
    (2, PROSE + " chi", "b"),
    (3, PROSE, "a"),
    (3, PROSE, "a"),
    (4, None, "a"),
    (5, "", None),
    (6, " \n\t ", "c"),
    (7, "one", "c"),
    (8, "x " * 3000 + PROSE, "c"),
    (9, "É à — " + PROSE[20:] + "\n\nline\nline\n" + PROSE[:60], "d"),
    (None, PROSE[5:90], "d"),
    (None, "no id here but words enough to count for something", None),
    (12, "".join(f"w{i} " for i in range(4000)), "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*row, *["x"] * 7) for row in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ordered(found):
    return sorted(found, key=repr)


# -- SimHash


def fingerprint(text):
    w = space_words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most):
    """Smallest id reachable for each (id, bits)."""
    bits = sorted({b for _, b in prints})
    root = {b: b for b in bits}

    def find(b):
        while root[b] != b:
            b = root[b]
        return b

    for i, a in enumerate(bits):
        for b in bits[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, b in prints:
        ids[find(b)].append(i)
    smallest = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return [(i, f"{b:016x}", smallest[find(b)]) for i, b in prints]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_simhash(request, table):
    docs = request.getfixturevalue(table)
    expected = components([(i, fingerprint(t)) for i, t in texts_of(docs)], 4)
    assert ordered(rows(simhash.near_duplicates(docs))) == ordered(expected)


@pytest.mark.parametrize(("max_bits", "cloud"), [(4, 30), (4, 500), (3, 100), (5, 60), (1, 80), (2, 80)])
def test_simhash_links_connect(spark, max_bits, cloud):
    random = np.random.default_rng(5)
    bits = {int(b) for b in random.integers(0, 1 << 63, 40)}
    for base in list(bits)[:4]:
        for _ in range(cloud):
            flips = random.choice(64, random.integers(1, 4), replace=False)
            bits.add(base ^ sum(1 << int(f) for f in flips))
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    found = simhash.links(spark.createDataFrame([(b,) for b in signed], "bits bigint"), max_bits).collect()
    mask = (1 << 64) - 1
    root = {b & mask: b & mask for b in signed}

    def find(b):
        while root[b] != b:
            b = root[b]
        return b

    for r in found:
        root[find(r.a & mask)] = find(r.b & mask)
    groups = collections.Counter(find(b) for b in root)
    expected = collections.Counter(r[2] for r in components([(b & mask, b & mask) for b in signed], max_bits))
    assert len(found) <= 70 * len(signed)  # links in proportion to the fingerprints, no pairs
    assert sorted(groups.values()) == sorted(expected.values())


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    expected = components([(i, fingerprint(t)) for i, t in texts_of(odd)], 4)
    heads = {c for _, _, c in expected if c is not None}
    assert sorted(i for i, _ in found if i is not None) == sorted(heads)


# -- mixing


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 900), ("c", 900), (None, 0), ("d", 50)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    caps = {"a": 200, "b": 1800, "c": 1800, "d": 100, None: 0}
    full = set()
    while True:  # share out, stop at the limits, share the excess again
        left = 1.5 * 1950 - sum(caps[s] for s in full)
        level = left / sum(w for s, w in weights.items() if s not in full)
        over = {s for s, w in weights.items() if s not in full and level * w >= caps[s]}
        if not over:
            break
        full |= over
    assert found == {s: caps[s] if s in full else pytest.approx(level * weights[s]) for s in weights}


def test_decontamination_with_null_item_ids(spark, odd):
    items = spark.createDataFrame([(None, PROSE), ("b", PROSE), (None, "one")], "item_id string, text string")
    found = {r.doc_id: r for r in decontam.contamination(odd, items).collect()}
    assert found[1].n_items == 2 and found[1].items_sha256 == hashlib.sha256(b",b").hexdigest()
    assert found[7].n_items == 1 and found[7].items_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("table", ["odd", "small"])
def test_mixing(request, table):
    docs = request.getfixturevalue(table)
    found = mixing.mixed_sources(docs).collect()
    assert len(found) == docs.count()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    total = sum(r.size for r in found)
    assert total * 1.5 - max(r.size for r in found) <= sum(r.taken for r in found) <= total * 1.5
    by_source = collections.defaultdict(list)
    for r in found:
        by_source[r.source].append(r)
    for group in by_source.values():
        longest = max(r.size for r in group)
        most = max(r.size for r in found)
        assert abs(sum(r.taken for r in group) - group[0].target) <= longest + most
    assert ordered(map(tuple, found)) == ordered(rows(mixing.mixed_sources(docs.repartition(5))))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.times for r in found)
    want = collections.Counter()
    for r in found:
        want[r.doc_id] += r.times
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +want


def test_mixed_documents_with_clashing_names_and_a_budget_that_ends_in_copies(spark):
    data = [(1, "a b c", "s", "x", "y")] * 500 + [(i, f"w{i} v u", "t", "x", "y") for i in range(2, 60)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string, _mix_unit string, mix_here string").repartition(7)
    found = mixing.mixed_sources(table).collect()
    mixed = mixing.mixed_documents(table).collect()
    assert len(mixed) == sum(r.times for r in found)
    assert {tuple(r)[3:] for r in mixed} == {("x", "y")}
    assert 500 < sum(r.doc_id == 1 for r in mixed) < 1000


def test_one_of_each_with_clashing_names(spark):
    data = [(i % 3, "some words that are the same in all of them", f"k{i % 3}", "t") for i in range(30)]
    table = spark.createDataFrame(data, "doc_id long, text string, simhash_key string, _simhash_key string")
    assert [tuple(r) for r in simhash.one_of_each(table).collect()] == [(0, data[0][1], "k0", "t")]


# -- decontamination


def naive_contamination(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, owners = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                owners.add(str(item))
    digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
    return len(words), len(hit), len(owners), digest, bool(hit)


ITEMS = [(1, PROSE[6:70]), (2, "XI, omicron-pi"), (3, None), (4, "..."), (10, "pi"), (5, PROSE[6:70]), (6, "one two")]


@pytest.mark.parametrize("block_words", [5, 10_000])
@pytest.mark.parametrize("table", ["odd", "small"])
def test_decontamination(request, spark, table, block_words):
    docs = request.getfixturevalue(table)
    items = ITEMS + [(100 + k, t[100:300]) for k, (_, t) in enumerate(texts_of(docs)[:6]) if t]
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = rows(decontam.contamination(docs, bench, block_words=block_words))
    assert ordered(found) == ordered((i, *naive_contamination(t, items)) for i, t in texts_of(docs))


def test_clean_documents(odd, spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    kept = decontam.clean_documents(odd, bench)
    clean = [(i, t) for i, t in texts_of(odd) if not naive_contamination(t, ITEMS)[-1]]
    assert ordered(texts_of(kept)) == ordered(clean)
    cut = decontam.clean_documents(odd, bench, max_coverage=0.9).filter("doc_id = 8").first().text
    assert "xi omicron" not in cut and cut.startswith("x x")


# -- shards


def jump(key, count):
    step, bucket, following = 0, -1, 0
    while following < count:
        bucket, step = following, step + 1
        number = int(hashlib.md5(f"{'' if key is None else key}|{step}".encode()).hexdigest()[:8], 16) + 1
        following = math.floor((bucket + 1) * float(1 << 32) / number)
    return bucket


@pytest.mark.parametrize("table", ["odd", "small"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    found = shards.sharded(docs, 7).collect()
    data = [(i, (t or "").encode()) for i, t in texts_of(docs)]
    expected = [(i, len(b) + 16, zlib.crc32(b), "key", jump(i, 7), jump(i, 8)) for i, b in data]
    assert ordered((*r[:5], r.grown_shard) for r in found) == ordered(expected)
    assert all(r.grown_shard in (r.shard, 7) for r in found)
    for shard in range(7):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


# -- tokens


@pytest.mark.parametrize("table", ["odd", "small"])
def test_token_files(request, spark, table):
    docs = request.getfixturevalue(table)
    encode = Tokenizer.from_file(BPE).encode
    folder = tokens.write_ids(docs, "doc_id", "text", BPE, 2)
    expected = [(i, [*encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts_of(docs)]
    found = tokens.read_ids(spark, folder).collect()
    assert ordered((r.doc_id, list(r.ids)) for r in found) == ordered(expected)
    found.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:k]) for k in range(len(found))]
    digests = tokens.read_ids(spark, folder, digest=True).collect()
    crc = [(i, zlib.crc32(np.array(d, "<u4").tobytes())) for i, d in expected]
    assert ordered((r.doc_id, r.ids_crc32) for r in digests) == ordered(crc)


def test_pieces_equal_whole_texts():
    import pyarrow as pa

    random = np.random.default_rng(3)
    letters = ["a", "b", " ", "\n", "'", "1", ".", "é", "don't", "\t", " ", "<|endoftext|>"]
    made = ["".join(random.choice(letters, random.integers(0, 14))) for _ in range(3000)]
    encoder, whole = tokens.PieceEncoder(BPE), Tokenizer.from_file(BPE)
    for run in tokens.texts(pa.array(made, pa.string())):
        ids, sizes = encoder.encode(run)
        for i, part in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == whole.encode(made[run.first + i], add_special_tokens=False).ids


@pytest.mark.parametrize("most", [4, 6, 16])
def test_code_lengths_are_optimal_within_the_limit(most):
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    lengths = tokens.code_lengths(counts, most)
    assert lengths.max() <= most and sum(2.0**-lengths) <= 1
    if most == 16:  # plain Huffman of Fibonacci counts
        assert lengths.tolist() == [11, 11, *range(10, 0, -1)]


# -- quality rules


@pytest.mark.parametrize("table", ["odd", "small"])
def test_quality_base(request, table):
    docs = request.getfixturevalue(table)
    found = {}
    for r in rules.quality(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, text in texts_of(docs):
        w, text = space_words(text), text or ""
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = collections.Counter(windows)
        inside = {k + j for k, g in enumerate(windows) if count[g] > 1 for j in range(8)}
        lines = [line for line in text.split("\n") if space_words(line)]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert base in [tuple(r[n] for n in names) for r in found[i]]
    kept = rules.good_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for group in found.values() for r in group)


# -- language model


@pytest.mark.parametrize(("table", "order"), [("odd", 2), ("small", 2), ("odd", 3), ("small", 3), ("odd", 1), ("odd", 4)])
def test_language_model(request, table, order):
    docs = request.getfixturevalue(table)
    found = lm.scored(docs, order=order).collect()
    assert len(found) == docs.count()
    coded = [(i, [*space_words(lower(t)), "\0end"]) for i, t in texts_of(docs)]
    train = [t for i, t in coded if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    begun = ["\0begin"]
    grams = collections.Counter()
    for t in train:
        whole = [*begun, *t]
        grams[tuple(begun)] += 1
        for p in range(1, len(whole)):
            for n in range(1, min(order, p + 1) + 1):
                grams[tuple(whole[p + 1 - n : p + 1])] += 1
    total = sum(len(t) for t in train)
    distinct = len({w for t in train for w in t})

    def base(w, less=0):
        return (grams[(w,)] - less + 0.5) / (total - less + 0.5 * (distinct + 1))

    def chances(t, a, less=0):
        whole = [*begun, *t]
        for p in range(1, len(whole)):
            chance = base(whole[p], less)
            for n in range(2, min(order, p + 1) + 1):
                gram = tuple(whole[p + 1 - n : p + 1])
                chance = (grams[gram] - less + a * chance) / (grams[gram[:-1]] - less + a)
            yield chance

    best = max(lm.STRENGTHS, key=lambda a: sum(math.log10(c) for t in train for c in chances(t, a, 1))) if order > 1 else 1.0
    expected = [
        (i, len(t), sum(grams[(w,)] > 0 for w in t), round(sum(math.log10(base(w)) for w in t), 6),
         round(sum(map(math.log10, chances(t, best))), 6))
        for i, t in coded
    ]
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found]
    assert ordered(got) == ordered(expected)
    assert {r.train_tokens for r in found} == {total}


# -- substrings


@pytest.mark.parametrize("table", ["odd", "small"])
def test_substrings(request, table):
    docs = request.getfixturevalue(table)
    data = [(math.inf if i is None else i, (t or "").encode()) for i, t in texts_of(docs)]
    first = {}
    for i, b in sorted(data):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    expected = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        kept = hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()
        expected.append((None if i == math.inf else i, len(b), sum(gone), spans, kept))
    assert ordered(rows(suffixes.deduplicated(docs))) == ordered(expected)


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").cache()
    test = labels.filter("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("truth"))
    train = labels.filter("doc_id % 4 <> 0")
    how = {"grade": "toxic", "weak": True}
    found = toxicity.severity(docs.withColumn("toxic", F.lit("x")), train, **how).join(test, "doc_id").collect()
    toxic = [r for r in found if r.truth > 0]
    assert sum(r.toxic for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.toxic for r in found if r.truth == 0) <= 0.03 * len(found)
    means = [np.mean([r.severity for r in found if r.grade == g]) for g in (0, 1, 2)]
    assert means == sorted(means)


def severity_table(spark, seed, n=600):
    """Texts of 30 words with 0 to 9 toxic ones among them."""
    random = np.random.default_rng(seed)
    clean, bad = [f"plain{i}" for i in range(300)], [f"awful{chr(97 + i)}x" for i in range(25)]
    rows = []
    for i in range(n):
        k = int(random.integers(1, 10)) if i % 3 == 0 else 0
        rows.append((i, " ".join([*random.choice(clean, 30 - k), *random.choice(bad, k)]), k))
    return spark.createDataFrame(rows, "doc_id long, text string, k int")


def test_severity_rises_with_the_evidence_and_ignores_partitions(spark):
    train, test = severity_table(spark, 1), severity_table(spark, 2)
    labels = train.select("doc_id", (F.col("k") > 0).cast("int").alias("toxic"))
    both = train.withColumn("doc_id", F.col("doc_id")).unionByName(test.withColumn("doc_id", F.col("doc_id") + 10_000))
    answers = [
        {r.doc_id: r for r in toxicity.severity(both.repartition(n), labels, grade="toxic", weak=True).collect()} for n in (2, 9)
    ]
    assert answers[0] == answers[1]
    mean = collections.defaultdict(list)
    for r in test.collect():
        mean[0 if r.k == 0 else 1 if r.k <= 3 else 2 if r.k <= 6 else 3].append(answers[0][r.doc_id + 10_000].severity)
    steps = [np.mean(mean[g]) for g in range(4)]
    assert steps[0] < 0.3 and all(b > a + 0.15 for a, b in zip(steps[:3], steps[1:4], strict=True)), steps


def test_ordinal_fit_against_a_plain_one():
    """The likelihood reached is that of a slow, plain descent on the same rows."""
    import pyarrow as pa

    random = np.random.default_rng(6)
    x = random.random((400, 5)) < 0.4
    score = x @ [3.0, 1.5, -2.0, 0.0, 1.0]
    y = (score + random.logistic(size=400) > 0.5).astype(int) + (score + random.logistic(size=400) > 2.5)
    lists = [np.flatnonzero(r).tolist() for r in x]
    model = toxicity.fit(pa.table({"grade": pa.array(y, pa.int32()), "features": pa.array(lists, pa.list_(pa.int32()))}), 3, 5, rounds=600, l1=0.0)

    def loss(w, cuts):
        above = np.column_stack([np.ones(400), *(1 / (1 + np.exp(-(x @ w - c))) for c in cuts), np.zeros(400)])
        return -np.log(np.maximum(above[np.arange(400), y] - above[np.arange(400), y + 1], 1e-12)).mean()

    w, cuts = np.zeros(5), np.array([0.0, 1.0])
    for _ in range(3000):
        point = np.concatenate([w, cuts])
        slope = [(loss(*np.split(point + d, [5])) - loss(*np.split(point - d, [5]))) / 2e-5 for d in np.eye(7) * 1e-5]
        w, cuts = np.split(point - 0.5 * np.array(slope), [5])
    assert loss(model.weights, model.thresholds) <= loss(w, cuts) + 1e-3


def test_toxicity_odd(odd, empty, spark):
    labels = spark.createDataFrame([(1, 2), (2, 0), (3, 1), (4, None), (99, 1)], "doc_id long, grade int")
    assert toxicity.severity(odd, labels).count() == len(TEXTS)
    assert toxicity.severity(odd, labels.limit(0)).count() == len(TEXTS)


# -- pages


PAGE = """<html><head><title>t</title></head><body class="menu"><nav><a href=x>Menu</a></nav><div class="cookie">Yes?</div>
<article class="post-12"><header><h1>Head &amp;  line</h1></header><p>First <b>bold</b>
 text &#233;<p>Second<script>bad("</p>")</script> one<div class="ad">buy</div><ul><li>a<li>b</ul>
<section class="comments"><p>reader says</p></section></article><aside>Side</aside><footer>(c)</footer>"""


def test_pages(spark):
    made = [(1, "https://a.example/x", PAGE), (2, None, None), (3, "https://a.example/y", ""), (4, "b", "plain text")]
    other = "<body><div class='c1'><p>" + "Some long running text. " * 9 + "</p></div><div class='sidebar'>no</div></body>"
    made += [(None, "http://c.example/1", other), (None, "http://c.example/1", other)]
    found = pages.extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == "Head & line\nFirst bold text é\nSecond one\na\nb"
    assert texts[2] == texts[3] == "" and texts[4] == "plain text"
    assert texts[None] == ("Some long running text. " * 9).strip() and len(found) == 6
    assert all(r.n_chars == len(r.text) for r in found)


def test_pages_of_the_tables(spark):
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r.page_id: r.html for r in table.collect()}
    import html as references

    for r in pages.extracted(table).collect():
        body = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


# -- all together


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id int, text string")
    labels = spark.createDataFrame([], "doc_id long, grade int")
    folder = tokens.write_ids(empty, "doc_id", "text", BPE, 2)
    for result in (
        simhash.near_duplicates(empty),
        mixing.mixed_sources(empty),
        mixing.mixed_documents(empty),
        decontam.contamination(empty, bench),
        shards.sharded(empty, 40),
        tokens.read_ids(spark, folder, digest=True),
        rules.quality(empty),
        lm.scored(empty),
        suffixes.deduplicated(empty),
        toxicity.severity(empty, labels),
        pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert result.collect() == []


def naive_kept(text):
    """The verdict of the quality rules, n-gram by n-gram."""
    found = space_words(text)

    def inside(n):
        grams = collections.Counter(tuple(found[i : i + n]) for i in range(len(found) - n + 1))
        return {i + k for i in range(len(found) - n + 1) if grams[tuple(found[i : i + n])] > 1 for k in range(n)}

    if len(found) < 20 or 100 * len(inside(8)) > 30 * len(found):
        return False
    chars = sum(map(len, found))
    if any(sum(len(found[i]) for i in inside(n)) > most * chars + 1e-9 for n, most in rules.NGRAM_LIMITS.items()):
        return False
    lines = [line for line in text.split("\n") if space_words(line)]
    again = [line for i, line in enumerate(lines) if line in lines[:i]]
    symbols = sum(c in rules.SYMBOLS.decode() for c in text)
    if len(again) > 0.3 * len(lines) + 1e-9 or symbols > 0.1 * len(found) + 1e-9:
        return False
    return sum(len(w) for line in again for w in space_words(line)) <= 0.2 * chars + 1e-9


def naive_mix(rows):
    """How often fair queueing takes each of ``(id, text, source)``, sorting every document."""
    def key(x):
        return (x is not None, x if x is not None else 0)

    size = [len(space_words(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        left = 1.5 * sum(whole.values()) - sum(2 * whole[s] for s in full)
        rest = [s for s in sources if s not in full]
        target = {s: 2 * whole[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in sources}
        over = {s for s in rest if target[s] >= 2 * whole[s]}
        if not over:
            break
        full |= over
    queue = []
    for s in sources:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        shuffled = [hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}|7".encode()).hexdigest() for i in mine]
        sent, copies = 0, collections.Counter()
        for _, i in sorted(zip(shuffled, mine, strict=True), key=lambda x: (x[0], key(rows[x[1]][0]), size[x[1]])):
            unit = (rows[i][0], s, size[i])
            for turn in (0, 1):
                if size[i]:
                    at = (sent + size[i] + turn * whole[s]) / target[s]
                    queue.append((at, (s is not None, s or ""), key(rows[i][0]), turn, size[i], copies[unit], i))
            sent += size[i]
            copies[unit] += 1
    taken, used, budget = collections.Counter(), 0, 1.5 * sum(whole.values())
    for entry in sorted(queue):
        used += entry[4]
        if used > budget:
            break
        taken[entry[-1]] += 1
    return taken


def naive_pipeline(rows, items):
    rows = [r for r in rows if naive_kept(r[1] or "")]
    groups = collections.defaultdict(list)
    marked = [(i, fingerprint(r[1])) for i, r in enumerate(rows)]
    for i, _, group in components(marked, 4):
        groups[group].append(i)

    def first(i):
        mark = xxhash.xxh64_intdigest((rows[i][1] or "").encode(), 42)
        return (rows[i][0] is None, rows[i][0] or 0, mark - (1 << 64 if mark >> 63 else 0))

    rows = [rows[min(g, key=first)] for g in groups.values()]
    rows = [r for r in rows if not naive_contamination(r[1], items)[1]]
    taken = naive_mix(rows)
    tokenizer = Tokenizer.from_file(BPE)
    out, start = [], 0
    coded = []
    for i, n in taken.items():
        ids = [*tokenizer.encode(rows[i][1] or "", add_special_tokens=False).ids, 2]
        coded += [(rows[i][0], zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))] * n
    for doc, crc, n in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        out.append((doc, start, n, crc))
        start += n
    return out


def test_pipeline(spark, small, tmp_path):
    """All stages on plain and odd documents, against one search after the other."""
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in small.collect() if len(r.text or "") < 12_000]
    data += [(None if i is None else i + 5000, t, "xx", s, 0) for i, t, s in TEXTS]
    data += [(6000 + i % 2, f"{PROSE} psi {i % 2} omega", None, None, None) for i in range(6)]
    spark.createDataFrame(data, small.select("doc_id", "text", "lang", "source", "n_chars").schema).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    wanted = naive_pipeline([(d[0], d[1], d[3]) for d in data], [(str(r.item_id), r.text) for r in items.collect()])
    found = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert len(wanted) > 50 and ordered(found) == ordered(wanted)


def test_pipeline_of_nothing(spark, small, tmp_path):
    small.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pieces_give_the_ids_of_whole_texts():
    """Every way to cut a text gives what the library makes of it whole."""
    from strandwork.llm.words import texts as runs

    samples = [
        "It's they'll we've I'm he'd you're can't 'quoted' 'S 's  ' don't, stop.",
        "a,b;c:d!e?f 3.5 1,000.25 x=1.e5 end.. ... .start ,, (paren), [x]. \"q.\"",
        "é.à ,ü ñ! ¿qué? —dash—. …dots… “quotes”, naïve façade. Ångström ÆØ ß.",
        "日本語。テスト、 混ぜ text. Ω≈ç √∫ Ж. пример, текст: да!",
        "\n\n  two  spaces \n and   three\t tab\r\n.  nbsp. x y",
        "<s> </s> <|endoftext|> <unk>. tokens <pad>",
        "".join(chr(c) for c in range(32, 700)) + " " + " ".join(chr(c) + "." for c in range(33, 1500)),
        "", " ", ".", "?a", "a?", "́combining é. ä,", "🙂. 👍🏽, ok🙂.x",
    ]
    tokenizer = Tokenizer.from_file(BPE)
    encoder = tokens.PieceEncoder(BPE)
    for usable in (True, False):
        encoder.words.usable = usable and encoder.words.usable
        encoder.forget()
        for run in runs(__import__("pyarrow").array(samples)):
            ids, sizes = encoder.encode(run)
            for text, part in zip(samples, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_memory(tmp_path):
    """A worker of its own stays below 250 MB over megabytes of new words."""
    import subprocess
    import sys

    code = f"""
import resource, pyarrow as pa, numpy as np
from strandwork.llm.tokens import PieceEncoder, _RUN_BYTES
from strandwork.llm.words import texts
random = np.random.default_rng(1)
encoder = PieceEncoder.of({BPE!r})
for _ in range(4):
    words = ["".join(w) for w in random.choice(list("abcdefghijklmnopqrstuvwxyz"), (150_000, 7))]
    for run in texts(pa.array([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]), _RUN_BYTES):
        encoder.encode(run)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": ":".join(sys.path)})
    assert int(done.stdout) < 250, done.stdout + done.stderr


def test_frequent_pieces_stay_known(monkeypatch):
    """When the memory of pieces is full, those of several runs stay; the ids do not change."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from strandwork.llm.words import texts as runs

    monkeypatch.setattr(tokens, "_KEPT_BYTES", 200_000)
    common = [" ".join(f"été{i} naïveté maïs über{chr(97 + i % 26)} Ångström word {i}x{i}" for i in range(300))]
    encoder, whole = tokens.PieceEncoder(BPE), Tokenizer.from_file(BPE)
    learned, learn = [], encoder._learn

    def counted(run, keys, begin, end):
        learned.extend(run.data[a:b].tobytes() for a, b in zip(begin, end, strict=True))
        learn(run, keys, begin, end)

    monkeypatch.setattr(encoder, "_learn", counted)
    for turn in range(40):
        text = common + [" ".join(f"rare{turn}z{i}" for i in range(300))]
        for run in runs(pa.array(text)):
            ids, sizes = encoder.encode(run)
            assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in whole.encode_batch_fast(text, add_special_tokens=False)]
        assert encoder.kept_bytes() < 300_000
    assert learned.count(" naïveté".encode()) == 1 and learned.count(" rare0z5".encode()) == 1


def test_latin_words_are_single_pieces():
    data = np.frombuffer(" été ×a b÷ ÿ Āɏ abc12 12 ȿ ".encode(), np.uint8)
    cuts = np.flatnonzero(data == 0x20)
    single = tokens.PieceEncoder(BPE).words.single(data, cuts[:-1], cuts[1:])
    assert single.tolist() == [True, False, False, True, False, False, True, True]


def test_words_merged_together_stay_apart():
    """Many words in one call to the merges have the ids that each has alone."""
    from tokenizers import Tokenizer

    encoder, whole = tokens.PieceEncoder(BPE), Tokenizer.from_file(BPE)
    pieces = [f"{a}{w}" for w in ("the", "été", "ÿÿ", "xqzjk", "Straße", "a", "0123456789", "ĀāȾ") for a in (" ", "")] * 30
    flat, lengths = encoder.words.merged([p.encode() for p in pieces])
    assert encoder.words.lone
    assert [p.tolist() for p in np.split(flat, np.cumsum(lengths)[:-1])] == [whole.encode(p, add_special_tokens=False).ids for p in pieces]
    assert encoder.words.merged([])[1].tolist() == []
