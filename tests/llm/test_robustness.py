"""Rows and files over a changing cluster, brute-force versions of language ID and fertility bands, and every stage of the
pipeline on tables of nulls, clashes, ties, repeats and no rows."""

import collections
import math
from types import SimpleNamespace

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import exact_dedup, jaccard_join, langid, line_dedup, mixing, quality, queries
from quarry.llm.common import crc_bucket, numbered, shared_dir, text_groups, word_hashes, words_of
from .test_operators import SCHEMA, texts

SPLITS = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t, ("en", "fr", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t or ""), "r", 1, 2, 3) for i, t in enumerate(texts())]
    return out + [out[5], out[5], (None, "no id " * 20, "en", "a", 1, "r", 1, 2, 3), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def resplit(spark):
    """Changes how scans are split from now on, as when executors come or go."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}

    def change(parallelism: int, size: str = "1k"):
        for k, v in zip(SPLITS, (str(parallelism), size, "1")):
            spark.conf.set(k, v)

    yield change
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_numbers_stay(docs, resplit):
    rows = numbered(docs, "n")
    resplit(1, "128m")
    one = sorted(map(str, rows.collect()))
    parts = rows.rdd.getNumPartitions()
    resplit(16)
    again = numbered(docs, "n")
    assert again.rdd.getNumPartitions() != parts
    assert sorted(map(str, again.collect())) == one and len({r.n for r in again.collect()}) == len(one)
    assert len({r.n for r in numbered(docs.union(docs), "n").collect()}) == 2 * len(one)


@pytest.mark.parametrize("keep", [exact_dedup.keep_one, jaccard_join.keep_one, lambda d: line_dedup.dedup_lines(d).filter("n_removed = 0"), lambda d: mixing.mix(d, block_words=64)])
def test_results_over_changing_splits(docs, resplit, keep):
    """The plan is made under one number of splits and run under another."""
    resplit(1, "128m")
    plain = sorted(str(r) for r in keep(docs).collect())
    made = keep(docs)
    resplit(16)
    assert sorted(str(r) for r in made.collect()) == plain and plain
    assert sorted(str(r) for r in keep(docs).collect()) == plain


def test_missing_shard_is_an_error(tmp_path):
    sets = jaccard_join.Sets(str(tmp_path), 4)
    sets.write("df", 1, np.arange(3))
    sets.wrote("df", [(1,), (2,)])
    assert sets.read("df", 0) is None and sets.read("df", 1).tolist() == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        sets.read("df", 2)


def test_shared_folder_must_be_named_on_a_cluster():
    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master), "x")
    assert "/x-" in shared_dir(session("local[2]"), "x")


def test_words_of_agrees_with_lists():
    some = [(t or "").encode() for t in texts()[:80]]
    buf, edges = np.frombuffer(b"".join(some), dtype=np.uint8), np.cumsum([0] + [len(x) for x in some])
    for lower in (True, False):
        one, two = word_hashes(some, lower), words_of(buf, edges, lower)
        assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
    assert [x for a, b in text_groups(np.array([0, 5, 5, 9, 30]), 8) for x in range(a, b)] == [0, 1, 2, 3] and list(text_groups(np.array([0]), 8)) == []


def naive_vector(space, text):
    """Bundled n-grams of letters, one by one."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    v = np.zeros(space.dim)
    if not runs:
        return v
    seq = [ord(c) if c != " " else 0 for c in " " + " ".join(runs) + " "]
    for i in range(len(seq) - 2):
        gram = np.ones(space.dim, dtype=np.int64)
        # The last letter is not rotated, the one before it by one place, and so on.
        for place, code in enumerate(reversed(seq[i : i + 3])):
            gram = gram * np.roll(space._letter(code).astype(np.int64), place)
        v += gram
    return v


def test_language_id_by_brute_force(docs, rows):
    space = langid.Space()
    short = [r for r in rows if len(r[1] or "") < 2000]
    sums = collections.defaultdict(lambda: np.zeros(space.dim))
    for r in rows:
        if r[2] is not None and r[1] is not None:
            sums[r[2]] += naive_vector(space, r[1])
    units = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    got = collections.Counter((r.doc_id, r.text, r.lang_pred, round(r.score, 4)) for r in langid.predict(docs, langid.train(docs)).collect())
    for r in short:
        v = naive_vector(space, r[1])
        n = np.linalg.norm(v)
        cos = {k: float(v @ u) / n if n else 0.0 for k, u in units.items()}
        best = max(cos, key=lambda k: cos[k])
        close = [(r[0], r[1], best if n else "und", round(max(0.0, cos[best]) + d, 4) if n else 0.0) for d in (0, 1e-4, -1e-4)]
        assert any(got[x] for x in close), (r, close)


def test_fertility_by_brute_force(spark):
    """Measures, groups, bands and verdicts, on a whole small table."""
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    texts_ = {r.doc_id: r for r in table.collect()}
    second = queries.vocabulary("byte_bpe_50k.json")
    byte_level = tokenizers.Tokenizer.from_file(second)
    got = {r.doc_id: r for r in quality.judge(table, path, second).collect()}
    assert set(got) == set(texts_)
    measured = {}
    for k, r in texts_.items():
        ids = [i for w in (r.text or "").split() for i in sp.encode(w)]
        count = collections.Counter(ids)
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in count.values()) if ids else 0.0
        fallback = sum(sp.is_byte(i) or sp.is_unknown(i) for i in ids)
        chars = sum(map(len, (r.text or "").encode().split()))
        assert got[k].n_tokens == len(ids) and got[k].byte_share == pytest.approx(fallback / max(1, len(ids))) and got[k].entropy == pytest.approx(entropy, abs=1e-9)
        assert got[k].chars_per_token == pytest.approx(got[k].word_chars / max(1, len(ids))) and chars >= got[k].word_chars
        ids_2 = byte_level.encode(r.text or "", add_special_tokens=False).ids
        count_2 = collections.Counter(ids_2)
        # A token that is no whole character decodes to the replacement character.
        broken = sum("\ufffd" in byte_level.decode([i]) for i in ids_2)
        assert got[k].n_tokens_2 == len(ids_2) and got[k].byte_share_2 == pytest.approx(broken / max(1, len(ids_2)))
        assert got[k].entropy_2 == pytest.approx(-sum(c / len(ids_2) * math.log2(c / len(ids_2)) for c in count_2.values()) if ids_2 else 0.0, abs=1e-9)
        group = f"lang {r.lang}" if r.lang else f"script {got[k].script}"
        measured[k] = {c: got[k][c] for c in quality.LEAST_ROOM} | {"group": group,
                       "class": min(10, max(4, int(math.log2(max(1, len(ids))))))}

    def bands(c, some):
        lo, hi = (sorted(some)[max(0, math.ceil(q * len(some)) - 1)] for q in (0.25, 0.75))
        room = max(5.0 * (hi - lo), {"chars_per_token": 0.1, "byte_share": 0.05, "entropy": 0.25}[c.removesuffix("_2")])
        return lo - room, hi + room

    def limits(c, k, by_class):
        own = lambda g, m: m["group"] == g and (not by_class or m["class"] == measured[k]["class"])
        values = {g: [m[c] for m in measured.values() if own(g, m)] for g in {m["group"] for m in measured.values()}}
        large = {g: bands(c, v) for g, v in values.items() if len(v) >= 30}
        if measured[k]["group"] in large:
            return large[measured[k]["group"]]
        if large:
            return min(b[0] for b in large.values()), max(b[1] for b in large.values())
        return bands(c, [m[c] for m in measured.values() if not by_class or m["class"] == measured[k]["class"]])

    for k, m in measured.items():
        inside = all(limits(c, k, "entropy" in c)[0] <= m[c] <= limits(c, k, "entropy" in c)[1] for c in quality.LEAST_ROOM)
        assert got[k].kept == (inside and not got[k].base_failed), (k, m)


def test_stages_on_odd_rows(spark, docs, rows, empty, tmp_path):
    for name, table in (("odd", docs), ("none", empty)):
        d = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, "/nowhere")
            assert k == 4 or out.columns == table.columns
            path = str(tmp_path / f"{name}{k}")
            out.write.parquet(path)
            before, d = d, spark.read.parquet(path)
            if name == "none":
                assert d.count() == 0
            elif k < 3:
                assert 0 < d.count() <= before.count()
                assert d.exceptAll(before).count() == 0
    kept = spark.read.parquet(str(tmp_path / "odd0")).collect()
    told = langid.predict(docs, langid.train(docs.filter(crc_bucket(F.col("doc_id"), 5) != 0))).filter("lang_pred <> 'und' and score >= 0.1")
    assert sorted(str(tuple(r)) for r in kept) == sorted(str(tuple(r)) for r in told.select(*docs.columns).collect())
    assert all(any(c.isalpha() for c in r.text or "") for r in kept) and len(kept) > 0.8 * len(rows)
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    exact = spark.read.parquet(str(tmp_path / "odd1")).collect()
    assert sorted(norm(r.text) for r in exact) == sorted({norm(r.text) for r in kept})
    pieces = spark.read.parquet(str(tmp_path / "odd4"))
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_native_operators_on_empty_tables(empty):
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_tied_turns_are_ordered_by_text(spark):
    from quarry.llm import chat

    turns = spark.createDataFrame([(1, 0, "user", "<|z"), (1, 0, "user", "0 a"), (1, 0, "user", "&"), (1, 0, "user", "0 a")], "conv_id long, turn long, role string, text string").repartition(3)
    said = chat.format_chats(turns).select(chat.parse_chats(F.col("formatted")).alias("t")).head().t
    assert [x.text for x in said] == sorted(["<|z", "0 a", "&", "0 a"])


def test_large_draws():
    """Populations beyond the library's are drawn with the right mean and spread, and split without loss."""
    for good, bad, n in ((3 * 10**9, 5 * 10**9, 10**9), (10**10, 10**10, 10**10), (2 * 10**9, 7, 10**9)):
        x = np.array([mixing.hypergeometric(np.random.default_rng(i), good, bad, n) for i in range(60)], dtype=np.float64)
        mean = n * good / (good + bad)
        spread = math.sqrt(mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1))
        assert abs(x.mean() - mean) < 5 * spread / math.sqrt(60) and 0.6 * spread < x.std() < 1.5 * spread
    quotas = [5 * 10**9, 10**9, 3]
    out = mixing.split_tree(quotas, 6, 3)
    assert out.sum(axis=0).tolist() == quotas and out.min() >= 0 and np.ptp(out.sum(axis=1)) <= 3
    tree = mixing.Tree([700, 30, 1], 9, 5)
    whole, ends = mixing.split_tree([700, 30, 1], 9, 5), np.cumsum(mixing.split_tree([700, 30, 1], 9, 5), axis=0)
    for k, quota in enumerate((700, 30, 1)):
        found = collections.Counter(tree.shard(k, p) for p in range(quota))
        assert [found[s] for s in range(9)] == whole[:, k].tolist() and all(tree.shard(k, p) == int(np.searchsorted(ends[:, k], p, side="right")) for p in range(quota))


def test_crc_folds(spark):
    import zlib

    d = spark.createDataFrame([(7,), (None,), (-3,)], "doc_id long")
    assert {r.doc_id: r.b for r in d.select("doc_id", crc_bucket(F.col("doc_id"), 5).alias("b")).collect()} == {k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 for k in (7, None, -3)}
