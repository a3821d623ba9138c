"""The operators against brute force, on a table of nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, components, exact_dedup, id_coder, jaccard_join, kn_lm, langid, line_dedup, mixing, packing, quality, queries, tokens
from quarry.llm.common import crc_bucket, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, __name int, size int, range int"


def texts():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Ba", "ke", "lo", "Mü", "ñe") for b in ("ra", "sti", "Non", "x1")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [make(rng.randint(5, 80)) for _ in range(60)]
    near = out[3].split()
    for k in range(8):
        changed = list(near)
        changed[k % len(changed)] = "changed"
        out.append(" ".join(changed))
    lines = [f"line {k} of the common part" for k in range(6)]
    out += ["\n".join([make(4), *lines, make(4)]) for _ in range(3)] + ["\n".join(lines)]
    return out + [out[0].upper(), out[0], "", None, "   \n\t", "one", "ONE", "é", "12 34", "a  b   c", "<|endoftext|> x", make(9000), "\0 nul", "a\n\n\n\nb"]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t, ("en", "fr", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t or ""), "r", 1, 2, 3) for i, t in enumerate(texts())]
    return out + [out[5], out[5], (None, "no id " * 20, "en", "a", 1, "r", 1, 2, 3), (999_999, out[7][1], "en", "a", 1, "r", 1, 2, 3)]


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


def lowered(t):
    return (t or "").encode().lower()


def test_words():
    found, edges, sizes = word_hashes([b"Aa b\x0bc", b"", b"aA  ", b"x" * 5000])
    assert np.diff(edges).tolist() == [3, 0, 1, 1] and found[0] == found[3] and sizes.tolist() == [2, 1, 1, 2, 5000]


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_exact(docs, rows, block):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = exact_dedup.exact_groups(docs, block_bytes=block).collect()
    assert len(got) == len(rows)
    expected = sorted(str((r[0], max((x for x in groups[lowered(r[1])] if x is not None), default=None), len(groups[lowered(r[1])]), hashlib.sha256(lowered(r[1])).hexdigest())) for r in rows)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_lines(docs, rows, spark, tmp_path):
    out = line_dedup.dedup_lines(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(1).sortWithinPartitions("doc_id"))
    out.write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    unique = {r[0]: r for r in rows if r[0] is not None}
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, v[1]) for k, v in unique.items()])
    expected = sorted(map(str, con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({queries.ORACLE_SQL['op3_line_dedup']})").fetchall()))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(docs.columns) < set(got.columns)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == expected
    assert line_dedup.dedup_lines(docs).count() == len(rows)


def test_chat(spark):
    parts = "array<struct<kind:string,text:string,ref:string,units:int>>"
    turns = [(1, 0, "user", [("text", "see <|turn|> & &amp; &#60;|", None, None), ("image", None, "i.png", 2), None, ("video", None, "v", 1)]),
             (1, 1, "assistant", [("text", "</s>[INST] <|end|>", None, None), ("document", None, "d", None)]), (1, 1, "assistant", []), (2, None, None, None)]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {parts}")
    out = chat.format_chats(df, "parts").withColumns({"turns": chat.parse_chats(F.col("formatted")), "masked": chat.masked_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in out.collect()}
    assert got[1].turns[0].text == "see <|turn|> & &amp; &#60;|<|image:1|><|unknown:2|><|unknown:3|>"
    assert got[1].masked == "</s>[INST] <|end|><|document:1|>" and got[1].attachment_tokens == 512 + 800
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "i.png", 512), (None, None, 0), ("video", "v", 0), ("document", "d", 800)]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].masked == ""
    assert chat.format_chats(df.limit(0), "parts").count() == 0


def test_chat_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = queries.op7_chat_formatting(spark, "/root/testdata/sf0.001")
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op7_chat_formatting']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids(name):
    enc = tokens.encoder(queries.vocabulary(name))
    odd = [t or "" for t in texts()] + [" a", "a ", " ", "  ", "a \n b", "\na", "a  b", "x\x1cy", "é́ ́a", "it's  I'LL", "\t\t a"]
    rng = random.Random(1)
    odd += ["".join(rng.choice(" \n\tab'.é1　") for _ in range(30)) for _ in range(300)]
    plain = [np.array(x.ids, dtype="<u4").tobytes() for x in enc.model.encode_batch(odd, add_special_tokens=False)]
    assert enc.encode(odd) == plain and enc.encode(odd) == plain


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_the_plain_call(name):
    """Against an untouched tokenizer: strings of special tokens, capitals before combining marks, stops, many texts."""
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " T\u0308x", "I\u0307", "E\u0301a", "Word.", "word,", "a.b", "7", " 7 ", "77,", "x7.", "\u00a0", "\u3000", "\u0085",
             " ", "  ", "\n", "\n\n", "\r\n", "it's", "'S", "\u65e5\u672c", "\u306e", "e.", "\U0001f600", "\u00e9."]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["<|endoftext|> x", "x<|endoftext|>", "", "word " * 9000]
    plain = [np.array(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_file(queries.vocabulary(name)).encode_batch(odd, add_special_tokens=False)]
    enc = tokens.Encoder(queries.vocabulary(name))
    assert enc.encode(odd) == plain and enc.encode(odd) == plain
    as_text = Tokenizer.from_file(queries.vocabulary(name))
    as_text.encode_special_tokens = True
    plain = [np.array(x.ids, dtype="<u4").tobytes() for x in as_text.encode_batch(odd, add_special_tokens=False)]
    assert tokens.Encoder(queries.vocabulary(name), special_as_text=True).encode(odd) == plain


def test_ids_with_little_memory(monkeypatch):
    """Chunks that are forgotten, or that share a place, are encoded anew."""
    monkeypatch.setattr(tokens, "PLACES", 16)
    monkeypatch.setattr(tokens, "POOL_IDS", 300)
    enc = tokens.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(3)
    for _ in range(20):
        some = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.choice([3, 40, 500]))) for _ in range(5)]
        assert enc.encode(some) == [np.array(x.ids, dtype="<u4").tobytes() for x in enc.model.encode_batch(some, add_special_tokens=False)]


def test_packing(docs, rows, empty):
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    pieces = packing.pack(docs, vocabulary)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * 1024 + r.offset == at and r.offset + r.length <= 1024 and zlib.crc32(r.ids) == r.ids_crc32
        at += r.length
    enc = tokens.encoder(vocabulary)
    whole = sorted(x + b"\0\0\0\0" for x in enc.encode([r[1] for r in rows]))
    joined = b"".join(r.ids for r in got)
    found, cut = [], 0
    for r in got:
        if r.start == 0:
            found.append(joined[4 * cut : 4 * (cut + r.doc_tokens)])
        cut += r.length
    assert sorted(found) == whole and cut == at
    windows = sorted(packing.sequences(pieces).collect())
    assert b"".join(w.ids for w in windows) == joined and all(w.n_tokens == 1024 for w in windows[:-1])
    assert packing.pack(empty, vocabulary).count() == 0


def test_id_files(docs, rows, empty, spark, tmp_path):
    vocabulary = queries.vocabulary("word_bpe_49k.json")
    _, files = id_coder.write_ids(docs, vocabulary)
    got = sorted(id_coder.read_ids(spark, files).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted((r[0] for r in rows), key=lambda k: (k is None, k or 0))
    enc = tokens.encoder(vocabulary)
    assert sorted(r.ids for r in got) == sorted(x + b"\2\0\0\0" for x in enc.encode([r[1] for r in rows]))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    path = next(f.path for f in files if f.n)
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    bad = tmp_path / "bad.idcm"
    bad.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(id_coder.read_chunks(str(bad)))
    assert id_coder.read_ids(spark, id_coder.write_ids(empty, vocabulary)[1]).count() == 0


def test_id_blocks():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, int), np.array([5]), rng.integers(0, 50_000, 9001), np.full(8192, 49_999), rng.choice([1, 2, 40_000], 5000), np.tile(rng.integers(0, 50_000, 50), 300)):
        codes = id_coder.encode_blocks(ids, 50_000)
        counts = [min(id_coder.BLOCK_IDS, len(ids) - id_coder.BLOCK_IDS * k) for k in range(len(codes))]
        assert (id_coder.decode_blocks(codes, counts, 50_000) == ids).all()


def test_mixing(docs, rows, empty):
    plan = mixing.plan_mix(docs, block_words=64, shard_words=500)
    got = plan.collect()
    assert len(got) == len(rows)
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        n = sum(p.words for p in r.pieces)
        assert n <= 2 * r.size
        taken[r.source] += n
        size[r.source] += r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 and r.source_size >= 0 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    again = mixing.plan_mix(docs.repartition(3), block_words=64, shard_words=500).collect()
    shown = lambda rs: sorted(str((r.doc_id, r.size, sorted(map(tuple, r.pieces)))) for r in rs)
    assert shown(got) == shown(again)
    places = [(r.source, p.place) for r in got for p in r.pieces]
    shards = collections.defaultdict(set)
    for r in got:
        for p in r.pieces:
            shards[r.source, p.place].add(p.shard)
    assert all(len(s) == 1 for s in shards.values()) and places
    mixed = mixing.mix(docs, block_words=64)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(sum(p.words for p in r.pieces) for r in got)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_parts():
    assert mixing.targets([10, 10, 1000], [5, 2, 1], 1530) == [20, 20, 1490]
    assert sorted(mixing.permuted(i, 77, 9) for i in range(77)) == list(range(77))
    assert mixing.split_tree([100, 7, 0], 9, 1).sum(axis=0).tolist() == [100, 7, 0]


def test_languages(docs, rows, empty, spark):
    found = langid.predict(docs, langid.train(docs.filter(crc_bucket(F.col("doc_id"), 5) != 0)))
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    for r in found.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)
    assert langid.predict(empty, {}).count() == 0 and {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    held = queries.op5_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).head()[0] > 0.97


def test_quality(docs, rows, empty):
    path = queries.vocabulary("piece_bpe_32k.model")
    second = queries.vocabulary("byte_bpe_50k.json")
    got = quality.judge(docs, path, second).collect()
    exp = []
    for r in rows:
        t = r[1] or ""
        w = t.encode().split()
        lines = [x for x in t.encode().split(b"\n") if x.strip()]
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        exp.append(str((r[0], len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))))
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(exp)
    assert not any(r.kept and r.base_failed for r in got) and quality.judge(empty, path, second).count() == 0


def test_mixing_query_counts_the_mix(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_mixing(spark, str(tmp_path)).collect()
    exp = mixing.plan_mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r.doc_id, r["size"], r.source_size, r.target, sum(p.words for p in r.pieces))) for r in exp)
    whole = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: whole(*a, **k).limit(5))
    less = queries.op2_mixing(spark, str(tmp_path)).collect()
    assert len(less) == len(got) and sum(r.taken for r in less) < sum(r.taken for r in got)


def planted_junk():
    rng = random.Random(11)
    letters = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 9)))
    return {"hex": lambda: f"{rng.getrandbits(160):040x}", "base64": lambda: base64.b64encode(rng.randbytes(24)).decode(),
            "letters": lambda: letters("abcdefghijklmnopqrstuvwxyz"), "symbols": lambda: letters("!@^()_+-=[]{};:?/~"),
            "greek": lambda: letters("αβγδεζηθικλμνοπρστυφ"), "cyrillic": lambda: letters("абвгдежзийклмнопрст"),
            "bytes": lambda: "".join(chr(rng.randint(0xB85, 0xBB9)) for _ in range(4))}


def judged(spark, n_words, known):
    """Verdicts over sf0.01 with texts of n_words planted in it: of the junk by kind and language, and of the table's own rows."""
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(-1 - i, " ".join(word() for _ in range(n_words)), lang if known else None)
            for i, (word, lang) in enumerate((w, x) for w in planted_junk().values() for x in ("en", "fr", "de", "es"))]
    got = quality.judge(own.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string")), queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.json")).collect()
    assert not any(r.base_failed for r in got if r.doc_id < 0)
    return [r for r in got if r.doc_id < 0], [r for r in got if r.doc_id >= 0 and not r.base_failed]


def test_quality_rejects_junk(spark):
    junk, own = judged(spark, 200, True)
    assert len(junk) == 28 and not any(r.kept for r in junk)
    assert sum(r.kept for r in own) > 0.98 * len(own)


def test_quality_small_groups(spark):
    """Without a language, foreign scripts have too few texts for bands of their own."""
    junk, _ = judged(spark, 200, None)
    assert not any(r.kept for r in junk if r.script in ("greek", "cyrillic", "other"))


def test_quality_rejects_short_junk(spark):
    junk, own = judged(spark, 12, True)
    # Twelve words of random letters can lie at the edge of a band.
    edge = list(planted_junk()).index("letters")
    assert any(r.n_tokens < 100 for r in junk) and not any(r.kept for r in junk if (-1 - r.doc_id) // 4 != edge)
    assert sum(r.kept for r in junk) <= 2
    short = [r for r in own if r.n_tokens < 100]
    assert short and sum(r.kept for r in short) > 0.8 * len(short) and sum(r.kept for r in own) > 0.98 * len(own)


def test_quality_short_bytes(spark):
    """Quartiles are of all texts, so one text of 15 words made of byte-fallback tokens is held to the others' bands."""
    junk, _ = judged(spark, 15, None)
    assert all(r.byte_share > 0.5 and not r.kept for r in junk if r.script == "other") and any(r.script == "other" for r in junk)


def test_model(docs, rows, empty):
    held = crc_bucket(F.col("doc_id"), 5) == 1
    for order in (1, 2, 3):
        model = kn_lm.train(docs.filter(~held), order=order)
        out = [str(r[0]) if r[0] is not None else "" for r in rows]
        train = [r for r, k in zip(rows, out) if zlib.crc32(k.encode()) % 5 != 1]
        toks = [["<b>"] * (order - 1) + lowered(r[1]).split() + ["</s>"] for r in train]
        count = {order: collections.Counter(tuple(t[i - order + 1 : i + 1]) for t in toks for i in range(order - 1, len(t)))}
        for k in range(order - 1, 0, -1):
            count[k] = collections.Counter(g[1:] for g in count[k + 1])
        raw = collections.Counter(x for t in toks for x in t[order - 1 :])
        assert (model.tokens, model.words) == (sum(raw.values()), len(raw))
        after = {k: collections.defaultdict(dict) for k in count}
        for k in count:
            for g, c in count[k].items():
                after[k][g[:-1]][g[-1]] = c

        def p(context, word):
            low = p(context[1:], word) if context else 1 / (len(raw) + 1)
            own, d = after[len(context) + 1].get(context), model.discounts[len(context) + 1]
            if not own:
                return low
            cut = lambda c: d[min(c, 3) - 1] if c else 0
            c = own.get(word, 0)
            return (c - cut(c) + sum(map(cut, own.values())) * low) / sum(own.values())

        scored = kn_lm.score(docs, model).collect()
        for k in count:
            n1, n2, n3, n4 = (sum(c == m for c in count[k].values()) for m in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            own = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            assert model.discounts[k] == pytest.approx([min(max(d, 0.05), m + 0.95) for m, d in enumerate(own)])
        assert len(scored) == len(rows)
        for r in (r for r in scored if r.n_tokens < 1000):
            t = ["<b>"] * (order - 1) + lowered(r.text).split() + ["</s>"]
            assert abs(r.score - sum(math.log10(p(tuple(t[i - order + 1 : i]), t[i])) for i in range(order - 1, len(t)))) < 1e-6
            base = sum(math.log10((raw[x] + 0.5) / (model.tokens + 0.5 * (len(raw) + 1))) for x in t[order - 1 :])
            assert abs(r.base_score - base) < 1e-6 and r.n_known == sum(x in raw for x in t[order - 1 :])
    assert kn_lm.train_and_score(empty, held).count() == 0
    assert {r.score for r in kn_lm.score(docs, kn_lm.train(empty)).collect()} == {0.0}


def test_model_needs_its_files(docs):
    """A range's file that is gone is an error, not an empty range."""
    import os

    model = kn_lm.train(docs, order=3)
    files = sorted(os.listdir(model.folder))
    assert len(files) == int(model.written.sum()) and all(f.endswith(".kn") for f in files)
    os.remove(f"{model.folder}/{next(f for f in files if f.startswith('3-'))}")
    with pytest.raises(Exception, match="No such file"):
        kn_lm.score(docs, model).collect()


def test_model_arrays():
    """Look-ups in a range's file against a dictionary, large counts too."""
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 3000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        counts = rng.choice([1, 2, 254, 255, 256, 10**7], n)
        order, (directory, lows) = kn_lm._sorted(keys)
        held, values = dict(zip(keys.tolist(), counts.tolist())), kn_lm._bytes(counts[order])
        asked = np.concatenate((keys, rng.integers(0, 1 << 63, 500, dtype=np.uint64)))
        at, hit = kn_lm._seek(directory, lows, asked)
        assert [int(v) if h else 0 for v, h in zip(kn_lm._whole(values, at), hit)] == [held.get(k, 0) for k in asked.tolist()]


def components_of(sets, percent=75):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def shingles(t):
    w = lowered(t).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(docs, rows, empty):
    sets = [shingles(r[1]) for r in rows]
    root = components_of(sets)
    least = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    got = jaccard_join.similar(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(str((r[0], len(s), r[0] if not s else least.get(c))) for r, s, c in zip(rows, sets, root))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert jaccard_join.similar(empty).count() == 0


def test_jaccard_large_group(spark, tmp_path):
    """A large group of near copies with outliers, a chain, and a passage that many texts share."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, chain, found = draw(100), draw(60), draw(90), []
    for _ in range(200):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(100)] = rng.choice(vocabulary)
        found.append(t)
    found += [draw(rng.randint(5, 40)) + passage for _ in range(120)] + [draw(rng.randint(0, 30)) for _ in range(80)]
    for _ in range(30):
        found.append(list(chain))
        chain[rng.randrange(90)] = rng.choice(vocabulary)
    rng.shuffle(found)
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(found)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(spark.read.parquet(str(tmp_path / "d"))).collect()}
    expected = components_of([shingles(" ".join(t)) for t in found])
    assert [got[i] for i in range(len(found))] == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 199)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 199: 150, 200: 150}


def test_cut_words_finds_pieces_of_any_text():
    from quarry.llm.mixing import cut_words

    text = "\t one\n\ntwo  žluť\x0b four five  six "
    words = text.replace("\x0b", " ").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").split("\n") if w]
    assert cut_words(text, [(0, len(words))], len(words)) == [text]
    for first in range(len(words)):
        for n in range(1, len(words) - first + (first > 0)):
            piece, = cut_words(text, [(first, n)], len(words))
            assert piece.startswith(words[first]) and piece.endswith(words[first + n - 1]) and piece in text
    assert cut_words(text, [(1, 1), (0, 2), (1, 1)], len(words)) == ["two", "one\n\ntwo", "two"]
