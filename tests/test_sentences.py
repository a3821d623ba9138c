"""Learned abbreviations and what they do to sentences."""

import random

from quarry.operators import sentences


def texts(rng):
    """Prose of made-up words; kg., u.s. and approx. always have their stop, ends of sentences are any words."""
    words = [f"{a}{b}" for a in ("ba", "ke", "lomi", "tura") for b in ("ra", "sti", "nona", "ül")]
    out = []
    for _ in range(120):
        said = []
        for _ in range(rng.randint(1, 6)):
            row = rng.choices(words, k=rng.randint(4, 12))
            if rng.random() < 0.6:
                row.insert(rng.randint(1, len(row) - 1), rng.choice(["kg.", "U.S.", "approx."]))
            said.append(" ".join(row).capitalize() + rng.choice([".", ".", "!", "?"]))
        out.append((said, rng.choice([" ", "\n", "  "]).join(said)))
    return out


def test_planted_abbreviations(spark):
    made = texts(random.Random(3))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "doc_id long, text string").repartition(3)
    learned = sentences.abbreviations(sentences.word_counts(df))
    assert {r.word for r in learned.collect()} == {"kg", "u.s", "approx"}
    got = {}
    for r in sentences.split(df, learned).orderBy("doc_id", "nth").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {i: said for i, (said, _) in enumerate(made)}
    none = sentences.split(df, learned.limit(0))
    assert none.count() > sum(len(s) for s, _ in made)


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "no end"), (5, "One. Two"), (6, "Ends with kg."), (7, "It is 3 kg. of it. Next?! Yes")], "doc_id long, text string")
    learned = spark.createDataFrame([("kg", 1.0)], "word string, score double")
    got = [(r.doc_id, r.nth, r.sentence) for r in sentences.split(df, learned).orderBy("doc_id", "nth").collect()]
    assert got == [(4, 1, "no end"), (5, 1, "One."), (5, 2, "Two"), (6, 1, "Ends with kg."), (7, 1, "It is 3 kg. of it."), (7, 2, "Next?!"), (7, 3, "Yes")]
    empty = df.limit(0)
    assert sentences.abbreviations(sentences.word_counts(empty)).collect() == [] and sentences.split(empty, learned).collect() == []


def test_frequent_word_is_dealt_out(spark):
    """Pieces that end in one word, or in none, don't meet in one task of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(400).selectExpr("id as doc_id", "if(id % 2 = 0, 'It is 3 kg. of it! Yes', 'No end') as text")
        said = sentences.split(df, spark.createDataFrame([("kg", 1.0)], "word string, score double"))
        plan = said._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(word" in plan and "salt" in plan.split("hashpartitioning(word")[1].split(")")[0]
        assert {(r.nth, r.sentence) for r in said.filter("doc_id % 2 = 0").collect()} == {(1, "It is 3 kg. of it!"), (2, "Yes")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
