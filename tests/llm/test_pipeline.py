"""The pipeline's stages on a small table: their columns, and what each keeps."""

import zlib

import corpus_pipeline
from quarry.llm import queries, tokens


def test_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(d.count())
    assert counts[0] >= 0.95 * docs.count() and counts[0] >= counts[1] >= counts[2]
    mixed = spark.read.parquet(str(tmp_path / "3")).collect()
    assert sum(r.doc_tokens for r in d.filter("start = 0").collect()) == sum(r.length for r in d.collect())
    enc = tokens.encoder(queries.vocabulary("byte_bpe_50k.json"))
    ids = sorted(zlib.crc32(x + b"\0\0\0\0") for x in enc.encode([r.text for r in mixed]) if len(x) < 4 * 100)
    assert set(ids) >= {r.ids_crc32 for r in d.filter("start = 0 and length = doc_tokens and length < 101").collect()}
