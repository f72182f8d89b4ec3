"""corpus_pipeline.run on messy and on empty tables."""

import corpus_pipeline
from quern.llm import mixing
from quern.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _h string, shard string"


def write(spark, where, docs):
    docs.write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).write.parquet(f"{where}/{name}.parquet")


def test_messy_rows_pass_every_stage(spark, sf, tmp_path):
    real = table(spark, sf, "documents").selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as int) n_chars", "'x' _h", "'y' shard")
    odd = [(None, None, None, None, None, None, None), (10**6, "", "en", None, 0, "a", "b"), (10**6, "", "en", None, 0, "a", "b"), (1, "one id, another text of its own", None, "s9", 1, "a", "b"), (10**6 + 1, "word " * 60_000, "en", "s9", 1, None, None)]
    write(spark, str(tmp_path), real.unionByName(spark.createDataFrame(odd, SCHEMA)))
    kept = real.sparkSession.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = kept.columns
        kept = stage(spark, kept, str(tmp_path))
        counts.append(kept.count())
        if name != "sharding":
            assert kept.columns == before
    total = real.count() + len(odd)
    assert 0.7 * total < counts[0] <= total and counts[2] <= counts[1] <= counts[0] and counts[4] == counts[3] > 0
    shards = {}
    for r in kept.collect():
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert mixing.MAX_REPEAT == 3


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    write(spark, str(tmp_path), spark.createDataFrame([], SCHEMA))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
