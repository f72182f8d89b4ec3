"""The registered queries of this subpackage and the SQL that checks them. Each applies one operator, with its
production parameters, to the whole of its table and returns the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import crosspolytope, langid, licenses, mixing, neardup, periodic, prefixtrie, quality, sharding, simhash, tiling, toxicity, wrapper
from quern.llm.oracles import CIRCULANT_SQL, PERIODIC_SQL, TRIE_SQL
from quern.session import ship, table

QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return m.withColumn("target", F.round("target", 6))


@_query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op5_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return crosspolytope.neighbours(table(spark, sf_dir, "embeddings"))


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@_query
def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return wrapper.extract(table(spark, sf_dir, "pages"))


@_query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


@_query
def op12_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return dict(QUERIES)


MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents),
s AS (SELECT src, src = 'n' AS nul, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY nul, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
v AS (SELECT *, max(CASE WHEN lv * w <= cap THEN lv END) OVER () AS level FROM l),
p AS (SELECT src, source_size, least(cap, coalesce(level * w, cap))::DOUBLE AS target FROM v),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::INT ELSE 0 END AS f,
    CASE WHEN source_size > 0 AND least(floor(target / source_size), 3) >= 3 THEN 0
         WHEN source_size > 0 THEN floor(target - least(floor(target / source_size), 3) * source_size) ELSE floor(target) END::BIGINT AS rest FROM p),
h AS (SELECT d.*, CAST('0x' || substr(md5('29:' || doc_id || ':' || size || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS h FROM d),
c AS (SELECT h.*, b.rest, sum(size) OVER (PARTITION BY h.src ORDER BY h.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h JOIN budget b USING (src)),
x0 AS (SELECT c.src, c.doc_id, c.size, c.h, b.f + CASE WHEN b.f < 3 AND c.upto <= c.rest THEN 1 ELSE 0 END AS n, c.rest, CASE WHEN c.upto <= c.rest THEN c.size ELSE 0 END AS used FROM c JOIN budget b USING (src)),
-- each step: the documents that fit what is left get one more copy as far as it reaches, in order of hash; rows of all steps are kept
x AS (
  SELECT 0 AS step, src, doc_id, size, h, n, rest - sum(used) OVER (PARTITION BY src) AS room FROM x0
  UNION ALL
  SELECT step + 1, src, doc_id, size, h, n + taken, room - sum(taken * size) OVER (PARTITION BY src) FROM (
    SELECT *, CASE WHEN fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room THEN 1 ELSE 0 END AS taken
    FROM (SELECT *, n < 3 AND size > 0 AND size <= room AS fits, bool_or(n < 3 AND size > 0 AND size <= room) OVER () AS go_on FROM x) WHERE go_on)
)
SELECT x.doc_id, x.size, b.source_size, round(b.target, 6) AS target, (x.size * x.n)::BIGINT AS taken, x.n::INT AS copies, d.source
FROM x JOIN budget b USING (src) JOIN d ON d.doc_id = x.doc_id WHERE x.step = (SELECT max(step) FROM x)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING_SQL, "op11_periodic": PERIODIC_SQL, "op12_circulant": CIRCULANT_SQL, "op13_prefix_trie": TRIE_SQL}
