"""op11: Merkle manifest of all documents, its proofs, and tampered documents found out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.llm.merkle import folded, merkle_proofs

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = merkle_proofs(docs, FIELDS, altered=tampered, lowered="text")
    seen = folded(F.coalesce("altered", "leaf"), F.col("places"), F.col("siblings"))

    def text(name):
        return F.lower(F.hex(name)).alias(name.split(".")[-1])

    return proofs.withColumn("f", seen).select(
        "doc_id", text("leaf"), text("subroot"), text("root"),
        F.lower(F.hex("f.proof")).alias("proof_sha256"), F.lower(F.hex("f.root")).alias("folded_root"),
        (F.col("f.root") == F.col("root")).alias("verified"))


LEVELS, TOP_LEVELS = 9, 4  # the SQL's: 8**9 documents a language, 8**4 languages


def _levels(prefix: str, levels: int) -> list[str]:
    """CTEs of the nodes of each level, of what stands beside them, and of the walk up."""
    out = []
    for i in range(levels):
        out.append(f"""{prefix}s{i} AS (
          SELECT k, idx, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g
          FROM {prefix}n{i} WHERE n > 1 WINDOW r AS (PARTITION BY k, idx // 8 ORDER BY idx))""")
        out.append(f"""{prefix}n{i + 1} AS (
          SELECT k, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY idx)) AS d
          FROM {prefix}n{i} WHERE n > 1 GROUP BY k, idx // 8
          UNION ALL SELECT k, idx, n, d FROM {prefix}n{i} WHERE n = 1)""")
        out.append(f"""{prefix}w{i + 1} AS (
          SELECT w.row, w.k, w.idx // 8 AS idx, w.proof || coalesce(s.l || s.g, '') AS proof,
                 CASE WHEN s.k IS NULL THEN w.f ELSE sha256(s.l || w.f || s.g) END AS f
          FROM {prefix}w{i} w LEFT JOIN {prefix}s{i} s ON s.k = w.k AND s.idx = w.idx)""")
    return out


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(i) + 1),
  lambda p: ascii(substr(i, p, 1))::BIGINT), lambda c, b: list_reduce(
  [xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"


ORACLES = {"op11_merkle": ",\n".join([
    f"""WITH rows AS (
      SELECT row_number() OVER () AS row, *, doc_id::VARCHAR AS i, coalesce('1' || lang, '0') AS k,
             translate(text, '{_AZ}', '{_AZ.lower()}') AS small FROM documents)""",
    f"""leaves AS (
      SELECT row, doc_id, k, {_leaf_sql('text')} AS leaf,
             CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql('small')} ELSE {_leaf_sql('text')} END AS f FROM rows)""",
    """placed AS (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY k) AS n FROM leaves)""",
    "an0 AS (SELECT k, idx, n, leaf AS d FROM placed)",
    "aw0 AS (SELECT row, k, idx, '' AS proof, f FROM placed)",
    *_levels("a", LEVELS),
    f"""tops AS (
      SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM an{LEVELS})""",
    "bn0 AS (SELECT 0 AS k, idx, n, d FROM tops)",
    f"""bw0 AS (SELECT w.row, 0 AS k, t.idx, w.proof, w.f FROM aw{LEVELS} w JOIN tops t USING (k))""",
    *_levels("b", TOP_LEVELS)]) + f"""
    SELECT p.doc_id, p.leaf, t.d AS subroot, r.d AS root, sha256(w.proof) AS proof_sha256,
           w.f AS folded_root, w.f = r.d AS verified
    FROM placed p JOIN tops t USING (k) JOIN bw{TOP_LEVELS} w USING (row) CROSS JOIN bn{TOP_LEVELS} r"""}
QUERIES = {"op11_merkle": op11_merkle}
