"""The driver's tables read as a collection: documents as chunks, the benchmark as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import access


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: the source's number gives the department, the id's last digit a sensitivity."""
    dept = F.element_at(F.array(*map(F.lit, access.DEPARTMENTS)), F.substring("source", 4, 10).cast("int") % 5 + 1)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "text", F.col("source").alias("source_path"), F.col("lang").alias("section_path"), dept.alias("owner_dept"), F.lit("md").alias("doc_type"))
    plain = access.default_sensitivity(F.col("owner_dept"), F.col("doc_type"))
    rows = rows.withColumn("sensitivity", F.when(F.col("chunk") % 10 == 8, "confidential").when(F.col("chunk") % 10 == 9, "restricted").otherwise(plain))
    return rows.withColumn("allowed_roles", access.allowed_roles(F.col("owner_dept"), F.col("doc_type"), F.col("sensitivity")))


def asked(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    """benchmark as queries; roles go round unless one is given."""
    every = F.element_at(F.array(*map(F.lit, access.ROLES)), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.lit(role) if role else every).alias("role"))


DEPT_SQL = (
    "CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'engineering' WHEN 1 THEN 'finance' WHEN 2 THEN "
    "'marketing' WHEN 3 THEN 'hr' ELSE 'general' END"
)
ROLE_SQL = (
    "CASE CAST(item_id % 6 AS INTEGER) WHEN 0 THEN 'finance' WHEN 1 THEN 'marketing' WHEN 2 THEN 'hr' WHEN "
    "3 THEN 'engineering' WHEN 4 THEN 'c_level' ELSE 'employee' END"
)
ROLES_SQL = "(VALUES ('finance'), ('marketing'), ('hr'), ('engineering'), ('c_level'), ('employee')) AS r(role)"


def with_sql(role: str | None = None, q: str | None = None) -> str:
    """The CTEs corpus, q (queries; or the given ones, of columns query_id, query, role), roles and vis (role, chunk)."""
    q = q or f"""q AS (SELECT item_id AS query_id, text AS query, {f"'{role}'" if role else ROLE_SQL} AS role FROM benchmark)"""
    return f"""WITH c0 AS (SELECT doc_id AS chunk, text, source AS source_path, lang AS section_path, {DEPT_SQL} AS owner_dept, 'md' AS doc_type FROM documents),
corpus AS (SELECT *, CASE WHEN chunk % 10 = 8 THEN 'confidential' WHEN chunk % 10 = 9 THEN 'restricted' WHEN owner_dept =
    'general' THEN 'general' ELSE 'internal' END AS sensitivity FROM c0),
{q},
vis AS (SELECT role, chunk FROM {ROLES_SQL}, corpus WHERE owner_dept = 'general' OR (sensitivity IN ('general', 'internal')
    AND (role = owner_dept OR role = 'c_level')))"""


PERMIT_SQL = "(role = 'c_level' OR owner_dept = 'general' OR (doc_type = 'md' AND sensitivity IN ('general', 'internal') AND role = owner_dept))"


def bm25_sql(role: str | None = None, k: int = 5, q: str | None = None) -> str:
    """CTEs up to hits (query_id, role, chunk, score, rank)."""
    return with_sql(role, q) + f""",
words AS (SELECT chunk, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS w FROM corpus),
dl AS (SELECT chunk, len(w) AS dl FROM words),
tf AS (SELECT chunk, term, count(*) AS tf FROM (SELECT chunk, lower(unnest(w)) AS term FROM words) GROUP BY chunk, term),
qt AS (SELECT query_id, role, term, count(*) AS times FROM (SELECT query_id, role, lower(unnest(regexp_extract_all(coalesce(query,
    ''), '[A-Za-z0-9_]+'))) AS term FROM q) GROUP BY query_id, role, term),
stats AS (SELECT role, count(*) AS n, sum(dl) * 1.0 / greatest(1, count(*)) AS avgdl FROM vis JOIN dl USING (chunk) GROUP BY role),
df AS (SELECT role, term, count(*) AS df FROM tf JOIN vis USING (chunk) WHERE term IN (SELECT term FROM qt) GROUP BY role, term),
scored AS (SELECT query_id, role, chunk, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1
    - 0.75 + 0.75 * dl / greatest(1e-9, avgdl)))), 6) AS score FROM qt JOIN tf USING (term) JOIN vis USING (role, chunk)
    JOIN df USING (role, term) JOIN stats USING (role) JOIN dl USING (chunk) GROUP BY query_id, role, chunk),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def rerank_sql(candidates: str) -> str:
    """CTEs from a CTE of candidates (query_id, query, rank, chunk, text) to reranked (query_id, chunk, score, rank)."""
    return f""",
rw AS (SELECT query_id, chunk, rank AS before, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS w FROM {candidates}),
rstats AS (SELECT query_id, count(*) AS n, sum(len(w)) * 1.0 / greatest(1, count(*)) AS avgdl FROM rw GROUP BY query_id),
rq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, lower(unnest(regexp_extract_all(coalesce(query, ''),
    '[A-Za-z0-9_]+'))) AS term FROM (SELECT DISTINCT query_id, query FROM {candidates})) GROUP BY query_id, term),
rtf AS (SELECT query_id, chunk, dl, term, count(*) AS tf FROM (SELECT query_id, chunk, len(w) AS dl, lower(unnest(w)) AS
    term FROM rw) GROUP BY query_id, chunk, dl, term),
rtq AS (SELECT * FROM rtf JOIN rq USING (query_id, term)),
rdf AS (SELECT query_id, term, count(*) AS df FROM rtq GROUP BY query_id, term),
rs AS (SELECT query_id, chunk, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 +
    0.75 * dl / greatest(1e-9, avgdl)))), 6) AS score FROM rtq JOIN rdf USING (query_id, term) JOIN rstats USING (query_id)
    GROUP BY query_id, chunk),
reranked AS (SELECT rw.query_id, rw.chunk, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY rw.query_id ORDER
    BY coalesce(score, 0.0) DESC, before) AS rank FROM rw LEFT JOIN rs ON rw.query_id = rs.query_id AND rw.chunk = rs.chunk)"""
