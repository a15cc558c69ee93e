"""All queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import access, aliases, tables
from corvane.functions import text as T
from corvane.operators import chunking, generation, permits, policy, providers, retrieval, sparse_index, store, tabular, vector_index
from corvane.plans.corpus import DEPT_SQL, PERMIT_SQL, ROLE_SQL, ROLES_SQL, asked, bm25_sql, chunks, rerank_sql, table, with_sql
from corvane.sources import files
from corvane.storage import kept, shared_folder, stored
from corvane.streaming import events as E
from corvane.streaming import stateful

K = 5
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of its result."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Texts and access


@query((
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, lower(array_to_string(w, ' ')) AS tokens FROM (SELECT "
    "doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS w FROM documents)"
))
def tokenize_bm25(spark, d):
    t = T.tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query((
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, lower(array_to_string(w, ' ')) AS tokens FROM (SELECT "
    "doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS w FROM documents)"
))
def tokenize_keyword(spark, d):
    t = T.tokens("text", False)
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, substr(sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')), 1, 32) AS id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id("source", "lang", "text").alias("id"))


@query((
    "SELECT page_id, CASE lower(regexp_extract(url || CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.CSV' "
    "WHEN 2 THEN '.pdf' ELSE '' END, '\\.([^./]+)$', 1)) WHEN 'md' THEN 'md' WHEN 'csv' THEN 'csv' ELSE 'unknown' "
    "END AS doc_type FROM pages"
))
def doc_types(spark, d):
    suffix = F.when(F.col("page_id") % 4 == 0, ".md").when(F.col("page_id") % 4 == 1, ".CSV").when(F.col("page_id") % 4 == 2, ".pdf").otherwise("")
    return table(spark, d, "pages").select("page_id", access.doc_type(F.concat("url", suffix)).alias("doc_type"))


_KINDS_SQL = f"(SELECT doc_id, {DEPT_SQL} AS owner_dept, CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'csv' ELSE 'aggregate' END AS doc_type FROM documents)"
_SENSITIVITY_SQL = "CASE WHEN owner_dept = 'general' THEN 'general' WHEN owner_dept = 'hr' AND doc_type = 'csv' THEN 'restricted' ELSE 'internal' END"


def _kinds(spark, d) -> DataFrame:
    rows = chunks(spark, d).withColumn("doc_type", F.when(F.col("chunk") % 3 == 0, "md").when(F.col("chunk") % 3 == 1, "csv").otherwise("aggregate"))
    return rows.select(F.col("chunk").alias("doc_id"), "owner_dept", "doc_type", access.default_sensitivity(F.col("owner_dept"), F.col("doc_type")).alias("sensitivity"))


@query(f"SELECT doc_id, owner_dept, doc_type, {_SENSITIVITY_SQL} AS sensitivity FROM {_KINDS_SQL}")
def sensitivity(spark, d):
    return _kinds(spark, d)


@query(f"""SELECT doc_id, CASE WHEN owner_dept = 'general' THEN 'finance,marketing,hr,engineering,c_level,employee' WHEN
    doc_type = 'md' AND sensitivity IN ('general', 'internal') THEN owner_dept || ',c_level' WHEN owner_dept = 'hr' AND doc_type
    IN ('csv', 'aggregate') THEN 'hr,c_level' ELSE '' END AS roles
FROM (SELECT *, {_SENSITIVITY_SQL} AS sensitivity FROM {_KINDS_SQL})""")
def allowed_roles(spark, d):
    return _kinds(spark, d).select("doc_id", F.array_join(access.allowed_roles(F.col("owner_dept"), F.col("doc_type"), F.col("sensitivity")), ",").alias("roles"))


@query(with_sql() + """ SELECT c.chunk, count(CASE WHEN role = 'finance' THEN 1 END) > 0 AS role_finance, count(CASE WHEN
    role = 'marketing' THEN 1 END) > 0 AS role_marketing, count(CASE WHEN role = 'hr' THEN 1 END) > 0 AS role_hr, count(CASE
    WHEN role = 'engineering' THEN 1 END) > 0 AS role_engineering, count(CASE WHEN role = 'c_level' THEN 1 END) > 0 AS role_c_level,
    count(CASE WHEN role = 'employee' THEN 1 END) > 0 AS role_employee, coalesce(string_agg(role, ',' ORDER BY role), '')
    AS allowed_roles_str FROM corpus c LEFT JOIN vis v ON c.chunk = v.chunk GROUP BY c.chunk""")
def role_flags(spark, d):
    return chunks(spark, d).select("chunk", *access.role_flags(F.col("allowed_roles")))


@query("SELECT doc_id, coalesce(source, 'None') || '#' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE lang END AS key FROM documents")
def fusion_keys(spark, d):
    """Keys whose missing parts read None."""
    section = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.fusion_key("source", section, "None").alias("key"))


@query(with_sql() + " SELECT 'hr' AS role, chunk FROM vis WHERE role = 'hr' UNION ALL SELECT 'none', chunk FROM corpus")
def metadata_filter(spark, d):
    """Chunks under the filter of a role, and without a role."""
    c = chunks(spark, d)
    one = retrieval.visible_to(c, "hr").select(F.lit("hr").alias("role"), "chunk")
    return one.unionByName(retrieval.visible_to(c, None).select(F.lit("none").alias("role"), "chunk"))


@query(with_sql() + (
    f", t AS (SELECT role, c.* FROM {ROLES_SQL}, corpus c) SELECT role, chunk, CASE WHEN role = 'c_level' "
    "THEN 'c_level_full_access' WHEN owner_dept = 'general' THEN 'general_docs_any_role' ELSE 'same_department_internal_docs' "
    f"END AS rule FROM t WHERE {PERMIT_SQL}"
))
def authorized(spark, d):
    """Requests that the policy permits pass the gate, each with its rule; a denied one would fail the job."""
    rows = chunks(spark, d).withColumn("role", F.explode(F.array(*map(F.lit, access.ROLES))))
    rows = policy.permitted(rows, F.col("role")).drop("decision")
    return policy.authorized(rows, F.col("role"), F.lit("retrieve_chunk")).select("role", "chunk", "rule")


@query(with_sql() + " SELECT role, chunk FROM vis")
def role_filter(spark, d):
    """The pre-filter for every role."""
    roles = spark.createDataFrame([(r,) for r in access.ROLES], "role string")
    return chunks(spark, d).select("chunk", F.explode("allowed_roles").alias("role")).join(F.broadcast(roles), "role").select("role", "chunk")


@query(with_sql() + (
    f", t AS (SELECT role, c.* FROM {ROLES_SQL}, corpus c) SELECT role, chunk, CASE WHEN {PERMIT_SQL} THEN "
    "'permit' ELSE 'deny' END AS effect, CASE WHEN role = 'c_level' THEN 'c_level_full_access' WHEN owner_dept "
    "= 'general' THEN 'general_docs_any_role' WHEN sensitivity IN ('general', 'internal') AND role = owner_dept "
    "THEN 'same_department_internal_docs' WHEN role = 'employee' THEN 'employee_non_general_deny' WHEN role "
    "<> owner_dept THEN 'cross_department_deny' ELSE 'high_sensitivity_md_deny_by_default' END AS rule FROM "
    "t"
))
def policy_decisions(spark, d):
    rows = chunks(spark, d).withColumn("role", F.explode(F.array(*map(F.lit, access.ROLES))))
    return rows.withColumn("x", policy.decision(F.col("role"), F.lit("retrieve_chunk"))).select("role", "chunk", "x.effect", "x.rule")


_GRID = {
    "role": [*access.ROLES, None],
    "owner_dept": [*access.DEPARTMENTS, None],
    "doc_type": ["md", "csv", "aggregate", None],
    "sensitivity": ["general", "internal", "confidential", "restricted", None],
    "action": ["retrieve_chunk", "view_source", "view_row", "view_masked_row", "aggregate_query"],
    "rows_mode": ["enabled", "disabled", None],
    "aggregate_mode": ["enabled", "disabled", None],
}


def _of_grid(name: str, number: str) -> str:
    """SQL of the value of a list that a number picks, in turn."""
    values = _GRID[name]
    return f"CASE CAST(({number}) % {len(values)} AS INTEGER) {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values) if x is not None)} END"


_DEALT = {"doc_type": "chunk", "sensitivity": "chunk // 4", "action": "chunk // 20"}
_GRID_SQL = with_sql() + ", " + ", ".join(f"v_{k} AS (SELECT * FROM (VALUES {', '.join('(NULL)' if x is None else f"('{x}')" for x in _GRID[k])}) AS t({k}))" for k in ("role", "rows_mode", "aggregate_mode"))


def policy_of_grid():
    """The decision on rows with the columns of the grid."""
    return policy.decision(F.col("role"), F.col("action"), {"hr_masked_rows_mode": F.col("rows_mode"), "hr_aggregate_mode": F.col("aggregate_mode")})


def policy_rows(spark) -> DataFrame:
    """Every combination of inputs, nulls included."""
    one = spark.range(1)
    for k, v in _GRID.items():
        one = one.withColumn(k, F.explode(F.array(*(F.lit(x).cast("string") for x in v))))
    return one.drop("id")


@query(_GRID_SQL + f""", g AS (SELECT chunk, CASE WHEN chunk % 11 > 0 THEN owner_dept END AS owner_dept, {", ".join(f"{_of_grid(k, n)} AS {k}" for k, n in _DEALT.items())}, role, rows_mode, aggregate_mode
    FROM corpus, v_role, v_rows_mode, v_aggregate_mode),
""" + """f AS (SELECT *, coalesce(role = 'c_level', FALSE) AS top, coalesce(role IN ('hr', 'c_level'), FALSE) AS hrc, coalesce(owner_dept
    = 'general', FALSE) AS gen, coalesce(owner_dept = 'hr', FALSE) AS hr, coalesce(doc_type, '') AS dt, role IS NOT DISTINCT
    FROM owner_dept AS own, action IN ('retrieve_chunk', 'view_source') AS rd, coalesce(sensitivity, '') AS s FROM g),
r AS (SELECT *, CASE WHEN top THEN 'c_level_full_access' WHEN gen AND rd THEN 'general_docs_any_role' WHEN dt = 'md' AND
    s IN ('general', 'internal') AND own AND rd THEN 'same_department_internal_docs' WHEN coalesce(role, '') = 'employee'
    AND NOT gen THEN 'employee_non_general_deny' WHEN dt = 'md' AND NOT own AND NOT gen THEN 'cross_department_deny' WHEN
    hr AND dt = 'csv' AND action = 'view_row' AND hrc THEN 'hr_rows_hr_and_c_level_only' WHEN hr AND dt = 'csv' AND action
    = 'view_row' THEN 'non_hr_hr_rows_deny' WHEN coalesce(rows_mode, '') = 'enabled' AND hr AND dt = 'csv' AND action = 'view_masked_row'
    AND NOT hrc THEN 'hr_masked_rows_non_hr_if_enabled' WHEN hr AND dt = 'csv' AND action = 'view_masked_row' AND hrc THEN
    'hr_masked_rows_hr_and_c_level' WHEN coalesce(aggregate_mode, '') = 'enabled' AND hr AND dt = 'aggregate' AND action
    IN ('retrieve_chunk', 'view_source', 'aggregate_query') AND NOT hrc THEN 'hr_aggregates_non_hr_if_enabled' WHEN hr AND
    dt = 'aggregate' AND action IN ('retrieve_chunk', 'view_source', 'aggregate_query') AND hrc THEN 'hr_aggregates_hr_and_c_level'
    WHEN dt = 'md' AND s IN ('confidential', 'restricted') THEN 'high_sensitivity_md_deny_by_default' END AS rule FROM f)
SELECT chunk, role, owner_dept, doc_type, sensitivity, action, rows_mode, aggregate_mode, rule, CASE WHEN rule IS NULL OR rule LIKE
    '%deny%' THEN 'deny' ELSE 'permit' END AS effect FROM r""")
def policy_grid(spark, d):
    """Requests of all roles, with both flags in every state, for the documents, whose types, sensitivities and actions go round, nulls among them."""
    dealt = {"doc_type": F.col("chunk"), "sensitivity": F.expr("chunk div 4"), "action": F.expr("chunk div 20")}
    pick = lambda k, n: F.element_at(F.array(*(F.lit(x).cast("string") for x in _GRID[k])), (n % len(_GRID[k]) + 1).cast("int"))
    rows = chunks(spark, d).select("chunk", F.when(F.col("chunk") % 11 > 0, F.col("owner_dept")).alias("owner_dept"), *(pick(k, n).alias(k) for k, n in dealt.items()))
    for k in ("role", "rows_mode", "aggregate_mode"):
        rows = rows.withColumn(k, F.explode(F.array(*(F.lit(x).cast("string") for x in _GRID[k]))))
    return rows.withColumn("x", policy_of_grid()).select("chunk", *_GRID, "x.rule", "x.effect")


@query(with_sql() + (
    f", t AS (SELECT role, c.* FROM {ROLES_SQL}, corpus c) SELECT role, owner_dept, sensitivity, count(*) "
    f"AS n, count(v.chunk) AS admitted, count(CASE WHEN {PERMIT_SQL} THEN 1 END) AS permitted FROM (SELECT "
    "t.*, vis.chunk AS v FROM t LEFT JOIN vis ON t.role = vis.role AND t.chunk = vis.chunk) AS x(role, chunk, "
    "text, source_path, section_path, owner_dept, doc_type, sensitivity, v) LEFT JOIN (SELECT chunk AS k "
    "FROM corpus) ON FALSE LEFT JOIN (SELECT 1 AS chunk) v ON x.v IS NOT NULL GROUP BY role, owner_dept, "
    "sensitivity"
))
def prefilter_vs_policy(spark, d):
    rows = chunks(spark, d).withColumn("role", F.explode(F.array(*map(F.lit, access.ROLES))))
    permit = policy.decision(F.col("role"), F.lit("retrieve_chunk"))["effect"] == "permit"
    return rows.groupBy("role", "owner_dept", "sensitivity").agg(F.count("*").alias("n"), F.count_if(F.array_contains("allowed_roles", F.col("role"))).alias("admitted"), F.count_if(permit).alias("permitted"))


def _of_departments(spark, d) -> DataFrame:
    """documents as a table with a folder for each department."""

    def make(folder: str) -> str:
        chunks(spark, d).select("chunk", "doc_type", "sensitivity", "owner_dept").write.partitionBy("owner_dept").parquet(f"{folder}/chunks")
        return f"{folder}/chunks"

    return spark.read.parquet(kept(spark, f"departments {d}", make))


@query(with_sql() + f", t AS (SELECT role, c.* FROM {ROLES_SQL}, corpus c) SELECT role, chunk FROM t WHERE {PERMIT_SQL}")
def permit_boxes(spark, d):
    """What each role may read, by filters that leave out the folders of other departments."""
    rows = _of_departments(spark, d)
    each = [permits.permitted(rows, r).select(F.lit(r).alias("role"), "chunk") for r in access.ROLES]
    return reduce(DataFrame.unionByName, each)


_MANY = 3000
_MANY_RULES = [
    {"name": f"own_{i}", "effect": "permit" if i % 2 else "deny", "when": {"all": [{"eq": ["resource.source_path", f"src{i // 2}"]}, {"eq": ["subject.role", access.ROLES[i % 6]]}, {"not_in": ["resource.sensitivity", ["confidential"]]}]}}
    for i in range(_MANY)
]


@query(with_sql() + (
    f", t AS (SELECT role, c.*, 2 * CAST(substr(source_path, 4) AS INTEGER) AS i, CASE role {' '.join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(access.ROLES))} END AS r FROM {ROLES_SQL}, corpus c), "
    f"o AS (SELECT *, CASE WHEN sensitivity = 'confidential' THEN NULL WHEN i % 6 = r AND i < {_MANY} THEN i WHEN (i + 1) % 6 = r AND i + 1 < {_MANY} THEN i + 1 END AS own FROM t) "
    "SELECT role, chunk, CASE WHEN own IS NOT NULL THEN 'own_' || own WHEN role = 'c_level' THEN 'c_level_full_access' WHEN owner_dept = 'general' THEN 'general_docs_any_role' WHEN sensitivity "
    "IN ('general', 'internal') AND role = owner_dept THEN 'same_department_internal_docs' WHEN role = 'employee' THEN 'employee_non_general_deny' WHEN role <> owner_dept THEN 'cross_department_deny' "
    "ELSE 'high_sensitivity_md_deny_by_default' END AS rule, CASE WHEN own IS NOT NULL THEN CASE WHEN own % 2 = 1 THEN 'permit' ELSE 'deny' END "
    f"WHEN {PERMIT_SQL} THEN 'permit' ELSE 'deny' END AS effect FROM o"
))
def policy_table(spark, d):
    """Thousands of rules, for single sources, in front of the policy: held as a table."""
    rows = chunks(spark, d).withColumn("role", F.explode(F.array(*map(F.lit, access.ROLES))))
    columns = {"subject.role": F.col("role"), "action": F.lit("retrieve_chunk")} | {f"resource.{c}": F.col(c) for c in ("owner_dept", "doc_type", "sensitivity", "source_path")}
    every = {"default": "deny", "rules": [*_MANY_RULES, *policy.POLICY["rules"]]}
    return permits.decided(rows.select("chunk", "role", "owner_dept", "doc_type", "sensitivity", "source_path"), every, columns).select("role", "chunk", "rule", "effect")


# Retrieval



def _index(spark, d) -> DataFrame:
    """The rows of the sparse index of documents: built by the first query that asks, read by all others."""
    return kept(spark, f"sparse {d}", lambda folder: sparse_index.created(folder, chunks(spark, d))).rows()


def _found(spark, d, queries: DataFrame | None = None) -> DataFrame:
    """BM25 hits of each query, searched once: few rows, which go to the documents, whose texts are not shuffled."""
    hits = retrieval.bm25_search(chunks(spark, d), asked(spark, d) if queries is None else queries, K, _index(spark, d))
    return sparse_index.bounded(stored(hits.select("query_id", "chunk", "score", "rank"), shared_folder(spark), "hits"))


_HITS = " SELECT query_id, chunk, score, rank FROM hits"


@query(bm25_sql("c_level") + _HITS)
def bm25_topk(spark, d):
    return retrieval.bm25_search(chunks(spark, d), asked(spark, d, "c_level"), K, _index(spark, d)).select("query_id", "chunk", "score", "rank")


@query(bm25_sql() + _HITS)
def batch_bm25(spark, d):
    return retrieval.bm25_search(chunks(spark, d), asked(spark, d), K, _index(spark, d)).select("query_id", "chunk", "score", "rank")


@query(bm25_sql() + _HITS)
def bm25_blocks(spark, d):
    """The same search by bounds of blocks, which leaves out chunks that cannot be among the best."""
    rows = _index(spark, d)
    found = sparse_index.best(rows, sparse_index.worths(rows, asked(spark, d)), K)
    return retrieval.top(found.where("score > 0"), K).select("query_id", "chunk", "score", "rank")


def _seventh(c: DataFrame) -> DataFrame:
    return c.where("chunk % 7 = 0")


@query(bm25_sql() + _HITS)
def bm25_segments(spark, d):
    """The same search over an index that followed its collection: chunks came, changed and went, and it was compacted once."""

    def make(folder: str):
        c = chunks(spark, d)
        old = F.concat(F.lit("before "), F.coalesce("text", F.lit("")))
        first = c.where("chunk % 3 > 0").withColumn("text", F.when(F.col("chunk") % 7 == 0, old).otherwise(F.col("text")))
        gone = _seventh(c).withColumn("chunk", -F.col("chunk") - 1)
        index = sparse_index.created(folder, first.unionByName(gone))
        index = sparse_index.followed(index, c.where("chunk % 5 > 0").unionByName(gone))
        return sparse_index.followed(sparse_index.compacted(index), c)

    rows = kept(spark, f"segments {d}", make).rows()
    return retrieval.bm25_search(chunks(spark, d), asked(spark, d), K, rows).select("query_id", "chunk", "score", "rank")


@query((
    "SELECT doc_id AS chunk, term, count(*) AS tf FROM (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, "
    "''), '[A-Za-z0-9_]+'))) AS term FROM documents) GROUP BY doc_id, term"
))
def postings(spark, d):
    """Counted where texts are read, no shuffle."""
    return sparse_index.postings(sparse_index.block_rows(chunks(spark, d))).select("chunk", "term", F.col("tf").cast("long").alias("tf"))


@query(with_sql() + f""", w AS (SELECT chunk, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))) AS term FROM corpus),
t AS (SELECT DISTINCT query_id, role, term FROM (SELECT query_id, role, lower(unnest(regexp_extract_all(coalesce(query, ''), '[A-Za-z0-9]+'))) AS term FROM q)),
s AS (SELECT query_id, chunk, count(*) AS score FROM t JOIN w USING (term) JOIN vis USING (role, chunk) JOIN (SELECT chunk,
    owner_dept, doc_type, sensitivity FROM corpus) USING (chunk) WHERE {PERMIT_SQL} GROUP BY query_id, chunk)
SELECT query_id, chunk, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM s) WHERE rank <= {K}""")
def overlap_search(spark, d):
    return retrieval.keyword_search(chunks(spark, d), asked(spark, d), K).select("query_id", "chunk", "score", "rank")


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


_NEAREST = (
    f"SELECT query_id, id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score, "
    f"row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, "
    f"embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= {K}"
)


@query(_NEAREST)
def cosine_topk(spark, d):
    """The stated query set (ids divisible by 20) against all rows."""
    v = _vectors(spark, d)
    return retrieval.dense_search(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), K)


def _collection(spark, d) -> vector_index.VectorIndex:
    """The vector collection of embeddings: built by the first query that asks, opened by all others."""
    return kept(spark, f"vectors {d}", lambda folder: vector_index.created(folder, _vectors(spark, d), "given"))


@query()
def cells_topk(spark, d):
    """The stated query set over the nearest cells of the stored collection; tests measure the recall."""
    asked_for = _vectors(spark, d).where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return vector_index.search(_collection(spark, d), asked_for, K, model="given").select("query_id", "id", "score", "rank")


@query(_NEAREST)
def cells_exact_topk(spark, d):
    """The same, and then the cells whose bound the nearest ones do not rule out."""
    asked_for = _vectors(spark, d).where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return vector_index.search(_collection(spark, d), asked_for, K, exact=True).select("query_id", "id", "score", "rank")


@query()
def lsh_topk(spark, d):
    """The same search over shared hash buckets; tests measure its recall."""
    v = _vectors(spark, d)
    return retrieval.lsh_search(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), K).select("query_id", "id", "score", "rank")


def _dense(spark, d) -> DataFrame:
    """(query_id, chunk, score, rank): a query's vector is that of its number; each role searches the chunks it may see."""
    v = _vectors(spark, d)
    seen = v.join(retrieval.visible(chunks(spark, d), asked(spark, d)).select(F.col("chunk").alias("id"), "mask"), "id")
    q = asked(spark, d).select("query_id", access.role_bit(F.col("role")).alias("bit")).join(v.withColumnRenamed("id", "query_id"), "query_id")
    return retrieval.dense_search(seen, q, K).withColumnRenamed("id", "chunk")


_DENSE = f""",
dv AS (SELECT q.query_id, b.vec_id AS chunk, {_COS} AS score FROM q JOIN embeddings a ON a.vec_id = q.query_id JOIN vis ON
    vis.role = q.role JOIN embeddings b ON b.vec_id = vis.chunk),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM dv) WHERE rank <= {K})"""


@query(with_sql() + _DENSE + " SELECT query_id, chunk, score, rank FROM dense")
def dense_role_search(spark, d):
    return _dense(spark, d).select("query_id", "chunk", "score", "rank")


_FUSED = f""",
lists AS (SELECT query_id, 0 AS list, rank, chunk FROM dense UNION ALL SELECT query_id, 1, rank, chunk FROM hits),
parts AS (SELECT query_id, coalesce(source_path, '') || '#' || coalesce(section_path, '') AS key, list, rank, chunk FROM lists JOIN corpus USING (chunk)),
sums AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first, arg_max(chunk,
    list * 1000000 + rank) AS chunk FROM parts GROUP BY query_id, key),
fused AS (SELECT * FROM (SELECT query_id, key, score, chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM sums) WHERE rank <= {K})"""


@query(bm25_sql() + _DENSE + _FUSED + " SELECT query_id, key, score, chunk, rank FROM fused")
def rrf_fuse(spark, d):
    c = chunks(spark, d)
    lists = _dense(spark, d).select("query_id", F.lit(0).alias("list"), "rank", "chunk").unionByName(_found(spark, d).select("query_id", F.lit(1).alias("list"), "rank", "chunk"))
    lists = stored(lists, shared_folder(spark), "lists")
    return retrieval.fuse(sparse_index.bounded(lists).join(c.select("chunk", "source_path", "section_path"), "chunk"), K)


_CANDIDATES = ", cand AS (SELECT hits.query_id, q.query, hits.rank, hits.chunk, corpus.text FROM hits JOIN q USING (query_id) JOIN corpus USING (chunk))"


def _candidates(spark, d, *more: str) -> DataFrame:
    """(query_id, rank, chunk, query, text) of the hits, with more columns of their chunks."""
    hits = _found(spark, d).select("query_id", "rank", "chunk").join(asked(spark, d).select("query_id", "query"), "query_id")
    return sparse_index.bounded(hits).join(chunks(spark, d).select("chunk", "text", *more), "chunk")


@query(bm25_sql() + _CANDIDATES + rerank_sql("cand") + " SELECT query_id, chunk, score, rank FROM reranked")
def rerank_simple(spark, d):
    return retrieval.rerank(_candidates(spark, d), "simple")


@query(bm25_sql() + f""", e AS (SELECT hits.query_id, hits.chunk, hits.rank AS before, {_COS} AS score FROM hits JOIN embeddings
    a ON a.vec_id = hits.query_id JOIN embeddings b ON b.vec_id = hits.chunk) SELECT query_id, chunk, score, row_number()
    OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM e""")
def rerank_embedding(spark, d):
    v = _vectors(spark, d)
    rows = stored(_found(spark, d).select("query_id", "rank", "chunk").join(v.withColumnRenamed("id", "chunk"), "chunk"), shared_folder(spark), "vectors")
    rows = sparse_index.bounded(rows).join(v.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id")
    return retrieval.rerank_embedding(rows)


@query(bm25_sql() + _DENSE + _FUSED + (
    ", cand AS (SELECT fused.query_id, q.query, fused.rank, fused.chunk, corpus.text FROM fused JOIN q USING "
    "(query_id) JOIN corpus USING (chunk))"
) + rerank_sql("cand") + (
    " SELECT query_id, chunk, source_path, section_path, score, rank FROM reranked JOIN q USING (query_id) "
    f"JOIN corpus USING (chunk) WHERE {PERMIT_SQL}"
))
def hybrid_search(spark, d):
    out = retrieval.hybrid_search(chunks(spark, d), asked(spark, d), _dense(spark, d), K, index=_index(spark, d))
    return out.select("query_id", "chunk", "source_path", "section_path", "score", "rank")


@query(bm25_sql() + (
    " SELECT round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS precision_at_k, "
    "count(*) AS judged FROM hits JOIN labels ON labels.doc_id = hits.chunk"
))
def precision_at_k(spark, d):
    hits = _found(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "chunk"), "chunk")
    return hits.agg(F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("precision_at_k"), F.count("*").alias("judged"))


# Tables


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def hr_page(spark, d):
    return tabular.page(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 20, 40)


@query("SELECT '[REDACTED]' AS employee_id, '[REDACTED]' AS name, c_mktsegment AS department, c_acctbal AS salary FROM customer")
def hr_masked(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"), F.col("c_acctbal").alias("salary"))
    return tabular.masked(rows)


def _staff(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("department"), F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 13 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("salary"), F.col("c_nationkey").cast("string").alias("performance_rating"))


_STAFF = (
    "(SELECT CASE WHEN c_custkey % 11 = 0 THEN 'Unknown' ELSE c_mktsegment END AS department, CASE WHEN c_custkey "
    "% 7 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) "
    "AS DOUBLE) END AS salary, CAST(c_nationkey AS DOUBLE) AS rating FROM customer)"
)


@query(f"SELECT department, count(*) AS n, round(avg(salary), 6) AS avg_salary, round(avg(rating), 6) AS avg_rating FROM {_STAFF} GROUP BY department")
def hr_aggregates(spark, d):
    return tabular.safe_aggregates(_staff(spark, d))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT department) AS BIGINT) AS departments FROM {_STAFF}")
def hr_total(spark, d):
    return tabular.nested_aggregates(_staff(spark, d)).select("total", F.size("by_department").cast("long").alias("departments"))


@query((
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p "
    "FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS "
    "mean, round(median(value), 6) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT "
    "event_type, n, mean, median, round(value, 6) AS p95 FROM s JOIN r USING (event_type) WHERE p = CASE "
    "WHEN n < 20 THEN n ELSE CAST(floor(n * 0.95) AS BIGINT) + 1 END"
))
def latency_summary(spark, d):
    return tabular.latency_summary(table(spark, d, "events"), "value", "event_type")


# Chunks


@query((
    "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 2048 + 1 AS BIGINT), 2048) AS "
    "text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 2047) // 2048)) AS i FROM documents "
    "WHERE length(text) > 0)"
))
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents"))


@query((
    "WITH f AS (SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 2048 + 1 AS BIGINT), "
    "2048) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 2047) // 2048)) AS i FROM documents "
    "WHERE length(text) > 0)), g AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) "
    "AS before FROM f) SELECT doc_id, chunk_index, CASE WHEN length(before) > 200 THEN right(before, 200) "
    "|| ' ' || text ELSE text END AS text FROM g"
))
def overlap_prefix(spark, d):
    from pyspark.sql import Window

    rows = chunking.fixed_chunks(table(spark, d, "documents"))
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return rows.withColumn("before", before).select("doc_id", "chunk_index", F.when(F.length("before") > 200, F.concat(F.substring(F.col("before"), F.length("before") - 199, F.lit(200)), F.lit(" "), F.col("text"))).otherwise(F.col("text")).alias("text"))


@query((
    "SELECT CAST(doc_id AS VARCHAR) AS source_path, '' AS section_path, text FROM (SELECT doc_id, trim(text, "
    "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents) WHERE text <> ''"
))
def markdown_sections(spark, d):
    """Documents here have no headings, so each is one section."""
    return chunking.sections(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), "text")).select("source_path", "section_path", "text")


@query()
def chunks_lateral(spark, d):
    """The same chunks from SQL, by the table function."""
    tables.register(spark)
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), "text")
    return spark.sql("SELECT source_path, c.section_path, c.ordinal, c.chunk_index, c.text FROM {docs} AS d, LATERAL chunk_markdown(d.text, 512, 50) AS c", docs=rows)


@query()
def split_recursive(spark, d):
    return chunking.chunk_markdown(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), "text"))


# Questions, prompts, replies

_PATTERN = "|".join(T.COMPLEX_PATTERNS)


@query((
    f"SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), '{_PATTERN}') OR length(text) - length(replace(text, "
    "'?', '')) > 1 OR (contains(lower(text), ' and ') AND len(regexp_extract_all(text, '[^\\s]+')) > 10) "
    "AS is_complex FROM conversations"
))
def query_complexity(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_complex("text").alias("is_complex"))


@query((
    "WITH m AS (SELECT conv_id, string_agg(CASE WHEN role IN ('user', 'assistant') THEN text END, chr(10) "
    "|| chr(10) ORDER BY turn) AS said, arg_max(text, turn) FILTER (WHERE role = 'system') AS system FROM "
    "conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN said IS NULL THEN coalesce(system, '') WHEN "
    "coalesce(system, '') = '' THEN said ELSE system || chr(10) || chr(10) || said END AS prompt FROM m"
))
def flat_messages(spark, d):
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", T.flat_messages("m").alias("prompt"))


@query((
    "SELECT conv_id, turn, CAST(p AS BIGINT) AS position, CAST(o - 1 AS BIGINT) AS ordinal FROM (SELECT conv_id, "
    "turn, unnest(v) AS p, generate_subscripts(v, 1) AS o FROM (SELECT conv_id, turn, list_filter(CASE WHEN "
    "turn % 3 = 2 THEN [0, 1, 2] ELSE [2, CAST(turn AS INTEGER), 7, 0] END, lambda x: x < 3) AS v FROM conversations))"
))
def parse_llm_order(spark, d):
    """Replies made up from each turn: a list with an item out of range, or no list."""
    reply = F.when(F.col("turn") % 3 == 2, "no order").otherwise(F.concat(F.lit("[2, "), F.col("turn").cast("string"), F.lit(", 7, 0]")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.llm_order(reply, F.lit(3))))
    return rows.select("conv_id", "turn", F.col("col").cast("long").alias("position"), F.col("pos").cast("long").alias("ordinal"))


@query((
    "SELECT item_id, CAST(o - 1 AS BIGINT) AS ordinal, s AS subquery FROM (SELECT item_id, unnest(v) AS s, "
    "generate_subscripts(v, 1) AS o FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN ['a' || item_id, 'b'] "
    "WHEN 1 THEN ['a', 'b', 'c'] ELSE [text] END AS v FROM benchmark))"
))
def parse_subqueries(spark, d):
    """Replies made up for each query: fenced, too long, or no list."""
    i = F.col("item_id").cast("string")
    reply = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('```json\n["a'), i, F.lit('", "b"]\n```'))).when(F.col("item_id") % 3 == 1, '["a", "b", "c", "d", "e"]').otherwise("sorry")
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(T.subqueries(reply, F.col("text"))))
    return rows.select("item_id", F.col("pos").cast("long").alias("ordinal"), F.col("col").alias("subquery"))


_ALIASES = {"the": "[article]", "there": "[place]", "and": "[and]", "of": "[of]", "ing": "[ing]"}
_STEPS = "text"
for _name in sorted(_ALIASES, key=len, reverse=True):
    _STEPS = f"replace({_STEPS}, '{_name}', chr({0xE000 + list(_ALIASES).index(_name)}))"
for _i, _to in enumerate(_ALIASES.values()):
    _STEPS = f"replace({_STEPS}, chr({0xE000 + _i}), '{_to}')"


@query(f"SELECT item_id, {_STEPS} AS query, text AS query_original FROM benchmark")
def query_aliases(spark, d):
    """Names in queries brought to one form in one pass; the longer of two that begin alike wins, and no two of these overlap otherwise."""
    return aliases.normalized(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), _ALIASES)


def _contexts(spark, d, *more: str) -> DataFrame:
    rows = _candidates(spark, d, "source_path", "section_path", *more)
    return retrieval.first_of_each(rows, ["rank"]).withColumnRenamed("rank", "place")


_CONTEXTS = _CANDIDATES + (
    ", ctx AS (SELECT * FROM (SELECT cand.query_id, cand.query, cand.rank AS place, cand.chunk, cand.text, "
    "source_path, section_path, row_number() OVER (PARTITION BY cand.query_id, source_path, section_path "
    "ORDER BY cand.rank) AS n FROM cand JOIN corpus USING (chunk)) WHERE n = 1)"
)


@query(bm25_sql() + _CONTEXTS + " SELECT query_id, place, source_path || '#' || section_path AS key, chunk FROM ctx")
def dedup_contexts(spark, d):
    return _contexts(spark, d).select("query_id", "place", "key", "chunk")


@query(bm25_sql() + _CONTEXTS + (
    ", p AS (SELECT query_id, query, string_agg('[' || n2 || '] ' || replace(trim(text, ' '), chr(10), ' "
    "') || chr(10) || '(Source: ' || source_path || '#' || section_path || ')', chr(10) ORDER BY place) AS "
    "s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n2 FROM ctx) GROUP BY "
    "query_id, query) SELECT query_id, 'Query:' || chr(10) || query || chr(10) || chr(10) || 'Context snippets:' "
    "|| chr(10) || s AS prompt FROM p"
))
def prompt_build(spark, d):
    return generation.contexts(_contexts(spark, d)).select("query_id", generation.chat_prompt(F.col("query"), F.col("snippets")).alias("prompt"))


@query(bm25_sql() + _CONTEXTS + (
    ", p AS (SELECT query_id, query, string_agg((n2 - 1) || ': ' || replace(text, chr(10), ' '), chr(10) "
    "ORDER BY place) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n2 "
    f"FROM ctx) GROUP BY query_id, query) SELECT query_id, '{generation.RERANK}' || chr(10) || 'Query: ' || "
    "query || chr(10) || 'Snippets:' || chr(10) || s AS prompt FROM p"
))
def rerank_prompt(spark, d):
    return generation.contexts(_contexts(spark, d)).select("query_id", generation.rerank_prompt(F.col("query"), F.col("snippets")).alias("prompt"))


@query(bm25_sql() + _CONTEXTS + (
    ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n2 FROM ctx) SELECT q.query_id, "
    "CASE WHEN f.query_id IS NULL THEN 'I don''t know based on the available context.' ELSE 'Based on [1], "
    "' || substr(text, 1, 200) || '...' || chr(10) || chr(10) || 'Citations: [1] ' || trim(source_path || "
    "'#' || section_path, '#') END AS answer FROM q LEFT JOIN f ON f.query_id = q.query_id AND n2 = 1"
))
def extractive_answer(spark, d):
    found = generation.contexts(_contexts(spark, d)).select("query_id", "snippets")
    rows = asked(spark, d).select("query_id").join(found, "query_id", "left")
    empty = F.array().cast(found.schema["snippets"].dataType)
    return rows.select("query_id", generation.extractive_answer(F.coalesce("snippets", empty)).alias("answer"))


_ANSWERS = bm25_sql() + _CONTEXTS + """, found AS (SELECT query_id, query, to_json(list({'text': text, 'source': source_path} ORDER BY place))::VARCHAR AS s, string_agg('[' || n2 || '] ' || replace(trim(text, ' '), chr(10), ' ') || chr(10) || '(Source: ' || source_path || '#' || section_path || ')', chr(10)
    ORDER BY place) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n2 FROM ctx) GROUP BY query_id, query),
keyed AS (SELECT query_id, query, p, 'llm:model:' || sha256(to_json({'query': query, 'context': substr(sha256(s), 1, 16)})::VARCHAR) AS key FROM found)"""


@query(_ANSWERS + """ SELECT query_id, key, query_id % 3 = 0 AS cached, CASE WHEN query_id % 3 = 0 THEN 'kept ' || query_id ELSE substr('Query:' || chr(10) || query || chr(10) || chr(10) || 'Context snippets:'
    || chr(10) || p, 1, 200) END AS answer FROM keyed""")
def answer_cache(spark, d):
    """Answers of all questions over a cache that holds those of every third one, and entries that are over for the rest."""
    found = generation.contexts(_contexts(spark, d))
    found = stored(found, shared_folder(spark), "contexts")
    now = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    held = generation.answer_keys(found, "model")
    expires = F.when(F.col("query_id") % 3 == 0, now + F.expr("interval 1 minute")).otherwise(now)
    cache = held.select("key", F.concat(F.lit("kept "), F.col("query_id").cast("string")).alias("value"), now.alias("at"), expires.alias("expires_at"))
    answer = lambda rows: providers.generated(rows, providers.provider(providers.GENERATORS, "extractive"))
    return generation.answered(found, cache, answer, "model", now)[0]


@query(bm25_sql() + _CONTEXTS + (
    " SELECT ctx.query_id, ctx.place, ctx.source_path, ctx.section_path, CASE WHEN role = 'c_level' THEN "
    "'c_level_full_access' WHEN owner_dept = 'general' THEN 'general_docs_any_role' ELSE 'same_department_internal_docs' "
    f"END AS rule FROM ctx JOIN q USING (query_id) JOIN corpus USING (chunk) WHERE {PERMIT_SQL}"
))
def citations(spark, d):
    rows = _contexts(spark, d, "owner_dept", "doc_type", "sensitivity").join(asked(spark, d).select("query_id", "role"), "query_id")
    return generation.citations(policy.permitted(rows, F.col("role")).withColumn("rule", F.col("decision.rule")))


@query(bm25_sql() + f""", sub AS (SELECT query_id % 4 AS qid, query_id AS sub, rank, source_path, section_path, hits.chunk FROM hits JOIN corpus USING (chunk)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_path, section_path ORDER BY sub, rank) AS n FROM sub) WHERE n = 1)
SELECT qid AS query_id, sub, rank, chunk, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sub, rank) AS place FROM one) WHERE place <= {2 * K}""")
def multihop_retrieve(spark, d):
    """Every benchmark query as a sub-query of one of four questions."""
    found = _found(spark, d).join(chunks(spark, d).select("chunk", "source_path", "section_path"), "chunk")
    rows = found.select((F.col("query_id") % 4).alias("query_id"), F.col("query_id").alias("sub"), "rank", "source_path", "section_path", "chunk")
    return retrieval.multihop(rows, K, 2 * K).select("query_id", "sub", "rank", "chunk", "place")


_PARTS = f"""b AS (SELECT item_id, text, {ROLE_SQL} AS role, coalesce(regexp_matches(lower(coalesce(text, '')), '{_PATTERN}')
    OR length(text) - length(replace(text, '?', '')) > 1 OR (contains(lower(text), ' and ') AND len(regexp_extract_all(text,
    '[^\\s]+')) > 10), FALSE) AS hard FROM benchmark),
l AS (SELECT *, CASE WHEN hard THEN list_slice(string_split(text, ' and '), 1, 3) ELSE [text] END AS parts FROM b),
parts AS (SELECT item_id, role, sub - 1 AS sub, subquery, hops FROM (SELECT item_id, role, NOT (len(parts) = 1 AND parts[1]
    = text) AS hops, unnest(parts) AS subquery, generate_subscripts(parts, 1) AS sub FROM l))"""


@query(f"WITH {_PARTS} SELECT item_id AS query_id, CAST(sub AS BIGINT) AS sub, subquery, hops FROM parts")
def decompose(spark, d):
    """Complex questions cut by the built-in generator, the others whole."""
    return retrieval.decomposed(asked(spark, d)).select("query_id", F.col("sub").cast("long").alias("sub"), "subquery", "hops")


def _sourced(spark, d):
    """Retrieval for sub-queries: BM25 hits with their source and section."""

    def retrieve(queries: DataFrame) -> DataFrame:
        c = chunks(spark, d)
        return _found(spark, d, queries).join(c.select("chunk", "source_path", "section_path"), "chunk").select("query_id", "rank", "source_path", "section_path", "chunk")

    return retrieve


_HOPS = bm25_sql(q=f"{_PARTS}, q AS (SELECT item_id * 10 + sub AS query_id, subquery AS query, role FROM parts)") + """,
    found AS (SELECT p.item_id AS qid, p.sub, hops, hits.rank, source_path, section_path, hits.chunk FROM hits JOIN parts
    p ON p.item_id * 10 + p.sub = hits.query_id JOIN corpus USING (chunk))"""


@query(_HOPS + f""", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, coalesce(source_path, ''), coalesce(section_path,
    '') ORDER BY sub, rank) AS n FROM found WHERE hops) WHERE n = 1),
several AS (SELECT qid, sub, rank, chunk, row_number() OVER (PARTITION BY qid ORDER BY sub, rank) AS place FROM one)
SELECT qid AS query_id, CAST(sub AS BIGINT) AS sub, rank, chunk, rank AS place FROM found WHERE NOT hops UNION ALL SELECT
    qid, CAST(sub AS BIGINT), rank, chunk, place FROM several WHERE place <= {2 * K}""")
def multihop_search(spark, d):
    found = retrieval.multihop_search(asked(spark, d), _sourced(spark, d), K)
    return found.select("query_id", F.col("sub").cast("long").alias("sub"), "rank", "chunk", "place")


@query(bm25_sql() + (
    ", found AS (SELECT query_id % 4 AS qid, source_path, section_path FROM hits JOIN corpus USING (chunk)) "
    "SELECT qid AS query_id, count(*) AS before, CAST(count(DISTINCT coalesce(source_path, '') || '#' || "
    "coalesce(section_path, '')) AS BIGINT) AS after FROM found GROUP BY qid"
))
def dedup_counts(spark, d):
    found = _sourced(spark, d)(asked(spark, d))
    return retrieval.dedup_counts(found.withColumn("query_id", F.col("query_id") % 4))


@query(bm25_sql() + " SELECT query_id, chunk, CAST(count(*) OVER (PARTITION BY query_id) + 1 - rank AS BIGINT) AS rank FROM hits")
def rerank_llm(spark, d):
    """The order of a generator that lists every snippet, the last first."""
    return retrieval.rerank_replied(_candidates(spark, d), providers.provider(providers.GENERATORS, "backwards"))


@query(bm25_sql() + _DENSE + _FUSED + (
    " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused.rank) AS place, source_path, "
    f"section_path, chunk FROM fused JOIN q USING (query_id) JOIN corpus USING (chunk) WHERE {PERMIT_SQL}"
))
def chat_contexts(spark, d):
    out = retrieval.chat_contexts(chunks(spark, d), asked(spark, d), _dense(spark, d), K, index=_index(spark, d))
    return out.select("query_id", "place", "source_path", "section_path", "chunk")


# Stores, caches, events


def _described(spark, d) -> DataFrame:
    """documents as chunks of a collection, one section each, with ids and roles."""
    rows = chunks(spark, d).where("chunk % 10 < 8").withColumn("source_path", F.concat_ws("/", "owner_dept", F.col("chunk").cast("string")))
    parts = chunking.chunk_markdown(rows.select("source_path", "text"), max_tokens=10**8)
    rows = parts.join(rows.drop("text", "section_path"), "source_path")
    return rows.withColumn("id", T.chunk_id("source_path", "section_path", "text"))


_DESCRIBED = with_sql() + """, s AS (SELECT chunk, owner_dept, source_path, substr(sha256(source_path || '||' || text), 1,
    32) AS id FROM (SELECT chunk, owner_dept, owner_dept || '/' || chunk AS source_path, trim(text, ' ' || chr(9) || chr(10)
    || chr(11) || chr(12) || chr(13)) AS text FROM corpus WHERE chunk % 10 < 8) WHERE text <> '')"""


@query(_DESCRIBED + " SELECT id, source_path, owner_dept, CAST(256 AS INTEGER) AS dim FROM s")
def dense_index(spark, d):
    """Scan, chunks, roles, embeddings and upsert of the documents of odd ids over an index of all: every id once."""
    rows = _described(spark, d)
    every = files.dense_index(rows, None)
    return files.dense_index(rows.where("chunk % 2 = 1"), every).select("id", "source_path", "owner_dept", "dim")


@query(_DESCRIBED + " SELECT (SELECT count(*) FROM corpus) AS sparse, (SELECT count(*) FROM s) AS dense")
def index_counts(spark, d):
    c = chunks(spark, d)
    sparse = sparse_index.block_rows(c).where("term is null").select(F.inline("docs"))
    return files.index_counts(sparse, _described(spark, d).dropDuplicates(["id"]))


@query((
    "SELECT event_id, CASE CAST(c_nationkey % 6 AS INTEGER) WHEN 0 THEN 'finance' WHEN 1 THEN 'marketing' "
    "WHEN 2 THEN 'hr' WHEN 3 THEN 'engineering' WHEN 4 THEN 'c_level' ELSE 'employee' END AS role FROM events "
    "JOIN customer ON c_custkey = user_id WHERE c_custkey % 3 > 0"
))
def user_roles(spark, d):
    """Events with their user's role; two of three customers are users."""
    role = F.element_at(F.array(*map(F.lit, access.ROLES)), (F.col("c_nationkey") % 6 + 1).cast("int"))
    users = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), role.alias("role"))
    return access.with_role(table(spark, d, "events"), users, "user_id").select("event_id", "role")


@query((
    "WITH p AS (SELECT value FROM events WHERE event_type <> 'purchase' AND value IS NOT NULL ORDER BY event_id "
    "LIMIT (SELECT count(value) FROM events WHERE event_type = 'purchase')) SELECT round((SELECT avg(value) "
    "FROM p) / avg(value), 6) AS prefix_cache_speedup FROM events WHERE event_type = 'purchase'"
))
def prefix_cache_speedup(spark, d):
    """Purchases as the runs with a cached prefix, the other events as those without."""
    e = table(spark, d, "events")
    return tabular.speedup(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), "value", "event_id")


@query((
    "WITH n AS (SELECT * FROM (SELECT 'd' || doc_id % 700 AS id, text, row_number() OVER (PARTITION BY doc_id "
    "% 700 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1), o AS (SELECT 'd' || item_id AS id, text "
    "FROM benchmark) SELECT id, text FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, text "
    "FROM n"
))
def upsert(spark, d):
    """benchmark texts, overwritten by documents with repeated ids."""
    old = table(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("id"), "text")
    new = table(spark, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("id"), "text", F.col("doc_id").alias("ord"))
    return store.upsert(old, new)


def _asked_keys(spark, d) -> tuple[DataFrame, DataFrame]:
    key = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    asked_for = table(spark, d, "documents").select("doc_id", key(F.col("text")).alias("key"))
    cache = table(spark, d, "conversations").select(key(F.col("text")).alias("key")).unionByName(table(spark, d, "documents").where("lang = 'en'").select(key(F.col("text")).alias("key"))).distinct()
    return asked_for, cache


_CACHE = "(SELECT text FROM conversations UNION ALL SELECT text FROM documents WHERE lang = 'en')"


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents WHERE coalesce(text, '') IN (SELECT coalesce(text, '') FROM {_CACHE})")
def cache_hits(spark, d):
    return store.hits(*_asked_keys(spark, d)).select("doc_id", "key")


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM {_CACHE})")
def cache_misses(spark, d):
    return store.misses(*_asked_keys(spark, d)).select("doc_id", "key")


@query((
    "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS value, coalesce(text, '') IN (SELECT coalesce(text, "
    f"'') FROM {_CACHE}) AS cached FROM documents"
))
def cache_merge(spark, d):
    """Values of all documents: those of the cache, and those computed for the misses."""
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    row = lambda t: t.select(key.alias("key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("value"))
    docs = table(spark, d, "documents")
    cache = row(table(spark, d, "conversations")).unionByName(row(docs.where("lang = 'en'"))).dropDuplicates(["key"])
    new = store.misses(row(docs), cache)
    return store.merged(docs.select("doc_id", key.alias("key")), cache, new).select("doc_id", "value", "cached")


def _entries(spark, d) -> DataFrame:
    """Events as cache entries: their user is the key, their value the size."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("at"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.coalesce("value", F.lit(0))).cast("long").alias("size"))


@query((
    "SELECT key, event_id FROM (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
))
def cache_put(spark, d):
    """Entries of odd events written over those of even ones and themselves: a user's latest one stays."""
    rows = _entries(spark, d)
    return store.put(rows.limit(0), rows).select("key", "event_id")


_CAP = 20_000


@query((
    "SELECT event_id FROM (SELECT event_id, sum(size) OVER (ORDER BY hour DESC, ts DESC, event_id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM (SELECT event_id, ts, date_trunc('hour', ts) AS hour, "
    f"CAST(floor(coalesce(value, 0)) AS BIGINT) AS size FROM events)) WHERE upto <= {_CAP}"
))
def cache_within(spark, d):
    return store.within(_entries(spark, d), _CAP, at="ts", tie="event_id").select("event_id")


@query("SELECT count(*) AS item_count, CAST(sum(CAST(floor(coalesce(value, 0)) AS BIGINT)) AS BIGINT) AS size_bytes FROM events")
def cache_stats(spark, d):
    return store.stats(_entries(spark, d))


@query((
    "SELECT event_id, user_id FROM events WHERE event_type <> 'purchase' AND ts + INTERVAL 15 DAY > (SELECT "
    "max(ts) FROM events) UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'purchase'"
))
def cache_ttl(spark, d):
    """Events as cache entries of fifteen days; purchases never expire."""
    rows = table(spark, d, "events").withColumn("expires_at", F.when(F.col("event_type") != "purchase", F.col("ts") + F.expr("interval 15 days")))
    now = rows.agg(F.max("ts").alias("now"))
    return store.live(rows.join(F.broadcast(now)), F.col("now")).select("event_id", "user_id")


@query((
    "SELECT window_start, user_id, n FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, "
    "user_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 2"
))
def rate_limit_windows(spark, d):
    return E.windows(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


_RATES = {"default": "3/day", "purchase": "1/day", "view": "2/hour"}
_RATE_SQL = "event_type = 'view' AS hourly, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS most, CASE WHEN event_type IN ('purchase', 'view') THEN event_type ELSE 'default' END AS name"


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {_RATE_SQL} FROM events),
n AS (SELECT *, CASE WHEN hourly THEN count(*) OVER (PARTITION BY user_id, name ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) ELSE count(*) OVER (PARTITION
    BY user_id, name ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) END AS n FROM e)
SELECT event_id, user_id, name, least(n, most + 1) AS n, n <= most AS allowed FROM n""")
def rate_limit_sliding(spark, d):
    """Every event against the limit of its type over the window that ends with it."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("name"), F.col("event_id").alias("id"), F.timestamp_seconds(T.utc_seconds("ts", T.zoned(e)) + F.expr("extract(SECOND FROM ts) % 1")).alias("ts"))
    return stateful.limited(rows, _RATES).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "name", "n", "allowed")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def audit_daily(spark, d):
    e = table(spark, d, "events")
    return e.select(T.utc_day("ts", T.zoned(e)).alias("day"), "event_type").groupBy("day", "event_type").agg(F.count("*").alias("n"))


@query()
def audit_lines(spark, d):
    return E.audit_rows(table(spark, d, "events"))


@query((
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'user:u' || user_id WHEN event_id % 3 = 1 THEN 'user:n' "
    "|| user_id ELSE '10.0.0.' || user_id END AS key FROM events"
))
def rate_limit_keys(spark, d):
    u = F.col("user_id").cast("string")
    user = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), u))
    header = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("n"), u, F.lit(":secret")).cast("binary"))))
    return table(spark, d, "events").select("event_id", T.rate_limit_key(user, header, F.concat(F.lit("10.0.0."), u)).alias("key"))


@query()
def local_embeddings(spark, d):
    """Vectors of all documents from the built-in embedder, in provider batches."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    return providers.embedded(rows, providers.provider(providers.EMBEDDERS, "local"), "hashed-256").select("doc_id", "embedding", "model", "dim")
