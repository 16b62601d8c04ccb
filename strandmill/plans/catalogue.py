"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.functions import metrics, text
from strandmill.operators import analytics, context, graph, ranking, selection
from strandmill.plans import sqltext as S
from strandmill.plans.stages import Stage, retrieve, stage_counts, traces
from strandmill.sources import conversations as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = src.turns(spark, sf_dir)
    return turns, src.records(turns), src.questions(turns)


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("sample_id", "question_id", F.col("question").alias("query"))


_ASKED = "asked AS (SELECT sample_id, question_id, question AS query FROM questions)"


# ---- sources and projections


@query(f"WITH {S.TURNS} SELECT sample_id, record_id, pos, text, text AS content, speaker, '1' AS session_id, 'D1:' || (pos + 1) AS evidence FROM records")
def turn_chunk(spark, sf_dir):
    _, records, _ = _turns(spark, sf_dir)
    return records.select("sample_id", "record_id", "pos", "text", "content", "speaker", "session_id", F.array_join("evidence_refs", ",").alias("evidence"))


@query(f"WITH {S.TURNS} SELECT sample_id, question_id, question_pos, label, reference, evidence FROM questions")
def category_labels(spark, sf_dir):
    _, _, questions = _turns(spark, sf_dir)
    return questions.select("sample_id", "question_id", "question_pos", F.col("labels")["question_type"][0].alias("label"), "reference", F.array_join("evidence_ids", ",").alias("evidence"))


@query("""
SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(TRY_CAST(split_part(key, '_', 2) AS BIGINT), 1000000000), key) AS place
FROM (SELECT conv_id, CASE WHEN turn = 3 THEN 'session_extra' ELSE 'session_' || (turn * 7 % 11) END AS key FROM conversations)""")
def session_order(spark, sf_dir):
    from strandmill.sources.dialogues import session_number

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.when(F.col("turn") == 3, "session_extra").otherwise(F.concat(F.lit("session_"), (F.col("turn") * 7 % 11).cast("string"))).alias("key"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(session_number(F.col("key")), "key")))


@query(f"SELECT conv_id, turn, {S.strip('''CASE WHEN turn % 2 = 0 THEN '[Image: ' || role || '] ' || text ELSE text END''')} AS text FROM conversations")
def caption_merge(spark, sf_dir):
    from strandmill.sources.dialogues import with_caption

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", with_caption(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("text")).alias("text"))


@query(f"WITH {S.TURNS} SELECT question_id, CASE WHEN label = 'adversarial' THEN coalesce(CASE WHEN question_pos % 2 = 0 THEN question END, 'None') ELSE coalesce(CASE WHEN question_pos % 3 > 0 THEN reference END, '') END AS chosen FROM questions")
def reference_choice(spark, sf_dir):
    from strandmill.sources.dialogues import reference_answer

    _, _, q = _turns(spark, sf_dir)
    category = F.col("question_pos") % 5 + 1
    return q.select("question_id", reference_answer(category, F.when(F.col("question_pos") % 3 > 0, F.col("reference")), F.when(F.col("question_pos") % 2 == 0, F.col("question"))).alias("chosen"))


# ---- selections


@query(f"WITH {S.TURNS}, s AS (SELECT sample_id, min(conv_id) AS p FROM (SELECT 'conv:' || conv_id AS sample_id, conv_id FROM conversations) GROUP BY sample_id) SELECT sample_id FROM s ORDER BY p LIMIT 10")
def select_samples(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.lit(1)).select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("sample_id"), F.col("conv_id").alias("sample_pos"))
    return selection.select_samples(rows, limit=10).select("sample_id")


@query(f"WITH {S.TURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY question_pos) AS n FROM questions WHERE label IN ('multi_hop', 'open_domain')) SELECT sample_id, question_id FROM c WHERE n <= 2")
def select_questions_category(spark, sf_dir):
    _, _, q = _turns(spark, sf_dir)
    return selection.select_questions(q, categories=["multi_hop", "open_domain"], limit=2).select("sample_id", "question_id")


@query(f"WITH {S.TURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY turn_pos) AS n FROM turns) SELECT sample_id, turn_id FROM c WHERE n <= 3")
def turn_limit(spark, sf_dir):
    turns, _, _ = _turns(spark, sf_dir)
    return selection.first_of_each(turns, "sample_id", "turn_pos", 3).select("sample_id", "turn_id")


@query(f"WITH {S.TURNS} SELECT sample_id, question_id FROM questions WHERE NOT (question_pos % 3 = 0 AND question_pos % 2 = 0)")
def resume_pending(spark, sf_dir):
    _, _, q = _turns(spark, sf_dir)
    units = q.select("sample_id", "question_id", "question_pos", F.lit("f").alias("fingerprint"), F.lit("e").alias("execution_fingerprint"))
    done = units.where("question_pos % 3 = 0").select("question_id", F.when(F.col("question_pos") % 2 == 0, "completed").otherwise("failed").alias("status"), "fingerprint", "execution_fingerprint")
    return selection.pending(units, done, ["question_id"]).select("sample_id", "question_id")


@query(f"WITH {S.TURNS} SELECT sample_id, question_id, 'failed' AS status, '' AS prediction, 'No construction store available for sample ''' || sample_id || '''' AS message FROM questions WHERE split_part(sample_id, ':', 2)::BIGINT % 4 = 1")
def missing_store_failed_rows(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    stores = records.where(F.split("sample_id", ":")[1].cast("long") % 4 != 1).select("sample_id")
    return selection.failed_rows(q, stores).select("sample_id", "question_id", "status", "prediction", F.col("errors")[0]["message"].alias("message"))


@query(f"WITH {S.TURNS} SELECT q.question_id, count(*) AS n_records, sum(length(r.text))::BIGINT AS chars FROM questions q JOIN records r USING (sample_id) GROUP BY q.question_id")
def store_question_join(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return q.select("sample_id", "question_id").join(records, "sample_id").groupBy("question_id").agg(F.count("*").alias("n_records"), F.sum(F.length("text")).alias("chars"))


# ---- ranking


@query(f"WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 3)}) SELECT question_id, record_id, rank, round(score, 6) AS score FROM t")
def bm25_topk_conversations(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return ranking.bm25_topk(_asked(q), records.drop("pos"), 3, scope=["sample_id"]).select("question_id", "record_id", "rank", r6("score"))


@query(f"WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')} SELECT question_id, record_id, round(score, 6) AS score FROM b")
def bm25_all_scores_keep_zero(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return ranking.bm25(_asked(q), records.drop("pos"), scope=["sample_id"]).select("question_id", "record_id", r6("score"))


_CORPUS = "corpus AS (SELECT doc_id AS record_id, text FROM documents), asked AS (SELECT item_id AS question_id, text AS query FROM benchmark)"


@query(f"WITH {_CORPUS}, {S.bm25('b', 'asked', 'corpus', '')}, t AS ({S.topk('b', 3)}) SELECT question_id, record_id, rank, round(score, 6) AS score FROM t WHERE score > 0")
def bm25_topk_documents(spark, sf_dir):
    """The first three documents of each benchmark text; a document without a common term is never scored."""
    records = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("record_id"), "text")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    return ranking.bm25_topk(asked, records, 3, scope=[], keep_zero=False).where("score > 0").select("question_id", "record_id", "rank", r6("score"))


@query(f"""WITH {S.TURNS}, {_ASKED}, {S.bm25('a', 'asked', 'records', 'sample_id')}, one AS ({S.topk('a', 4)}),
left_over AS (SELECT one.question_id, one.record_id, r.text FROM one JOIN records r USING (record_id)), {S.bm25('b', 'asked', 'left_over', 'question_id')}, t AS ({S.topk('b', 2)})
SELECT question_id, record_id, rank, round(score, 6) AS score FROM t""")
def bm25_two_stage_survivor_idf(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("bm25", 4), Stage("bm25", 2)])).where("stage_index = 1").select("question_id", "record_id", "rank", r6("score"))


@query(f"WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id', okapi=True, pos=True)}, t AS ({S.topk('b', 3, 'score DESC, pos')}) SELECT question_id, record_id, rank, round(score, 6) AS score FROM t")
def bm25_okapi_topk(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return ranking.okapi_topk(_asked(q), records, 3, scope=["sample_id"]).select("question_id", "record_id", "rank", r6("score"))


@query(f"""WITH {S.TURNS}, {_ASKED}, {S.bm25('a', 'asked', 'records', 'sample_id')}, one AS ({S.topk('a', 5)}),
cand AS (SELECT one.question_id, one.record_id, one.rank AS pos, r.text FROM one JOIN records r USING (record_id)), {S.bm25('b', 'asked', 'cand', 'question_id', okapi=True, pos=True)}, t AS ({S.topk('b', 2, 'score DESC, pos')})
SELECT question_id, record_id, rank, round(score, 6) AS score FROM t""")
def okapi_rerank(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    first = ranking.bm25_topk(_asked(q), records.drop("pos"), 5, scope=["sample_id"])
    cand = first.select("question_id", "record_id", F.col("rank").alias("pos")).join(records.select("record_id", "text"), "record_id")
    return ranking.okapi_topk(_asked(q), cand, 2, scope=["question_id"]).select("question_id", "record_id", "rank", r6("score"))


@query(f"WITH {S.TURNS}, o AS (SELECT q.question_id, r.record_id, row_number() OVER (PARTITION BY q.question_id ORDER BY r.pos) AS rank FROM questions q JOIN records r USING (sample_id)) SELECT question_id, record_id, rank, CAST(NULL AS DOUBLE) AS score FROM o WHERE rank <= 2")
def limit_stage(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("limit", 2)])).select("question_id", "record_id", "rank", "score")


@query(f"""WITH {S.TURNS}, asked AS (SELECT sample_id, question_id, lower(question) AS query FROM questions), {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 2)})
SELECT t.question_id, record_id, rank, round(score, 6) AS score, query FROM t JOIN asked USING (question_id)""")
def query_transform_lower(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("query_transform"), Stage("bm25", 2)])).where("stage_index = 1").select("question_id", "record_id", "rank", r6("score"), "query")


@query(f"""WITH {S.TURNS}, asked AS (SELECT sample_id, question_id, 'the ' || question AS query FROM questions), {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 2)})
SELECT t.question_id, record_id, rank, round(score, 6) AS score, query FROM t JOIN asked USING (question_id)""")
def query_transform_prefix(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("query_transform", params={"mode": "prefix", "prefix": "the "}), Stage("bm25", 2)])).where("stage_index = 1").select("question_id", "record_id", "rank", r6("score"), "query")


@query(f"WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 1)}) SELECT t.question_id, record_id, rank, round(score, 6) AS score, query FROM t JOIN asked USING (question_id)")
def original_question_selector(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    stages = [Stage("query_transform", params={"mode": "prefix", "prefix": "zzz "}), Stage("bm25", 1, query="original_question")]
    return traces(retrieve(q, records, stages)).where("stage_index = 1").select("question_id", "record_id", "rank", r6("score"), "query")


_TWO = f"{S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 3)})"


@query(f"""WITH {S.TURNS}, {_ASKED}, {_TWO}
SELECT question_id, 0 AS stage_index, 'bm25' AS adapter, record_id, rank, round(score, 6) AS score FROM t
UNION ALL SELECT question_id, 1, 'limit', record_id, rank, NULL FROM t WHERE rank <= 2""")
def stage_trace(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("bm25", 3), Stage("limit", 2)])).select("question_id", "stage_index", "adapter", "record_id", "rank", r6("score"))


@query(f"""WITH {S.TURNS}, n AS (SELECT q.question_id, count(*) AS n FROM questions q JOIN records r USING (sample_id) GROUP BY q.question_id)
SELECT question_id, 0 AS stage_index, n AS input_count, least(n, 3)::BIGINT AS output_count FROM n UNION ALL SELECT question_id, 1, least(n, 3)::BIGINT, least(n, 2)::BIGINT FROM n""", name="stage_counts")
def stage_counts_query(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return stage_counts(retrieve(q, records, [Stage("bm25", 3), Stage("limit", 2)]), q, records)


# ---- vectors


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # The set of queries: every row whose id is divisible by 100, against all rows.
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vector")), rows.select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))


_COS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT q.vec_id AS question_id, r.vec_id AS record_id, round(list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))), 9) AS score FROM e q, e r WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {_COS}, t AS ({S.topk('c', 5)}) SELECT question_id, record_id, rank, round(score, 6) AS score FROM t")
def cosine_topk(spark, sf_dir):
    queries, records = _vectors(spark, sf_dir)
    return ranking.cosine_topk(queries, records, 5).select("question_id", "record_id", "rank", r6("score"))


@query(f"WITH {_COS}, t AS ({S.topk('c', 5, 'score DESC, record_id DESC')}) SELECT question_id, record_id, rank, round(score, 6) AS score FROM t")
def cosine_topk_late_ties(spark, sf_dir):
    """The retriever whose ties go to the later position."""
    queries, records = _vectors(spark, sf_dir)
    return ranking.cosine_topk(queries, records, 5, descending_ties=True).select("question_id", "record_id", "rank", r6("score"))


@query(f"""WITH {_COS}, p AS ({S.topk('c', 20)}), q AS (SELECT question_id, record_id, rank AS r FROM p UNION ALL SELECT question_id, -1 - rank, rank FROM p WHERE rank <= 2),
x AS (SELECT q.question_id, q.record_id, row_number() OVER (PARTITION BY q.question_id ORDER BY q.r DESC, q.record_id) AS prior, c.score FROM q LEFT JOIN c USING (question_id, record_id)), t AS ({S.topk('x', 22, 'score DESC NULLS LAST, prior')})
SELECT question_id, record_id, rank, prior, round(score, 6) AS score FROM t""")
def embedding_rerank_prior_rank(spark, sf_dir):
    """The nearest twenty in reverse, with two ids that have no vector, ranked anew."""
    queries, records = _vectors(spark, sf_dir)
    near = ranking.cosine_topk(queries, records, 20).select("question_id", "record_id", F.col("rank").alias("r"))
    both = near.unionByName(near.where("r <= 2").withColumn("record_id", -1 - F.col("r")))
    cand = both.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("r"), "record_id"))).drop("r")
    return ranking.rerank_by_vector(cand, queries, records, 22).select("question_id", "record_id", "rank", "prior", r6("score"))


@query(f"""WITH {_COS}, docs AS (SELECT doc_id AS record_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
asked AS (SELECT doc_id AS question_id, text AS query FROM documents WHERE doc_id % 100 = 0), {S.bm25('b', 'asked', 'docs', '')},
m AS (SELECT *, (score - min(score) OVER (PARTITION BY question_id)) / (max(score) OVER (PARTITION BY question_id) - min(score) OVER (PARTITION BY question_id) + 0.000001::DOUBLE) AS lex FROM b),
h AS (SELECT m.question_id, m.record_id, round(0.5::DOUBLE * lex + 0.5::DOUBLE * c.score, 9) AS score FROM m JOIN c USING (question_id, record_id)), t AS ({S.topk('h', 5)})
SELECT question_id, record_id, rank, round(score, 6) AS score FROM t""")
def hybrid_minmax_topk(spark, sf_dir):
    queries, records = _vectors(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = docs.join(records.select(F.col("record_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("record_id"), "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.col("text").alias("query"))
    return ranking.hybrid_search(asked, ranking.corpus_of(ranking.written(held), []), queries, records, 5).select("question_id", "record_id", "rank", r6("score"))


_ENCODED = f"""x AS (SELECT q.question_id, r.record_id, [length(question)::DOUBLE, len({S.tokens('question')})::DOUBLE, 1.0::DOUBLE] AS a, [length(r.text)::DOUBLE, len({S.tokens('r.text')})::DOUBLE, 1.0::DOUBLE] AS b, question, r.text FROM questions q JOIN records r USING (sample_id))"""


def _encode(column):
    """A small encoder that SQL can repeat: characters, tokens and a constant."""
    return F.array(F.length(column).cast("double"), F.size(text.tokens(column)).cast("double"), F.lit(1.0))


@query(f"""WITH {S.TURNS}, {_ENCODED}, c AS (SELECT question_id, record_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) AS score FROM x), t AS ({S.topk('c', 3)})
SELECT question_id, record_id, rank, round(score, 6) AS score FROM t""")
def embedding_stage(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("embedding", 3, params={"encode": _encode})])).select("question_id", "record_id", "rank", r6("score"))


@query(f"""WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 4)}),
p AS (SELECT t.question_id, t.record_id, round({S.f1('q.question', 'r.text')}, 9) AS score FROM t JOIN questions q USING (question_id) JOIN records r ON r.record_id = t.record_id), u AS ({S.topk('p', 2)})
SELECT question_id, record_id, rank, round(score, 6) AS score FROM u""")
def cross_encoder_stage(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return traces(retrieve(q, records, [Stage("bm25", 4), Stage("cross_encoder", 2, params={"score": metrics.f1})])).where("stage_index = 1").select("question_id", "record_id", "rank", r6("score"))


# ---- contexts, prompts, answers, metrics


_TOP2 = f"{S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 2)})"
_CTX = f"ctx AS (SELECT question_id, string_agg(r.speaker || CASE WHEN r.text = '' THEN '' ELSE ' | ' || r.text END, chr(10) ORDER BY rank) AS context_text, string_agg(record_id, ',' ORDER BY rank) AS item_ids FROM t JOIN records r USING (record_id) GROUP BY question_id)"


def _context(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, records, q = _turns(spark, sf_dir)
    plan = retrieve(q, records, [Stage("bm25", 2)])
    items = plan.candidates.join(records.drop("pos", "sample_id"), "record_id")
    return q, context.joined(items, context.line(["timestamp", "speaker", "content", "keywords"]))


@query(f"WITH {S.TURNS}, {_ASKED}, {_TOP2}, {_CTX} SELECT question_id, context_text, item_ids FROM ctx")
def context_records(spark, sf_dir):
    return _context(spark, sf_dir)[1].select("question_id", "context_text", F.array_join("item_ids", ",").alias("item_ids"))


_NOTE = "note AS (SELECT record_id, sample_id, pos, text, speaker, speaker || ' at ' || pos AS context, speaker || ', turn' AS kw, 'tag' || (pos % 3) AS tags FROM records)"


def _notes(records: DataFrame) -> DataFrame:
    """Turns as notes with a context, keywords, tags and links to the two turns before and, for even turns, one that doesn't exist."""
    links = F.filter(F.array(F.when(F.col("pos") >= 1, (F.col("pos") - 1).cast("string")), F.when(F.col("pos") >= 2, (F.col("pos") - 2).cast("string")), F.when(F.col("pos") % 2 == 0, (F.col("pos") + 100).cast("string"))), lambda x: x.isNotNull())
    return records.drop("keywords").withColumns({"context": F.concat("speaker", F.lit(" at "), F.col("pos").cast("string")), "keywords": F.array(F.col("speaker"), F.lit("turn")), "tags": F.array(F.concat(F.lit("tag"), (F.col("pos") % 3).cast("string"))), "links": links})


@query(f"WITH {S.TURNS}, {_NOTE} SELECT record_id, 'talk start time:' || chr(10) || 'memory content: ' || text || chr(10) || 'memory context: ' || context || chr(10) || 'memory keywords: ' || kw || chr(10) || 'memory tags: ' || tags AS lines FROM note")
def context_graph(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return notes.select("record_id", context.graph_lines(F.col("timestamp"), F.col("content"), F.col("context"), F.col("keywords"), F.col("tags")).alias("lines"))


@query(f"WITH {S.TURNS}, {_NOTE} SELECT record_id, 'talk start time: None' || chr(10) || 'memory content: ' || text || chr(10) || 'memory context: ' || context || chr(10) || 'memory keywords: ' || kw || chr(10) || 'memory tags: ' || tags AS lines FROM note")
def rerank_text(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return notes.select("record_id", context.rerank_text(F.col("timestamp"), F.col("content"), F.col("context"), F.col("keywords"), F.col("tags")).alias("lines"))


@query(f"WITH {S.TURNS}, {_NOTE} SELECT record_id, context || ' keywords: ' || kw AS document FROM note")
def retrieval_document(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return notes.select("record_id", context.index_document(F.col("context"), F.col("keywords")).alias("document"))


@query(f"""WITH {S.TURNS}, {_NOTE} SELECT record_id, 'memory index:' || pos || chr(9) || ' talk start time:now' || chr(9) || ' memory content: ' || text || chr(9) || ' memory context: ' || context || chr(9) || ' memory keywords: [''' || speaker || ''', ''turn'']' || chr(9) || ' memory tags: [''' || tags || ''']' || chr(10) AS line FROM note""")
def neighbour_prompt_line(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return notes.select("record_id", context.neighbour_line(F.col("pos"), F.lit("now"), F.col("content"), F.col("context"), F.col("keywords"), F.col("tags")).alias("line"))


@query(f"WITH {S.TURNS}, {_ASKED}, {_TOP2}, {_CTX} SELECT question_id, split_part(context_text, chr(10), 1) AS prediction FROM ctx")
def extractive_answer(spark, sf_dir):
    return _context(spark, sf_dir)[1].select("question_id", context.extractive(F.col("context_text")).alias("prediction"))


_ODD = "('0x' || substr(sha256('17:' || question_id), 1, 2))::INT % 2 = 1"


@query(f"""WITH {S.TURNS}, {_ASKED}, {_TOP2}, {_CTX}, p AS (SELECT q.*, context_text, CASE WHEN {_ODD} THEN reference ELSE 'Not mentioned in the conversation' END AS c0, CASE WHEN {_ODD} THEN 'Not mentioned in the conversation' ELSE reference END AS c1 FROM questions q JOIN ctx USING (question_id))
SELECT question_id, sha256(CASE label WHEN 'adversarial' THEN 'Based on the context: ' || context_text || ', answer the following question. ' || question || chr(10) || chr(10) || 'Select the correct answer: ' || c0 || ' or ' || c1 || '  Short answer:'
WHEN 'temporal' THEN 'Based on the context: ' || context_text || ', answer the following question. Use DATE OF CONVERSATION to answer with an approximate date.' || chr(10) || 'Please generate the shortest possible answer, using words from the conversation where possible, and avoid using any subjects.' || chr(10) || chr(10) || 'Question: ' || question || ' Short answer:'
ELSE 'Based on the context: ' || context_text || ', write an answer in the form of a short phrase for the following question. Answer with exact words from the context whenever possible.' || chr(10) || chr(10) || 'Question: ' || question || ' Short answer:' END) AS prompt_sha256,
CASE WHEN label = 'adversarial' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS temperature FROM p""")
def qa_prompts(spark, sf_dir):
    q, ctx = _context(spark, sf_dir)
    label = F.col("labels")["question_type"][0]
    both = q.join(ctx, "question_id")
    return both.select("question_id", F.sha2(context.qa_prompt(F.col("question_id"), F.col("question"), F.col("reference"), label, F.col("context_text"), 17), 256).alias("prompt_sha256"), context.qa_temperature(label).alias("temperature"))


@query(f"WITH {S.TURNS} SELECT question_id, {_ODD} AS reversed FROM questions")
def adversarial_choice_order(spark, sf_dir):
    return _turns(spark, sf_dir)[2].select("question_id", text.flip(17, F.col("question_id")).alias("reversed"))


_PAIRS = f"{S.TURNS}, {_ASKED}, {_TOP2}, {_CTX}, a AS (SELECT q.question_id, q.sample_id, q.label, q.reference, split_part(context_text, chr(10), 1) AS prediction FROM questions q JOIN ctx USING (question_id))"


def _answers(spark, sf_dir) -> DataFrame:
    q, ctx = _context(spark, sf_dir)
    return q.join(ctx, "question_id").withColumn("prediction", context.extractive(F.col("context_text")))


@query(f"WITH {_PAIRS} SELECT question_id, {S.exact('prediction', 'reference')} AS exact_match FROM a UNION ALL SELECT question_id || ':same', {S.exact('upper(reference)', 'reference')} FROM a")
def metric_exact_match(spark, sf_dir):
    a = _answers(spark, sf_dir)
    same = a.select(F.concat("question_id", F.lit(":same")).alias("question_id"), metrics.exact_match(F.upper("reference"), F.col("reference")).alias("exact_match"))
    return a.select("question_id", metrics.exact_match(F.col("prediction"), F.col("reference")).alias("exact_match")).unionByName(same)


@query(f"WITH {_PAIRS} SELECT question_id, round({S.f1('prediction', 'reference')}, 6) AS f1 FROM a")
def metric_f1(spark, sf_dir):
    return _answers(spark, sf_dir).select("question_id", F.round(metrics.f1(F.col("prediction"), F.col("reference")), 6).alias("f1"))


@query(f"WITH {_PAIRS} SELECT question_id, round({S.bleu1('prediction', 'reference')}, 6) AS bleu1 FROM a")
def metric_bleu1(spark, sf_dir):
    return _answers(spark, sf_dir).select("question_id", F.round(metrics.bleu1(F.col("prediction"), F.col("reference")), 6).alias("bleu1"))


_SCORED = f"{_PAIRS}, m AS (SELECT *, {S.exact('prediction', 'reference')} AS em, {S.f1('prediction', 'reference')} AS f1, {S.bleu1('prediction', 'reference')} AS bleu1 FROM a)"


def _results(spark, sf_dir) -> DataFrame:
    """Scored rows; those of every seventh conversation have failed."""
    a = _answers(spark, sf_dir)
    failed = F.split("sample_id", ":")[1].cast("long") % 7 == 3
    scored = metrics.metric_map(["exact_match", "f1", "bleu1"], F.col("prediction"), F.col("reference"))
    return a.withColumn("status", F.when(failed, "failed").otherwise("completed")).withColumn("metrics", F.when(failed, F.create_map().cast("map<string,double>")).otherwise(scored))


@query(f"WITH {_SCORED} SELECT question_id, em AS exact_match, round(f1, 6) AS f1, round(bleu1, 6) AS bleu1 FROM m")
def metric_all(spark, sf_dir):
    m = _answers(spark, sf_dir).withColumn("m", metrics.metric_map(["exact_match", "f1", "bleu1"], F.col("prediction"), F.col("reference")))
    return m.select("question_id", F.col("m")["exact_match"].alias("exact_match"), F.round(F.col("m")["f1"], 6).alias("f1"), F.round(F.col("m")["bleu1"], 6).alias("bleu1"))


@query(f"WITH {_SCORED} SELECT question_id, sample_id, label, prediction, reference, em AS exact_match, round(f1, 6) AS f1, round(bleu1, 6) AS bleu1 FROM m")
def turn_rag_e2e(spark, sf_dir):
    """Chunk, rank, build the context, answer and score: the flagship."""
    m = _answers(spark, sf_dir).withColumn("m", metrics.metric_map(["exact_match", "f1", "bleu1"], F.col("prediction"), F.col("reference")))
    return m.select("question_id", "sample_id", F.col("labels")["question_type"][0].alias("label"), "prediction", "reference", F.col("m")["exact_match"].alias("exact_match"), F.round(F.col("m")["f1"], 6).alias("f1"), F.round(F.col("m")["bleu1"], 6).alias("bleu1"))


# ---- graph


@query(f"WITH {S.TURNS}, {S.LINKS} SELECT sample_id, record_id || '->' || target_id AS edge_id, record_id AS source_id, target_id, 'amem_link' AS type FROM resolved")
def link_edges(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return graph.edges(graph.resolve_links(notes)).drop("link_pos")


@query(f"""WITH {S.TURNS}, {S.LINKS} SELECT sample_id, 'amem_notes' AS name, (SELECT string_agg(record_id, ',' ORDER BY pos) FROM records r WHERE r.sample_id = s.sample_id) AS node_ids,
coalesce((SELECT string_agg(x.record_id || '->' || target_id, ',' ORDER BY r.pos, link_pos) FROM resolved x JOIN records r USING (record_id) WHERE x.sample_id = s.sample_id), '') AS edge_ids FROM (SELECT DISTINCT sample_id FROM records) s""")
def graph_layers(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return graph.layers(notes, graph.edges(graph.resolve_links(notes))).select("sample_id", "name", F.array_join("node_ids", ",").alias("node_ids"), F.array_join("edge_ids", ",").alias("edge_ids"))


_HOP = f"""{S.TURNS}, {S.LINKS}, {_ASKED}, {_TOP2}, found AS (
  SELECT t.question_id, t.record_id AS source_id, t.rank, x.link_pos, x.target_id AS record_id FROM t JOIN resolved x ON x.record_id = t.record_id
  WHERE x.target_id IN (SELECT record_id FROM records))"""


@query(f"""WITH {_HOP}, fresh AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.question_id = f.question_id AND t.record_id = f.record_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, record_id ORDER BY rank, link_pos) AS n FROM fresh) WHERE n = 1)
SELECT question_id, record_id, rank, CAST(NULL AS VARCHAR) AS source_id FROM t
UNION ALL SELECT o.question_id, o.record_id, (SELECT max(rank) FROM t WHERE t.question_id = o.question_id) + row_number() OVER (PARTITION BY o.question_id ORDER BY o.rank, o.link_pos), o.source_id FROM once o""")
def neighbor_expansion(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    items = retrieve(q, records, [Stage("bm25", 2)]).candidates
    return graph.expand(items, graph.resolve_links(_notes(records)), records).select("question_id", "record_id", "rank", "source_id")


@query(f"""WITH {_HOP}, every AS (SELECT question_id, rank, 0 AS hop, -1 AS link_pos, record_id FROM t UNION ALL SELECT question_id, rank, 1, link_pos, record_id FROM found WHERE link_pos <= 1)
SELECT question_id, record_id, hop, row_number() OVER (PARTITION BY question_id ORDER BY rank, hop, link_pos) AS place FROM every""")
def neighbor_expansion_capped(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    items = retrieve(q, records, [Stage("bm25", 2)]).candidates
    return graph.expand_capped(items, graph.resolve_links(_notes(records)), records, 1).select("question_id", "record_id", "hop", "place")


@query(f"""WITH {S.TURNS}, {S.LINKS}, s AS (SELECT DISTINCT sample_id, record_id AS a, target_id AS b FROM resolved), n AS (SELECT sample_id, a AS node_id, 1 AS o, 0 AS i FROM s UNION ALL SELECT sample_id, b, 0, 1 FROM s)
SELECT sample_id, node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM n GROUP BY sample_id, node_id""")
def graph_degree(spark, sf_dir):
    notes = _notes(_turns(spark, sf_dir)[1])
    return graph.degrees(graph.edges(graph.resolve_links(notes)))


# ---- analytics


_FAIL = "split_part(sample_id, ':', 2)::BIGINT % 7 = 3"


@query(f"WITH {_SCORED}, d AS (SELECT * FROM m WHERE NOT ({_FAIL})) SELECT 'exact_match' AS name, round(avg(em), 6) AS mean FROM d UNION ALL SELECT 'f1', round(avg(f1), 6) FROM d UNION ALL SELECT 'bleu1', round(avg(bleu1), 6) FROM d")
def overview_metrics(spark, sf_dir):
    return analytics.metric_means(_results(spark, sf_dir)).select("name", r6("mean"))


@query(f"WITH {S.TURNS} SELECT 'question_type' AS dimension, label, count(*) AS n FROM questions GROUP BY label")
def taxonomy_breakdown(spark, sf_dir):
    return analytics.breakdown(_turns(spark, sf_dir)[2])


@query(f"WITH {S.TURNS} SELECT count(*) AS questions, count(*) FILTER (NOT ({_FAIL})) AS completed, count(*) FILTER ({_FAIL}) AS failed FROM questions")
def run_status(spark, sf_dir):
    return analytics.status_counts(_results(spark, sf_dir).select("status"))


def _usage(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.when(F.col("user_id") % 10 > 0, F.col("event_type")).alias("source"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("total_tokens"), F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("latency_ms"))


_USAGE = "u AS (SELECT CASE WHEN user_id % 10 > 0 THEN event_type END AS source, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS total_tokens, CASE WHEN event_id % 4 > 0 THEN value END AS latency_ms FROM events)"


@query(f"WITH {_USAGE} SELECT coalesce(source, 'unknown') AS source, count(*) AS calls, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens, round(sum(coalesce(latency_ms, 0)), 2) AS latency_ms FROM u GROUP BY 1")
def usage_by_source(spark, sf_dir):
    return analytics.usage_by_source(_usage(spark, sf_dir)).withColumn("latency_ms", F.round("latency_ms", 2))


@query(f"WITH {S.TURNS} SELECT 'estimated' AS source, count(*) AS calls, sum(len(list_filter(regexp_split_to_array(question, '[\\s\\p{{Z}}]+'), lambda x: x <> '')))::BIGINT AS total_tokens, 0.0::DOUBLE AS latency_ms FROM questions")
def usage_union_fallback(spark, sf_dir):
    """No usage files, so the usage inside the results counts."""
    q = _turns(spark, sf_dir)[2]
    results = q.select(F.array(F.struct(F.lit("estimated").alias("source"), text.word_count(F.col("question")).alias("total_tokens"), F.lit(None).cast("double").alias("latency_ms"))).alias("usage"))
    return analytics.usage_by_source(analytics.usage_records(None, results))


_AB = f"""WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 1)}),
ra AS (SELECT CASE WHEN question_pos % 4 > 0 THEN 0 END AS construction_run, question_pos % 2 AS qa_run, q.question_id, q.question, q.reference, r.text AS prediction FROM questions q JOIN t USING (question_id) JOIN records r USING (record_id) WHERE question_pos % 6 <> 2),
rb AS (SELECT CASE WHEN question_pos % 4 > 0 THEN 0 END AS construction_run, question_pos % 2 AS qa_run, q.question_id, q.question, q.reference, r.text AS prediction FROM questions q JOIN records r ON r.sample_id = q.sample_id AND r.pos = (SELECT min(pos) FROM records z WHERE z.sample_id = q.sample_id) WHERE question_pos % 6 <> 4)
SELECT coalesce(ra.construction_run, rb.construction_run) AS construction_run, coalesce(ra.qa_run, rb.qa_run) AS qa_run, coalesce(ra.question_id, rb.question_id) AS question_id,
coalesce(ra.question, rb.question, '') AS question, coalesce(ra.reference, rb.reference, '') AS reference, ra.prediction AS prediction_a, rb.prediction AS prediction_b
FROM ra FULL OUTER JOIN rb ON ra.question_id = rb.question_id AND ra.construction_run IS NOT DISTINCT FROM rb.construction_run AND ra.qa_run IS NOT DISTINCT FROM rb.qa_run"""


def _experiment(q: DataFrame, records: DataFrame, stage: Stage) -> DataFrame:
    best = retrieve(q, records, [stage]).candidates.where("rank = 1").select("question_id", "record_id").join(records.select("record_id", F.col("text").alias("prediction")), "record_id")
    rows = q.join(best, "question_id").select(F.when(F.col("question_pos") % 4 > 0, 0).alias("construction_run"), (F.col("question_pos") % 2).alias("qa_run"), "question_id", "question_pos", "question", "reference", "prediction", F.lit(1).alias("pos"))
    return rows.unionByName(rows.where("question_pos % 3 = 0").withColumn("pos", F.lit(0)).withColumn("prediction", F.lit("earlier")))


@query(_AB)
def qa_compare(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    a = _experiment(q, records, Stage("bm25", 1)).where("question_pos % 6 <> 2")
    b = _experiment(q, records, Stage("limit", 1)).where("question_pos % 6 <> 4")
    return analytics.compare(a, b)


@query(f"""WITH {S.TURNS}, f AS (SELECT question_id FROM questions ORDER BY question_id LIMIT 1), rows AS (SELECT question_id, question, c AS construction_run, r AS qa_run FROM questions, (VALUES (1), (0)) c(c), (VALUES (2), (1)) r(r))
SELECT question_id, question, construction_run, qa_run FROM rows WHERE question_id = (SELECT question_id FROM f) AND qa_run = 2 ORDER BY construction_run LIMIT 1""")
def retrieval_trace(spark, sf_dir):
    q = _turns(spark, sf_dir)[2]
    runs = q.withColumn("construction_run", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("qa_run", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("pos", F.col("question_pos"))
    first = q.agg(F.min("question_id").alias("question_id"))
    return analytics.trace(runs.join(first, "question_id", "left_semi"), None, qa_run=2).select("question_id", "question", "construction_run", "qa_run")


@query("""SELECT event_type AS stage, count(*) AS count, round(sum(value), 2) AS total, min(value) AS min, max(value) AS max, round(sum(value) / count(*), 6) AS avg FROM events GROUP BY event_type""")
def timing_merge(spark, sf_dir):
    """Partial timings of ten parts, merged."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = events.groupBy(F.col("event_type").alias("stage"), (F.col("event_id") % 10).alias("part")).agg(F.count("*").alias("count"), F.sum("value").alias("total"), F.min("value").alias("min"), F.max("value").alias("max"))
    return analytics.merge_timings(parts).select("stage", "count", F.round("total", 2).alias("total"), "min", "max", r6("avg"))


@query("SELECT event_type AS stage, count(*) AS count, round(sum(value), 2) AS total, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return analytics.timing(events, "event_type", "value").withColumnRenamed("event_type", "stage").withColumn("total", F.round("total", 2)).withColumn("avg", F.round("avg", 6))


# ---- scalar text functions


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+'), lambda x: x <> ''))::BIGINT AS n FROM documents")
def token_count_estimate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.word_count(F.col("text")).alias("n"))


_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[_/\\-]+', ' ', 'g'), '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-]+|[ \\-]+$', '', 'g')"


@query(f"SELECT page_id, {_KEY.format('url')} AS keyword FROM pages")
def normalize_keyword(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.normal_keyword(F.col("url")).alias("keyword"))


@query(f"""WITH p AS (SELECT page_id, i, {_KEY.format('part')} AS k FROM (SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) AS i FROM pages)),
f AS (SELECT page_id, k, min(i) AS i FROM p WHERE k <> '' GROUP BY page_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f)
SELECT pages.page_id, coalesce(string_agg(k, '|' ORDER BY n) FILTER (n <= 5), '') AS keywords FROM pages LEFT JOIN r USING (page_id) GROUP BY pages.page_id""")
def keywords_none(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.array_join(text.plain_keywords(F.split("url", "/")), "|").alias("keywords"))


@query(f"""WITH l AS (SELECT item_id, i, {S.strip("regexp_replace(" + S.strip('line') + ", '^[-*•]\\s*', '')")} AS line FROM (SELECT item_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT item_id, '- ' || replace(text, '. ', chr(10) || '* ') AS t FROM benchmark))),
p AS (SELECT item_id, i, {S.strip('part')} AS part, j FROM (SELECT item_id, i, unnest(string_split(line, ',')) AS part, generate_subscripts(string_split(line, ','), 1) AS j FROM l))
SELECT item_id, count(*) AS n, string_agg(part, '|' ORDER BY i, j) AS items FROM p WHERE part <> '' GROUP BY item_id""")
def list_items(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.list_items(F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit("\n* ")))).alias("x"))
    return rows.select("item_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("items"))


@query(f"""WITH s AS (SELECT conv_id, turn, regexp_extract(text, '^([^\\n]+?[.!?])[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]', 1) AS f, text FROM conversations)
SELECT conv_id, turn, {S.strip("CASE WHEN f <> '' THEN f ELSE substr(text, 1, 200) END")} AS context FROM s""")
def heuristic_context(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.first_sentence(F.col("text")).alias("context"))


@query(f"WITH {S.TURNS} SELECT turn_id, replace(replace(turn_id, ':', '__'), '/', '_') AS key FROM turns UNION ALL SELECT url, replace(replace(url, ':', '__'), '/', '_') FROM pages")
def artifact_key(spark, sf_dir):
    turns = _turns(spark, sf_dir)[0].select("turn_id").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("turn_id")))
    return turns.select("turn_id", text.path_key(F.col("turn_id")).alias("key"))


@query("SELECT doc_id, sha256('{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS fingerprint FROM documents")
def sha_fingerprint(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.sha2(F.to_json(F.struct(F.col("doc_id").alias("id"), "lang")), 256).alias("fingerprint"))


@query(f"WITH {S.TURNS} SELECT turn_id, len({S.tokens('text')})::BIGINT AS n_tokens, len(list_distinct({S.tokens('text')}))::BIGINT AS n_distinct, len({S.words('text')})::BIGINT AS n_words, coalesce({S.tokens('text')}[1], '') AS first_token FROM turns")
def token_lists(spark, sf_dir):
    turns = _turns(spark, sf_dir)[0]
    found = turns.select("turn_id", text.tokens(F.col("text")).alias("t"), text.words(F.col("text")).alias("w"))
    return found.select("turn_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size("w").cast("long").alias("n_words"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


@query(f"""WITH {S.TURNS}, t AS (SELECT turn_id, '```json' || chr(10) || '{{"answer": "' || speaker || '"}}' || chr(10) || '```' AS r FROM turns) SELECT turn_id, regexp_extract(r, '"answer": "([^"]*)"', 1) AS answer FROM t""")
def fenced_json_answer(spark, sf_dir):
    """The answer in a completion that is JSON within code fences."""
    raw = F.concat(F.lit('```json\n{"answer": "'), "speaker", F.lit('"}\n```'))
    clean = text.without_fences(raw)
    return _turns(spark, sf_dir)[0].select("turn_id", F.coalesce(F.get_json_object(clean, "$.answer"), text.strip(raw)).alias("answer"))


@query(f"WITH {S.TURNS} SELECT sample_id, count(*) AS n, sum(CASE WHEN evidence IN (SELECT record_id FROM records) THEN 1 ELSE 0 END)::BIGINT AS found FROM questions GROUP BY sample_id")
def evidence_recall_base(spark, sf_dir):
    """Questions whose evidence is a record: what a recall metric starts from."""
    _, records, q = _turns(spark, sf_dir)
    hit = q.select("sample_id", F.explode("evidence_ids").alias("record_id")).join(records.select("record_id", F.lit(1).alias("hit")), "record_id", "left")
    return hit.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


# ---- usage over time


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type AS source, count(*) AS calls, round(sum(value), 2) AS latency_ms FROM events GROUP BY 1, 2""")
def usage_tumbling(spark, sf_dir):
    from strandmill.streaming import usage

    return usage.tumbling(usage.events(spark, sf_dir), "6 hours")


@query("""SELECT s AS start, event_type AS source, count(*) AS calls, round(sum(value), 2) AS latency_ms
FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def usage_sliding(spark, sf_dir):
    from strandmill.streaming import usage

    return usage.sliding(usage.events(spark, sf_dir), "12 hours", "6 hours")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS calls, round(sum(value), 2) AS latency_ms FROM s GROUP BY user_id, n""")
def usage_session(spark, sf_dir):
    from strandmill.streaming import usage

    return usage.sessions(usage.events(spark, sf_dir), "6 hours")


# ---- note building: serial folds and ordered rules, held against plain Python in the tests


@query()
def graph_memory_fold(spark, sf_dir):
    """Notes of every conversation, built turn by turn by a deterministic model."""
    from strandmill.operators import construct

    turns = _turns(spark, sf_dir)[0]
    notes = construct.enriched(construct.build_notes(turns, construct.rule_model), turns)
    return notes.select("sample_id", "record_id", "pos", "context", F.array_join("keywords", ",").alias("keywords"), F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"), "completions", "failures", "speaker")


@query()
def graph_memory_qa(spark, sf_dir):
    """Questions over built notes: ranked, expanded by one hop, context in graph form, answered and scored."""
    from strandmill.operators import construct

    turns, _, q = _turns(spark, sf_dir)
    # Built once: ranking, links, expansion and contexts all read notes.
    notes = ranking.written(construct.build_notes(turns, construct.rule_model).select("sample_id", "record_id", "pos", "text", "context", "keywords", "tags", "links"))
    items = retrieve(q, notes.select("sample_id", "record_id", "pos", "text"), [Stage("bm25", 2)]).candidates
    both = graph.expand(items, notes.select("sample_id", "record_id", F.posexplode("links").alias("link_pos", "target_id")), notes)
    lines = context.graph_lines(F.lit(""), F.col("text"), F.col("context"), F.col("keywords"), F.col("tags"))
    ctx = context.joined(both.join(notes.drop("sample_id"), "record_id"), lines)
    return q.join(ctx, "question_id").select("question_id", "context_text", F.array_join("item_ids", ",").alias("item_ids"), F.round(metrics.f1(F.col("context_text"), F.col("reference")), 6).alias("f1"))


@query()
def keyword_pruning(spark, sf_dir):
    """All words of a turn as candidates; the modes without stems have SQL in keyword_pruning_simple."""
    from strandmill.functions import keywords

    turns = _turns(spark, sf_dir)[0]
    given = F.array_distinct(F.split("text", " "))
    return turns.select("turn_id", *(F.array_join(keywords.pruned(F.col("text"), given, m), ",").alias(m) for m in ("none", "simple", "nltk")))


@query()
def porter_stems(spark, sf_dir):
    from strandmill.functions import keywords

    words = _turns(spark, sf_dir)[0].select(F.explode(text.ascii_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", keywords.stemmed(F.col("word")).alias("stem"))


from strandmill.plans import note_queries, run_queries  # noqa: E402, F401  register their queries too
