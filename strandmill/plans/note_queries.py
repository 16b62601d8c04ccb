"""Queries over dialogues as files, stores, failures, default plans, and what completions say; each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import keywords, metrics, parsers, text, treebank
from strandmill.functions import vocabulary as V
from strandmill.operators import analytics, construct, context, graph, ranking, selection
from strandmill.plans import sqltext as S
from strandmill.plans.catalogue import _ASKED, _KEY, _NOTE, _asked, _notes, _turns, query, r6
from strandmill.plans.stages import Stage, build_reranker, candidate_rows, default_stages, finished, retrieve
from strandmill.sources import artifacts, dialogues, indexes

# ---- dialogues as the file has them: sessions out of order, missing ids and dates, captions, categories


def _samples(spark, sf_dir) -> DataFrame:
    """sample_pos, conversation, qa of every conversation: even turns are session 2, odd ones session 10."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct("turn", "role", "text")
    place = F.struct(F.col("role").alias("speaker"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("D"), F.when(F.col("turn") % 2 == 0, "2").otherwise("10"), F.lit(":x"), F.col("turn").cast("string"))).alias("dia_id"), "text", F.when(F.col("turn") % 4 == 0, F.col("role")).alias("blip_caption"))
    asked = F.struct(
        F.col("text").alias("question"), F.when(F.col("turn") % 7 > 0, F.concat(F.lit("a"), F.col("turn").cast("string"))).alias("answer"), F.when(F.col("turn") % 4 == 0, F.lit("adv")).alias("adversarial_answer"),
        F.when(F.col("turn") % 6 > 0, (F.col("turn") % 6).cast("string")).alias("category"), F.when(F.col("turn") % 5 > 0, F.array(F.lit("D1:1"))).alias("evidence"),
    )
    each = rows.select("conv_id", "turn", turn.alias("o"), place.alias("p"), F.when(F.col("role") == "user", asked).alias("q"))
    listed = lambda column, only: F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("o", F.col(column).alias("x"))))), lambda z: z["x"])
    held = each.groupBy("conv_id").agg(listed("p", F.col("turn") % 2 == 0).alias("two"), listed("p", F.col("turn") % 2 == 1).alias("ten"), listed("q", F.col("q").isNotNull()).alias("qa"))
    return held.select(F.col("conv_id").alias("sample_pos"), F.create_map(F.lit("speaker_a"), F.lit("user"), F.lit("session_10"), F.to_json("ten"), F.lit("session_2_date_time"), F.lit("1 Jan 2026"), F.lit("session_2"), F.to_json("two")).alias("conversation"), "qa")


@query(f"""WITH s AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 2 ELSE 10 END AS n FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY turn, role, text) AS k FROM s),
e AS (SELECT *, CASE WHEN turn % 3 > 0 THEN 'D' || n || ':x' || turn ELSE 'D' || n || ':' || k END AS evidence_id FROM k)
SELECT 'talk:' || conv_id AS sample_id, evidence_id, 'talk:' || conv_id || ':turn:' || evidence_id AS turn_id, role AS speaker, {S.strip("CASE WHEN turn % 4 = 0 THEN '[Image: ' || role || '] ' ELSE '' END || coalesce(text, '')")} AS text,
n::VARCHAR AS session_id, CASE WHEN n = 2 THEN '1 Jan 2026' END AS timestamp, row_number() OVER (PARTITION BY conv_id ORDER BY n, k) - 1 AS turn_pos FROM e""")
def dialogue_turns(spark, sf_dir):
    return dialogues.parse(spark, _samples(spark, sf_dir), "talk")["turns"]


@query("""WITH q AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS p FROM conversations WHERE role = 'user')
SELECT 'talk:' || conv_id AS sample_id, 'talk:' || conv_id || ':' || p AS question_id, p AS question_pos, text AS question,
CASE WHEN turn % 6 = 5 THEN CASE WHEN turn % 4 = 0 THEN 'adv' ELSE 'None' END ELSE CASE WHEN turn % 7 > 0 THEN 'a' || turn ELSE '' END END AS reference, CASE WHEN turn % 5 > 0 THEN 'D1:1' ELSE '' END AS evidence,
CASE turn % 6 WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open_domain' WHEN 4 THEN 'single_hop' WHEN 5 THEN 'adversarial' END AS label FROM q""")
def dialogue_questions(spark, sf_dir):
    found = dialogues.parse(spark, _samples(spark, sf_dir), "talk")["questions"]
    return found.select("sample_id", "question_id", "question_pos", "question", "reference", F.array_join("evidence_ids", ",").alias("evidence"), F.get(F.col("labels")["question_type"], F.lit(0)).alias("label"))


# ---- tables that are written and read again


@query(f"WITH {S.TURNS} SELECT turn_id, text, turn_pos FROM turns")
def row_file_round_trip(spark, sf_dir):
    """Rows as JSON lines."""
    place = artifacts.scratch(spark, "rows")
    _turns(spark, sf_dir)[0].select("turn_id", "text", "turn_pos").write.json(place)
    return artifacts.read_rows(spark, place, "turn_id string, text string, turn_pos long")


@query(f"""WITH {S.TURNS}, t AS (SELECT sample_id, record_id, {S.tokens('text')} AS ts FROM records), p AS (SELECT sample_id, record_id, unnest(ts) AS term, len(ts) AS dl FROM t), g AS (SELECT sample_id, record_id, term, dl, count(*) AS tf FROM p GROUP BY ALL)
SELECT sample_id, record_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, max(dl)::BIGINT AS dl, max(tf)::BIGINT AS most FROM g GROUP BY ALL""")
def text_index_round_trip(spark, sf_dir):
    place = artifacts.scratch(spark, "index")
    indexes.save_text_index(_turns(spark, sf_dir)[1], place)
    return indexes.load_index(spark, place, "postings").groupBy("sample_id", "record_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("dl").cast("long").alias("dl"), F.max("tf").alias("most"))


@query("SELECT vec_id, len(embedding)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_index_round_trip(spark, sf_dir):
    place = artifacts.scratch(spark, "index")
    indexes.save_vector_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector"), place, keys=("vec_id",))
    held = indexes.load_index(spark, place, "vectors")
    return held.select("vec_id", F.size("vector").cast("long").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query(f"""WITH {S.TURNS}, {S.LINKS}, n AS (SELECT sample_id, count(*) AS n FROM records GROUP BY 1), e AS (SELECT sample_id, count(*) AS e, count(*) FILTER (WHERE target_id NOT IN (SELECT record_id FROM records)) AS dangling FROM resolved GROUP BY 1)
SELECT sample_id, n AS records, n AS nodes, coalesce(e, 0) AS edges, coalesce(dangling, 0) AS dangling, 1::BIGINT AS layers, 'private/' || sample_id AS ref, 'graph' AS method FROM n LEFT JOIN e USING (sample_id)""")
def store_round_trip(spark, sf_dir):
    """All tables of a note store written and read: dangling edges stay, the header has private refs and metadata."""
    notes = _notes(_turns(spark, sf_dir)[1])
    place, edges = artifacts.scratch(spark, "store"), graph.edges(graph.resolve_links(notes))
    header = notes.select("sample_id").distinct().select("sample_id", F.lit("store/v1").alias("schema_version"), F.create_map(F.lit("index"), F.concat(F.lit("private/"), "sample_id")).alias("private_refs"), F.create_map(F.lit("method"), F.lit("graph")).alias("metadata"))
    artifacts.write_store(place, {"records": notes, "nodes": graph.nodes(notes), "edges": edges, "layers": graph.layers(notes, edges), "stores": header})
    back = artifacts.read_store(spark, place)
    count = lambda frame, name: frame.groupBy("sample_id").agg(F.count("*").alias(name))
    lost = back["edges"].join(back["nodes"].select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    out = back["stores"].select("sample_id", F.col("private_refs")["index"].alias("ref"), F.col("metadata")["method"].alias("method"))
    for frame, name in ((back["records"], "records"), (back["nodes"], "nodes"), (back["edges"], "edges"), (lost, "dangling"), (back["layers"], "layers")):
        out = out.join(count(frame, name), "sample_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


@query(f"WITH {S.TURNS}, {_NOTE} SELECT sample_id, record_id AS node_id, 'amem_note' AS type, text, 'amem_notes' AS layer, context, kw AS keywords, pos FROM note")
def graph_nodes(spark, sf_dir):
    found = graph.nodes(_notes(_turns(spark, sf_dir)[1]))
    return found.select("sample_id", "node_id", "type", "text", "layer", "properties.context", F.array_join("properties.keywords", ", ").alias("keywords"), "pos")


@query(f"WITH {S.TURNS} SELECT turn_id AS record_id, speaker, '1' AS session_id, evidence_id AS evidence FROM turns")
def note_provenance(spark, sf_dir):
    """Notes with speaker, session and evidence of their turns; one without a turn would be an error."""
    turns, records, _ = _turns(spark, sf_dir)
    found = construct.enriched(records.select("sample_id", "record_id"), turns)
    return found.select("record_id", "speaker", "session_id", F.array_join("evidence_refs", ",").alias("evidence"))


# ---- failures and results


@query(f"WITH {S.TURNS} SELECT 'retrieve_qa' AS stage, sample_id, question_id, 'FileNotFoundError' AS type, 'No construction store available for sample ''' || sample_id || '''' AS message, true AS retryable FROM questions WHERE split_part(sample_id, ':', 2)::BIGINT % 4 = 1")
def error_rows(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    return analytics.errors(selection.failed_rows(q, records.where(F.split("sample_id", ":")[1].cast("long") % 4 != 1)))


_TREE = {
    "experiment": {"id": "queries"},
    "pipeline": {
        "stages": ["retrieve_qa"], "dataset": {"adapter": "locomo", "path": "none"},
        "retrieve_qa": {"memory_source": {"experiment_id": "other"}, "retrieval": {"adapter": "staged", "stages": [{"adapter": "bm25", "top_k": 2}]}, "context": {"adapter": "records", "fields": ["timestamp", "speaker", "content"]}, "qa": {"adapter": "extractive"}, "metrics": [{"adapter": "exact_match"}, {"adapter": "f1"}]},
    },
}


@query(f"""WITH {S.TURNS}, h AS (SELECT * FROM records WHERE split_part(sample_id, ':', 2)::BIGINT % 4 <> 1), able AS (SELECT * FROM questions WHERE sample_id IN (SELECT sample_id FROM h)), asked AS (SELECT sample_id, question_id, question AS query FROM able), {S.bm25('b', 'asked', 'h', 'sample_id')}, t AS ({S.topk('b', 2)}),
ctx AS (SELECT question_id, string_agg(r.speaker || CASE WHEN r.text = '' THEN '' ELSE ' | ' || r.text END, chr(10) ORDER BY rank) AS c, string_agg(record_id, ',' ORDER BY rank) AS item_ids FROM t JOIN h r USING (record_id) GROUP BY question_id),
a AS (SELECT q.question_id, reference, c, item_ids, split_part(c, chr(10), 1) AS prediction FROM able q JOIN ctx USING (question_id))
SELECT question_id, 'completed' AS status, prediction, item_ids, {S.exact('prediction', 'reference')} AS exact_match, round({S.f1('prediction', 'reference')}, 6) AS f1, NULL AS message FROM a
UNION ALL SELECT question_id, 'failed', '', '', NULL, NULL, 'No construction store available for sample ''' || sample_id || '''' FROM questions WHERE sample_id NOT IN (SELECT sample_id FROM h)""")
def experiment_answers(spark, sf_dir):
    """What a run writes as results: answered questions, and failed ones of samples without a store."""
    from strandmill.plans.config import validated
    from strandmill.plans.experiment import Runner, Work
    from strandmill.sources.files import Place

    _, records, q = _turns(spark, sf_dir)
    runner = Runner(spark, validated(_TREE))
    work = Work(Place(artifacts.scratch(spark, "answers"), spark))
    rows, _ = runner._answers(runner.tree["pipeline"]["retrieve_qa"], q, records.where(F.split("sample_id", ":")[1].cast("long") % 4 != 1), work)
    return rows.select("question_id", "status", "prediction", F.array_join("item_ids", ",").alias("item_ids"), F.col("metrics")["exact_match"].alias("exact_match"), F.round(F.col("metrics")["f1"], 6).alias("f1"), F.get("errors", F.lit(0))["message"].alias("message"))


_COMPONENTS = """VALUES ('chunker', 'turn'), ('construction', 'amem'), ('construction', 'turn_rag'), ('context', 'amem'), ('context', 'records'), ('dataset', 'locomo'), ('llm_provider', 'fake'), ('llm_provider', 'ollama'), ('llm_provider', 'openai'),
('llm_provider', 'sglang'), ('llm_provider', 'vllm'), ('metric', 'bleu1'), ('metric', 'exact_match'), ('metric', 'f1'), ('qa', 'extractive'), ('qa', 'robust'), ('retrieval', 'staged'), ('retrieval_stage', 'bm25'), ('retrieval_stage', 'cross_encoder'),
('retrieval_stage', 'embedding'), ('retrieval_stage', 'embedding_rerank'), ('retrieval_stage', 'limit'), ('retrieval_stage', 'query_transform')"""


@query(f"""WITH c AS (SELECT * FROM ({_COMPONENTS}) t(family, name)), w AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct({S.tokens("coalesce(text, '')")})) AS w FROM documents) GROUP BY w)
SELECT family, name, coalesce(n, 0)::BIGINT AS documents FROM c LEFT JOIN w ON w = name""")
def component_names(spark, sf_dir):
    """The names that experiment files may use, and how many documents mention each."""
    from strandmill.plans.registry import public_names

    names = spark.createDataFrame([(family, name) for family, names in public_names().items() for name in names], "family string, name string")
    # Only words that are names leave a row, so a text's other words are neither sorted nor shuffled; explode_outer, as explode would tokenise once more.
    known = F.array(*(F.lit(name) for name in sorted({name for found in public_names().values() for name in found})))
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode_outer(F.array_intersect(text.tokens(F.col("text")), known)).alias("name")).where("name IS NOT NULL")
    return names.join(words.groupBy("name").agg(F.count("*").alias("documents")), "name", "left").select("family", "name", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


# ---- default plans


_WIDE = f"{S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 5)}), p AS (SELECT t.question_id, t.record_id, t.rank AS prior, round({S.f1('q.question', 'r.text')}, 9) AS score FROM t JOIN questions q USING (question_id) JOIN records r ON r.record_id = t.record_id)"


@query(f"WITH {S.TURNS}, {_ASKED}, {_WIDE}, u AS ({S.topk('p', 3)}) SELECT question_id, record_id, rank FROM u WHERE rank <= 2")
def default_plan_final_k(spark, sf_dir):
    """Candidates by text, re-ranked; of the three that are left the first two."""
    _, records, q = _turns(spark, sf_dir)
    stages = default_stages(3, "bm25", reranker=build_reranker("cross_encoder", metrics.f1), rerank_top_n=5)
    return finished(retrieve(q, records, stages), 2).select("question_id", "record_id", "rank")


@query(f"WITH {S.TURNS}, {_ASKED}, {_WIDE}, u AS ({S.topk('p', 3, 'score DESC, prior')}) SELECT question_id, record_id, rank, prior, round(score, 6) AS score FROM u")
def rerank_pairs_prior_ties(spark, sf_dir):
    """Ties keep the order that the candidates came in."""
    _, records, q = _turns(spark, sf_dir)
    first = ranking.bm25_topk(_asked(q), records.drop("pos"), 5, scope=["sample_id"]).select("question_id", "record_id", "rank")
    return ranking.rerank_pairs(first, _asked(q), records, metrics.f1, 3).select("question_id", "record_id", "rank", "prior", r6("score"))


@query(f"""WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 3)})
SELECT question_id, record_id AS memory_id, r.pos AS memory_index, r.text, round(t.score, 6) AS score, rank AS first_rank, rank AS last_rank, 'limit:1' AS source_stage, 2::INT AS steps, 1::INT AS scored FROM t JOIN records r USING (record_id) WHERE rank <= 2""")
def candidate_records(spark, sf_dir):
    _, records, q = _turns(spark, sf_dir)
    found = candidate_rows(retrieve(q, records, [Stage("bm25", 3), Stage("limit", 2)]))
    return found.select("question_id", "memory_id", "memory_index", "text", F.round(F.col("scores")["bm25:0"], 6).alias("score"), F.col("ranks")["bm25:0"].alias("first_rank"), F.col("ranks")["limit:1"].alias("last_rank"), "source_stage", F.size("stage_trace").alias("steps"), F.size("scores").alias("scored"))


@query(f"""WITH {S.TURNS}, {_NOTE} SELECT record_id, 'content:' || text || ' context:' || context || ' keywords: ' || kw || ' tags: ' || tags AS add_document, text || ' , ' || context || ' ' || speaker || ' turn ' || tags AS rebuild_document, kw AS hybrid_document FROM note""")
def legacy_documents(spark, sf_dir):
    parts = (F.col("content"), F.col("context"), F.col("keywords"), F.col("tags"))
    return _notes(_turns(spark, sf_dir)[1]).select("record_id", *(context.legacy_document(kind, *parts).alias(f"{kind}_document") for kind in ("add", "rebuild", "hybrid")))


# ---- what completions say


_LINE = "regexp_replace(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g'), ':', '', 'g')"


def _line():
    """A turn's text in one line."""
    return F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s]+", " "), F.lit(":"), F.lit(""))


@query(f"""WITH {S.TURNS}, l AS (SELECT turn_id, {_LINE} AS x FROM turns), p AS (SELECT turn_id, i, {_KEY.format('part')} AS k FROM (SELECT turn_id, unnest(regexp_split_to_array(x, '[ ,]+')) AS part, generate_subscripts(regexp_split_to_array(x, '[ ,]+'), 1) AS i FROM l)),
f AS (SELECT turn_id, k, min(i) AS i FROM p WHERE k <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY i) AS n FROM f), k AS (SELECT turn_id, string_agg(k, '|' ORDER BY n) AS ks FROM r WHERE n <= 5 GROUP BY 1)
SELECT turn_id, ks AS keywords, {S.strip('x')} AS context, 'one|two' AS tags FROM l JOIN k USING (turn_id)""")
def parsed_analysis(spark, sf_dir):
    """Keywords, context and tags of a completion in sections; the keywords are all words of the turn."""
    line = _line()
    reply = F.concat(F.lit("KEYWORDS: "), F.regexp_replace(line, "[ ,]+", ", "), F.lit("\nCONTEXT: "), line, F.lit("\nTAGS:\n- one\n- 'two'"))
    found = keywords.through("keywords array<string>, context string, tags array<string>", lambda r, c: parsers.analysis(r, c, "none"), reply, F.col("text"))
    return _turns(spark, sf_dir)[0].select("turn_id", found.alias("a")).select("turn_id", F.array_join("a.keywords", "|").alias("keywords"), "a.context", F.array_join("a.tags", "|").alias("tags"))


@query(f"""WITH {S.TURNS} SELECT turn_id, CASE turn_pos % 7 WHEN 0 THEN 'STRENGTHEN' WHEN 1 THEN 'NO_EVOLUTION' WHEN 2 THEN 'STRENGTHEN_AND_UPDATE' WHEN 3 THEN 'UPDATE_NEIGHBOR' WHEN 4 THEN 'STRENGTHEN_AND_UPDATE' WHEN 5 THEN 'UPDATE_NEIGHBOR' ELSE 'NO_EVOLUTION' END AS decision,
CASE turn_pos % 7 WHEN 0 THEN speaker WHEN 2 THEN 'r' ELSE '' END AS reason FROM turns""")
def parsed_decisions(spark, sf_dir):
    """Named, inferred and absent decisions, in text and as objects."""
    replies = [
        F.concat(F.lit("DECISION: strengthen\nREASON: "), "speaker"), F.lit("DECISION: NO EVOLUTION"), F.lit("REASON: r\nDECISION: strengthen_and_update"), F.lit("DECISION: maybe\nan update of some neighbor"),
        F.lit('{"should_evolve": true, "actions": ["strengthen", "update_neighbor"]}'), F.lit('```json\n{"should_evolve": true, "actions": ["update_neighbor"]}\n```'), F.lit('{"thoughts": "none"}'),
    ]
    reply = F.get(F.array(*replies), (F.col("turn_pos") % 7).cast("int"))
    found = keywords.through("decision string, reason string", parsers.decision, reply)
    return _turns(spark, sf_dir)[0].select("turn_id", found.alias("d")).select("turn_id", "d.decision", "d.reason")


@query(f"""WITH {S.TURNS} SELECT turn_id, CASE turn_pos % 3 WHEN 0 THEN '0|' || turn_pos WHEN 1 THEN '1|2' ELSE turn_pos::VARCHAR END AS connections, CASE turn_pos % 3 WHEN 2 THEN '' ELSE speaker || '|seen' END AS tags FROM turns""")
def parsed_links(spark, sf_dir):
    """Whole numbers among connections; the older kind of object has other names."""
    pos = F.col("turn_pos").cast("string")
    replies = [
        F.concat(F.lit("CONNECTIONS: 0, x, "), pos, F.lit(", 2.5\nTAGS: "), "speaker", F.lit(", seen")), F.concat(F.lit('{"suggested_connections": [1, 2.0, "3"], "tags_to_update": ["'), "speaker", F.lit('", "seen"]}')),
        F.concat(F.lit("1. thoughts\nCONNECTIONS:\n- "), pos, F.lit("\n- none")),
    ]
    found = keywords.through("connections array<long>, tags array<string>", parsers.strengthening, F.get(F.array(*replies), (F.col("turn_pos") % 3).cast("int")))
    return _turns(spark, sf_dir)[0].select("turn_id", found.alias("s")).select("turn_id", F.array_join(F.col("s.connections").cast("array<string>"), "|").alias("connections"), F.array_join("s.tags", "|").alias("tags"))


@query(f"""WITH {S.TURNS}, v AS (SELECT turn_id, speaker, turn_pos, k FROM turns, (VALUES (0), (1), (2)) n(k))
SELECT turn_id, k, CASE WHEN turn_pos % 2 = 0 THEN CASE k WHEN 0 THEN speaker WHEN 2 THEN 'two' ELSE '' END ELSE CASE k WHEN 0 THEN 'c' || turn_pos ELSE '' END END AS context,
CASE WHEN turn_pos % 2 = 0 THEN CASE k WHEN 0 THEN 'a|b|neighbor 2:' ELSE '' END ELSE CASE k WHEN 0 THEN 't' WHEN 1 THEN 'u|v' ELSE '' END END AS tags FROM v""")
def parsed_updates(spark, sf_dir):
    """Three blocks, whatever is missing. A block ends where the next number begins, so without a block 1 block 0 takes in the header of block 2."""
    text_reply = F.concat(F.lit("NEIGHBOR 0:\nCONTEXT: "), "speaker", F.lit("\nTAGS: a, b\nneighbor 2:\nCONTEXT: two"))
    as_object = F.concat(F.lit('{"new_context_neighborhood": ["c'), F.col("turn_pos").cast("string"), F.lit('"], "new_tags_neighborhood": [["t"], ["u", "v"]]}'))
    found = keywords.through("blocks array<struct<context:string,tags:array<string>>>", lambda r: {"blocks": parsers.neighbour_updates(r, 3)}, F.when(F.col("turn_pos") % 2 == 0, text_reply).otherwise(as_object))
    rows = _turns(spark, sf_dir)[0].select("turn_id", F.posexplode(found["blocks"]).alias("k", "b"))
    return rows.select("turn_id", "k", "b.context", F.array_join("b.tags", "|").alias("tags"))


@query(f"WITH {S.TURNS} SELECT turn_id, CASE WHEN turn_pos % 2 = 0 THEN speaker ELSE 'plain ' || speaker END AS answer, CASE WHEN turn_pos % 2 = 0 THEN speaker ELSE '' END AS inner_answer, '|0|' AS blank FROM turns")
def completion_objects(spark, sf_dir):
    """A field of an object or the whole text; the object between the outermost braces; an empty object of a schema."""
    fenced = F.concat(F.lit('```json\n{"answer": "'), "speaker", F.lit('"}\n```'))
    loose = F.concat(F.lit('Sure: {"answer": "'), "speaker", F.lit('"} as asked'))
    schema = {"properties": {"answer": {"type": "string"}, "n": {"type": "integer"}, "tags": {"type": "array"}}}
    even = F.col("turn_pos") % 2 == 0

    def read(reply, other):
        blank = parsers.empty_object(schema)
        return {"answer": parsers.field_or_text(reply, "answer"), "inner_answer": parsers.outer_object(other).get("answer", ""), "blank": f"{blank['answer']}|{blank['n']}|{''.join(blank['tags'])}"}

    found = keywords.through("answer string, inner_answer string, blank string", read, F.when(even, fenced).otherwise(F.concat(F.lit(" plain "), "speaker", F.lit("\n"))), F.when(even, loose).otherwise(F.lit("no braces")))
    return _turns(spark, sf_dir)[0].select("turn_id", found.alias("o")).select("turn_id", "o.*")


_IN = lambda words: ", ".join(f"'{w}'" for w in sorted(words))


@query(f"""WITH {S.TURNS}, l AS (SELECT turn_id, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS known, string_split(text, ' ') AS given FROM turns),
d AS (SELECT DISTINCT turn_id, low, known, {_KEY.format('g')} AS k FROM (SELECT turn_id, low, known, unnest(given) AS g FROM l)),
c AS (SELECT *, regexp_extract_all(k, '[a-z0-9]+') AS parts FROM d WHERE k <> ''),
e AS (SELECT *, list_filter(parts, lambda w: w NOT IN ({_IN(V.FILTERED)})) AS core, len(list_filter(parts, lambda w: ends_with(w, 'says') OR w IN ({_IN(V.BARRED)}))) AS barred FROM c),
u AS (SELECT * FROM e WHERE len(core) > 0 AND barred = 0 AND NOT (len(core) = 1 AND core[1] IN ({_IN(V.GENERIC)})) AND (len(known) = 0 OR list_has_all(known, core))),
x AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.turn_id = u.turn_id AND (len(o.core) > len(u.core) OR len(o.core) = len(u.core) AND o.k < u.k) AND len(list_distinct(o.core)) > len(list_distinct(u.core)) AND list_has_all(o.core, u.core))),
s AS (SELECT turn_id, k, list_sum(list_transform(core, lambda w: (length(low) - length(replace(low, w, ''))) / length(w))) AS n, least(len(core), 3) AS words,
coalesce(list_min(list_filter(list_transform(core, lambda w: strpos(low, w)), lambda z: z > 0)) - 1, length(low) + 1) AS place_at FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY n DESC, words DESC, place_at, k) AS place FROM s)
SELECT turn_id, coalesce(string_agg(r.k, '|' ORDER BY place) FILTER (WHERE place <= 5), '') AS keywords FROM l LEFT JOIN r USING (turn_id) GROUP BY turn_id""")
def keyword_pruning_simple(spark, sf_dir):
    """All words of a turn as candidates: barred ones go, parts of longer ones go, the most frequent, longest and earliest stay."""
    found = keywords.pruned(F.col("text"), F.split("text", " "), "simple")
    return _turns(spark, sf_dir)[0].select("turn_id", F.array_join(found, "|").alias("keywords"))


@query(f"WITH {S.TURNS} SELECT turn_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w IN ({_IN(V.FILTERED)})))::BIGINT AS filtered FROM turns")
def ascii_words_filtered(spark, sf_dir):
    found = _turns(spark, sf_dir)[0].select("turn_id", text.ascii_tokens(F.col("text")).alias("t"))
    return found.select("turn_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", lambda w: w.isin(*sorted(V.FILTERED)))).cast("long").alias("filtered"))


# ---- tokens of the Treebank, full folding, notes by one completion


@query(f"SELECT doc_id, len(ts)::BIGINT AS n, array_to_string(ts, '|') AS tokens FROM (SELECT doc_id, {treebank.sql('text')} AS ts FROM documents)")
def treebank_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", treebank.tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n"), F.array_join("ts", "|").alias("tokens"))


#: Characters that the texts get, as the given tables have few that fold to others.
_ODD = "ŉ ﬁn ὒΐ ſt µ ς ẛ ﬗ ǰ և"


def _folded_sql(text: str) -> str:
    out = f"translate(lower({text}), '{''.join(c for c, to in F_FOLDS if len(to) == 1)}', '{''.join(to for _, to in F_FOLDS if len(to) == 1)}')"
    for c, to in F_FOLDS:
        out = f"replace({out}, '{c}', '{to}')" if len(to) > 1 else out
    return out


F_FOLDS = [(c, to) for c, to in text.FOLDS.items() if c in _ODD + "ß"]


@query(f"WITH {S.TURNS} SELECT turn_id, {_folded_sql(f"'{_ODD} ' || text")} AS folded FROM turns")
def folded_texts(spark, sf_dir):
    """Full case folding of turns, each with some characters before it that fold to others."""
    return _turns(spark, sf_dir)[0].select("turn_id", text.fold(F.concat(F.lit(f"{_ODD} "), "text")).alias("folded"))


@query()
def schema_memory_fold(spark, sf_dir):
    """Notes of every conversation by one object for each note, from a model that goes by rules; held against a plain version in the tests."""
    from strandmill.operators import schema_fold
    from strandmill.plans.standins import letter_counts, schema_model

    notes = schema_fold.build_notes(_turns(spark, sf_dir)[0], schema_model, lambda: letter_counts, evolution_threshold=3)
    return notes.select("sample_id", "record_id", "pos", "context", F.array_join("keywords", ",").alias("keywords"), F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"), "completions", "error")
