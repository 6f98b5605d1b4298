"""Queries of the retrieval, chunking and evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.config import RetrievalConfig
from marram.engine import Engine
from marram.functions import text as T
from marram.functions.packer import greedy
from marram.operators import code_chunker, dense, evaluate, fusion, generate, lexical
from marram.operators.ranking import spread
from marram.sources import files
from marram.sources.tables import table
from marram.storage import scratch

C = RetrievalConfig()
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


# ---- inputs -------------------------------------------------------------------------


def corpus(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """``doc, text, id, source, file, method`` of stored chunks with a content; doc is the storage order."""
    c = table(spark, root, "chunks").where("content is not null").select(
        F.col("chunk_no").alias("doc"),
        F.col("content").alias("text"),
        "id",
        F.lower(F.trim("source")).alias("source"),
        generate.citation(F.col("source"), F.col("metadata.file_path"), F.col("metadata.file")).alias("file"),
        F.col("metadata.section").alias("section"),
        F.col("metadata.method").alias("method"),
        F.col("metadata.start_line").alias("start_line"),
        F.col("metadata.end_line").alias("end_line"),
    )
    return c if source is None else c.where(F.col("source") == source)


_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, root: str) -> Engine:
    """The engine over the stored chunks; queries of one application share its indexes and vectors."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(corpus(spark, root), C)
    return _ENGINES[key]


def asked(spark: SparkSession, root: str) -> DataFrame:
    """``query_id, query, category`` of the docs benchmark; repeated rows once, null queries left out."""
    q = table(spark, root, "retrieval_questions").where("query is not null")
    return q.groupBy(F.col("id").alias("query_id")).agg(F.min("query").alias("query"), F.min("category").alias("category"))


def judged(spark: SparkSession, root: str) -> DataFrame:
    """``query_id, id``: references of the docs benchmark, each once."""
    q = table(spark, root, "retrieval_questions").where("query is not null")
    return q.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("id")).where("id is not null").distinct()


_CORPUS = "corpus AS (SELECT chunk_no AS doc, content AS text, id, lower(trim(source)) AS source FROM chunks WHERE content IS NOT NULL)"
_ASKED = "asked AS (SELECT id AS query_id, min(query) AS query, min(category) AS category FROM retrieval_questions WHERE query IS NOT NULL GROUP BY id)"
_JUDGED = "judged AS (SELECT DISTINCT query_id, r AS id FROM (SELECT id AS query_id, unnest(relevant_chunk_ids) AS r FROM retrieval_questions WHERE query IS NOT NULL) WHERE r IS NOT NULL)"


def _terms(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({STOPS}))"


# ---- cleaning and parsing -----------------------------------------------------------


def word_count(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def slugify(spark, root):
    return table(spark, root, "documents").where("title is not null").select("doc_id", T.slug(F.col("title")).alias("slug"))


def clean_text(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    c = T.clean(F.regexp_replace("text", r"\r\n?", "\n"))
    return d.select("doc_id", F.md5(c).alias("cleaned_md5"), F.length(c).cast("long").alias("n_chars"))


def clean_cases(spark, root):
    """One small page for each rule of cleaning; the pages are the query's own table."""
    from marram.plans.cases import RAW

    d = spark.createDataFrame(list(RAW.items()), "id string, text string")
    return d.select("id", T.clean(T.body(F.col("text"))).alias("cleaned"))


def front_matter(spark, root):
    d = table(spark, root, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    m = T.front_matter_map(T.front_matter(F.col("text")))
    return d.select("doc_id", F.try_element_at(m, F.lit("title")).alias("title"), F.md5(T.body(F.col("text"))).alias("body_md5"))


def skip_filter(spark, root):
    c = table(spark, root, "chunks").where("content is not null")
    return c.where(T.keep_chunk(F.col("metadata.section"), F.col("content"))).select("chunk_no", "id")


#: A boilerplate text; which texts are noise is a parameter.
NOISE = ("This page assumes that the framework has been installed and that the sample project was created.",)


def noise_filter(spark, root):
    """Paragraphs that are boilerplate and nothing else, per chunk."""
    c = table(spark, root, "chunks").where("content is not null").select("chunk_no", F.explode(F.split("content", "\n\n")).alias("paragraph"))
    return c.where(T.is_noise(F.col("paragraph"), NOISE)).groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n_noise"))


def link_text(spark, root):
    lines = table(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    item = F.regexp_extract("line", r"^- (\[[^\]]+\]\([^)]*\))", 1)
    return lines.where(item != "").select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.link_text(item).alias("link_text"))


def dup_id_suffix(spark, root):
    """Chunk ids made unique within their file in storage order."""
    c = table(spark, root, "chunks").where("id is not null")
    w = Window.partitionBy("id").orderBy("chunk_no")
    n = F.row_number().over(w)
    return c.select("chunk_no", F.when(n > 1, F.concat("id", F.lit("-"), n.cast("string"))).otherwise(F.col("id")).alias("unique_id"))


def greedy_pack_parts(spark, root):
    """Lines of documents packed to 500 words, one row per part."""
    d = table(spark, root, "documents").where("text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    g = d.select("doc_id", F.posexplode(greedy(lines, C.max_words)).alias("part", "items"))
    return g.select("doc_id", (F.col("part") + 1).cast("long").alias("part"), F.size("items").cast("long").alias("n_lines"), T.word_count(F.array_join("items", "\n")).alias("n_words"))


def prev_next_links(spark, root):
    """Neighbours of code chunks within their method, from the index alone."""
    c = table(spark, root, "chunks").where("metadata.parent_id is not null and deleted_at is null").select(
        "chunk_no", "id", F.col("metadata.parent_id").alias("parent_id"), F.col("metadata.chunk_index").alias("chunk_index")
    )
    w = Window.partitionBy("parent_id").orderBy("chunk_index", "chunk_no")
    return c.select("chunk_no", "parent_id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def method_chunks(spark, root):
    """Chunks of the stored methods (Python stage; tested for cover, order and size)."""
    m = table(spark, root, "methods").where("content is not null").select("id", "name", "content", "start_line", "end_line", F.col("metadata.file").alias("file"))
    c = code_chunker.chunk_methods(spread(m))
    return c.select("id", "parent_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("n_chars"), "start_line", "end_line", "prev_chunk_id", "next_chunk_id")


def method_cover(spark, root):
    """What must hold of each method's chunks: together they are the method, none is too long, they are linked in order."""
    m = table(spark, root, "methods").where("content is not null").select(F.col("method_no").cast("string").alias("id"), "name", "content", "start_line", "end_line", F.col("metadata.file").alias("file"))
    c = code_chunker.chunk_methods(spread(m))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    n = lambda cond: F.count(F.when(cond, 1))
    return c.groupBy(F.col("parent_id").cast("long").alias("method_no")).agg(
        F.md5(whole).alias("content_md5"),
        n(F.length("content") > C.max_code_chars).alias("n_too_long"),
        n(F.col("prev_chunk_id").isNull()).alias("n_first"),
        n(F.col("next_chunk_id").isNull()).alias("n_last"),
        n(F.col("next_chunk_id") != F.concat_ws("::", "parent_id", (F.col("chunk_index") + 1).cast("string"))).alias("n_wrong_links"),
        F.min("start_line").cast("long").alias("first_line"),
        F.max("end_line").cast("long").alias("last_line"),
    )


def parsed_methods(spark, root):
    """Methods in source documents."""
    d = table(spark, root, "documents").where("source = 'source_code' and text is not null")
    m = code_chunker.parse_methods(d.select(F.col("path").alias("file"), F.col("text").alias("content")))
    return m.select("id", "name", "start_line", "end_line", F.length("content").cast("long").alias("n_chars"))


def document_chunks(spark, root):
    """Chunks of all Markdown documents."""
    from marram.operators.docs_chunker import chunk_documents

    d = table(spark, root, "documents").where("text is not null and not source <=> 'source_code'")
    body = T.clean(T.body(F.regexp_replace("text", r"\r\n?", "\n")))
    c = chunk_documents(d.select(F.col("doc_id").cast("string").alias("doc"), body.alias("content")))
    return c.select("doc", "id", "section", F.col("part").cast("long").alias("part"), T.word_count(F.col("content")).alias("n_words"))


def heading_sections(spark, root):
    """Documents by heading: id, title, path and text of each section."""
    from marram.operators.docs_chunker import split_sections

    d = table(spark, root, "documents").where("text <> ''")
    s = split_sections(d.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")))
    return s.select(F.col("doc").cast("long").alias("doc_id"), "id", "section", F.array_join("heading_path", " > ").alias("path"), F.md5("content").alias("content_md5"))


def chunker_cases(spark, root):
    """One small page for each rule of the page chunker, at twelve words a chunk; the pages are the query's own table."""
    from marram.operators.docs_chunker import chunk_documents
    from marram.plans.cases import PAGES, WORDS

    d = spark.createDataFrame(list(PAGES.items()), "doc string, content string")
    return chunk_documents(d, RetrievalConfig(max_words=WORDS)).select("id", "content", "section", "method", "event_component")


def code_cases(spark, root):
    """Methods of one small source file for each rule of the source parser."""
    from marram.plans.cases import SOURCES

    m = code_chunker.parse_methods(spark.createDataFrame(list(SOURCES.items()), "file string, content string"))
    return m.select("id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content")


# ---- stored forms ---------------------------------------------------------------------


def chunk_lines(spark, root):
    """All chunks written as JSON lines and read back."""
    path = scratch(spark, "chunk-lines")
    files.write_chunks(table(spark, root, "chunks"), path)
    c = files.read_chunks(spark, path)
    return c.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("n_ids"), F.sum(F.length("content")).alias("n_chars"), F.sum(F.array_size("metadata.heading_path")).alias("n_path"), F.count("metadata.section").alias("n_sections"), F.sum("metadata.start_line").alias("lines")
    )


def stored_vectors(spark, root):
    """All vectors written by model and source, read back and matched with their rows one to one."""
    path = scratch(spark, "stored-vectors")
    e = table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit("given").alias("model"), F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("source"))
    files.write_embeddings(e, path)
    rows = e.select(F.col("chunk_id").alias("id"), F.col("source").alias("content"))
    r = files.read_retrieval_data(rows, spark.read.parquet(path))
    return r.select(F.col("id").cast("long").alias("vec_id"), F.array_size("embedding").cast("long").alias("dims"), F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


def stored_result(spark, root):
    """Hit rates written as an evaluation result and read back."""
    path = scratch(spark, "stored-result")
    m = recall_mrr_bm25(spark, root)
    files.write_result(m, path)
    return files.read_json(spark, path, ", ".join(f"{n} {t}" for n, t in m.dtypes))


# ---- lexical and dense search --------------------------------------------------------


def tokenize_stats(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    t = T.terms(F.col("text"))
    return d.select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def postings_df(spark, root):
    p = lexical.postings(spread(corpus(spark, root)))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_top10(spark, root):
    return lexical.search(asked(spark, root), engine(spark, root).index(), 10).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def dense_top10(spark, root):
    """Vectors nearest to every vector whose id is divisible by 100."""
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("embedding"))
    q = v.where("doc % 100 = 0").withColumnRenamed("doc", "query_id")
    return dense.search(q, v, 10).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def embedding_texts(spark, root):
    """Text that is embedded or reranked for each chunk."""
    c = corpus(spark, root)
    return c.select("doc", F.md5(T.embedding_text(F.col("source"), F.col("file"), F.col("method"), F.col("text"))).alias("text_md5"))


def query_texts(spark, root):
    """Questions in the forms that model families expect."""
    q = asked(spark, root)
    return q.select("query_id", *(dense.format_query(s, F.col("query")).alias(s) for s in dense.QUERY_FORMATS))


def hashed_embeddings(spark, root):
    return engine(spark, root).vectors().select("doc", F.posexplode("embedding").alias("dim", "x")).where("x <> 0").select("doc", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def hybrid_topk(spark, root):
    return engine(spark, root).hybrid(asked(spark, root)).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def rrf_weighted(spark, root):
    """Two orders of each category's questions fused four to one."""
    q = asked(spark, root).where("category is not null")
    by = lambda *o: q.select(F.col("category").alias("query_id"), F.col("query_id").alias("doc"), F.row_number().over(Window.partitionBy("category").orderBy(*o)).cast("long").alias("rank"))
    a = by(F.length("query").desc(), F.col("query_id")).where("rank <= 50")
    b = by(F.md5("query_id"), F.col("query_id")).where("rank <= 50")
    return fusion.fuse([(a, C.dense_weight), (b, C.lexical_weight)], C.rrf_k, 10).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def multi_source_union(spark, root):
    return engine(spark, root).search(asked(spark, root)).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def source_quota_select(spark, root):
    """Two documents and five pieces of code per question: both sources reranked, documents first."""
    return engine(spark, root).retrieve(asked(spark, root))


def _reranked(spark, root):
    q, e = asked(spark, root), engine(spark, root)
    return e.rerank(e.hybrid(q), q)


def reranked(spark, root):
    """The hybrid candidates of every question, in all sources, ordered by the offline reranker."""
    return _reranked(spark, root).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


# ---- evaluation ---------------------------------------------------------------------


def _ranks(spark, root, ranking: DataFrame) -> DataFrame:
    """First relevant ranks of a ranking of docs whose ids are judged."""
    ids = ranking.join(corpus(spark, root).select("doc", "id"), "doc").select("query_id", F.col("id").alias("doc"), "rank")
    return evaluate.first_relevant_rank(asked(spark, root), ids, judged(spark, root).withColumnRenamed("id", "doc"))


def _bm25(spark, root, k=10):
    return lexical.search(asked(spark, root), engine(spark, root).index(), k)


def reranked_metrics(spark, root):
    """Hit rates and reciprocal rank after the reranker."""
    return evaluate.hit_metrics(_ranks(spark, root, _reranked(spark, root)), (1, 2, 3, 5, 10))


def _first_ranks(spark, root, source=None):
    """First relevant rank of every question among all texts that share a term with it, at any depth."""
    q, c = asked(spark, root), corpus(spark, root, source)
    relevant = judged(spark, root).join(c.select("doc", "id"), "id").select("query_id", "doc")
    return q.select("query_id").join(lexical.first_ranks(q, engine(spark, root).index(source), relevant), "query_id", "left")


def first_relevant_rank(spark, root):
    return _first_ranks(spark, root)


def recall_mrr_bm25(spark, root):
    return evaluate.hit_metrics(_first_ranks(spark, root), (1, 2, 3, 5, 10))


def recall_by_category(spark, root):
    r = _ranks(spark, root, _bm25(spark, root)).join(asked(spark, root).select("query_id", F.coalesce("category", F.lit("none")).alias("category")), "query_id")
    hit = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}")
    return r.rollup("category").agg(F.count(F.lit(1)).alias("n_questions"), hit(5), hit(10)).select(F.coalesce("category", F.lit("all")).alias("category"), "n_questions", "recall_at_5", "recall_at_10")


def recall_mrr_dense(spark, root):
    """Rank of the nearest vector of the same label among all others, for every vector whose id is divisible by 100."""
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    q = v.where("doc % 100 = 0").withColumnRenamed("doc", "query_id")
    return evaluate.hit_metrics(q.select("query_id").join(dense.first_ranks(q, v), "query_id", "left"), (5, 9))


def pairwise_compare(spark, root):
    """The lexical run over everything against the one over documents only."""
    return evaluate.compare(_first_ranks(spark, root), _first_ranks(spark, root, "docs"))


def _multi_questions(spark, root):
    q = table(spark, root, "questions").where("question is not null")
    return q.groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("query"))


def _expected(spark, root):
    q = table(spark, root, "questions").where("question is not null")
    return q.select(F.col("id").alias("query_id"), F.explode("expected_sources").alias("expected")).where("expected is not null").distinct()


def _source_recall(spark, root):
    c = corpus(spark, root, "code")
    top = lexical.search(_multi_questions(spark, root), engine(spark, root).index("code"), 10).join(c.select("doc", "id"), "doc")
    method = F.concat_ws("::", F.slice(F.split("id", "::"), 1, 2))
    return evaluate.source_recall(_expected(spark, root).where(F.col("expected").contains(".zep::")), top.select("query_id", method.alias("group"), "rank"))


def expected_source_recall(spark, root):
    """Methods expected by the multi-source benchmark among the best ten code chunks, grouped by method."""
    return _source_recall(spark, root)


def source_metrics(spark, root):
    """Hit rates, mean source recall and reciprocal rank over the questions that expect code, and how many do not."""
    return evaluate.source_metrics(_source_recall(spark, root), _multi_questions(spark, root))


def _prefix_recall(spark, root):
    top = engine(spark, root).retrieve(_multi_questions(spark, root)).join(corpus(spark, root).select("doc", "id"), "doc")
    return evaluate.prefix_recall(_expected(spark, root), top.select("query_id", "id"))


def prefix_match_recall(spark, root):
    """Expected sources that lead to one of the seven chunks that the pipeline selects."""
    return _prefix_recall(spark, root)


def pipeline_metrics(spark, root):
    """Hit rate and mean source recall of the pipeline's selection."""
    return evaluate.prefix_metrics(_prefix_recall(spark, root))


def _lengths(spark, root):
    return table(spark, root, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.word_count(F.col("text")).alias("tokens"))


def token_length_stats(spark, root):
    return evaluate.length_statistics(_lengths(spark, root), C.max_words)


def oversized_top30(spark, root):
    return evaluate.longest(_lengths(spark, root), C.max_words)


# ---- generation and service ----------------------------------------------------------


def prompt_context(spark, root):
    """Numbered excerpts of the chunks each answer was given, in their order."""
    c = corpus(spark, root)
    first = c.groupBy("id").agg(F.min_by(F.struct("source", "file", "section", "method", "start_line", "end_line", F.col("text").alias("content")), "doc").alias("chunk"))
    r = table(spark, root, "rag_results").where("chunks is not null").select("result_id", F.posexplode("chunks").alias("pos", "c"))
    j = r.select("result_id", "pos", F.col("c.id").alias("id")).join(first, "id")
    ordered = j.groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("cs"))
    text = generate.context(F.transform("cs", lambda x: x["chunk"]))
    return ordered.select("result_id", F.size("cs").cast("long").alias("n_chunks"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("context_md5"))


def answers(spark, root):
    """Offline pipeline for every question: retrieve, rerank, select, build the prompt, extract an answer."""
    q = asked(spark, root).select("query_id", F.col("query").alias("question"), F.lit(None).cast("string").alias("context"))
    got = engine(spark, root).ask(q)
    return got.select("query_id", F.array_size("sources").cast("long").alias("n_chunks"), F.length("prompt").cast("long").alias("prompt_chars"), "answer")


def ask_validation(spark, root):
    """Questions with the answer they got as context, checked as requests."""
    r = table(spark, root, "rag_results").select("result_id", "question_id", F.col("answer").alias("context"))
    q = table(spark, root, "questions").groupBy(F.col("id").alias("question_id")).agg(F.min("question").alias("question"))
    v = generate.validate(r.join(q, "question_id", "left"))
    return v.groupBy(F.coalesce("reject", F.lit("ok")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("question_chars"))


def rewritten(spark, root):
    r = table(spark, root, "rag_results").where("answer is not null").select("result_id", "question_id", "answer")
    q = table(spark, root, "questions").groupBy(F.col("id").alias("question_id")).agg(F.min("question").alias("question"))
    return r.join(q, "question_id").select("result_id", generate.rewrite(F.col("question"), F.col("answer")).alias("query"))


def citation_sources(spark, root):
    """What an answer cites: id, type and place of each of its chunks."""
    c = corpus(spark, root)
    first = c.groupBy("id").agg(F.min_by(F.struct("source", "file", "section", "method", "start_line", "end_line"), "doc").alias("c"))
    r = table(spark, root, "rag_results").select("result_id", F.posexplode("chunks").alias("pos", "k"))
    return r.select("result_id", (F.col("pos") + 1).cast("long").alias("position"), F.col("k.id").alias("id")).join(first, "id").select(
        "result_id", "position", "id", F.col("c.source").alias("type"), F.col("c.file").alias("file"), F.col("c.section").alias("section"), F.col("c.method").alias("method"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line")
    )


def graded_runs(spark, root):
    """Rubric totals per model; the test data have no grades, so three plain facts of an answer stand in for them."""
    r = table(spark, root, "rag_results").select(F.coalesce("model", F.lit("none")).alias("model"), T.word_count(F.coalesce("answer", F.lit(""))).alias("n"), F.coalesce(F.array_size("chunks"), F.lit(0)).alias("c"), F.coalesce(F.col("answer").contains("`"), F.lit(False)).alias("q"))
    two = lambda low, high: F.when(low, 0).when(high, 1).otherwise(2)
    graded = r.select("model", two(F.col("n") == 0, F.col("n") < 10).alias("correctness"), two(F.col("c") == 0, F.col("c") < 3).alias("completeness"), two(F.col("n") == 0, ~F.col("q")).alias("groundedness"))
    return evaluate.rubric(graded, ("correctness", "completeness", "groundedness"))


def generation_records(spark, root):
    """Evaluation records of generated answers: the chunks in their positions, and grades left open."""
    r = table(spark, root, "rag_results").select("result_id", "model", "question_id", "answer", "chunks")
    listed = F.array_join(F.transform("chunks", lambda c, i: F.concat((i + 1).cast("string"), F.lit(":"), F.coalesce(c["source"], F.lit("none")), F.lit(":"), F.coalesce(c["id"], F.lit("none")))), "|")
    return r.select(
        "result_id", "model", "question_id", F.length("answer").cast("long").alias("answer_chars"), F.coalesce(F.array_size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(listed, F.lit("")).alias("chunks"),
        *(F.lit(None).cast("long").alias(g) for g in ("correctness", "completeness", "groundedness")),
    )


QUERIES = {
    f.__name__: f
    for f in (
        word_count, slugify, clean_text, clean_cases, front_matter, skip_filter, noise_filter, link_text, dup_id_suffix, greedy_pack_parts, prev_next_links,
        method_chunks, method_cover, parsed_methods, chunker_cases, code_cases, chunk_lines, stored_vectors, stored_result, reranked_metrics, source_metrics, pipeline_metrics, document_chunks, heading_sections, tokenize_stats, postings_df, bm25_top10, dense_top10, embedding_texts, query_texts, hashed_embeddings, hybrid_topk,
        rrf_weighted, multi_source_union, source_quota_select, reranked, first_relevant_rank, recall_mrr_bm25, recall_by_category, recall_mrr_dense,
        pairwise_compare, expected_source_recall, prefix_match_recall, token_length_stats, oversized_top30, prompt_context, answers, ask_validation,
        rewritten, citation_sources, graded_runs, generation_records,
    )
}

#: Their SQL is in :mod:`marram.plans.retrieval_sql`.
SQL: dict[str, str] = {}
