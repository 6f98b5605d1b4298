"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import budget, contamination, docpairs, neardup, packing, responses, truncation
from marram.llm.tokenizers import Tokenizer, Words
from marram.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.pairs(table(spark, root, "methods")).select("method_no", "name").distinct()


def p2_pairs(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.pairs(table(spark, root, "methods"))


def _budget(spark: SparkSession, root: str, tokenizer: Tokenizer | Words | None = None) -> budget.TokenBudget:
    """All chunks first, then the removal of the deleted ones as a change set: a signed delta."""
    chunks, domains = table(spark, root, "chunks"), table(spark, root, "path_domains")
    labelled = budget.label_chunks(chunks, domains)
    first = budget.TokenBudget(tokenizer or Tokenizer()).update(labelled)
    gone = chunks.where("deleted_at is not null").select(F.col("chunk_no").cast("string").alias("doc"))
    return first.change(labelled.limit(0), gone)


def p3_token_budget(spark: SparkSession, root: str) -> DataFrame:
    return _budget(spark, root).cube


def p3_totals(spark: SparkSession, root: str) -> DataFrame:
    return budget.totals(_budget(spark, root).cube)


def p3_words(spark: SparkSession, root: str) -> DataFrame:
    """The same cube with words as tokens, which SQL can count as well."""
    return _budget(spark, root, Words()).cube


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return responses.defects(table(spark, root, "rag_results"), table(spark, root, "questions"))


def p4_by_model(spark: SparkSession, root: str) -> DataFrame:
    """Defects per model, with the model's number of results."""
    results = table(spark, root, "rag_results")
    bad = p4_found(spark, root)
    n = results.groupBy("model").agg(F.count(F.lit(1)).alias("n_results"))
    d = results.select("result_id", "model").join(bad, "result_id").groupBy(F.col("model").alias("m"), "defect").agg(F.count(F.lit(1)).alias("n_defects"))
    return n.join(d, F.col("model").eqNullSafe(F.col("m"))).select("model", "defect", "n_defects", "n_results")


#: The near-duplicate case of the test data: runs of three words, 0.6, at least 20 words.
CHUNK_PAIRS = neardup.NearDuplicates(num=3, den=5, width=3, min_words=20)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, root, "chunks"), "chunk_no", "content", CHUNK_PAIRS).select("chunk_no_a", "chunk_no_b")


def p5_links(spark: SparkSession, root: str) -> DataFrame:
    """The same search in the form of classes: one row a chunk, copies not expanded."""
    return neardup.classes(table(spark, root, "chunks"), "chunk_no", "content", CHUNK_PAIRS)


def p5_classes(spark: SparkSession, root: str) -> DataFrame:
    """Classes of chunks at the general setting: runs of five words, similarity 0.8."""
    return neardup.classes(table(spark, root, "chunks"), "chunk_no", "content")


def _placed(spark: SparkSession, root: str, lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    limits = table(spark, root, "token_limits").where("max_tokens > reserved_tokens")
    limits = limits.select("model", (F.col("max_tokens") - F.col("reserved_tokens")).alias("capacity"))
    if lengths is None:
        lengths = packing.token_lengths(table(spark, root, "documents"), "doc_id", "text", Tokenizer())
    # a handful of models; the capacities become literals of the plan
    return packing.pack(lengths, [r["capacity"] for r in limits.select("capacity").distinct().collect()]), limits


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Contents and unused space of every container of every model."""
    placed, limits = _placed(spark, root)
    return packing.containers(placed).join(limits, "capacity").select("model", "capacity", "container_id", "n_items", "used", "unused", "contents")


def p6_placement(spark: SparkSession, root: str) -> DataFrame:
    """Container of every document, or of every piece of one that is larger than a container."""
    placed, limits = _placed(spark, root)
    return packing.container_id(placed).join(limits, "capacity").select("model", "capacity", "container_id", F.col("item").alias("doc_id"), "piece", "tokens", "bucket")


def p6_padding(spark: SparkSession, root: str) -> DataFrame:
    """Padding of each bucket's slots beside that of one bucket for all lengths."""
    return packing.padding(_placed(spark, root)[0])


def p6_rules(spark: SparkSession, root: str) -> DataFrame:
    """The rules of a packing, counted on documents measured in characters, which SQL can count as well."""
    lengths = table(spark, root, "documents").select(F.col("doc_id").alias("item"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    return packing.rules(_placed(spark, root, lengths)[0])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    found = contamination.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return contamination.verbatim(found).select("doc_id", "item_id")


#: Passages that may step over two other words in a row, so that a replaced word does not hide a leak.
PARAPHRASES = contamination.LeakSearch(bridge=2)


def p7_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Verbatim leaks and paraphrases, with their evidence."""
    found = contamination.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), p=PARAPHRASES)
    return contamination.kinds(found).select("doc_id", "item_id", "kind", "longest_run", F.round("lcs_share", 4).alias("lcs_share"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(table(spark, root, "documents")).select("doc_id").distinct()


def p8_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Every case with what broke off, and whether its length is a spike of its source."""
    return truncation.truncated(table(spark, root, "documents"))


def p8_by_source(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return truncation.truncation_by_source(documents, truncation.truncated(documents))


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_token_budget": p3_token_budget,
    "p3_totals": p3_totals,
    "p3_words": p3_words,
    "p4_found": p4_found,
    "p4_by_model": p4_by_model,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_classes": p5_classes,
    "p6_containers": p6_containers,
    "p6_placement": p6_placement,
    "p6_padding": p6_padding,
    "p6_rules": p6_rules,
    "p7_found": p7_found,
    "p7_kinds": p7_kinds,
    "p8_found": p8_found,
    "p8_evidence": p8_evidence,
    "p8_by_source": p8_by_source,
}

_WS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"

_PLAIN = r"lower(trim(regexp_replace({}, '^\s+|\s+$', '', 'g')))"
_LABEL = f"CASE WHEN coalesce({_PLAIN}, '') IN ('', 'und', 'none', 'null') THEN 'unknown' ELSE {_PLAIN} END"

def _links(words: int, least: int, num: int, den: int) -> str:
    """One row a chunk: class of equal sets of word runs, and links to other classes of similarity num / den."""
    run = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
WITH w AS (SELECT chunk_no, {_WS.format('content')} AS ws FROM chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT chunk_no, unnest(list_transform(range(1, len(ws) - {words - 2}), lambda i: {run})) AS g FROM w WHERE len(ws) >= {least}),
f AS (SELECT chunk_no, md5(string_agg(g, '|' ORDER BY g)) AS f FROM s GROUP BY chunk_no),
k AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY f) AS class_id, count(*) OVER (PARTITION BY f) AS class_size FROM f),
h AS (SELECT s.* FROM s JOIN k USING (chunk_no) WHERE chunk_no = class_id),
n AS (SELECT chunk_no, count(*) AS n FROM h GROUP BY chunk_no),
c AS (SELECT a.chunk_no AS x, b.chunk_no AS y, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.chunk_no < b.chunk_no GROUP BY ALL),
p AS (SELECT x, y FROM c JOIN n p ON p.chunk_no = x JOIN n q ON q.chunk_no = y WHERE {den} * k >= {num} * (p.n + q.n - k)),
l AS (SELECT x, count(*) AS n_links FROM (SELECT x FROM p UNION ALL SELECT y FROM p) GROUP BY x)
SELECT t.chunk_no, coalesce(k.class_id, t.chunk_no) AS class_id, CAST(coalesce(k.class_size, 1) AS BIGINT) AS class_size, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM chunks t LEFT JOIN k USING (chunk_no) LEFT JOIN l ON l.x = k.class_id"""


SQL: dict[str, str] = {
    "p3_words": f"""
WITH d AS (SELECT top_dir, min(domain) AS domain FROM path_domains GROUP BY top_dir),
c AS (SELECT deleted_at IS NOT NULL AS gone, coalesce(len({_WS.format('content')}), 0) AS n, {_LABEL.replace('{}', 'source')} AS source,
  string_split_regex({_LABEL.replace('{}', 'metadata.language')}, '[-_]')[1] AS language,
  string_split(coalesce(metadata.file_path, metadata.file, string_split(id, '::')[1]), '/')[1] AS dir FROM chunks)
SELECT source, language, CASE WHEN dir IS NULL THEN 'unknown' ELSE coalesce(d.domain, 'other') END AS domain,
  CAST(count(*) FILTER (NOT gone) AS BIGINT) AS n_docs, CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS added_docs,
  CAST(count(*) FILTER (gone) AS BIGINT) AS removed_docs, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed_tokens
FROM c LEFT JOIN d ON d.top_dir = c.dir GROUP BY ALL""",
    "p5_found": f"""
WITH w AS (SELECT chunk_no, {_WS.format('content')} AS ws FROM chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT chunk_no, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 20),
n AS (SELECT chunk_no, count(*) AS n FROM s GROUP BY chunk_no),
c AS (SELECT a.chunk_no AS x, b.chunk_no AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunk_no < b.chunk_no GROUP BY ALL)
SELECT x AS chunk_no_a, y AS chunk_no_b FROM c JOIN n p ON p.chunk_no = x JOIN n q ON q.chunk_no = y WHERE 5 * k >= 3 * (p.n + q.n - k)""",
    "p5_links": _links(3, 20, 3, 5),
    "p5_classes": _links(5, 5, 4, 5),
    "p6_rules": """
WITH c AS (SELECT DISTINCT max_tokens - reserved_tokens AS capacity FROM token_limits WHERE max_tokens > reserved_tokens),
l AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)
SELECT capacity, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(n) AS BIGINT) AS used, CAST(0 AS BIGINT) AS n_overfull,
  CAST(count(*) FILTER (n > capacity) AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_split_needlessly
FROM c CROSS JOIN l GROUP BY capacity""",
    "p7_found": f"""
WITH d AS (SELECT doc_id, {_WS.format('text')} AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {_WS.format('text')} AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM d),
eg AS (SELECT item_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM e)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
