"""SQL of the queries in :mod:`marram.plans.retrieval`, for any engine that reads the same tables."""

from __future__ import annotations

from marram.operators.generate import HEAD, LABELS
from marram.plans.cases import CHUNKS, CLEANED, METHODS, values
from marram.plans.retrieval import _ASKED, _CORPUS, _JUDGED, NOISE, C, _terms

_LF = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _bm25(name: str, queries: str, corpus: str, k: int) -> str:
    """CTEs that end in ``name(query_id, doc, score, rank)``."""
    n = name
    return f"""
{n}_t AS (SELECT doc, {_terms('text')} AS ts FROM {corpus}),
{n}_p AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, unnest(ts) AS term, len(ts) AS dl FROM {n}_t) GROUP BY doc, term),
{n}_df AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY term),
{n}_s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {n}_t),
{n}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms('query')}) AS term FROM {queries}) GROUP BY ALL),
{n}_sc AS (SELECT q.query_id, p.doc, round(sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + {C.bm25_k1} * (1 - {C.bm25_b} + {C.bm25_b} * p.dl / s.avgdl))), 9) AS score
  FROM {n}_q q JOIN {n}_df d USING (term) JOIN {n}_p p USING (term) CROSS JOIN {n}_s s GROUP BY q.query_id, p.doc),
{n} AS (SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {n}_sc) WHERE rank <= {k})"""


def _embed(name: str, key: str, text: str, source: str) -> str:
    return f"""
{name}_h AS (SELECT {key}, md5(term) AS h FROM (SELECT {key}, unnest({_terms(text)}) AS term FROM {source})),
{name}_d AS (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {C.dims} AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {key}, dim, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_d WHERE x <> 0)"""


_RANKS = """
ranks AS (SELECT a.query_id, min(h.rank) AS first_rank FROM asked a LEFT JOIN (
  SELECT b.query_id, b.rank FROM bm b JOIN corpus c USING (doc) JOIN judged j ON j.query_id = b.query_id AND j.id = c.id) h USING (query_id) GROUP BY a.query_id)"""
_B10 = _bm25("bm", "asked", "corpus", 10)
#: Ranks at any depth.
_BALL = _bm25("bm", "asked", "corpus", 10**9)
_DOCS = "docs AS (SELECT * FROM corpus WHERE source = 'docs')"
_CODE = "code AS (SELECT * FROM corpus WHERE source = 'code')"


def _hybrid(name: str, corpus: str) -> str:
    """CTEs that end in ``name(query_id, doc, score, rank)``: hybrid search of ``asked`` in a corpus, any depth."""
    n = name
    return ",".join((
        _embed(f"{n}v", "doc", "text", corpus),
        f"""
{n}_dots AS (SELECT q.query_id, d.doc, sum(q.x * d.x) AS s FROM eq q JOIN {n}v d USING (dim) GROUP BY ALL),
{n}_pairs AS (SELECT a.query_id, c.doc, round(coalesce(s, 0), 9) AS score FROM asked a CROSS JOIN {corpus} c LEFT JOIN {n}_dots USING (query_id, doc)),
{n}_de AS (SELECT * FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {n}_pairs) WHERE rank <= {C.candidates})""",
        _bm25(f"{n}_bm", "asked", corpus, C.candidates),
        f"""
{n}_un AS (SELECT query_id, doc, round(sum(w / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS first FROM
  (SELECT query_id, doc, rank, {C.dense_weight} AS w, 0 AS l FROM {n}_de UNION ALL SELECT query_id, doc, rank, {C.lexical_weight}, 1 FROM {n}_bm) GROUP BY ALL),
{n} AS (SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc) AS rank FROM {n}_un) WHERE rank <= {C.top_k})""",
    ))


_EQ = _embed("eq", "query_id", "query", "asked")
# documents frequencies of all texts, and the order of the offline reranker of a ranking
_DF = f"""
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc, unnest({_terms('text')}) AS term FROM corpus) GROUP BY term),
have AS (SELECT DISTINCT doc, unnest({_terms('text')}) AS term FROM corpus),
w AS (SELECT query_id, term, 1.0 / ln(2 + coalesce(df, 0)) AS w FROM (SELECT DISTINCT query_id, unnest({_terms('query')}) AS term FROM asked) LEFT JOIN df USING (term))"""


def _rerank(name: str, of: str) -> str:
    return f"""
{name}_s AS (SELECT b.query_id, b.doc, b.rank AS before, round(sum(CASE WHEN h.doc IS NOT NULL THEN w.w ELSE 0 END) / sum(w.w), 9) AS score
  FROM {of} b JOIN w USING (query_id) LEFT JOIN have h ON h.doc = b.doc AND h.term = w.term GROUP BY ALL),
{name} AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM {name}_s)"""


_UNION = f"""
un AS (SELECT query_id, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS first FROM
  (SELECT query_id, doc, rank, 0 AS l FROM b1 UNION ALL SELECT query_id, doc, rank, 1 FROM b2) GROUP BY ALL),
ur AS (SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc) AS rank FROM un) WHERE rank <= {2 * C.top_k})"""
# the whole pipeline up to the selection, of whatever ``asked`` is
_SEARCH = [_DOCS, _CODE, _EQ, _hybrid("b1", "docs"), _hybrid("b2", "code"), _UNION]
_SELECT = [*_SEARCH, _DF, _rerank("re", "ur"), f"""
sk AS (SELECT r.query_id, r.doc, c.source, row_number() OVER (PARTITION BY r.query_id, c.source ORDER BY r.score DESC, r.rank) AS in_source FROM re r JOIN corpus c USING (doc)),
sel AS (SELECT query_id, doc, source, in_source, row_number() OVER (PARTITION BY query_id ORDER BY source = 'code', in_source) AS position
  FROM sk WHERE in_source <= CASE source WHEN 'docs' THEN {C.docs_kept} ELSE {C.code_kept} END)"""]
_MULTI = "asked AS (SELECT id AS query_id, min(question) AS query FROM questions WHERE question IS NOT NULL GROUP BY id)"
_EXPECTED = "expected AS (SELECT DISTINCT query_id, e AS expected FROM (SELECT id AS query_id, unnest(expected_sources) AS e FROM questions WHERE question IS NOT NULL) WHERE e IS NOT NULL)"
_FIRST = "first AS (SELECT id, arg_min(struct_pack(source := lower(trim(source)), file := CASE WHEN metadata.file_path <> '' THEN metadata.file_path ELSE metadata.file END, section := metadata.section, method := metadata.method, start_line := metadata.start_line, end_line := metadata.end_line, content := content), chunk_no) AS c FROM chunks WHERE content IS NOT NULL AND id IS NOT NULL GROUP BY id)"
_Q1 = "q AS (SELECT id AS question_id, min(question) AS question FROM questions GROUP BY id)"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_SP = f"'^{_SPACE}+|{_SPACE}+$'"


def _hits(cutoffs: tuple[int, ...]) -> str:
    return ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in cutoffs)


_SUBSTANCE = "content"
for _p in (r"(?m)^#{1,6}\s+.*$", r"!\[[^\]]*\]\([^)]+\)", r"\[\s*\]\[[^\]]+\]", r"<[A-Za-z][^>]*/>", r"(?m)^\s*---+\s*$", r"\s+"):
    _SUBSTANCE = f"regexp_replace({_SUBSTANCE}, '{_p}', '', 'g')"
_CLEAN = _LF
for _p in (r"(?m)^\s*\[[^\]]+\]:\s+\S+.*$", r"(?s)<ApiUses>.*?</ApiUses>", r"(?s)<ApiUsedBy>.*?</ApiUsedBy>"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '\n{{3,}}', chr(10) || chr(10), 'g')"
_WORDS = "CAST(len(list_filter(string_split_regex({}, '" + _SPACE.replace("{", "{{").replace("}", "}}") + "+'), lambda x: x <> '')) AS BIGINT)"
_D, _K = LABELS["docs"], LABELS["code"]
_NL = " || chr(10) || "
_EXCERPT = (
    f"CASE WHEN c.source = 'docs' THEN '{_D[0]}'{_NL}'{_D[1]}' || coalesce(c.file, 'None'){_NL}'{_D[2]}' || coalesce(c.section, 'None'){_NL}'{_D[3]}' || c.content "
    f"WHEN c.source = 'code' THEN '{_K[0]}'{_NL}'{_K[1]}' || coalesce(c.file, 'None'){_NL}'{_K[2]}' || coalesce(c.method, 'None'){_NL}'{_K[3]}' || coalesce(c.start_line::VARCHAR, 'None') || '-' || coalesce(c.end_line::VARCHAR, 'None'){_NL}'{_K[4]}'{_NL}c.content ELSE '' END"
)
_CHUNK = f"struct_pack(pos := pos, t := {_EXCERPT})"
_FULL = "full_corpus AS (SELECT chunk_no AS doc, lower(trim(source)) AS source, CASE WHEN metadata.file_path <> '' THEN metadata.file_path ELSE metadata.file END AS file, metadata.section AS section, metadata.method AS method, metadata.start_line AS start_line, metadata.end_line AS end_line, content FROM chunks WHERE content IS NOT NULL)"

_SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9_]+', '-', 'g'), '-')"
_RECALL = """
re_call AS (SELECT query_id, CAST(count(*) AS BIGINT) AS n_expected, CAST(sum(f) AS BIGINT) AS n_found, CAST(max(f) AS BIGINT) AS hit, round(sum(f) / count(*), 6) AS source_recall
FROM (SELECT e.query_id, e.expected, max(CASE WHEN c.id = e.expected OR starts_with(c.id, e.expected || '::') THEN 1 ELSE 0 END) AS f
  FROM expected e LEFT JOIN sel b ON b.query_id = e.query_id LEFT JOIN corpus c ON c.doc = b.doc GROUP BY ALL) GROUP BY query_id)"""
_GROUPS = """
g AS (SELECT b.query_id, array_to_string(string_split(c.id, '::')[1:2], '::') AS grp, min(b.rank) AS rank FROM bm b JOIN corpus c USING (doc) GROUP BY ALL),
sr AS (SELECT e.query_id, CAST(count(*) AS BIGINT) AS n_expected, min(g.rank) AS first_rank, """ + ", ".join(f"round(count(*) FILTER (g.rank <= {k}) / count(*), 6) AS source_recall_at_{k}" for k in (1, 3, 5, 10)) + """
  FROM expected e LEFT JOIN g ON g.query_id = e.query_id AND g.grp = e.expected WHERE contains(e.expected, '.zep::') GROUP BY e.query_id)"""
_RR = [_CORPUS, _ASKED, _EQ, _hybrid("hy", "corpus"), _DF, _rerank("re", "hy")]
_PROMPT = len(HEAD) + len("\nQuestion:\n") + 1 + len("\nExcerpts:\n")

SQL = {
    "word_count": f"SELECT doc_id, {_WORDS.format('text')} AS n_words FROM documents WHERE text IS NOT NULL",
    "slugify": "SELECT doc_id, trim(regexp_replace(lower(trim(title)), '[^a-z0-9_]+', '-', 'g'), '-') AS slug FROM documents WHERE title IS NOT NULL",
    "clean_text": f"SELECT doc_id, md5(c) AS cleaned_md5, CAST(length(c) AS BIGINT) AS n_chars FROM (SELECT doc_id, {_CLEAN} AS c FROM documents WHERE text IS NOT NULL)",
    "front_matter": rf"""
WITH d AS (SELECT doc_id, {_LF} AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, string_split(text, '---') AS ps, starts_with(text, '---') AND len(string_split(text, '---')) >= 3 AS fm FROM d)
SELECT doc_id,
  CASE WHEN fm THEN regexp_replace(list_last(regexp_extract_all(ps[2], '(?m)^title:[ \t]*(.*?)[ \t]*$', 1)), '^["''](.*)["'']$', '\1') END AS title,
  md5(CASE WHEN fm THEN regexp_replace(array_to_string(ps[3:], '---'), '^\s+', '') ELSE text END) AS body_md5
FROM p""",
    "skip_filter": rf"""
SELECT chunk_no, id FROM chunks WHERE content IS NOT NULL AND coalesce(metadata.section, '') <> 'Method Summary'
AND NOT regexp_full_match(regexp_replace(content, {_SP}, '', 'g'), '#{{1,6}}[ \t\f\r]+[^\n]+') AND {_SUBSTANCE} <> ''""",
    "noise_filter": """
SELECT chunk_no, CAST(count(*) AS BIGINT) AS n_noise FROM (SELECT chunk_no, unnest(string_split(content, chr(10) || chr(10))) AS p FROM chunks WHERE content IS NOT NULL)
WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13)) = '""" + NOISE[0] + "' GROUP BY chunk_no",
    "link_text": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(line, '^- \[([^\]]+)\]\([^)]*\)', 1) AS link_text FROM l WHERE regexp_matches(line, '^- \[[^\]]+\]\([^)]*\)')""",
    "dup_id_suffix": """
SELECT chunk_no, CASE WHEN n > 1 THEN id || '-' || n ELSE id END AS unique_id
FROM (SELECT chunk_no, id, row_number() OVER (PARTITION BY id ORDER BY chunk_no) AS n FROM chunks WHERE id IS NOT NULL)""",
    "greedy_pack_parts": rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, {_WORDS.format('line')} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL) WHERE trim(line) <> ''
), g AS (
  SELECT doc_id, i, w AS used, CAST(1 AS BIGINT) AS part, w FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN g.used + l.w > {C.max_words} THEN l.w ELSE g.used + l.w END, CASE WHEN g.used + l.w > {C.max_words} THEN g.part + 1 ELSE g.part END, l.w
  FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i + 1
)
SELECT doc_id, part, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(w) AS BIGINT) AS n_words FROM g GROUP BY doc_id, part""",
    "prev_next_links": """
SELECT chunk_no, parent_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
FROM (SELECT chunk_no, id, metadata.parent_id AS parent_id, metadata.chunk_index AS i FROM chunks WHERE metadata.parent_id IS NOT NULL AND deleted_at IS NULL)
WINDOW w AS (PARTITION BY parent_id ORDER BY i, chunk_no)""",
    "heading_sections": rf"""
WITH d AS (SELECT doc_id, {_LF} AS t FROM documents WHERE text <> ''),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}}){_SPACE}+[^\n]+', 1)) AS lv, regexp_replace(regexp_extract(line, '^#{{1,6}}{_SPACE}+([^\n]+)', 1), {_SP}, '', 'g') AS title FROM l),
s AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h),
g AS (SELECT doc_id, sec, max(lv) AS lv, max(CASE WHEN lv > 0 THEN title END) AS title, string_agg(line, chr(10) ORDER BY pos) AS c FROM s GROUP BY doc_id, sec),
p AS (SELECT *, {", ".join(f"max(CASE WHEN lv = {k} THEN struct_pack(s := sec, t := title) END) OVER o AS p{k}" for k in range(1, 7))} FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING)),
q AS (SELECT doc_id, sec, title, c, list_transform(list_filter([{", ".join(f"struct_pack(k := coalesce(p{k}.s, 0) > greatest(0{''.join(f', coalesce(p{j}.s, 0)' for j in range(1, k))}), t := p{k}.t)" for k in range(1, 7))}], lambda x: x.k), lambda x: x.t) AS path FROM p),
i AS (SELECT *, doc_id::VARCHAR || '::' || CASE WHEN len(path) = 0 THEN 'root' ELSE array_to_string(list_transform(path, lambda x: {_SLUG.format('x')}), '::') END AS base FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY sec) AS n FROM i)
SELECT doc_id, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS id, CASE WHEN len(path) > 0 THEN path[-1] END AS section, array_to_string(path, ' > ') AS path, md5(regexp_replace(c, {_SP}, '', 'g')) AS content_md5 FROM n""",
    "chunker_cases": values(CHUNKS, "id VARCHAR, content VARCHAR, section VARCHAR, method VARCHAR, event_component VARCHAR"),
    "code_cases": values(METHODS, "id VARCHAR, start_line BIGINT, end_line BIGINT, content VARCHAR"),
    "method_cover": f"""
SELECT method_no, md5(content) AS content_md5, CAST(0 AS BIGINT) AS n_too_long, CAST(1 AS BIGINT) AS n_first, CAST(1 AS BIGINT) AS n_last, CAST(0 AS BIGINT) AS n_wrong_links,
  CAST(start_line AS BIGINT) AS first_line, CAST(CASE WHEN length(content) <= {C.max_code_chars} THEN end_line ELSE start_line + length(content) - length(replace(content, chr(10), '')) END AS BIGINT) AS last_line
FROM methods WHERE content IS NOT NULL""",
    "chunk_lines": """
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(id) AS BIGINT) AS n_ids, CAST(sum(length(content)) AS BIGINT) AS n_chars, CAST(sum(len(metadata.heading_path)) AS BIGINT) AS n_path,
  CAST(count(metadata.section) AS BIGINT) AS n_sections, CAST(sum(metadata.start_line) AS BIGINT) AS lines FROM chunks GROUP BY source""",
    "stored_vectors": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
    "reranked_metrics": _with(*_RR, _JUDGED, _RANKS.replace("FROM bm b", "FROM re b")) + f"SELECT CAST(count(*) AS BIGINT) AS n_questions, {_hits((1, 2, 3, 5, 10))}, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM ranks",
    "source_metrics": _with(_CORPUS, _MULTI, _CODE, _EXPECTED, _bm25("bm", "asked", "code", 10), _GROUPS) + "SELECT CAST(count(*) AS BIGINT) AS n_questions, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}, round(avg(source_recall_at_{k}), 6) AS source_recall_at_{k}" for k in (1, 3, 5, 10)) + """,
  round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, CAST((SELECT count(*) FROM asked) - count(*) AS BIGINT) AS n_skipped FROM sr""",
    "pipeline_metrics": _with(_CORPUS, _MULTI, _EXPECTED, *_SELECT, _RECALL) + "SELECT CAST(count(*) AS BIGINT) AS n_questions, round(avg(hit::DOUBLE), 6) AS hit_rate, round(avg(source_recall), 6) AS source_recall FROM re_call",
    "answers": _with(_CORPUS, _ASKED.replace("min(query) AS query", f"regexp_replace(min(query), {_SP}, '', 'g') AS query"), *_SELECT, _FULL, f"""
o AS (SELECT query_id, list(struct_pack(pos := position, c := {_EXCERPT}, f := regexp_extract(regexp_replace(content, '\\s+', ' ', 'g'), '^(.*?[.!?])(?: |$)', 1)) ORDER BY position) AS cs FROM sel JOIN full_corpus c USING (doc) GROUP BY query_id)""") + f"""
SELECT a.query_id, CASE WHEN length(query) BETWEEN 1 AND 2000 THEN CAST(coalesce(len(cs), 0) AS BIGINT) END AS n_chunks,
  CASE WHEN length(query) BETWEEN 1 AND 2000 THEN CAST({_PROMPT} + length(query) + length(coalesce(array_to_string(list_transform(cs, lambda x, i: '[' || i || ']' || chr(10) || x.c || chr(10) || chr(10)), ''), '')) AS BIGINT) END AS prompt_chars,
  CASE WHEN length(query) BETWEEN 1 AND 2000 THEN coalesce(array_to_string(list_filter(list_transform(cs, lambda x, i: CASE WHEN x.f <> '' THEN x.f || ' [' || i || ']' END), lambda x: x IS NOT NULL), ' '), '') END AS answer
FROM asked a LEFT JOIN o USING (query_id)""",
    "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "postings_df": _with(_CORPUS) + f"""
SELECT term, CAST(count(DISTINCT doc) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM (SELECT doc, unnest({_terms('text')}) AS term FROM corpus) GROUP BY term""",
    "bm25_top10": _with(_CORPUS, _ASKED, _B10) + "SELECT query_id, doc, round(score, 6) AS score, rank FROM bm",
    "dense_top10": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, round(list_inner_product(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0)
SELECT query_id, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""",
    "embedding_texts": """
SELECT chunk_no AS doc, md5(CASE lower(trim(source)) WHEN 'code' THEN 'File: ' || coalesce(CASE WHEN metadata.file_path <> '' THEN metadata.file_path ELSE metadata.file END, '') || chr(10) || 'Method: ' || coalesce(metadata.method, '') || chr(10) || chr(10) || content
  WHEN 'docs' THEN content ELSE '' END) AS text_md5 FROM chunks WHERE content IS NOT NULL""",
    "query_texts": _with(_ASKED) + """
SELECT query_id, query AS raw, 'Represent this sentence for searching relevant passages: ' || query AS prefix,
  'Instruct: Retrieve passages that answer the question.' || chr(10) || 'Query: ' || query AS instruct FROM asked""",
    "graded_runs": f"""
SELECT model, CAST(sum(a) AS BIGINT) AS correctness, CAST(sum(b) AS BIGINT) AS completeness, CAST(sum(g) AS BIGINT) AS groundedness, CAST(sum(a + b + g) AS BIGINT) AS score, CAST(6 * count(*) AS BIGINT) AS out_of, round(sum(a + b + g) / (6 * count(*)), 6) AS share
FROM (SELECT model, CASE WHEN n = 0 THEN 0 WHEN n < 10 THEN 1 ELSE 2 END AS a, CASE WHEN c = 0 THEN 0 WHEN c < 3 THEN 1 ELSE 2 END AS b, CASE WHEN n = 0 THEN 0 WHEN NOT q THEN 1 ELSE 2 END AS g
  FROM (SELECT coalesce(model, 'none') AS model, {_WORDS.format("coalesce(answer, '')")} AS n, coalesce(len(chunks), 0) AS c, coalesce(contains(answer, '`'), false) AS q FROM rag_results)) GROUP BY model""",
    "hashed_embeddings": _with(_CORPUS, _embed("e", "doc", "text", "corpus")) + "SELECT doc, dim, round(x, 6) AS x FROM e",
    "hybrid_topk": _with(_CORPUS, _ASKED, _EQ, _hybrid("hy", "corpus")) + "SELECT query_id, doc, round(score, 6) AS score, rank FROM hy",
    "rrf_weighted": _with(_ASKED) + """,
a AS (SELECT category, query_id, row_number() OVER (PARTITION BY category ORDER BY length(query) DESC, query_id) AS rank FROM asked WHERE category IS NOT NULL),
b AS (SELECT category, query_id, row_number() OVER (PARTITION BY category ORDER BY md5(query_id), query_id) AS rank FROM asked WHERE category IS NOT NULL),
un AS (SELECT category, query_id, round(sum(w / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS first FROM
  (SELECT *, 4.0 AS w, 0 AS l FROM a WHERE rank <= 50 UNION ALL SELECT *, 1.0, 1 FROM b WHERE rank <= 50) GROUP BY ALL)
SELECT category AS query_id, query_id AS doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, first, query_id) AS rank FROM un) WHERE rank <= 10""",
    "multi_source_union": _with(_CORPUS, _ASKED, *_SEARCH) + "SELECT query_id, doc, round(score, 6) AS score, rank FROM ur",
    "source_quota_select": _with(_CORPUS, _ASKED, *_SELECT) + "SELECT query_id, doc, source, in_source, position FROM sel",
    "reranked": _with(*_RR) + "SELECT query_id, doc, round(score, 6) AS score, rank FROM re",
    "first_relevant_rank": _with(_CORPUS, _ASKED, _JUDGED, _BALL, _RANKS) + "SELECT query_id, first_rank FROM ranks",
    "recall_mrr_bm25": _with(_CORPUS, _ASKED, _JUDGED, _BALL, _RANKS) + f"SELECT CAST(count(*) AS BIGINT) AS n_questions, {_hits((1, 2, 3, 5, 10))}, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM ranks",
    "recall_by_category": _with(_CORPUS, _ASKED, _JUDGED, _B10, _RANKS) + f"""
SELECT coalesce(cat, 'all') AS category, CAST(count(*) AS BIGINT) AS n_questions, {_hits((5, 10))}
FROM (SELECT first_rank, coalesce(category, 'none') AS cat FROM ranks JOIN asked USING (query_id)) GROUP BY ROLLUP (cat)""",
    "recall_mrr_dense": f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, a.label AS la, b.label AS lb, round(list_inner_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s),
ranks AS (SELECT e.vec_id, min(t.rank) FILTER (t.la = t.lb) AS first_rank FROM embeddings e LEFT JOIN t ON t.query_id = e.vec_id WHERE e.vec_id % 100 = 0 GROUP BY e.vec_id)
SELECT CAST(count(*) AS BIGINT) AS n_questions, {_hits((5, 9))}, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM ranks""",
    "pairwise_compare": _with(_CORPUS, _ASKED, _JUDGED, _DOCS, _BALL, _RANKS, _bm25("bd", "asked", "docs", 10**9), _RANKS.replace("ranks AS", "other AS").replace("FROM bm b", "FROM bd b")) + """
SELECT CAST(count(*) AS BIGINT) AS n_questions, CAST(count(*) FILTER (a < b) AS BIGINT) AS a_better, CAST(count(*) FILTER (a > b) AS BIGINT) AS b_better, CAST(count(*) FILTER (a = b) AS BIGINT) AS equal
FROM (SELECT coalesce(x.first_rank, 1e9) AS a, coalesce(y.first_rank, 1e9) AS b FROM ranks x JOIN other y USING (query_id))""",
    "expected_source_recall": _with(_CORPUS, _MULTI, _CODE, _EXPECTED, _bm25("bm", "asked", "code", 10), _GROUPS) + "SELECT * FROM sr",
    "prefix_match_recall": _with(_CORPUS, _MULTI, _EXPECTED, *_SELECT, _RECALL) + "SELECT * FROM re_call",
    "token_length_stats": f"""
WITH l AS (SELECT {_WORDS.format('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(t), 6) AS mean, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.95), 6) AS p95, round(quantile_cont(t, 0.99), 6) AS p99,
  min(t) AS min, max(t) AS max, CAST({C.max_words} AS BIGINT) AS model_limit, CAST(count(*) FILTER (t > {C.max_words}) AS BIGINT) AS over_limit, round(100.0 * count(*) FILTER (t > {C.max_words}) / count(*), 6) AS percentage_over_limit
FROM l""",
    "oversized_top30": f"""
WITH l AS (SELECT doc_id AS id, {_WORDS.format('text')} AS tokens FROM documents WHERE text IS NOT NULL)
SELECT * FROM (SELECT id, tokens, row_number() OVER (ORDER BY tokens DESC, id) AS position FROM l WHERE tokens > {C.max_words}) WHERE position <= 30""",
    "prompt_context": _with(_FIRST, f"""
r AS (SELECT result_id, unnest(chunks).id AS id, unnest(range(len(chunks))) AS pos FROM rag_results WHERE chunks IS NOT NULL),
o AS (SELECT result_id, list_sort(list({_CHUNK})) AS cs FROM r JOIN first USING (id) GROUP BY result_id),
t AS (SELECT result_id, len(cs) AS n, array_to_string(list_transform(cs, lambda x, i: '[' || i || ']' || chr(10) || x.t || chr(10) || chr(10)), '') AS t FROM o)""") + """
SELECT result_id, CAST(n AS BIGINT) AS n_chunks, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS context_md5 FROM t""",
    "ask_validation": _with(_Q1, f"""
v AS (SELECT regexp_replace(q.question, {_SP}, '', 'g') AS q, regexp_replace(r.answer, {_SP}, '', 'g') AS c FROM rag_results r LEFT JOIN q USING (question_id))""") + """
SELECT CASE WHEN q IS NULL OR length(q) NOT BETWEEN 1 AND 2000 THEN 'question' WHEN c IS NOT NULL AND length(c) NOT BETWEEN 1 AND 2000 THEN 'context' ELSE 'ok' END AS verdict,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(length(q)) AS BIGINT) AS question_chars FROM v GROUP BY 1""",
    "citation_sources": _with(_FIRST, "r AS (SELECT result_id, unnest(chunks).id AS id, unnest(range(len(chunks))) AS pos FROM rag_results)") + """
SELECT result_id, CAST(pos + 1 AS BIGINT) AS position, id, c.source AS type, c.file AS file, c.section AS section, c.method AS method, c.start_line AS start_line, c.end_line AS end_line FROM r JOIN first USING (id)""",
    "generation_records": """
SELECT result_id, model, question_id, CAST(length(answer) AS BIGINT) AS answer_chars, CAST(coalesce(len(chunks), 0) AS BIGINT) AS n_chunks,
  coalesce(array_to_string(list_transform(chunks, lambda c, i: i || ':' || coalesce(c.source, 'none') || ':' || coalesce(c.id, 'none')), '|'), '') AS chunks,
  CAST(NULL AS BIGINT) AS correctness, CAST(NULL AS BIGINT) AS completeness, CAST(NULL AS BIGINT) AS groundedness FROM rag_results""",
}
SQL["stored_result"] = SQL["recall_mrr_bm25"]
SQL["clean_cases"] = values(CLEANED, "id VARCHAR, cleaned VARCHAR")
SQL["rewritten"] = _with(_Q1, r"""
r AS (SELECT result_id, question, answer, regexp_extract_all(answer, '([A-Za-z_][A-Za-z0-9_]*)[ \t\n\v\f\r]*\(', 1) AS ns FROM rag_results JOIN q USING (question_id) WHERE answer IS NOT NULL)""") + """
SELECT result_id, CASE WHEN answer <> '' THEN trim(concat_ws(' ', question, array_to_string(list_filter(ns, lambda x, i: list_position(ns, x) = i), ' '))) ELSE question END AS query FROM r"""
