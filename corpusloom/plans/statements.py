"""SQL building blocks shared by the stated results (DuckDB dialect)."""

from __future__ import annotations

from corpusloom.functions.text import WHITESPACE

WS = "'" + WHITESPACE + "'"
TOKENS = r"regexp_extract_all(lower({0}), '[a-z]+|[\x{{4e00}}-\x{{9fff}}]')"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def tokens(expr: str) -> str:
    return TOKENS.format(expr)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def terms(prefix: str, source: str, item: str, text: str) -> str:
    """<prefix>_len(item, doc_len), _tf(item, token, tf), _df(token, df), _tot(n_docs, avg_len)."""
    return f"""
{prefix}_len AS (SELECT {item}, len({tokens(text)}) AS doc_len FROM {source}),
{prefix}_tf AS (SELECT {item}, token, count(*) AS tf
  FROM (SELECT {item}, unnest({tokens(text)}) AS token FROM {source}) GROUP BY {item}, token),
{prefix}_df AS (SELECT token, count(*) AS df FROM {prefix}_tf GROUP BY token),
{prefix}_tot AS (SELECT count(*)::DOUBLE AS n_docs, coalesce(avg(doc_len::DOUBLE), 1e0) AS avg_len FROM {prefix}_len)"""


IDF = "ln((n_docs - df + 5e-1) / (df + 5e-1) + 1e0)"


def saturation(tf: str, length: str) -> str:
    return f"({tf} * 25e-1 / ({tf} + 15e-1 * (25e-2 + 75e-2 * {length} / greatest(avg_len, 1e0))))"


def bm25_search(prefix: str, corpus: str, item: str, queries: str, question: str, k: int) -> str:
    """<prefix>(question, item, score, rank) given terms(corpus, ...) and terms(queries, ...)."""
    return f"""
{prefix}_q AS (SELECT q.{question}, q.token, {IDF} AS idf, {IDF} * {saturation("q.tf", "l.doc_len")} AS qw
  FROM {queries}_tf q JOIN {queries}_len l USING ({question}) JOIN {corpus}_df d ON q.token = d.token, {corpus}_tot),
{prefix}_s AS (SELECT {question}, t.{item}, sum(qw * idf * {saturation("t.tf", "l.doc_len")}) AS score
  FROM {prefix}_q JOIN {corpus}_tf t ON {prefix}_q.token = t.token JOIN {corpus}_len l ON l.{item} = t.{item}, {corpus}_tot
  GROUP BY {question}, t.{item}),
{prefix} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {question} ORDER BY round(score, 9) DESC, {item}) AS rank
  FROM {prefix}_s) WHERE rank <= {k})"""


def letters(expr: str) -> str:
    """Unit letter-count vector of a text."""
    low = f"lower({expr})"
    raw = "[" + ", ".join(f"(length({low}) - length(replace({low}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
    return f"(SELECT CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END FROM (SELECT v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT {raw} AS v)))"


def vectors(name: str, source: str, item: str, text: str) -> str:
    low = f"lower({text})"
    raw = "[" + ", ".join(f"(length({low}) - length(replace({low}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
    return f"""
{name} AS (SELECT {item}, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS v
  FROM (SELECT {item}, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT {item}, {raw} AS v FROM {source})))"""


def dense_search(prefix: str, corpus: str, item: str, queries: str, question: str, k: int) -> str:
    return f"""
{prefix} AS (SELECT * FROM (SELECT {question}, {item}, score,
    row_number() OVER (PARTITION BY {question} ORDER BY round(score, 9) DESC, {item}) AS rank
  FROM (SELECT q.{question}, c.{item}, list_inner_product(q.v, c.v) AS score FROM {queries} q, {corpus} c)) WHERE rank <= {k})"""


def _windows(name: str, source: str, keys: str, text: str, size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""
{name} AS (SELECT {keys}, i, trim(substr({text}, i * {stride} + 1, {size}), {WS}) AS piece
  FROM (SELECT *, unnest(range(0, greatest(0, ceil((length({text}) - {size}) / {stride}.0))::BIGINT + 1)) AS i FROM {source}))"""


def chunks(source: str = "(SELECT 'doc' || doc_id AS filename, 0 AS page_number, text FROM documents)") -> str:
    """chunk(filename, page_number, text, chunk_level, chunk_id, parent_chunk_id, root_chunk_id, page_chunk_idx)."""
    cid = lambda level, idx: f"filename || '::p' || page_number || '::l{level}::' || ({idx})"
    key = "filename, page_number"
    number = lambda order: f"(row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1)::BIGINT"
    return f"""
page0 AS (SELECT {key}, trim(text, {WS}) AS body FROM {source}),
{_windows("w1", "page0", key, "body", 1200, 240)},
l1 AS (SELECT {key}, {number("i")} AS r, piece FROM w1 WHERE piece <> ''),
{_windows("w2", "l1", key + ", r", "piece", 600, 120)},
l2 AS (SELECT {key}, r, {number("r, i")} AS m, piece FROM w2 WHERE piece <> ''),
{_windows("w3", "l2", key + ", r, m", "piece", 300, 60)},
l3 AS (SELECT {key}, r, m, {number("m, i")} AS l, piece FROM w3 WHERE piece <> ''),
chunk0 AS (
  SELECT {key}, r, -1 AS m, -1 AS l, 1 AS chunk_level, {cid(1, "r")} AS chunk_id, '' AS parent_chunk_id, {cid(1, "r")} AS root_chunk_id, piece AS text FROM l1
  UNION ALL SELECT {key}, r, m, -1, 2, {cid(2, "m")}, {cid(1, "r")}, {cid(1, "r")}, piece FROM l2
  UNION ALL SELECT {key}, r, m, l, 3, {cid(3, "l")}, {cid(2, "m")}, {cid(1, "r")}, piece FROM l3),
chunk AS (SELECT {key}, text, chunk_level::BIGINT AS chunk_level, chunk_id, parent_chunk_id, root_chunk_id,
  (row_number() OVER (PARTITION BY {key} ORDER BY r, m, l) - 1)::BIGINT AS page_chunk_idx FROM chunk0),
leaf AS (SELECT * FROM chunk WHERE chunk_level = 3)"""


QUESTIONS = "question AS (SELECT item_id AS question_id, text AS query FROM benchmark)"

QA = """
qa AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def hybrid(prefix: str, queries: str, question: str, k: int = 15) -> str:
    """<prefix>(question, chunk_id, score, rrf_rank) over ``leaf`` with leaf_* terms and ``leaf_v``."""
    return f"""
{terms(prefix + "_t", queries, question, "query")},
{vectors(prefix + "_v", queries, question, "query")},
{bm25_search(prefix + "_b", "leaf", "chunk_id", prefix + "_t", question, 2 * k)},
{dense_search(prefix + "_d", "leaf_v", "chunk_id", prefix + "_v", question, 2 * k)},
{prefix}_u AS (SELECT {question}, chunk_id, 1e0 / (60 + rank) AS part FROM {prefix}_b
  UNION ALL SELECT {question}, chunk_id, 1e0 / (60 + rank) FROM {prefix}_d),
{prefix}_f AS (SELECT {question}, chunk_id, sum(part) AS score FROM {prefix}_u GROUP BY ALL),
{prefix} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {question} ORDER BY round(score, 9) DESC, chunk_id) AS rrf_rank
  FROM {prefix}_f) WHERE rrf_rank <= {k})"""


INDEX = f"""{chunks()},
{terms("leaf", "leaf", "chunk_id", "text")},
{vectors("leaf_v", "leaf", "chunk_id", "text")}"""


def reranked(prefix: str, hits: str, queries: str, question: str, top: int = 5) -> str:
    """Overlap-reranked hits with chunk fields as ``pos`` 1..top."""
    asked = f"list_distinct({tokens('query')})"
    return f"""
{prefix}_c AS (SELECT h.*, l.* EXCLUDE (chunk_id), len(list_intersect({asked}, {tokens("l.text")})) / greatest(len({asked}), 1)::DOUBLE AS rerank_score
  FROM {hits} h JOIN leaf l USING (chunk_id) JOIN {queries} q USING ({question})),
{prefix} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {question} ORDER BY round(rerank_score, 9) DESC, rrf_rank) AS pos
  FROM {prefix}_c) WHERE pos <= {top})"""


def merged_level(prefix: str, hits: str, question: str) -> str:
    """One merge pass; ``hits`` has pos, score, chunk fields, rrf_rank, rerank_score, merged_child_count, replaced, merge_steps."""
    taken = lambda c: f"CASE WHEN p_id IS NULL THEN {c} ELSE p_{c} END AS {c}"
    fields = ["text", "filename", "page_number", "parent_chunk_id", "root_chunk_id", "chunk_level"]
    return f"""
{prefix}_n AS (SELECT h.*, count(*) OVER (PARTITION BY {question}, parent_chunk_id) AS n FROM {hits} h),
{prefix}_j AS (SELECT h.*, c.chunk_id AS p_id, {", ".join(f"c.{f} AS p_{f}" for f in fields)}
  FROM {prefix}_n h LEFT JOIN chunk c ON c.chunk_id = h.parent_chunk_id AND h.parent_chunk_id <> '' AND h.n >= 2),
{prefix}_m AS (SELECT {question}, pos, score, CASE WHEN p_id IS NULL THEN chunk_id ELSE p_id END AS chunk_id,
  {", ".join(taken(f) for f in fields)},
  CASE WHEN p_id IS NULL THEN rrf_rank END AS rrf_rank, CASE WHEN p_id IS NULL THEN rerank_score END AS rerank_score,
  CASE WHEN p_id IS NULL THEN merged_child_count ELSE n END AS merged_child_count,
  replaced + sum(CASE WHEN p_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {question}) AS replaced,
  merge_steps + CASE WHEN sum(CASE WHEN p_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {question}) > 0 THEN 1 ELSE 0 END AS merge_steps
  FROM {prefix}_j),
{prefix} AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY {question}, chunk_id ORDER BY pos) AS nth
  FROM {prefix}_m) WHERE nth = 1)"""


def auto_merged(prefix: str, hits: str, question: str, top: int = 5) -> str:
    return f"""
{prefix}_0 AS (SELECT *, NULL::BIGINT AS merged_child_count, 0 AS replaced, 0 AS merge_steps FROM {hits}),
{merged_level(prefix + "_1", prefix + "_0", question)},
{merged_level(prefix + "_2", prefix + "_1", question)},
{prefix} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {question} ORDER BY round(score, 9) DESC, pos) AS rank
  FROM {prefix}_2) WHERE rank <= {top})"""


def retrieved(prefix: str, queries: str, question: str) -> str:
    return ",".join(
        [hybrid(prefix + "_h", queries, question), reranked(prefix + "_r", prefix + "_h", queries, question), auto_merged(prefix, prefix + "_r", question)]
    )


def context(name: str, hits: str, question: str) -> str:
    line = "'[' || rank || '] ' || filename || ' (Page ' || page_number || '):' || chr(10) || text"
    return f"""
{name} AS (SELECT {question}, string_agg({line}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM {hits} GROUP BY {question})"""


def default_cot(question: str) -> str:
    """The fixed reasoning text around the head of a question."""
    from corpusloom.operators import curation as cu

    quote = lambda text: "'" + text.replace("'", "''") + "'"
    return f"{quote(cu.DEFAULT_COT_HEAD)} || substr({question}, 1, {cu.DEFAULT_COT_QUESTION}) || {quote(cu.DEFAULT_COT_TAIL)}"
