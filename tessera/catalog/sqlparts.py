"""Reusable DuckDB SQL fragments for the oracles (CTE bodies)."""

# Words of a string as Python's str.split() gives them on the test data.
def words_sql(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')"


# Chunks (doc_id, chunk_no, chunk_text) of "Title: source\ntext", 256 words every 224.
CHUNKS = f"""
_cw AS (
  SELECT doc_id, {words_sql("'Title: ' || source || chr(10) || text")} AS w FROM documents
),
_ch AS (
  SELECT doc_id, CAST(i // 224 AS INTEGER) AS chunk_no, array_to_string(w[i + 1 : i + 256], ' ') AS chunk_text
  FROM (SELECT doc_id, w, unnest(range(0, len(w), 224)) AS i FROM _cw)
),
chunks AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS BIGINT) AS chunk_id, doc_id, chunk_no, chunk_text
  FROM _ch
)"""


def sparse_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    """CTE ``name`` (id, token, weight): L2-normalised term frequencies."""
    return f"""
{name}_t AS (
  SELECT {id_col} AS id, unnest({words_sql(f"lower({text_col})")}) AS token FROM {src}
),
{name}_tf AS (SELECT id, token, count(*) AS tf FROM {name}_t GROUP BY id, token),
{name} AS (
  SELECT id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS weight FROM {name}_tf
)"""


KNN_SPARSE_HITS = f"""
{CHUNKS},
{sparse_sql("qv", "benchmark", "item_id", "text")},
{sparse_sql("cv", "chunks", "chunk_id", "chunk_text")},
_sc AS (
  SELECT qv.id AS item_id, cv.id AS chunk_id, round(sum(qv.weight * cv.weight), 6) AS score
  FROM qv JOIN cv ON qv.token = cv.token GROUP BY qv.id, cv.id
),
hits AS (
  SELECT * FROM (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank,
           chunk_id, score FROM _sc)
  WHERE rank <= 3
)"""


def pairs_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    """CTE ``name`` (id, a, b): each character with its successor."""
    return f"""
{name}_c AS (SELECT {id_col} AS id, string_split({text_col}, '') AS c FROM {src}),
{name} AS (SELECT id, unnest(c[1 : len(c) - 1]) AS a, unnest(c[2 : len(c)]) AS b FROM {name}_c)"""


# Bigram model over documents: model(a, b, n_ab, n_a, vocab, p, bits).
MODEL = f"""
{pairs_sql("dp", "documents", "doc_id", "text")},
_mc AS (SELECT a, b, count(*) AS n_ab FROM dp GROUP BY a, b),
_mv AS (SELECT count(DISTINCT b) AS vocab FROM _mc),
_mn AS (SELECT a, b, n_ab, CAST(sum(n_ab) OVER (PARTITION BY a) AS BIGINT) AS n_a, vocab FROM _mc, _mv),
model AS (SELECT *, (n_ab + 1) / (n_a + vocab) AS p, -log2((n_ab + 1) / (n_a + vocab)) AS bits FROM _mn)"""

RAG_CONTEXT = f"""
{KNN_SPARSE_HITS},
ctx AS (
  SELECT h.item_id, string_agg(c.chunk_text, ' ' ORDER BY h.rank) AS context
  FROM hits h LEFT JOIN chunks c ON h.chunk_id = c.chunk_id GROUP BY h.item_id
)"""

def doc_bits_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    """CTE ``name`` (id, n_coded, bits): every row of ``src`` priced by ``model``; pairs the model
    has not seen cost -log2 1 / (c(a) + V), texts without a coded symbol 0."""
    return f"""
{pairs_sql(name + "_sp", src, id_col, text_col)},
{name}_pc AS (SELECT id, a, b, count(*) AS n FROM {name}_sp GROUP BY ALL),
{name}_ctx AS (SELECT DISTINCT a, n_a FROM model),
{name}_v AS (SELECT coalesce(max(vocab), 0) AS v FROM model),
{name}_pr AS (
  SELECT p.id, p.n, coalesce(m.bits, log2(greatest(coalesce(c.n_a, 0) + v, 1))) AS bits
  FROM {name}_pc p CROSS JOIN {name}_v LEFT JOIN model m ON p.a = m.a AND p.b = m.b LEFT JOIN {name}_ctx c ON p.a = c.a),
{name} AS (
  SELECT d.{id_col} AS id, CAST(coalesce(sum(q.n), 0) AS BIGINT) AS n_coded, coalesce(sum(q.n * q.bits), 0.0) AS bits
  FROM {src} d LEFT JOIN {name}_pr q ON d.{id_col} = q.id GROUP BY d.{id_col})"""


def backoff_sql(order: int, min_count: int, discount: float) -> str:
    """CTEs e0..e<order> (ctx, sym, n, p) and x0..x<order> (ctx, n_ctx, u, back_off) of the variable-order
    model of ``documents``."""
    out = [f"""{windows_sql("_tw", "documents", "doc_id", "text", order)},
_top AS (SELECT ctx, sym, count(*) AS n FROM _tw GROUP BY ALL)"""]
    for k in range(order + 1):
        lower = "1 / (x.u + 1)" if k == 0 else "l.p"
        below = "" if k == 0 else f" JOIN e{k - 1} l ON l.ctx = right(c.ctx, {k - 1}) AND l.sym = c.sym"
        out.append(f"""_c{k} AS (SELECT right(ctx, {k}) AS ctx, sym, CAST(sum(n) AS BIGINT) AS n FROM _top WHERE length(ctx) >= {k} GROUP BY 1, 2),
x{k} AS (SELECT ctx, CAST(sum(n) AS BIGINT) AS n_ctx, count(*) AS u, {discount} * count(*) / CAST(sum(n) AS BIGINT) AS back_off FROM _c{k} GROUP BY ctx
       HAVING sum(n) >= {min_count if k else 1}),
e{k} AS (SELECT c.ctx, c.sym, c.n, (c.n - {discount}) / x.n_ctx + x.back_off * {lower} AS p FROM _c{k} c JOIN x{k} x USING (ctx){below})""")
    return ",\n".join(out)


def windows_sql(name: str, src: str, id_col: str, text_col: str, order: int) -> str:
    """CTE ``name`` (id, ctx, sym): each character but the first, after the up to ``order`` characters before it."""
    before = " || ".join(f"coalesce(lag(ch, {j}) OVER w, '')" for j in range(order, 0, -1))
    return f"""{name}_c AS (SELECT {id_col} AS id, string_split({text_col}, '') AS c FROM {src}),
{name}_i AS (SELECT id, unnest(c) AS ch, generate_subscripts(c, 1) AS i FROM {name}_c),
{name}_w AS (SELECT id, i, ch AS sym, {before} AS ctx FROM {name}_i WINDOW w AS (PARTITION BY id ORDER BY i)),
{name} AS (SELECT id, ctx, sym FROM {name}_w WHERE i > 1)"""


def backoff_price_sql(name: str, src: str, order: int) -> str:
    """CTE ``name`` (ctx, sym, p): the distinct windows of ``src``, priced from the empty context up."""
    out = [f"{name}_s AS (SELECT DISTINCT ctx, sym, 1 / ((SELECT coalesce(max(u), 0) FROM x0) + 1) AS p FROM {src})"]
    for k in range(order + 1):
        before, now = name + ("_s" if k == 0 else f"_{k - 1}"), name if k == order else f"{name}_{k}"
        key = f"CASE WHEN length(s.ctx) >= {k} THEN right(s.ctx, {k}) END"
        out.append(f"""{now} AS (SELECT s.ctx, s.sym, coalesce(e.p, coalesce(x.back_off, 1.0) * s.p) AS p FROM {before} s
  LEFT JOIN e{k} e ON e.ctx = {key} AND e.sym = s.sym LEFT JOIN x{k} x ON x.ctx = {key})""")
    return ",\n".join(out)


DOC_STATS = f"""
{MODEL},
{doc_bits_sql("_db", "documents", "doc_id", "text")},
stats AS (
  SELECT d.doc_id, d.lang, d.source, CAST(length(d.text) AS INTEGER) AS n_chars,
         CAST(octet_length(encode(d.text)) AS BIGINT) AS original_bytes, round(_db.bits, 4) AS bits,
         CAST(ceil(round(_db.bits, 4) / 8) AS BIGINT) AS compressed_bytes
  FROM documents d JOIN _db ON d.doc_id = _db.id
)"""
