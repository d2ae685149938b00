"""Registered language-model queries: training, scoring, cdf, filters, retrieval gain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import MODEL, RAG_CONTEXT, backoff_price_sql, backoff_sql, doc_bits_sql, pairs_sql, windows_sql
from tessera.operators import backoff as BO
from tessera.operators import lm
from tessera.operators import retrieval as R
from tessera.plans.rag import retrieve_with_context
from tessera.session import table

NUCLEUS_P = 0.9
SAMPLE_T, SAMPLE_K, SAMPLE_P = 0.8, 10, 0.95
RAG_LAMBDA = 0.25


def _model(spark, sf):
    return lm.train_bigram(table(spark, sf, "documents"))


@register("train_ngram", f"""WITH {MODEL}
SELECT a, b, n_ab, n_a, vocab, round(p, 12) AS p, round(bits, 9) AS bits FROM model""")
def q_train_ngram(spark, sf):
    m = _model(spark, sf)
    return m.select("a", "b", "n_ab", "n_a", "vocab", F.round("p", 12).alias("p"), F.round("bits", 9).alias("bits"))


@register("entropy_bits", f"""WITH {MODEL},
{doc_bits_sql("_db", "documents", "doc_id", "text")}
SELECT d.doc_id, CAST(length(d.text) AS INTEGER) AS n_chars, _db.n_coded, round(_db.bits, 4) AS bits,
       CASE WHEN _db.bits > 0 THEN round(length(d.text) * 8 / _db.bits, 6) END AS theoretical_ratio_chars,
       CASE WHEN _db.bits > 0 THEN round(octet_length(encode(d.text)) * 8 / _db.bits, 6) END AS theoretical_ratio_bytes
FROM documents d JOIN _db ON d.doc_id = _db.id""")
def q_entropy_bits(spark, sf):
    docs = table(spark, sf, "documents")
    bits = lm.document_bits(docs, _model(spark, sf))
    sizes = docs.select("doc_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("_bytes"))
    return sizes.join(bits, "doc_id").select(
        "doc_id", "n_chars", "n_coded", F.round("bits", 4).alias("bits"),
        F.round(F.try_divide(F.col("n_chars") * 8, "bits"), 6).alias("theoretical_ratio_chars"),
        F.round(F.try_divide(F.col("_bytes") * 8, "bits"), 6).alias("theoretical_ratio_bytes"))


_TURNS_SQL = "turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)"


@register("heldout_bits", f"""WITH {MODEL}, {_TURNS_SQL},
{doc_bits_sql("_tb", "turns", "turn_id", "text")}
SELECT id AS turn_id, n_coded, round(bits, 4) AS bits FROM _tb""")
def q_heldout_bits(spark, sf):
    """Conversation turns scored by the model of the documents: pairs and contexts it has not seen count."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    b = lm.document_bits(turns, _model(spark, sf), id_col="turn_id")
    return b.select("turn_id", "n_coded", F.round("bits", 4).alias("bits"))


_BACKOFF = backoff_sql(BO.ORDER, BO.MIN_COUNT, BO.DISCOUNT)


@register("train_backoff", f"WITH {_BACKOFF}\n" + " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS level, ctx, sym, n, round(p, 10) AS p FROM e{k}" for k in range(BO.ORDER + 1)))
def q_train_backoff(spark, sf):
    m = BO.train(table(spark, sf, "documents"))
    return m.entries.select("level", "ctx", "sym", "n", F.round("p", 10).alias("p"))


@register("backoff_bits", f"""WITH {_BACKOFF}, {_TURNS_SQL},
{windows_sql("_hw", "turns", "turn_id", "text", BO.ORDER)},
{backoff_price_sql("_hp", "_hw", BO.ORDER)},
_hb AS (SELECT id, count(*) AS n_coded, sum(-log2(p)) AS bits FROM _hw JOIN _hp USING (ctx, sym) GROUP BY id)
SELECT turn_id, coalesce(n_coded, 0) AS n_coded, round(coalesce(bits, 0.0), 4) AS bits FROM turns LEFT JOIN _hb ON id = turn_id""")
def q_backoff_bits(spark, sf):
    """Conversation turns scored by the variable-order model of the documents."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    b = BO.document_bits(turns, BO.train(table(spark, sf, "documents")), id_col="turn_id")
    return b.select("turn_id", "n_coded", F.round("bits", 4).alias("bits"))


@register("shift_context", f"""WITH {pairs_sql("sp", "documents", "doc_id", "text")}
SELECT id AS doc_id, a, b, count(*) AS n FROM sp GROUP BY ALL""")
def q_shift_context(spark, sf):
    return lm.pair_counts(table(spark, sf, "documents"), "doc_id", "text")


@register("symbol_prob_join", f"""WITH {MODEL},
{pairs_sql("sp", "conversations", "conv_id", "text")},
_pc AS (SELECT id AS conv_id, a, b, count(*) AS n FROM sp GROUP BY ALL),
_ctx AS (SELECT DISTINCT a, n_a FROM model), _v AS (SELECT max(vocab) AS v FROM model)
SELECT _pc.conv_id, _pc.a, _pc.b, _pc.n, round(coalesce(m.p, 1 / (coalesce(c.n_a, 0) + v)), 12) AS p
FROM _pc CROSS JOIN _v LEFT JOIN model m ON _pc.a = m.a AND _pc.b = m.b LEFT JOIN _ctx c ON _pc.a = c.a""")
def q_symbol_prob_join(spark, sf):
    pc = lm.pair_counts(table(spark, sf, "conversations"), "conv_id", "text")
    return lm.with_bits(pc, _model(spark, sf)).select("conv_id", "a", "b", "n", F.round("p", 12).alias("p"))


@register("symbol_cdf", f"""WITH {MODEL}
SELECT a, b, CAST(coalesce(sum(n_ab) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_lo,
       CAST(coalesce(sum(n_ab) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n_ab AS BIGINT) AS cum_hi,
       n_a AS total FROM model""")
def q_symbol_cdf(spark, sf):
    return lm.symbol_cdf(_model(spark, sf))


@register("topk_membership", f"""WITH {MODEL},
_top AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n_ab DESC, b) AS r FROM model) WHERE r <= 5),
{pairs_sql("sp", "documents", "doc_id", "text")}
SELECT sp.id AS doc_id, count(*) AS n_coded, count(_top.a) AS n_in_topk, round(count(_top.a) / count(*), 6) AS topk_rate
FROM sp LEFT JOIN _top ON sp.a = _top.a AND sp.b = _top.b GROUP BY sp.id""")
def q_topk_membership(spark, sf):
    return lm.topk_membership(table(spark, sf, "documents"), _model(spark, sf))


@register("nucleus_filter", f"""WITH {MODEL},
_q AS (SELECT a, b, n_ab, n_a, n_ab / n_a AS q FROM model),
_m AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY a ORDER BY n_ab DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS mb FROM _q)
SELECT a, b, n_ab, n_a FROM _m WHERE mb < {NUCLEUS_P}""")
def q_nucleus_filter(spark, sf):
    return lm.nucleus_filter(_model(spark, sf), NUCLEUS_P).select("a", "b", "n_ab", "n_a")


@register("sample_distribution", f"""WITH {MODEL},
_w0 AS (SELECT a, b, n_ab, pow(n_ab / n_a, {1 / SAMPLE_T!r}) AS w FROM model),
_w1 AS (SELECT a, b, n_ab, w / sum(w) OVER (PARTITION BY a) AS w FROM _w0),
_w2 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r,
               coalesce(sum(w) OVER (PARTITION BY a ORDER BY w DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS mb
        FROM _w1),
_w3 AS (SELECT * FROM _w2 WHERE r <= {SAMPLE_K} AND mb < {SAMPLE_P})
SELECT a, b, round(w / sum(w) OVER (PARTITION BY a), 9) AS p_sample FROM _w3""")
def q_sample_distribution(spark, sf):
    d = lm.sample_distribution(_model(spark, sf), SAMPLE_T, SAMPLE_K, SAMPLE_P)
    return d.select("a", "b", F.round("p_sample", 9).alias("p_sample"))


@register("normalize_pdf", f"""WITH {MODEL}
SELECT a, b, round((1 - 2 * count(*) OVER (PARTITION BY a) * {lm.FLOAT32_EPS!r}) * (p / sum(p) OVER (PARTITION BY a)) + {lm.FLOAT32_EPS!r}, 10) AS p_norm
FROM model""")
def q_normalize_pdf(spark, sf):
    return lm.normalize_pdf(_model(spark, sf)).select("a", "b", F.round("p_norm", 10).alias("p_norm"))


@register("prob_diff", f"""WITH {MODEL},
_q AS (SELECT a, p, greatest(1, floor(p * 65536)) / 65536.0 AS pq FROM model)
SELECT a, round(max(abs(p - pq)), 10) AS max_abs_diff, round(abs(sum(pq) - 1), 10) AS sum_error FROM _q GROUP BY a""")
def q_prob_diff(spark, sf):
    d = lm.prob_diff(_model(spark, sf))
    return d.select("a", F.round("max_abs_diff", 10).alias("max_abs_diff"), F.round("sum_error", 10).alias("sum_error"))


@register("softmax", """
WITH _e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
_x AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS ex FROM _e),
_p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM _x)
SELECT vec_id, list_transform(p, lambda x: round(x, 9)) AS p, CAST(list_position(p, list_max(p)) AS INTEGER) AS argmax FROM _p""")
def q_softmax(spark, sf):
    e = table(spark, sf, "embeddings")
    p = lm.softmax_array(F.col("embedding").cast("array<double>"))
    return e.select("vec_id", p.alias("p")).select(
        "vec_id", F.transform("p", lambda x: F.round(x, 9)).alias("p"), F.array_position("p", F.array_max("p")).cast("int").alias("argmax"))


@register("rag_entropy_gain", f"""WITH {MODEL},
{RAG_CONTEXT},
{pairs_sql("ip", "benchmark", "item_id", "text")},
{pairs_sql("cp", "ctx", "item_id", "context")},
_ipc AS (SELECT id, a, b, count(*) AS n FROM ip GROUP BY ALL),
_cpc AS (SELECT id, a, b, count(*) AS c_ab FROM cp GROUP BY ALL),
_ca AS (SELECT id, a, sum(c_ab) AS c_a FROM _cpc GROUP BY ALL),
_ma AS (SELECT DISTINCT a, n_a FROM model),
_v AS (SELECT max(vocab) AS v FROM model),
_j AS (
  SELECT i.id, i.n,
         (coalesce(m.n_ab, 0) + 1) / (coalesce(ma.n_a, 0) + _v.v) AS pb,
         (coalesce(c.c_ab, 0) + 1) / (coalesce(ca.c_a, 0) + _v.v) AS pc
  FROM _ipc i CROSS JOIN _v
  LEFT JOIN _cpc c ON i.id = c.id AND i.a = c.a AND i.b = c.b
  LEFT JOIN _ca ca ON i.id = ca.id AND i.a = ca.a
  LEFT JOIN model m ON i.a = m.a AND i.b = m.b
  LEFT JOIN _ma ma ON i.a = ma.a
),
_s AS (SELECT id AS item_id, CAST(sum(n) AS BIGINT) AS n_coded, sum(-n * log2(pb)) AS bp,
              sum(-n * log2({RAG_LAMBDA} * pc + {1 - RAG_LAMBDA} * pb)) AS br FROM _j GROUP BY id)
SELECT item_id, n_coded, round(bp, 4) AS bits_plain, round(br, 4) AS bits_rag, round(bp - br, 4) AS gain_bits FROM _s""")
def q_rag_entropy_gain(spark, sf):
    ctx = retrieve_with_context(spark, sf)
    r = lm.rag_bits(table(spark, sf, "benchmark"), ctx, _model(spark, sf), lam=RAG_LAMBDA)
    return r.select("item_id", "n_coded", F.round("bits_plain", 4).alias("bits_plain"),
                    F.round("bits_rag", 4).alias("bits_rag"),
                    F.round(F.col("bits_plain") - F.col("bits_rag"), 4).alias("gain_bits"))


# ------------------------------------------------------------------ model hooks

@register("predictor_udf", f"""WITH {MODEL},
{doc_bits_sql("_db", "documents", "doc_id", "text")}
SELECT id AS doc_id, n_coded, round(bits, 4) AS bits FROM _db WHERE n_coded > 0""")
def q_predictor_udf(spark, sf):
    from tessera.functions.hooks import bigram_predictor, predicted_bits
    bits = predicted_bits(table(spark, sf, "documents"), bigram_predictor(_model(spark, sf)))
    return bits.where("n_coded > 0").select("doc_id", "n_coded", F.round("bits", 4).alias("bits"))


ACCUMULATION_STEPS = 4      # batches whose losses make one optimiser step


@register("mean_loss", f"""WITH {MODEL},
{doc_bits_sql("_db", "documents", "doc_id", "text")},
_d AS (SELECT id AS doc_id, CASE WHEN n_coded > 0 THEN bits / n_coded END AS loss FROM _db),
_b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_no, loss FROM _d),
_m AS (SELECT batch_no, avg(loss) / {ACCUMULATION_STEPS} AS batch_loss FROM _b GROUP BY batch_no),
_s AS (SELECT batch_no // {ACCUMULATION_STEPS} AS step, sum(batch_loss) AS step_loss FROM _m GROUP BY 1)
SELECT (SELECT count(*) FROM _m) AS n_batches, count(*) AS n_steps, round(avg(step_loss), 6) AS mean_loss FROM _s""")
def q_mean_loss(spark, sf):
    from tessera.operators.ordering import global_rank
    docs = table(spark, sf, "documents")
    bits = lm.document_bits(docs, _model(spark, sf)).select("doc_id", F.try_divide("bits", "n_coded").alias("loss"))
    ranked = global_rank(bits, ["doc_id"], out="r")
    per_batch = ranked.groupBy(F.floor(F.col("r") / 8).alias("batch_no")).agg(
        (F.avg("loss") / ACCUMULATION_STEPS).alias("batch_loss"))
    steps = per_batch.groupBy(F.floor(F.col("batch_no") / ACCUMULATION_STEPS).alias("step")).agg(
        F.sum("batch_loss").alias("step_loss"), F.count(F.lit(1)).alias("n"))
    return steps.agg(F.sum("n").cast("long").alias("n_batches"), F.count(F.lit(1)).alias("n_steps"),
                     F.round(F.avg("step_loss"), 6).alias("mean_loss"))


@register("classify_bytes")
def q_classify_bytes(spark, sf):
    from tessera.operators import classify as CL
    from tessera.operators import trainset as TS
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    split = TS.train_eval_split(CL.byte_features(docs, "content"), "doc_id", share=0.2)
    model = CL.fit_classifier(split.filter(F.col("split") == "train"), "content", "lang")
    pred = CL.predict(model, split, "content")
    return pred.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.avg((F.col("prediction") == F.col("_label")).cast("int")), 6).alias("accuracy"))


_CLASSIFY_SQL = """
_rk AS (SELECT doc_id, row_number() OVER (ORDER BY md5('31:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents),
_d AS (SELECT d.doc_id, lang, hex(encode(text)) AS h, CASE WHEN r < floor((SELECT count(*) FROM documents) * 0.2) THEN 'eval' ELSE 'train' END AS split
       FROM documents d JOIN _rk USING (doc_id)),
_by AS (SELECT doc_id, lang, split, regexp_extract_all(h, '..') AS l FROM _d),
_pos AS (SELECT doc_id, lang, split, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM _by),
_two AS (SELECT doc_id, lang, split, x || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS xy FROM _pos),
_pc AS (SELECT doc_id, lang, split, ('0x' || xy)::INTEGER AS pair, count(*) AS n FROM _two WHERE xy IS NOT NULL GROUP BY ALL),
_seen AS (SELECT pair, lang AS label, CAST(sum(n) AS BIGINT) AS n FROM _pc WHERE split = 'train' GROUP BY ALL),
_cl AS (SELECT lang AS label, count(*) AS n_rows, ln(count(*) / (SELECT count(*) FROM _d WHERE split = 'train')) AS prior FROM _d WHERE split = 'train' GROUP BY lang),
_np AS (SELECT label, sum(n) AS n_pairs FROM _seen GROUP BY label),
_sum AS (SELECT doc_id, label, sum(p.n * ln(s.n + 1)) AS s FROM _pc p JOIN _seen s USING (pair) GROUP BY ALL),
_len AS (SELECT doc_id, sum(n) AS n FROM _pc GROUP BY doc_id),
_score AS (SELECT d.doc_id, d.split, c.label, c.prior - coalesce(l.n, 0) * ln(coalesce(np.n_pairs, 0) + 65536) + coalesce(s.s, 0) AS score
           FROM _d d CROSS JOIN _cl c LEFT JOIN _np np ON np.label = c.label LEFT JOIN _len l ON l.doc_id = d.doc_id LEFT JOIN _sum s ON s.doc_id = d.doc_id AND s.label = c.label)"""


@register("classify_counts", f"""WITH {_CLASSIFY_SQL}
SELECT doc_id, split, label AS predicted FROM _score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1""")
def q_classify_counts(spark, sf):
    """The language of each document from its byte pairs, learned on the training part of the split."""
    from tessera.operators import classify as CL
    from tessera.operators import trainset as TS
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    split = TS.train_eval_split(docs.select("doc_id"), "doc_id", share=0.2).select("doc_id", "split")
    model = CL.fit_counts(docs.join(split.where("split = 'train'"), "doc_id", "left_semi"), "content", "lang")
    return CL.predict_counts(model, docs, "doc_id", "content").join(split, "doc_id").select("doc_id", "split", "predicted")


_GENERATE_SQL = """
_hi AS (SELECT a, b, sum(CAST(n_ab AS DOUBLE)) OVER (PARTITION BY a ORDER BY b ROWS UNBOUNDED PRECEDING) / sum(CAST(n_ab AS DOUBLE)) OVER (PARTITION BY a) AS hi FROM model),
_iv AS (SELECT a, b, hi, coalesce(lag(hi) OVER (PARTITION BY a ORDER BY b), 0.0) AS lo FROM _hi),
gen AS (
  SELECT item_id AS id, 0 AS step, CASE WHEN length(text) > 0 THEN right(text, 1) ELSE chr(10) END AS a, '' AS generated, true AS going, false AS stopped FROM benchmark
  UNION ALL
  SELECT g.id, g.step + 1, CASE WHEN v.b <> chr(10) THEN v.b ELSE g.a END, CASE WHEN v.b <> chr(10) THEN g.generated || v.b ELSE g.generated END,
         coalesce(v.b <> chr(10), false), coalesce(v.b = chr(10), false)
  FROM (SELECT *, CAST(('0x' || substr(md5('0:' || CAST(id AS VARCHAR) || ':' || CAST(step AS VARCHAR)), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496 AS u
        FROM gen WHERE going AND step < 64) g
  LEFT JOIN _iv v ON v.a = g.a AND g.u >= v.lo AND g.u < v.hi)"""


@register("ngram_generate", f"""WITH RECURSIVE {MODEL}, {_GENERATE_SQL}
SELECT id, arg_max(generated, step) AS generated, CAST(length(arg_max(generated, step)) AS INTEGER) AS n_generated, arg_max(stopped, step) AS stopped FROM gen GROUP BY id""")
def q_ngram_generate(spark, sf):
    from tessera.operators.generate import generate
    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return generate(prompts, _model(spark, sf), max_new=64)
