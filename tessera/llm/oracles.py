"""DuckDB SQL of the operators that SQL can express, over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit (fixed value: the polynomial)."""
    steps = f"list_transform(range(0, 4 * length(hex({text}))), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex({text}), (i // 4 + 1)::BIGINT, 2))::BIGINT ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda x, v: xor(xor(x, v) >> 1, 3988292384 * (xor(x, v) & 1))), 4294967295)"


SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS w, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (SELECT w, n, CASE WHEN doc_id IS NOT NULL THEN {crc32("(doc_id || ':' || w)")} END AS h FROM low WHERE length(w) >= 5),
seen AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM seen WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
lost AS (SELECT word, length(word) AS len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
         FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS word, b.word AS other FROM lost a JOIN lost b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM lost a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word FROM lost a JOIN words b ON a.d = b.word),
ranked AS (
  SELECT x.word, x.other, o.n AS other_n, count(*) OVER (PARTITION BY x.word) AS n_near,
         row_number() OVER (PARTITION BY x.word ORDER BY o.n DESC, x.other) AS k
  FROM near x JOIN words o ON o.word = x.other),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form,
         CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""


def _levels(name: str, first: str, levels: int) -> str:
    """CTEs of a forest's levels: (tree, p, n, h) and the digests left and right in each run."""
    out = []
    for k in range(levels + 1):
        src = first if k == 0 else (
            f"SELECT tree, p // 8 AS p, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h"
            f" FROM {name}{k - 1} GROUP BY tree, p // 8")
        out.append(f"{name}{k} AS ({src})")
        if k < levels:
            window = "OVER (PARTITION BY tree, p // 8 ORDER BY p ROWS BETWEEN {} AND {})"
            out.append(f"{name}_side{k} AS (SELECT tree, p, n, coalesce(string_agg(h, '') {window.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, '') AS l,"
                       f" coalesce(string_agg(h, '') {window.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')}, '') AS r FROM {name}{k})")
    return ",\n".join(out)


def _climb(name: str, src: str, tree: str, at: str, levels: int) -> str:
    """CTEs that extend (proof, node) of ``src`` by each level's siblings."""
    out = []
    for k in range(levels):
        before = src if k == 0 else f"{name}_up{k - 1}"
        out.append(f"{name}_up{k} AS (SELECT b.* EXCLUDE (proof, node), CASE WHEN s.n > 1 THEN b.proof || s.l || s.r ELSE b.proof END AS proof,"
                   f" CASE WHEN s.n > 1 THEN sha256(s.l || b.node || s.r) ELSE b.node END AS node"
                   f" FROM {before} b JOIN {name}_side{k} s ON s.tree = {tree} AND s.p = {at} // {8 ** k})")
    return ",\n".join(out)


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


LEVELS = 8          # 16.7 million documents a language, as many languages
MERKLE_SQL = f"""
WITH leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_leaf("text")} AS leaf,
         {_leaf(f"CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS seen
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_levels("a", "SELECT tree, p, n, leaf AS h FROM placed", LEVELS)},
{_levels("b", f"SELECT 0 AS tree, tree AS p, count(*) OVER () AS n, h FROM a{LEVELS}", LEVELS)},
begin AS (SELECT doc_id, leaf, tree, p, '' AS proof, seen AS node FROM placed),
{_climb("a", "begin", "b.tree", "b.p", LEVELS)},
{_climb("b", f"a_up{LEVELS - 1}", "0", "b.tree", LEVELS)}
SELECT u.doc_id, u.leaf, a.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = r.h AS verified
FROM b_up{LEVELS - 1} u JOIN a{LEVELS} a ON a.tree = u.tree CROSS JOIN b{LEVELS} r
"""

EGO_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
