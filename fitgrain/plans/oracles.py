"""The queries of ``fitgrain.plans.tables`` as SQL over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

# Parsing and sources: what the lines were built from.

SQL["parse_csv"] = """
SELECT l_linenumber::DOUBLE AS label, 3::INTEGER AS n_features,
       l_quantity::DOUBLE AS f1, l_partkey::DOUBLE AS f2, l_suppkey::DOUBLE AS f3
FROM lineitem
"""

SQL["parse_nested"] = """
SELECT l_linenumber::DOUBLE AS label, 2::INTEGER AS n_features,
       l_quantity::DOUBLE AS f1, l_suppkey::DOUBLE AS f2
FROM lineitem
"""

SQL["parse_space_first"] = """
SELECT l_linenumber::DOUBLE AS label, 1::INTEGER AS n_features, l_quantity::DOUBLE AS f1
FROM lineitem
"""

SQL["parse_space_all"] = """
SELECT l_linenumber::DOUBLE AS label, 2::INTEGER AS n_features,
       l_quantity::DOUBLE AS f1, l_suppkey::DOUBLE AS f2
FROM lineitem
"""

SQL["parse_vector"] = """
SELECT 3::INTEGER AS n_features, l_linenumber::DOUBLE AS f1,
       l_quantity::DOUBLE AS f2, l_suppkey::DOUBLE AS f3
FROM lineitem
"""

SQL["parse_pair"] = """
WITH lines AS (
  SELECT string_split(concat_ws(',', c_custkey, c_name, c_mktsegment), ',') AS fields
  FROM customer
)
SELECT fields[1]::BIGINT AS id, fields[2] AS username FROM lines
"""

SQL["text_scan"] = SQL["parse_pair"]

SQL["parse_edges"] = """
WITH lines AS (
  SELECT CASE WHEN l_linenumber = 7 THEN '# ' || l_orderkey || ' ' || l_suppkey
              WHEN l_linenumber = 6 THEN ''
              ELSE l_orderkey || ' ' || l_suppkey END AS line
  FROM lineitem
)
SELECT string_split(line, ' ')[1]::BIGINT AS src, string_split(line, ' ')[2]::BIGINT AS dst
FROM lines
WHERE line <> '' AND NOT starts_with(line, '#')
"""

SQL["libsvm"] = """
SELECT CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN -1.0 ELSE 0.0 END::DOUBLE AS label,
       4::INTEGER AS n_features, l_quantity::DOUBLE AS f1, 0.0::DOUBLE AS f2,
       round(l_discount * 100)::DOUBLE AS f3, l_linenumber::DOUBLE AS f4
FROM lineitem
"""

SQL["stage"] = "SELECT * FROM customer"

SQL["split_by_key"] = """
SELECT doc_id, CASE WHEN (((doc_id % 1000003 * 7919 + 11) % 1000003) * ((doc_id % 1000003 * 7919 + 11) % 1000003)) % 1000003 < 600002 THEN 0 ELSE 1 END::INTEGER AS part
FROM documents
"""

SQL["split_seeded"] = "SELECT doc_id, lang FROM documents"


# Naive Bayes.

_LETTERS = "enousl"


def _bayes() -> str:
    counts = ", ".join(
        f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS x{j}"
        for j, c in enumerate(_LETTERS)
    )
    sums = ", ".join(f"sum(x{j}) AS s{j}" for j in range(len(_LETTERS)))
    total = " + ".join(f"s{j}" for j in range(len(_LETTERS)))
    thetas = ", ".join(
        f"ln(s{j} + 1.0) - ln({total} + {float(len(_LETTERS))}) AS t{j}"
        for j in range(len(_LETTERS))
    )
    score = " + ".join(f"x{j} * t{j}" for j in range(len(_LETTERS)))
    return f"""
WITH points AS (
  SELECT doc_id, lang AS label, {counts} FROM documents
), training AS (
  SELECT * FROM points WHERE (((doc_id % 1000003 * 7919 + 11) % 1000003) * ((doc_id % 1000003 * 7919 + 11) % 1000003)) % 1000003 < 600002
), sums AS (
  SELECT label, count(*)::DOUBLE AS n, {sums} FROM training GROUP BY label
), model AS (
  SELECT label, ln(n + 1.0) - ln((SELECT sum(n) + count(*) FROM sums)) AS pi, {thetas} FROM sums
), scored AS (
  SELECT doc_id, p.label, m.label AS candidate, pi + {score} AS score
  FROM points p, model m
  WHERE (((doc_id % 1000003 * 7919 + 11) % 1000003) * ((doc_id % 1000003 * 7919 + 11) % 1000003)) % 1000003 >= 600002
), predicted AS (
  SELECT doc_id, label, candidate AS prediction
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, candidate) AS r
        FROM scored)
  WHERE r = 1
)
"""


SQL["nb_model"] = (
    _bayes()
    + "\nUNION ALL\n".join(
        f"SELECT label, {j}::INTEGER AS j, round(pi, 6) AS pi, round(t{j}, 6) AS theta FROM model"
        for j in range(len(_LETTERS))
    )
)
SQL["nb_predict"] = _bayes() + "SELECT doc_id, label, prediction FROM predicted"
SQL["nb_correct"] = _bayes() + "SELECT doc_id, label FROM predicted WHERE label = prediction"
SQL["nb_accuracy"] = (
    _bayes()
    + """SELECT 'Accuracy' AS name,
       round(count(*) FILTER (label = prediction) / count(*)::DOUBLE, 6) AS value
FROM predicted"""
)


# Gradient models: one row of state per round.

_PRICE = """
  SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, l_extendedprice / 100000 AS y
  FROM lineitem
"""
_MARGIN = """
  SELECT 2 * l_quantity / 50 - 1 AS x1, 2 * l_discount * 10 - 1 AS x2,
         CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
         l_orderkey * 7 + l_linenumber AS key
  FROM lineitem
"""


def _descent(points: str, where: str, rounds: int, hinge: bool, dim: int = 2) -> str:
    """CTEs ``points`` and ``w`` with the final weights ``w1, w2``."""
    names = [f"w{j}" for j in range(1, dim + 1)]
    margin = "(" + " + ".join(f"w{j} * x{j}" for j in range(1, dim + 1)) + ")"
    new = []
    for j in range(1, dim + 1):
        if hinge:
            sign = "(2 * y - 1)"
            gradient = f"avg(CASE WHEN {sign} * {margin} < 1 THEN -{sign} * x{j} ELSE 0.0 END)"
            kept = f"w{j} * (1 - 0.01 / sqrt(i + 1))"
        else:
            gradient = f"avg(({margin} - y) * x{j})"
            kept = f"w{j}"
        new.append(f"{kept} - {gradient} / sqrt(i + 1) AS n{j}")
    state = ", ".join(names)
    moved = "sqrt(" + " + ".join(f"(n{j} - w{j}) ** 2" for j in range(1, dim + 1)) + ")"
    norm = "sqrt(" + " + ".join(f"n{j} ** 2" for j in range(1, dim + 1)) + ")"
    return f"""
WITH RECURSIVE points AS MATERIALIZED ({points}), training AS MATERIALIZED (
  SELECT * FROM points WHERE {where}
), g(i, {state}, done) AS (
  SELECT 0, {", ".join("0.0::DOUBLE" for _ in names)}, false
  UNION ALL
  SELECT i + 1, {", ".join(f"n{j}" for j in range(1, dim + 1))},
         i >= 1 AND {moved} < 0.001 * greatest({norm}, 1.0)
  FROM (SELECT i, {state}, {", ".join(new)}
        FROM g, training WHERE i < {rounds} AND NOT done GROUP BY i, {state})
), w AS (
  SELECT {state} FROM g ORDER BY i DESC LIMIT 1
)
"""


def _weight_rows() -> str:
    return """
SELECT 0::INTEGER AS j, round(w1, 6) AS weight FROM w
UNION ALL
SELECT 1::INTEGER AS j, round(w2, 6) AS weight FROM w"""


_LINREG = _descent(_PRICE, "true", 20, hinge=False)
_SVM20 = _descent(_MARGIN, "true", 20, hinge=True)
_SVM100 = _descent(_MARGIN, "(((key % 1000003 * 7919 + 11) % 1000003) * ((key % 1000003 * 7919 + 11) % 1000003)) % 1000003 < 600002", 100, hinge=True)
_SVM1 = _descent(_MARGIN, "true", 20, hinge=True, dim=1)

SQL["linreg_weights"] = _LINREG + _weight_rows()
SQL["linreg_predict"] = (
    _LINREG
    + """SELECT y AS label, x1 AS f1, x2 AS f2,
       round(w1 * x1 + w2 * x2, 6) AS prediction
FROM points, w"""
)
SQL["linreg_mse"] = (
    _LINREG
    + """SELECT 'training Mean Squared Error' AS name,
       round(sum((y - (w1 * x1 + w2 * x2)) ** 2) / count(*), 6) AS value
FROM points, w"""
)
SQL["program_least_squares_mse"] = SQL["linreg_mse"]
SQL["svm20_weights"] = _SVM20 + _weight_rows()
SQL["svm20_error"] = (
    _SVM20
    + """SELECT 'Training Error' AS name,
       round(avg(CASE WHEN y <> (w1 * x1 + w2 * x2 > 0)::INTEGER THEN 1.0 ELSE 0.0 END), 6)
         AS value
FROM points, w"""
)
SQL["svm20_misclassified"] = (
    _SVM20
    + """SELECT y AS label, key, (w1 * x1 + w2 * x2 > 0)::INTEGER::DOUBLE AS prediction,
       round(x1, 6) AS f1, round(x2, 6) AS f2
FROM points, w
WHERE y <> (w1 * x1 + w2 * x2 > 0)::INTEGER"""
)
SQL["svm_first_feature"] = (
    _SVM1
    + """SELECT 'Training Error' AS name,
       round(avg(CASE WHEN y <> (w1 * x1 > 0)::INTEGER THEN 1.0 ELSE 0.0 END), 6) AS value
FROM points, w"""
)
SQL["program_svm_error"] = SQL["svm_first_feature"]

_TEST = """, scored AS (
  SELECT key, y AS label, w1 * x1 + w2 * x2 AS score
  FROM points, w WHERE (((key % 1000003 * 7919 + 11) % 1000003) * ((key % 1000003 * 7919 + 11) % 1000003)) % 1000003 >= 600002
)
"""
_AREA = """
, grouped AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score
), ranked AS (
  SELECT pos, neg, coalesce(sum(neg) OVER (
    ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM grouped
)
SELECT 'Area under ROC' AS name,
       round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS value
FROM ranked
"""
SQL["svm100_margin"] = (
    _SVM100 + _TEST + "SELECT key, label, round(score, 6) AS score FROM scored"
)
SQL["svm100_auc"] = _SVM100 + _TEST + _AREA
SQL["auc_ties"] = """
WITH grouped AS (
  SELECT l_linenumber AS score, count(*) FILTER (l_returnflag = 'R') AS pos,
         count(*) FILTER (l_returnflag <> 'R') AS neg
  FROM lineitem GROUP BY l_linenumber
)
SELECT 'Area under ROC' AS name,
       round(sum(p.pos * n.neg * CASE WHEN p.score > n.score THEN 1.0
                                      WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE
             / ((SELECT sum(pos) FROM grouped) * (SELECT sum(neg) FROM grouped))::DOUBLE, 6)
         AS value
FROM grouped p, grouped n
"""


# k-means on part: both centres in one row of state per round.

_CLUSTERS = """
WITH RECURSIVE points AS MATERIALIZED (
  SELECT p_partkey, p_size / 50.0::DOUBLE AS x, (p_retailprice - 900) / 1000 AS y FROM part
), g(i, ax, ay, bx, b_y, done) AS (
  SELECT 0, 0.25::DOUBLE, 0.025::DOUBLE, 0.75::DOUBLE, 0.075::DOUBLE, false
  UNION ALL
  SELECT i + 1, nax, nay, nbx, nby,
         sqrt((nax - ax) ** 2 + (nay - ay) ** 2) <= 0.0001
         AND sqrt((nbx - bx) ** 2 + (nby - b_y) ** 2) <= 0.0001
  FROM (
    SELECT i, ax, ay, bx, b_y,
           coalesce(avg(x) FILTER (near = 0), ax) AS nax,
           coalesce(avg(y) FILTER (near = 0), ay) AS nay,
           coalesce(avg(x) FILTER (near = 1), bx) AS nbx,
           coalesce(avg(y) FILTER (near = 1), b_y) AS nby
    FROM (SELECT *, CASE WHEN (x - bx) ** 2 + (y - b_y) ** 2 < (x - ax) ** 2 + (y - ay) ** 2
                         THEN 1 ELSE 0 END AS near
          FROM g, points WHERE i < 20 AND NOT done)
    GROUP BY i, ax, ay, bx, b_y
  )
), c AS (
  SELECT * FROM g ORDER BY i DESC LIMIT 1
), assigned AS (
  SELECT p_partkey, (x - ax) ** 2 + (y - ay) ** 2 AS da, (x - bx) ** 2 + (y - b_y) ** 2 AS db
  FROM points, c
)
"""
SQL["kmeans_centers"] = (
    _CLUSTERS
    + """
SELECT 0::INTEGER AS cluster, 0::INTEGER AS j, round(ax, 6) AS x FROM c
UNION ALL SELECT 0::INTEGER, 1::INTEGER, round(ay, 6) FROM c
UNION ALL SELECT 1::INTEGER, 0::INTEGER, round(bx, 6) FROM c
UNION ALL SELECT 1::INTEGER, 1::INTEGER, round(b_y, 6) FROM c"""
)


def _seeds() -> str:
    """The start that seed 1 gives: two races of the different points."""
    prime = 2147483647
    parts = ["apart AS MATERIALIZED (SELECT DISTINCT x, y FROM points)"]
    for turn, (gap, others) in enumerate(
        (("1.0", ""), ("(x - s0.x) ** 2 + (y - s0.y) ** 2", ", s0"))
    ):
        parts.append(f"""s{turn} AS MATERIALIZED (
  SELECT x, y FROM (
    SELECT *, (a * a % {prime} * (a * a % {prime}) + a - 1) % {prime} AS draw FROM (
      SELECT apart.x, apart.y, {gap.replace("(x", "(apart.x").replace("(y", "(apart.y")} AS gap,
        1 + (({1009 + turn} * 48271 + floor(apart.x * 1e6)::BIGINT % {prime}) % {prime} * 48271
          + floor(apart.y * 1e6)::BIGINT % {prime}) % {prime} AS a
      FROM apart{others}))
  WHERE gap > 0 ORDER BY -ln((draw + 1) / {prime}::DOUBLE) / gap, x, y LIMIT 1
)""")
    return ", ".join(parts)


SQL["kmeans_seeded_centers"] = (
    SQL["kmeans_centers"]
    .replace("), g(i,", f"), {_seeds()}, g(i,")
    .replace(
        "SELECT 0, 0.25::DOUBLE, 0.025::DOUBLE, 0.75::DOUBLE, 0.075::DOUBLE, false",
        "SELECT 0, s0.x, s0.y, s1.x, s1.y, false FROM s0, s1",
    )
)
SQL["kmeans_assign"] = (
    _CLUSTERS + "SELECT p_partkey, (db < da)::INTEGER AS cluster FROM assigned"
)
SQL["kmeans_wssse"] = SQL["program_kmeans_cost"] = (
    _CLUSTERS
    + """SELECT 'Within Set Sum of Squared Errors' AS name,
       round(sum(least(da, db)), 6) AS value FROM assigned"""
)


def _embedding_clusters() -> str:
    """Twenty rounds written out; centres stay as they are once they have stopped."""
    parts = [
        "pts AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        """long AS MATERIALIZED (
  SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM pts)""",
        """c0 AS MATERIALIZED (
  SELECT vec_id::INTEGER AS k, e, false AS done FROM pts WHERE vec_id IN (0, 1))""",
    ]
    for i in range(20):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT p.vec_id, arg_min(c.k, (list_distance(p.e, c.e), c.k)) AS k
  FROM pts p, c{i} c GROUP BY p.vec_id)""")
        parts.append(f"""n{i} AS MATERIALIZED (
  SELECT k, list(x ORDER BY j) AS e
  FROM (SELECT k, j, avg(x) AS x FROM a{i} JOIN long USING (vec_id) GROUP BY k, j)
  GROUP BY k)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, CASE WHEN c.done THEN c.e ELSE coalesce(n.e, c.e) END AS e,
         c.done OR max(list_distance(c.e, coalesce(n.e, c.e))) OVER () <= 0.0001 AS done
  FROM c{i} c LEFT JOIN n{i} n ON c.k = n.k)""")
    return "WITH " + ",\n".join(parts) + "\n"


SQL["kmeans_embeddings_centers"] = (
    _embedding_clusters()
    + """SELECT k AS cluster, (j - 1)::INTEGER AS j, round(x, 6) AS x
FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM c20)"""
)
SQL["kmeans_embeddings_wssse"] = (
    _embedding_clusters()
    + """SELECT 'Within Set Sum of Squared Errors' AS name, round(sum(d), 6) AS value
FROM (SELECT min(list_distance(p.e, c.e) ** 2) AS d FROM pts p, c20 c GROUP BY p.vec_id)"""
)


# Graphs.

_TRADE = """
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
"""
_SUPPLY = """
  SELECT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem
  UNION ALL
  SELECT -1 - l_suppkey AS src, l_partkey AS dst FROM lineitem
"""
_PAGES = """
  SELECT page_id::VARCHAR AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst
  FROM pages
"""


def _ranks(edges: str) -> str:
    """CTE ``ranks(id, rank)``; a hundred supersteps, of which the last change nothing."""
    return f"""
WITH RECURSIVE edges AS MATERIALIZED ({edges}), ids AS (
  SELECT src AS id FROM edges UNION SELECT dst FROM edges
), degree AS (
  SELECT src, count(*) AS n FROM edges GROUP BY src
), x AS MATERIALIZED (
  SELECT src AS s, dst AS d, 0.85 * count(*) / any_value(n) AS w, 1 AS kind
  FROM edges JOIN degree USING (src) GROUP BY src, dst
  UNION ALL
  SELECT id, id, 0.0, 0 FROM ids
), state(i, id, rk, dl) AS (
  SELECT 0, id, 0.15::DOUBLE, 0.15::DOUBLE FROM ids
  UNION ALL
  SELECT i + 1, d,
         sum(CASE WHEN kind = 0 THEN rk WHEN dl > 0.0001 THEN dl * w ELSE 0.0 END),
         sum(CASE WHEN kind = 1 AND dl > 0.0001 THEN dl * w ELSE 0.0 END)
  FROM state JOIN x ON id = s WHERE i < 100 GROUP BY i, d
), final AS (
  SELECT id, rk FROM state WHERE i = 100
), ranks AS (
  SELECT id, rk * (SELECT count(*) FROM final) / (SELECT sum(rk) FROM final) AS rank FROM final
)
"""


SQL["outdegree"] = f"SELECT src AS id, count(*) AS degree FROM ({_SUPPLY}) GROUP BY src"
SQL["graph_vertices"] = (
    f"SELECT src AS id FROM ({_SUPPLY}) UNION SELECT dst AS id FROM ({_SUPPLY})"
)
SQL["pagerank_trade"] = _ranks(_TRADE) + "SELECT id, round(rank, 6) AS rank FROM ranks"
SQL["pagerank_names"] = (
    _ranks(_TRADE)
    + """SELECT n_name AS username, round(rank, 6) AS rank
FROM ranks JOIN nation ON id = n_nationkey"""
)
SQL["program_ranks_by_username"] = SQL["pagerank_names"]
SQL["pagerank_pages"] = _ranks(_PAGES) + "SELECT id, round(rank, 6) AS rank FROM ranks"
SQL["pagerank_supply"] = _ranks(_SUPPLY) + "SELECT id, round(rank, 6) AS rank FROM ranks"


# Trees: five levels written out over the distinct feature rows.


def _tree(label: str, impurity: str, levels: int = 5) -> str:
    """CTEs ``base``, ``g0`` (root gains), ``placed`` (rows by leaf) and ``leaves``."""

    def imp(n: str, s: str, q: str) -> str:
        if impurity == "gini":
            return f"(1.0 - (({n} - {s}) / {n}) ** 2 - ({s} / {n}) ** 2)"
        return f"({q} / {n} - ({s} / {n}) ** 2)"

    parts = [
        f"""base AS MATERIALIZED (
  SELECT floor(l_quantity / 2)::DOUBLE AS f1, l_linenumber::DOUBLE AS f2,
         round(l_discount * 100)::DOUBLE AS f3, {label} AS y
  FROM lineitem)""",
        """cells AS MATERIALIZED (
  SELECT f1, f2, f3, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q
  FROM base GROUP BY f1, f2, f3)""",
        "thresholds AS MATERIALIZED (\n"
        + "\n  UNION ALL\n".join(
            f"  SELECT {j} AS j, f{j + 1} AS v, (f{j + 1} + lead(f{j + 1}) OVER "
            f"(ORDER BY f{j + 1})) / 2 AS t FROM (SELECT DISTINCT f{j + 1} FROM cells)"
            for j in range(3)
        )
        + ")",
        "l0 AS (SELECT *, 1 AS node FROM cells)",
    ]
    for k in range(levels):
        histogram = "\n  UNION ALL\n".join(
            f"  SELECT node, {j} AS j, f{j + 1} AS v, sum(n) AS n, sum(s) AS s, sum(q) AS q "
            f"FROM l{k} GROUP BY node, f{j + 1}"
            for j in range(3)
        )
        parts.append(f"h{k} AS MATERIALIZED (\n{histogram})")
        parts.append(f"""p{k} AS (
  SELECT node, j, v, sum(n) OVER upto AS ln, sum(s) OVER upto AS ls, sum(q) OVER upto AS lq,
         sum(n) OVER whole AS n, sum(s) OVER whole AS s, sum(q) OVER whole AS q
  FROM h{k}
  WINDOW upto AS (PARTITION BY node, j ORDER BY v), whole AS (PARTITION BY node, j))""")
        parts.append(f"""g{k} AS MATERIALIZED (
  SELECT node, p.j, t, {imp("n", "s", "q")} - ln / n * {imp("ln", "ls", "lq")}
         - (n - ln) / n * {imp("(n - ln)", "(s - ls)", "(q - lq)")} AS gain
  FROM p{k} p JOIN thresholds USING (j, v) WHERE ln < n)""")
        parts.append(f"""b{k} AS (
  SELECT node, j, t, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, t) AS r
    FROM g{k} WHERE gain > 0)
  WHERE r = 1)""")
        parts.append(f"""l{k + 1} AS MATERIALIZED (
  SELECT l.f1, l.f2, l.f3, l.n, l.s, l.q,
         CASE WHEN b.node IS NULL THEN l.node
              WHEN CASE b.j WHEN 0 THEN f1 WHEN 1 THEN f2 ELSE f3 END <= b.t THEN 2 * l.node
              ELSE 2 * l.node + 1 END AS node
  FROM l{k} l LEFT JOIN b{k} b ON l.node = b.node)""")
    value = (
        "CASE WHEN sum(s) > sum(n) - sum(s) THEN 1.0 ELSE 0.0 END::DOUBLE"
        if impurity == "gini"
        else "sum(s) / sum(n)"
    )
    parts.append(
        f"leaves AS (SELECT node, {value} AS prediction FROM l{levels} GROUP BY node)"
    )
    parts.append(f"""scored AS (
  SELECT y AS label, base.f1, base.f2, base.f3, prediction
  FROM base JOIN l{levels} l ON base.f1 = l.f1 AND base.f2 = l.f2 AND base.f3 = l.f3
  JOIN leaves USING (node))""")
    return "WITH " + ",\n".join(parts) + "\n"


_CLASS = "CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END::DOUBLE"
_TREE_CLASS = _tree(_CLASS, "gini")
_TREE_PRICE = _tree("l_extendedprice", "variance")

SQL["tree_class_predict"] = _TREE_CLASS + "SELECT label, f1, f2, f3, prediction FROM scored"
SQL["tree_class_error"] = (
    _TREE_CLASS
    + """SELECT 'Training Error' AS name,
       round(count(*) FILTER (label <> prediction) / count(*)::DOUBLE, 6) AS value FROM scored"""
)
SQL["program_tree_error"] = SQL["tree_class_error"]
SQL["tree_reg_predict"] = (
    _TREE_PRICE + "SELECT label, f1, f2, f3, round(prediction, 3) AS prediction FROM scored"
)
SQL["tree_reg_mse"] = (
    _TREE_PRICE
    + """SELECT 'training Mean Squared Error' AS name,
       round(avg((label - prediction) ** 2), 1) AS value FROM scored"""
)
SQL["program_tree_mse"] = SQL["tree_reg_mse"]
SQL["best_split_gini"] = (
    _tree(_CLASS, "gini", 1)
    + "SELECT j::INTEGER AS feature, t AS threshold, round(gain, 9) AS gain FROM b0"
)
SQL["best_split_variance"] = (
    _tree("l_extendedprice", "variance", 1)
    + "SELECT j::INTEGER AS feature, t AS threshold, round(gain, 1) AS gain FROM b0"
)
SQL["best_split_wide"] = """
WITH long AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j
  FROM embeddings
), cells AS (
  SELECT j, v, label, count(*) AS n FROM (
    SELECT label, j, floor(x * 10) AS v FROM long
    UNION ALL SELECT label, j + 64, floor(x * x * 200) FROM long)
  GROUP BY ALL
), cuts AS (
  SELECT j, v, (v + lead(v) OVER (PARTITION BY j ORDER BY v)) / 2 AS t
  FROM (SELECT DISTINCT j, v FROM cells)
), sides AS (
  SELECT c.j, t, label, sum(CASE WHEN h.v <= c.v THEN n ELSE 0 END)::DOUBLE AS l,
         sum(n)::DOUBLE AS n
  FROM cuts c JOIN cells h ON h.j = c.j
  WHERE t IS NOT NULL
  GROUP BY c.j, t, label
), gains AS (
  SELECT j, t, (sum(l ** 2) / sum(l) + sum((n - l) ** 2) / sum(n - l)
                - sum(n ** 2) / sum(n)) / sum(n) AS gain
  FROM sides GROUP BY j, t
)
SELECT j::INTEGER AS feature, t AS threshold, round(gain, 9) AS gain
FROM gains ORDER BY round(gain, 12) DESC, j, t LIMIT 1
"""

SQL["split_by_rows"] = """
WITH numbered AS (
  SELECT o_custkey % 50 AS k, o_orderstatus AS s,
         row_number() OVER (PARTITION BY o_custkey % 50, o_orderstatus) - 1 AS nth
  FROM orders
), drawn AS (
  SELECT *, ('0x' || md5('11|' || md5(to_json({'k': k, 's': s})::VARCHAR) || '|' || nth)[1:8])::BIGINT AS draw
  FROM numbered
)
SELECT (draw >= 2576980378)::INTEGER AS part, k, s, count(*) AS n FROM drawn GROUP BY ALL
"""
SQL["best_split_libsvm"] = """
WITH points AS (
  SELECT (l_extendedprice > 50000)::INTEGER AS label, floor(l_quantity / 2) AS half, l_linenumber,
         l_partkey % 90 AS part, 100 + l_suppkey % 20 AS supplier
  FROM lineitem
), found AS (
  SELECT j, v, label, count(*) AS n FROM (
    SELECT label, part AS j, half AS v FROM points WHERE half <> 0
    UNION ALL SELECT label, 99, l_linenumber FROM points
    UNION ALL SELECT label, supplier, 1 FROM points)
  GROUP BY ALL
), zeros AS (
  SELECT j, label, t.n - coalesce(f.n, 0) AS n
  FROM (SELECT DISTINCT j FROM found)
  CROSS JOIN (SELECT label, count(*) AS n FROM points GROUP BY label) t
  LEFT JOIN (SELECT j, label, sum(n) AS n FROM found GROUP BY j, label) f USING (j, label)
), cells AS (
  SELECT * FROM found UNION ALL SELECT j, 0, label, n FROM zeros WHERE n > 0
), cuts AS (
  SELECT j, v, (v + lead(v) OVER (PARTITION BY j ORDER BY v)) / 2 AS t
  FROM (SELECT DISTINCT j, v FROM cells)
), sides AS (
  SELECT c.j, t, label, sum(CASE WHEN h.v <= c.v THEN n ELSE 0 END)::DOUBLE AS l,
         sum(n)::DOUBLE AS n
  FROM cuts c JOIN cells h ON h.j = c.j
  WHERE t IS NOT NULL
  GROUP BY c.j, t, label
), gains AS (
  SELECT j, t, (sum(l ** 2) / sum(l) + sum((n - l) ** 2) / sum(n - l)
                - sum(n ** 2) / sum(n)) / sum(n) AS gain
  FROM sides GROUP BY j, t
)
SELECT j::INTEGER AS feature, t AS threshold, round(gain, 9) AS gain
FROM gains ORDER BY round(gain, 12) DESC, j, t LIMIT 1
"""

# The split programs, split by a key of the parsed values.
SQL["program_svm_auc"] = (_SVM100 + _TEST + _AREA).replace(
    "l_orderkey * 7 + l_linenumber AS key",
    "(l_quantity * 100 + round(l_discount * 100))::BIGINT AS key",
)
_KEY = " + ".join(f"x{j} * {j + 1}" for j in range(len(_LETTERS)))
SQL["program_naive_bayes_accuracy"] = (
    SQL["nb_accuracy"]
    .replace("doc_id % 1000003", "split_key % 1000003")
    .replace(
        "SELECT doc_id, lang AS label,",
        f"SELECT *, ({_KEY})::BIGINT AS split_key FROM (\n"
        "  SELECT doc_id, (lang = 'en')::INTEGER::DOUBLE AS label,",
    )
    .replace("FROM documents\n)", "FROM documents)\n)")
)
