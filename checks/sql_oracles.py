"""The same results in DuckDB SQL, straight from the tables.

Written from the definitions and sharing no step with the Spark side: text is
never formatted or parsed, trained weights come from plain gradient descent.
"""

from __future__ import annotations

from checks.tables import EMBEDDING_LABELS, EMBEDDING_SIZE, ONEHOT_FEATURES, SEGMENTS

SPLIT_HASH = "((({key} * 2654435761 + 11) % 4294967296) / 4294967296.0::double)"


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0::double)"


def sigmoid(z: str) -> str:
    return f"(1.0::double / (1.0::double + exp(-({z}))))"


def loss(y: str, z: str) -> str:
    return f"(greatest({z}, 0.0::double) - {y} * {z} + ln(1.0::double + exp(-abs({z}))))"


EMB = f"""emb AS (
  SELECT vec_id, CASE WHEN label >= 5 THEN 1.0::double ELSE 0.0::double END AS y,
         unnest(range({EMBEDDING_SIZE}))::int AS idx, unnest(embedding)::double AS v
  FROM embeddings)"""

EMB_SCORED = f"""{EMB}, scored AS (
  SELECT vec_id, any_value(y) AS y, sum(v * idx * 0.01::double) AS z FROM emb GROUP BY vec_id)"""

MEANS = f"""cells AS (
  SELECT label AS col, unnest(range({EMBEDDING_SIZE}))::int AS idx,
         unnest(embedding)::double AS x FROM embeddings),
means AS (SELECT idx, col, avg(x) AS v FROM cells GROUP BY idx, col)"""

SEGMENT_POSITION = "list_position([" + ", ".join(f"'{s}'" for s in SEGMENTS) + "], c_mktsegment)"
ORDERS = f"""ord AS (
  SELECT o_orderkey AS row_id,
         CASE WHEN o_orderstatus = 'F' THEN 1.0::double ELSE 0.0::double END AS y,
         o_totalprice / 500000 AS price,
         substr(o_orderpriority, 1, 1)::int AS priority,
         {SEGMENT_POSITION} + 5 AS segment,
         c_nationkey + 11 AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
ORDER_CELLS = f"""{ORDERS}, entries AS (
  SELECT row_id, y, 0 AS idx, price AS v FROM ord
  UNION ALL SELECT row_id, y, priority, 1.0::double FROM ord
  UNION ALL SELECT row_id, y, segment, 1.0::double FROM ord
  UNION ALL SELECT row_id, y, nation, 1.0::double FROM ord)"""
ORDER_SCORED = f"""{ORDER_CELLS}, scored AS (
  SELECT row_id, any_value(y) AS y, sum(v * idx * 0.01::double) AS z FROM entries GROUP BY row_id)"""

LINES = """lines AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::double ELSE 0.0::double END AS y,
         {scale}::double * l_quantity / 50 AS x0, {scale}::double * l_extendedprice / 1e5 AS x1,
         {scale}::double * l_discount AS x2, {scale}::double * l_tax AS x3
  FROM lineitem)"""


def lines(scale: float = 1.0) -> str:
    return LINES.format(scale=scale)


def linear(weights: str) -> str:
    return " + ".join(f"{weights}{i} * x{i}" for i in range(4))


def embedding_lines(condition: str = "true") -> str:
    return f"""WITH {EMB} SELECT vec_id, y AS label, idx, {r("v")} AS v FROM emb WHERE {condition}"""


def gradient_of(prefix: str, cells: str, key: str, features: int) -> str:
    """0.1-regularised gradient at w = 0.01 idx, from cells and scores."""
    return f"""WITH {prefix}
SELECT f.idx, {r(f"coalesce(g.total, 0) / (SELECT count(*) FROM scored) + 0.1::double * 0.01::double * f.idx", 8)} AS v
FROM (SELECT unnest(range({features}))::int AS idx) f LEFT JOIN (
  SELECT idx, sum(({sigmoid("z")} - s.y) * v) AS total
  FROM {cells} c JOIN scored s USING ({key}) GROUP BY idx) g USING (idx)"""


def warm_steps(reg: str, count: int) -> str:
    """CTEs it0 .. it<count>: weights, objective and gradient of each iterate."""
    parts = [lines(), "it0w AS (SELECT " + ", ".join(f"0.0::double AS w{i}" for i in range(4)) + ")"]
    for k in range(count + 1):
        if k:
            parts.append(
                f"it{k}w AS (SELECT "
                + ", ".join(f"w{i} - 0.5::double * g{i} AS w{i}" for i in range(4))
                + f" FROM it{k - 1})"
            )
        z = linear("w")
        squares = " + ".join(f"any_value(w{i}) * any_value(w{i})" for i in range(4))
        gradients = ", ".join(
            f"avg(({sigmoid('z')} - y) * x{i}) + {reg} * any_value(w{i}) AS g{i}" for i in range(4)
        )
        keep = ", ".join(f"any_value(w{i}) AS w{i}" for i in range(4))
        parts.append(
            f"it{k} AS (SELECT {keep}, {gradients}, avg({loss('y', 'z')}) + {reg} / 2 * ({squares}) AS f"
            f" FROM (SELECT *, {z} AS z FROM lines, it{k}w))"
        )
    return ",\n".join(parts)


def unpivot(table: str, prefix: str, count: int, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT {i}::int AS idx, {r(f'{prefix}{i}', digits)} AS v FROM {table}" for i in range(count)
    )


def descent(rows: str, count: int, score: str, gradient: list[str], rate: float, rounds: int) -> str:
    """Weights after ``rounds`` of gradient descent as a list, reg = 0.1."""
    updates = ", ".join(
        f"any_value(w)[{i + 1}] - {rate}::double * (avg({g}) + 0.1::double * any_value(w)[{i + 1}])"
        for i, g in enumerate(gradient)
    )
    return f"""descent(k, w) AS (
  SELECT 0, list_resize([]::double[], {count}, 0.0::double)
  UNION ALL
  SELECT any_value(k) + 1, [{updates}]
  FROM (SELECT {rows}.*, k, w, {sigmoid(score)} - y AS res FROM {rows}, descent WHERE k < {rounds})
  HAVING count(*) > 0),
final AS (SELECT w FROM descent WHERE k = {rounds})"""


def armijo_values(scale: float, reg: str, count: int) -> str:
    """Objectives at steps 2^-k along the warm-start direction from zero."""
    z = " + ".join(f"d{i} * x{i}" for i in range(4))
    directions = ", ".join(f"-0.5::double * avg((0.5::double - y) * x{i}) AS d{i}" for i in range(4))
    squares = " + ".join(f"any_value(d{i}) * any_value(d{i})" for i in range(4))
    return f"""{lines(scale)}, dir AS (SELECT {directions} FROM lines),
steps AS (SELECT unnest(range({count}))::int AS trial),
grid AS (
  SELECT trial, pow(2.0::double, -trial) AS step,
         avg({loss("y", "z")}) + {reg} / 2 * pow(4.0::double, -trial) * ({squares}) AS value
  FROM (SELECT trial, y, d0, d1, d2, d3, pow(2.0::double, -trial) * ({z}) AS z
        FROM lines, dir, steps) GROUP BY trial),
accepted AS (
  SELECT {scale}::double AS scale, step, (trial + 1)::int AS trials FROM grid, dir
  WHERE value < ln(2.0::double) - step * 1e-5::double * 2 * (d0*d0 + d1*d1 + d2*d2 + d3*d3)
  ORDER BY trial LIMIT 1)"""


def armijo_step(scale: float) -> str:
    return f"(WITH {armijo_values(scale, '0.01::double', 12)} SELECT * FROM accepted)"


def curvatures() -> str:
    """s.t of the three warm-start steps on the one-hot orders, reg = 0.1."""
    n = ONEHOT_FEATURES
    parts = [ORDER_CELLS, f"w0 AS (SELECT unnest(range({n}))::int AS idx, 0.0::double AS w)"]
    for k in range(4):
        parts.append(
            f"z{k} AS (SELECT row_id, any_value(y) AS y, sum(v * w) AS z "
            f"FROM entries JOIN w{k} USING (idx) GROUP BY row_id)"
        )
        parts.append(
            f"g{k} AS (SELECT w.idx, any_value(w.w) AS w, coalesce(sum(({sigmoid('z')} - z{k}.y) * v), 0)"
            f" / (SELECT count(*) FROM z{k}) + 0.1::double * any_value(w.w) AS g"
            f" FROM w{k} w LEFT JOIN entries e USING (idx) LEFT JOIN z{k} USING (row_id) GROUP BY w.idx)"
        )
        parts.append(f"w{k + 1} AS (SELECT idx, w - 0.5::double * g AS w FROM g{k})")
    selects = " UNION ALL ".join(
        f"SELECT {k + 1}::int AS iter, {r('sum((b.w - a.w) * (b.g - a.g))', 8)} AS curvature"
        f" FROM g{k} a JOIN g{k + 1} b USING (idx)"
        for k in range(3)
    )
    return f"WITH {', '.join(parts)} {selects}"


def onehot_optimum() -> str:
    score = "w[1] * price + w[priority + 1] + w[segment + 1] + w[nation + 1]"
    gradient = ["res * price"]
    for name, first, count in (("priority", 1, 5), ("segment", 6, 5), ("nation", 11, 25)):
        gradient += [
            f"CASE WHEN {name} = {i} THEN res ELSE 0.0::double END" for i in range(first, first + count)
        ]
    return f"""WITH RECURSIVE {ORDERS},
{descent("ord", ONEHOT_FEATURES, score, gradient, 1.7, 150)}
SELECT unnest(range({ONEHOT_FEATURES}))::int AS idx, {r("unnest(w)", 3)} AS v FROM final"""


def line_optimum() -> str:
    score = " + ".join(f"w[{i + 1}] * x{i}" for i in range(4))
    return f"""WITH RECURSIVE {lines()},
{descent("lines", 4, score, [f"res * x{i}" for i in range(4)], 2.0, 150)}
SELECT unnest(range(4))::int AS idx, {r("unnest(w)", 3)} AS v FROM final"""


def embedding_job(train: str, columns: str) -> str:
    """Train where ``train`` holds, score the others."""
    score = "list_dot_product(w, x)"
    return f"""WITH RECURSIVE base AS (
  SELECT vec_id, CASE WHEN label >= 5 THEN 1.0::double ELSE 0.0::double END AS y,
         embedding::double[] AS x, {train} AS train FROM embeddings),
train AS (SELECT y, x FROM base WHERE train),
{descent("train", EMBEDDING_SIZE, score, [f"res * x[{i + 1}]" for i in range(EMBEDDING_SIZE)], 2.0, 150)},
scored AS (SELECT vec_id, y, {sigmoid(score)} AS s FROM base, final WHERE NOT train),
area AS (
  SELECT sum(CASE WHEN a.s > b.s THEN 1.0::double WHEN a.s = b.s THEN 0.5::double ELSE 0.0::double END)
         / count(*) AS auc
  FROM scored a, scored b WHERE a.y = 1 AND b.y = 0)
SELECT {columns} y AS label, {r("s", 3)} AS score, round(auc, 2) AS auc FROM scored, area"""


def two_loop() -> str:
    """The recursion on full vectors, two pairs, step by step."""
    return f"""WITH {MEANS},
wide AS (SELECT idx, {", ".join(f"max(CASE WHEN col = {c} THEN v END) AS m{c}" for c in range(5))}
         FROM means GROUP BY idx),
v AS (SELECT idx, m1 - m0 AS s1, m3 - m2 AS s2, 2 * (m1 - m0) + 0.1::double * m4 AS t1,
             2 * (m3 - m2) + 0.1::double * m4 AS t2, m4 AS g FROM wide),
c AS (SELECT sum(s1 * t1) AS st1, sum(s2 * t2) AS st2, sum(t2 * t2) AS tt2 FROM v),
a2 AS (SELECT sum(s2 * -g) / any_value(st2) AS a2 FROM v, c),
q2 AS (SELECT v.*, -g - a2 * t2 AS q FROM v, a2),
a1 AS (SELECT sum(s1 * q) / any_value(st1) AS a1 FROM q2, c),
q1 AS (SELECT q2.* EXCLUDE (q), (q - a1 * t1) * st2 / tt2 AS q FROM q2, a1, c),
b1 AS (SELECT sum(t1 * q) / any_value(st1) AS b1 FROM q1, c),
p1 AS (SELECT q1.* EXCLUDE (q), q + (a1 - b1) * s1 AS q FROM q1, a1, b1),
b2 AS (SELECT sum(t2 * q) / any_value(st2) AS b2 FROM p1, c)
SELECT idx, {r("q + (a2 - b2) * s2")} AS v FROM p1, a2, b2"""


LINE_SCORED = f"""{lines()}, exact AS (
  SELECT y, {sigmoid(" + ".join(f"{-0.3 * i!r}::double * x{i}" for i in range(4)))} AS s FROM lines),
scored AS (SELECT y, round(s, 3) AS s FROM exact)"""

CURVE = """points AS (
  SELECT s, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM scored GROUP BY s),
curve AS (
  SELECT s, pos, neg, sum(pos) OVER above AS tp, sum(neg) OVER above AS fp
  FROM points WINDOW above AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT sum(pos) AS p, sum(neg) AS n FROM points)"""

AREA = f"""SELECT {r("sum(neg::double * (tp - pos + pos / 2.0::double)) / any_value(p) / any_value(n)", 8)} AS auc,
  any_value(p)::bigint AS positives, any_value(n)::bigint AS negatives FROM curve, totals"""

ORACLES = {
    "libsvm_parse": embedding_lines(),
    "libsvm_drop": embedding_lines("vec_id % 9 <> 0"),
    "libsvm_load": f"""WITH {EMB} SELECT y AS label, idx, count(*) AS n, {r("sum(v)")} AS total,
        {EMBEDDING_SIZE}::int AS num_features FROM emb GROUP BY y, idx""",
    "feature_count": "SELECT max(len(embedding))::int AS num_features FROM embeddings",
    "examples_onehot": f"WITH {ORDER_CELLS} SELECT row_id, idx::int AS idx, {r('v', 8)} AS v FROM entries",
    "dense_row": f"WITH {EMB} SELECT vec_id, idx, {r('v')} AS v FROM emb",
    "initial_weights": f"""WITH {MEANS} SELECT idx, {r("greatest(v, 0.0::double)")} AS v
        FROM means WHERE col = 0""",
    "split_counts": f"""SELECT CASE WHEN {SPLIT_HASH.format(key="o_orderkey")} < 0.6::double
        THEN 'train' ELSE 'test' END AS side, count(*) AS n, {r("sum(o_totalprice)", 2)} AS total
        FROM orders GROUP BY 1""",
    "split_random": """SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys,
        0.6::double AS train_share FROM orders""",
    "linear_score": f"WITH {EMB_SCORED} SELECT vec_id, {r('z')} AS z FROM scored",
    "linear_score_joined": f"WITH {ORDER_SCORED} SELECT row_id AS o_orderkey, {r('z')} AS z FROM scored",
    "residual": f"WITH {EMB_SCORED} SELECT vec_id, {r(sigmoid('z') + ' - y')} AS r FROM scored",
    "log_loss": f"WITH {EMB_SCORED} SELECT vec_id, {r(loss('y', 'z'))} AS loss FROM scored",
    "example_gradient": f"""WITH {EMB_SCORED} SELECT vec_id, idx, {r(f"({sigmoid('z')} - s.y) * v")} AS g
        FROM emb JOIN scored s USING (vec_id)""",
    "objective": f"""WITH {EMB_SCORED} SELECT count(*) AS examples, {r(f"sum({loss('y', 'z')})")} AS loss_sum,
        {r(f"avg({loss('y', 'z')}) + 0.05::double * (SELECT sum((0.01::double * i) * (0.01::double * i)) FROM range({EMBEDDING_SIZE}) t(i))")}
        AS objective FROM scored""",
    "gradient_dense": gradient_of(EMB_SCORED, "emb", "vec_id", EMBEDDING_SIZE),
    "gradient_short": f"""WITH {lines()}, res AS (
        SELECT *, {sigmoid(" + ".join(f"{-0.1 * i!r}::double * x{i}" for i in range(4)))} - y AS res FROM lines),
        g AS (SELECT {", ".join(f"avg(res * x{i}) - 0.1::double * {0.1 * i!r}::double AS g{i}" for i in range(4))} FROM res)
        {unpivot("g", "g", 4, 8)}""",
    "gradient_sparse": gradient_of(ORDER_SCORED, "entries", "row_id", ONEHOT_FEATURES),
    "gradient_joined": gradient_of(ORDER_SCORED, "entries", "row_id", ONEHOT_FEATURES),
    "vec_dot": f"""WITH {MEANS} SELECT {r("sum(a.v * b.v)")} AS dot
        FROM means a JOIN means b USING (idx) WHERE a.col = 1 AND b.col = 2""",
    "vec_axpy": f"""WITH {MEANS}, a AS (SELECT idx, v FROM means WHERE col = 1 AND v > 0),
        b AS (SELECT idx, v FROM means WHERE col = 2 AND v < 0.05::double)
        SELECT idx, {r("coalesce(b.v, 0) + 2.5::double * coalesce(a.v, 0)")} AS v
        FROM a FULL JOIN b USING (idx)""",
    "vec_scal": f"WITH {MEANS} SELECT idx, {r('-3.0::double * v')} AS v FROM means WHERE col = 1",
    "vec_norm2": f"WITH {MEANS} SELECT {r('sqrt(sum(v * v))')} AS norm FROM means WHERE col = 1",
    "vec_plus_minus": f"""WITH {MEANS} SELECT idx, {r("a.v + b.v")} AS sum, {r("a.v - b.v")} AS difference
        FROM means a JOIN means b USING (idx) WHERE a.col = 1 AND b.col = 2""",
    "mat_append_drop": f"""WITH {MEANS} SELECT idx, (CASE WHEN col = 0 THEN {EMBEDDING_LABELS} - 1
        ELSE col - 1 END)::int AS col, {r("v")} AS v FROM means""",
    "mat_concat": f"""WITH {MEANS} SELECT idx, col::int AS col, {r("v")} AS v FROM means
        UNION ALL SELECT idx, (col + {EMBEDDING_LABELS} - 1)::int, {r("v")} FROM means WHERE col > 0""",
    "mat_column": f"WITH {MEANS} SELECT idx, {r('v')} AS v FROM means WHERE col = 3",
    "mat_lastcol": f"WITH {MEANS} SELECT idx, {r('v')} AS v FROM means WHERE col = {EMBEDDING_LABELS - 1}",
    "mat_shape": f"""WITH {MEANS} SELECT count(DISTINCT idx) AS counted,
        count(DISTINCT idx)::int AS num_rows, count(DISTINCT col)::int AS num_cols FROM means""",
    "mat_vector": f"WITH {MEANS} SELECT idx, {r('v')} AS v FROM means WHERE col = 4",
    "mat_dense": f"WITH {MEANS} SELECT idx, col::int AS col, {r('greatest(v, 0.0::double)')} AS v FROM means",
    "mat_gram": f"""WITH {MEANS} SELECT a.col::int AS i, b.col::int AS j, {r("sum(a.v * b.v)")} AS v
        FROM means a JOIN means b USING (idx) WHERE a.col <= b.col GROUP BY 1, 2""",
    "vec_mat": f"""WITH {MEANS} SELECT col::int AS col, {r("sum(0.01::double * idx * v)")} AS v
        FROM means GROUP BY col""",
    "mat_vec": f"WITH {MEANS} SELECT idx, {r('sum(0.5::double * col * v)')} AS v FROM means GROUP BY idx",
    "two_loop_direction": two_loop(),
    "armijo_grid": f"""WITH {armijo_values(10.0, "0.01::double", 9)}
        SELECT trial, step, {r("value")} AS value FROM grid""",
    "armijo_step": " UNION ALL ".join(f"SELECT * FROM {armijo_step(s)}" for s in (1.0, 10.0, 100.0)),
    "warm_start_3": f"WITH {warm_steps('0.1::double', 3)} {unpivot('it3', 'w', 4, 6)}",
    "train_trace": f"""WITH {warm_steps("0.1::double", 3)}
        SELECT 0::int AS iter, {r("f", 8)} AS objective, NULL::double AS improvement, NULL::double AS step,
               1::int AS trials, NULL::double AS curvature, true AS accepted FROM it0 """
    + " ".join(
        f"""UNION ALL SELECT {k}::int, {r("b.f", 8)}, {r("a.f - b.f", 8)}, 1.0::double, 1::int,
        {r(" + ".join(f"(b.w{i} - a.w{i}) * (b.g{i} - a.g{i})" for i in range(4)), 8)}, true
        FROM it{k - 1} a, it{k} b"""
        for k in (1, 2, 3)
    ),
    "curvature_pairs": curvatures(),
    "train_logistic": line_optimum(),
    "train_sparse": onehot_optimum(),
    "train_joined": onehot_optimum(),
    "score_test": f"""WITH {EMB_SCORED} SELECT vec_id, y AS label, {r(sigmoid("z"))} AS score,
        CASE WHEN {sigmoid("z")} > 0.5::double THEN 1.0::double ELSE 0.0::double END AS prediction
        FROM scored WHERE {SPLIT_HASH.format(key="vec_id")} >= 0.6::double""",
    "auc": f"WITH {LINE_SCORED}, {CURVE} {AREA}",
    "auc_bands": f"""WITH {ORDER_CELLS}, linear AS (
        SELECT any_value(y) AS y, sum(v * (idx + 1) * 0.01::double) AS z FROM entries GROUP BY row_id),
        scored AS (SELECT y, round({sigmoid("z")}, 6) AS s FROM linear), {CURVE} {AREA}""",
    "roc_points": f"""WITH {LINE_SCORED}, {CURVE} SELECT {r("s")} AS threshold,
        {r("fp / n")} AS fpr, {r("tp / p")} AS tpr FROM curve, totals""",
    "end_to_end": embedding_job(SPLIT_HASH.format(key="vec_id") + " < 0.6::double", "vec_id,"),
    "job_two_files": embedding_job("vec_id % 5 <> 0", ""),
    "score_repeated_ids": f"""SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey END AS key, count(*) AS n,
        {r("sum(0.01::double * l_discount::double + 0.02::double * l_tax::double + 0.03::double * l_linenumber::double)")} AS z
        FROM lineitem GROUP BY 1""",
}
