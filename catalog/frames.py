"""Frames derived from the shared tables, in Spark and as SQL.

Every Spark frame ``x(spark, d)`` has SQL of the same rows in ``X``, to be
put after ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


N_FEATURES = 64
FEATURES = [f"VA/{i}" for i in range(N_FEATURES)]
REFERENCE = "D0"
DX = [f"D{i}" for i in range(10)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q(name: str) -> str:
    return '"' + name + '"'


# --- cohort: one row per vector, class D0..D9, D0 is the reference -------------
def cohort(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.selectExpr(
        "vec_id AS id",
        "concat('D', label) AS DX",
        *[f"CAST(get(embedding, {i}) AS DOUBLE) AS `{f}`" for i, f in enumerate(FEATURES)],
    )


COHORT = (
    "cohort AS (SELECT vec_id AS id, 'D' || CAST(label AS VARCHAR) AS DX, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {q(f)}" for i, f in enumerate(FEATURES))
    + " FROM embeddings)"
)
COHORT_LONG = (
    "places AS (SELECT unnest(range(64)) AS pos), "
    "cohort_long AS (SELECT e.vec_id AS id, 'D' || CAST(e.label AS VARCHAR) AS DX, CAST(p.pos AS INTEGER) AS pos, "
    "'VA/' || CAST(p.pos AS VARCHAR) AS feature, CAST(e.embedding[p.pos + 1] AS DOUBLE) AS x "
    "FROM embeddings e CROSS JOIN places p)"
)
# reference mean and spread, then the clipped and the signed score
SCORES = (
    COHORT_LONG + ", base AS (SELECT pos, avg(x) AS mean, stddev_pop(x) + 1e-8 AS std FROM cohort_long "
    "WHERE DX = 'D0' GROUP BY pos), "
    "signed AS (SELECT c.id, c.DX, c.pos, c.feature, c.x, b.mean, b.std, (c.x - b.mean) / b.std AS z "
    "FROM cohort_long c JOIN base b ON c.pos = b.pos), "
    "scores AS (SELECT *, greatest(-z, 0.0) AS s FROM signed)"
)

# --- weights: the shares of blocks of features, as topic weights ----
TOPICS = [f"Topic_{k}" for k in range(4)]
# one topic per patient class, as many as there are patterns
PATTERN_TOPICS = [f"Topic_{k}" for k in range(9)]


def _blocks(n: int) -> list[list[int]]:
    """All 64 features dealt to ``n`` blocks of neighbours."""
    return [[i for i in range(64) if i * n // 64 == k] for k in range(n)]


def weight_columns(topics: list[str] = TOPICS) -> list:
    """Non-negative weights that sum to 1, from all 64 features of a row."""
    blocks = [[F.abs(F.col(f"`VA/{i}`")) for i in block] for block in _blocks(len(topics))]
    raw = [sum(block[1:], block[0]) + F.lit(0.01) for block in blocks]
    total = sum(raw[1:], raw[0])
    return [(w / total).alias(t) for w, t in zip(raw, topics)]


def topic_weights(spark: SparkSession, d: str, topics: list[str] = TOPICS) -> DataFrame:
    """id, DX and non-negative weights summing to 1 per row."""
    return cohort(spark, d).select("id", "DX", *weight_columns(topics))


def weights_sql(n: int) -> str:
    total = " + ".join(f"w{k}" for k in range(n))
    sums = ", ".join(
        " + ".join(f"abs(CAST(embedding[{i + 1}] AS DOUBLE))" for i in block) + f" + 0.01 AS w{k}"
        for k, block in enumerate(_blocks(n))
    )
    return (
        f"raw_w AS (SELECT vec_id AS id, 'D' || CAST(label AS VARCHAR) AS DX, {sums} FROM embeddings), "
        "weights AS (SELECT id, DX, " + ", ".join(f"w{k} / ({total}) AS Topic_{k}" for k in range(n)) + " FROM raw_w)"
    )


WEIGHTS = weights_sql(len(TOPICS))
PATTERN_WEIGHTS = weights_sql(len(PATTERN_TOPICS))

# --- patterns: class mean maps of the nine non-reference classes ----------
PATTERNS = (
    SCORES + ", patterns AS (SELECT CAST(substr(DX, 2) AS INTEGER) - 1 AS topic, pos, feature, avg(s) AS weight "
    "FROM scores WHERE DX <> 'D0' GROUP BY DX, pos, feature)"
)


# --- class probabilities of the cohort: shares over three classes ---------------
PROBS = ["P(A)", "P(B)", "P(C)"]


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey, DX_true (A/B/C), P(A..C), DX_pred from the orders table."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    raw = [
        (F.pmod(key * 7, F.lit(101)) + 1) / F.lit(102.0),
        (F.pmod(key * 13, F.lit(103)) + 1) / F.lit(104.0),
        (F.pmod(key * 17, F.lit(107)) + 1) / F.lit(108.0),
    ]
    total = raw[0] + raw[1] + raw[2]
    out = o.select(
        "o_orderkey",
        F.translate("o_orderstatus", "FOP", "ABC").alias("DX_true"),
        *[(w / total).alias(p) for w, p in zip(raw, PROBS)],
    )
    a, b, c = [F.col(f"`{p}`") for p in PROBS]
    return out.withColumn(
        "DX_pred", F.when((a >= b) & (a >= c), "A").when(b >= c, "B").otherwise("C")
    )


PREDICTIONS = (
    "raw_p AS (SELECT o_orderkey, translate(o_orderstatus, 'FOP', 'ABC') AS DX_true, "
    "((o_orderkey * 7) % 101 + 1) / 102.0::DOUBLE AS a, ((o_orderkey * 13) % 103 + 1) / 104.0::DOUBLE AS b, "
    "((o_orderkey * 17) % 107 + 1) / 108.0::DOUBLE AS c FROM orders), "
    "pa AS (SELECT o_orderkey, DX_true, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM raw_p), "
    'predictions AS (SELECT o_orderkey, DX_true, a AS "P(A)", b AS "P(B)", c AS "P(C)", '
    "CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS DX_pred FROM pa)"
)

# --- stages: three predicted stage scores and an observed stage text -------------
STAGE_COLUMNS = ["pred/low", "pred/mid", "pred/high"]


def stages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    seen = (
        F.when(F.col("o_orderpriority") == "1-URGENT", " High ")
        .when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "mid")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "low ")
    )
    return o.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("DX"),
        "o_totalprice",
        (F.pmod(key * 7, F.lit(11)) / F.lit(11.0)).alias("pred/low"),
        F.when(F.pmod(key, F.lit(9)) != 0, F.pmod(key * 5, F.lit(11)) / F.lit(11.0)).alias("pred/mid"),
        (F.pmod(key * 3, F.lit(11)) / F.lit(11.0)).alias("pred/high"),
        seen.alias("stage_text"),
    )


STAGES = (
    "stages AS (SELECT o_orderkey, o_orderstatus AS DX, o_totalprice, "
    '((o_orderkey * 7) % 11) / 11.0::DOUBLE AS "pred/low", '
    'CASE WHEN o_orderkey % 9 <> 0 THEN ((o_orderkey * 5) % 11) / 11.0::DOUBLE END AS "pred/mid", '
    '((o_orderkey * 3) % 11) / 11.0::DOUBLE AS "pred/high", '
    "CASE o_orderpriority WHEN '1-URGENT' THEN ' High ' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'mid' "
    "WHEN '4-NOT SPECIFIED' THEN 'low ' END AS stage_text FROM orders)"
)
# predicted stage: first largest non-missing score; codes; comparison class
STAGED = (
    STAGES + ", picked AS (SELECT *, CASE "
    'WHEN "pred/low" >= coalesce("pred/mid", -1) AND "pred/low" >= "pred/high" THEN \'low\' '
    'WHEN coalesce("pred/mid", -1) >= "pred/high" THEN \'mid\' ELSE \'high\' END AS pred_stage, '
    "lower(trim(stage_text)) AS obs_stage FROM stages), "
    "coded AS (SELECT *, CASE pred_stage WHEN 'low' THEN 0 WHEN 'mid' THEN 1 WHEN 'high' THEN 2 END AS pred_code, "
    "CASE obs_stage WHEN 'low' THEN 0 WHEN 'mid' THEN 1 WHEN 'high' THEN 2 END AS obs_code FROM picked), "
    "staged AS (SELECT *, CASE WHEN pred_code > obs_code THEN 'Overpredict' WHEN pred_code = obs_code THEN 'Canonical' "
    "WHEN pred_code < obs_code THEN 'Underpredict' END AS stage_group FROM coded)"
)
STAGE_GROUPS = ["Underpredict", "Canonical", "Overpredict"]

# --- flags: per customer, 0/1 for every order status and priority ---------------
FLAG_RULES = {
    "FLAG_F": ("o_orderstatus", "F"),
    "FLAG_O": ("o_orderstatus", "O"),
    "FTD_ANY": ("o_orderpriority", "1-URGENT"),
    "PD": ("o_orderpriority", "5-LOW"),
}
FLAGS = list(FLAG_RULES)


def flags(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with orders; set flags vary with the order mix."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(
        *[F.max((F.col(c) == v).cast("int")).alias(f) for f, (c, v) in FLAG_RULES.items()],
        F.count("*").alias("n_orders"),
        F.max("o_totalprice").alias("price"),
    )


FLAGS_SQL = (
    "flags AS (SELECT o_custkey, "
    + ", ".join(f"max(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END) AS {f}" for f, (c, v) in FLAG_RULES.items())
    + ", count(*) AS n_orders, max(o_totalprice) AS price FROM orders GROUP BY o_custkey)"
)


# --- codes: small nullable ints per customer ------------------------------------
def codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.when(F.pmod(key, F.lit(7)) != 0, F.pmod(key, F.lit(5)).cast("int")).alias("code_a"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.pmod(key, F.lit(3)).cast("int")).alias("code_b"),
        F.when(F.pmod(key, F.lit(7)) != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.pmod(key, F.lit(13)) != 0, F.col("c_acctbal")).alias("balance"),
        "c_nationkey",
    )


CODES = (
    "codes AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS code_a, "
    "CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS code_b, "
    "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, "
    "CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS balance, c_nationkey FROM customer)"
)


# --- profile: event counts per user, one column per type ------------------------
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == t).cast("double").alias(t) for t in EVENT_TYPES]
    )


PROFILE = (
    "profile AS (SELECT user_id, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{t}') AS DOUBLE) AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY user_id)"
)


# --- pairs: labelled documents, quality as observed, toxic as predicted ---------
def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic",
        F.col("quality").cast("string").alias("observed"), F.col("toxic").cast("string").alias("predicted"),
    )


PAIRS = (
    "pairs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, "
    "CAST(l.quality AS VARCHAR) AS observed, CAST(l.toxic AS VARCHAR) AS predicted "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


# --- voxels: vector cells as image cells, eight areas, area 0 is background ------
def voxels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("subject"), F.posexplode("embedding").alias("place", "value")).select(
        "subject", "place", F.when(F.pmod("place", F.lit(9)) != 0, F.col("value").cast("double")).alias("value")
    )


def atlas(spark: SparkSession, d: str) -> DataFrame:
    """Label of every cell position that occurs in the vectors."""
    e = table(spark, d, "embeddings")
    return e.select(F.posexplode("embedding").alias("place", "_v")).select("place").distinct().select(
        "place", F.pmod("place", F.lit(8)).alias("label")
    )


VOXELS = (
    "places AS (SELECT unnest(range(64)) AS pos), "
    "voxels AS (SELECT e.vec_id AS subject, CAST(p.pos AS INTEGER) AS place, CASE WHEN p.pos % 9 <> 0 "
    "THEN CAST(e.embedding[p.pos + 1] AS DOUBLE) END AS value FROM embeddings e CROSS JOIN places p), "
    "atlas AS (SELECT DISTINCT place, place % 8 AS label FROM voxels)"
)

__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "DataFrame", "SparkSession", "F"}]


# --- two-part mixtures: the steps as recursive SQL -------------------------------
def mixture_sql(values: str) -> str:
    """CTEs up to ``mixture`` (key, m1, s1, w1, m2, s2, w2; part 1 has the lower mean) from rows (key, v).

    Two means first (at most 100 steps), then expectation and maximisation until the level moves by less than 1e-3.
    """
    logs = [f"(ln(greatest(w{i}, 1e-300)) - 0.5 * ln(2 * pi() * v{i}) - (x - m{i}) * (x - m{i}) * (0.5 / v{i}))" for i in (1, 2)]
    share = f"(1 / (1 + exp({logs[1]} - {logs[0]})))"
    top = f"greatest({logs[0]}, {logs[1]})"
    level = f"avg({top} + ln(exp({logs[0]} - {top}) + exp({logs[1]} - {top})))"

    def parts(a: str) -> str:
        out = []
        for i, s in ((1, a), (2, f"(1 - {a})")):
            size = f"(sum({s}) + 1e-12)"
            mean = f"(sum({s} * x) / {size})"
            out.append(f"{mean} AS m{i}, greatest(sum({s} * x * x) / {size} - {mean} * {mean}, 0) + 1e-6 AS v{i}, {size} / count(*) AS w{i}")
        return ", ".join(out)

    return (
        f"val AS (SELECT key, CAST(v AS DOUBLE) AS v FROM ({values}) WHERE v IS NOT NULL AND NOT isnan(v)), "
        "st AS (SELECT key, avg(v) AS c, min(v) AS lo, max(v) AS hi, var_pop(v) AS sp FROM val GROUP BY key HAVING count(*) >= 2), "
        "xs AS (SELECT key, v - c AS x FROM val JOIN st USING (key)), "
        "tm AS (SELECT key, 0 AS step, lo - c AS low, hi - c AS high, sp, CAST('inf' AS DOUBLE) AS moved FROM st UNION ALL "
        "SELECT key, step + 1, below, above, sp, (below - low) * (below - low) + (above - high) * (above - high) FROM ("
        "SELECT t.key, t.step, t.low, t.high, t.sp, coalesce(avg(x) FILTER (x <= (low + high) / 2), low) AS below, "
        "coalesce(avg(x) FILTER (x > (low + high) / 2), high) AS above FROM tm t JOIN xs ON t.key = xs.key "
        "WHERE t.moved > 1e-4 * t.sp AND t.step < 100 GROUP BY t.key, t.step, t.low, t.high, t.sp)), "
        "cut AS (SELECT key, arg_max((low + high) / 2, step) AS cut FROM tm GROUP BY key), "
        f"em0 AS (SELECT key, {parts('(CASE WHEN x <= cut THEN 1.0 ELSE 0.0 END)')} FROM xs JOIN cut USING (key) GROUP BY key), "
        "em AS (SELECT key, 0 AS step, m1, v1, w1, m2, v2, w2, CAST('-inf' AS DOUBLE) AS level, CAST('inf' AS DOUBLE) AS moved FROM em0 "
        "UNION ALL SELECT key, step + 1, n.m1, n.v1, n.w1, n.m2, n.v2, n.w2, n.l, abs(n.l - n.level) FROM ("
        f"SELECT e.key, e.step, e.level, {level} AS l, {parts(share)} "
        "FROM em e JOIN xs ON e.key = xs.key WHERE e.moved >= 1e-3 AND e.step < 100 "
        "GROUP BY e.key, e.step, e.level) n), "
        "last AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1), "
        "mixture AS (SELECT key, CASE WHEN m1 <= m2 THEN m1 ELSE m2 END + c AS m1, sqrt(CASE WHEN m1 <= m2 THEN v1 ELSE v2 END) AS s1, "
        "CASE WHEN m1 <= m2 THEN w1 ELSE w2 END AS w1, CASE WHEN m1 <= m2 THEN m2 ELSE m1 END + c AS m2, "
        "sqrt(CASE WHEN m1 <= m2 THEN v2 ELSE v1 END) AS s2, CASE WHEN m1 <= m2 THEN w2 ELSE w1 END AS w2 FROM last JOIN st USING (key))"
    )
