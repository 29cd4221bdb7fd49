"""Queries for scoring, training steps, metrics and scored tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ...functions import logistic as L
from ...functions.hashing import Namespace
from ...operators import features as feat
from ...operators import metrics, state as st, steps
from ...operators.ordering import every_k, with_dense_index
from ...operators.inorder import DESCENT, EXACT
from ...operators.sampling import with_shard
from ...operators.shards import shard_step, train_in_order
from ...session import cut_lineage, new_folder, stored
from ...sources.examples import score_line
from ...sources.logs import spread_out
from ...sources.deltas import DeltaStore
from ...sources.store import StateStore
from .. import progressive, training
from ..scoring import score
from .base import RAW_SQL, events, query, r6, sql6, sql_bucket, sql_hash, table
from .features import TOKENS_SQL

MD5 = "md5"
CONFIG = L.FtrlConfig(alpha=0.5, beta=1.0, l1=0.05, l2=0.01)
GRID = [
    L.FtrlConfig(alpha=0.5, beta=1.0, l1=0.05, l2=0.0),
    L.FtrlConfig(alpha=0.1, beta=1.0, l1=0.5, l2=0.1),
    L.FtrlConfig(alpha=0.3, beta=0.5, l1=0.0, l2=0.0, sigma_sign=1),
]
BATCHES = 5  # six days of log each
SHARDS = 8

# Feature name, text, bucket count and offset; the text is read by Spark and by SQL.
INDICATORS = [
    ("user", "concat('user', CAST(user_id AS {text}))", 1000000, 0),
    ("code", "concat('code', CAST(k AS {text}))", 1000000, 1000000),
    ("impression", "concat('imp', CAST(k AS {text}), '|', CAST(v AS {text}))", 1000000, 2000000),
    ("hour", "concat('hour', {hour})", 1000000, 3000000),
]
VALUE_FEATURE = 9000000

EXAMPLES_SQL = RAW_SQL + """,
base AS (SELECT *, CAST(event_type = 'purchase' AS BIGINT) AS label,
  CAST((day(ts) - 1) // 6 AS BIGINT) AS batch FROM raw),
ex AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT event_id AS example_id, batch, label, "
    f"{sql_bucket(text.format(text='VARCHAR', hour=chr(39).join(['strftime(ts, ', '%H', ')'])), size, offset)} "
    f"AS feature, 1.0::DOUBLE AS value FROM base"
    for _, text, size, offset in INDICATORS
) + f" UNION ALL SELECT event_id, batch, label, {VALUE_FEATURE}, value / 100 FROM base)"


def examples(spark, sf_dir):
    """Purchases among events: (example_id, seq, batch, k, label, features)."""
    return to_examples(events(spark, sf_dir))


def to_examples(base):
    groups = [
        feat.indicators([F.expr(text.format(text="STRING", hour="date_format(ts, 'HH')"))],
                        Namespace(name, size, offset), MD5)
        for name, text, size, offset in INDICATORS
    ]
    number = [feat.numbered(VALUE_FEATURE, F.col("value") / 100)]
    return base.select(
        F.col("event_id").alias("example_id"), F.col("event_id").alias("seq"),
        F.floor((F.dayofmonth("ts") - 1) / 6).cast("bigint").alias("batch"),
        (F.col("event_type") == "purchase").cast("bigint").alias("label"),
        "k", feat.as_map(*groups, number).alias("features"),
    )


# --- the same steps in SQL --------------------------------------------------------------


def _clip(margin: str) -> str:
    s = f"(1 / (1 + exp(-({margin}))))"
    return f"CASE WHEN {s} = 0 THEN {L.PROB_FLOOR!r} WHEN {s} = 1 THEN {L.PROB_CEILING!r} ELSE {s} END"


def _w(z: str, n: str, c: L.FtrlConfig) -> str:
    return (f"CASE WHEN abs({z}) <= {c.l1} THEN 0.0 ELSE -({z} - sign({z}) * {c.l1}) / "
            f"(({c.beta} + sqrt({n})) / {c.alpha} + {c.l2}) END")


START_SQL = ("SELECT 0::BIGINT AS feature, 0.0::DOUBLE AS w, 0.0::DOUBLE AS z, 0.0::DOUBLE AS n, "
             "0.0::DOUBLE AS p_count, 0.0::DOUBLE AS n_count, 0.0::DOUBLE AS g_sum WHERE false")


def sums_sql(tag: str, rows: str, weights: str) -> str:
    """CTE g{tag}: gradient sums per feature of ``rows`` under ``weights``."""
    return f"""
r{tag} AS MATERIALIZED (SELECT b.*, coalesce(w.w, 0.0) AS w FROM ({rows}) b
  LEFT JOIN ({weights}) w USING (feature)),
m{tag} AS (SELECT example_id, sum(w * value) AS margin FROM r{tag} GROUP BY example_id),
p{tag} AS (SELECT example_id, {_clip('margin')} AS prob FROM m{tag}),
g{tag} AS MATERIALIZED (SELECT feature, sum((prob - label) * value) AS g,
  sum(((prob - label) * value) * ((prob - label) * value)) AS q,
  CAST(sum(label) AS DOUBLE) AS p_new, CAST(sum(1 - label) AS DOUBLE) AS n_new
  FROM r{tag} JOIN p{tag} USING (example_id) GROUP BY feature)"""


def step_sql(tag: str, before: str, rows: str, c: L.FtrlConfig = CONFIG, counted: bool = False) -> str:
    """CTE s{tag}: the state after one step over ``rows``, from the state ``before``."""
    new_n = ("CASE WHEN p_count + n_count > 0 THEN p_count * n_count / (p_count + n_count) ELSE 0.0 END"
             if counted else "n + q")
    return sums_sql(tag, rows, f"SELECT feature, {_w('z', 'n', c)} AS w FROM ({before})") + f""",
j{tag} AS (SELECT feature, g, q, coalesce(w, 0.0) AS w, coalesce(z, 0.0) AS z, coalesce(n, 0.0) AS n,
  coalesce(p_count, 0.0) + coalesce(p_new, 0.0) AS p_count,
  coalesce(n_count, 0.0) + coalesce(n_new, 0.0) AS n_count,
  coalesce(g_sum, 0.0) + coalesce(g, 0.0) AS g_sum
  FROM ({before}) FULL JOIN g{tag} USING (feature)),
k{tag} AS (SELECT *, CASE WHEN g IS NULL THEN n ELSE {new_n} END AS n2 FROM j{tag}),
z{tag} AS (SELECT *, CASE WHEN g IS NULL THEN z ELSE
  z + g + {c.sigma_sign} * (sqrt(n2) - sqrt(n)) / {c.alpha} * ({_w('z', 'n', c)}) END AS z2 FROM k{tag}),
s{tag} AS MATERIALIZED (SELECT feature, CASE WHEN g IS NULL THEN w ELSE {_w('z2', 'n2', c)} END AS w,
  z2 AS z, n2 AS n, p_count, n_count, g_sum FROM z{tag})"""


def chain_sql(batches: list[str], c: L.FtrlConfig = CONFIG, counted: bool = False, tag: str = "") -> str:
    """CTEs s{tag}1 .. s{tag}N over row sets in order."""
    parts, before = [], START_SQL
    for i, rows in enumerate(batches, start=1):
        parts.append(step_sql(f"{tag}{i}", before, rows, c, counted))
        before = f"SELECT * FROM s{tag}{i}"
    return ",".join(parts)


def scored_sql(name: str, weights: str, rows: str = "SELECT * FROM ex") -> str:
    """CTE ``name``: (example_id, label, prob, loss) of all examples under ``weights``."""
    return f"""
{name} AS MATERIALIZED (SELECT example_id, label, margin, 1 / (1 + exp(-margin)) AS prob,
  -label * ln({_clip('margin')}) - (1 - label) * ln(1 - ({_clip('margin')})) AS loss
  FROM (SELECT example_id, label, sum(coalesce(w, 0.0) * value) AS margin
        FROM ({rows}) LEFT JOIN ({weights}) USING (feature) GROUP BY example_id, label))"""


def batch_sql(i: int) -> str:
    return f"SELECT * FROM ex WHERE batch = {i}"


FIRST_HALF = "SELECT * FROM ex WHERE batch < 2"
SECOND_HALF = "SELECT * FROM ex WHERE batch >= 2"
WITH_EX = f"WITH {EXAMPLES_SQL},\n"
STATE_SQL = ", ".join(["feature", *[sql6(c) for c in st.STATE_COLUMNS]])


def state_out(state):
    return state.select("feature", *[r6(c) for c in st.STATE_COLUMNS])


ALL_ROWS = "SELECT * FROM ex"


def trained(spark, sf_dir):
    """The state after one step over all events."""
    return steps.ftrl_step(st.empty_state(spark), examples(spark, sf_dir), CONFIG)


def first_step(spark, sf_dir, **how):
    """The state after one step over the first two batches, for queries that go on from there."""
    first = examples(spark, sf_dir).where(F.col("batch") < 2)
    return steps.ftrl_step(st.empty_state(spark), first, CONFIG, **how)


def scored(spark, sf_dir):
    """All events, scored and with their loss under ``trained``."""
    return steps.validate(examples(spark, sf_dir), trained(spark, sf_dir), carry=["seq"])


SCORED_SQL = chain_sql([ALL_ROWS]) + "," + scored_sql("scored", "SELECT feature, w FROM s1")


# --- scoring ----------------------------------------------------------------------------


@query("sparse_dot", WITH_EX + SCORED_SQL + f" SELECT example_id, {sql6('margin')} FROM scored")
def sparse_dot(spark, sf_dir):
    margins = steps.sparse_dot(examples(spark, sf_dir), trained(spark, sf_dir))
    return margins.select("example_id", r6("margin"))


@query("predict_label", WITH_EX + SCORED_SQL + f""" SELECT example_id, {sql6('prob')},
  CAST(prob >= 0.2 AS BIGINT) AS predicted FROM scored""")
def predict_label(spark, sf_dir):
    out = steps.predict(examples(spark, sf_dir), trained(spark, sf_dir), threshold=0.2)
    return out.select("example_id", r6("prob"), "predicted")


@query("log_loss", WITH_EX + SCORED_SQL + f" SELECT example_id, label, {sql6('loss')} FROM scored")
def log_loss(spark, sf_dir):
    return scored(spark, sf_dir).select("example_id", "label", r6("loss"))


# --- steps ------------------------------------------------------------------------------


@query("gradient_by_feature", WITH_EX + chain_sql([ALL_ROWS]) + "," + sums_sql(
    "x", "SELECT * FROM ex", "SELECT feature, w FROM s1") +
    f" SELECT feature, {sql6('g')}, {sql6('q')} FROM gx")
def gradient_by_feature(spark, sf_dir):
    sums = steps.gradients(examples(spark, sf_dir), trained(spark, sf_dir))
    return sums.select("feature", r6("g"), r6("q"))


@query("ftrl_one_batch", WITH_EX + chain_sql(["SELECT * FROM ex"]) + f" SELECT {STATE_SQL} FROM s1")
def ftrl_one_batch(spark, sf_dir):
    return state_out(steps.ftrl_step(st.empty_state(spark), examples(spark, sf_dir), CONFIG))


@query("ftrl_two_batches", WITH_EX + chain_sql([FIRST_HALF, SECOND_HALF]) + f" SELECT {STATE_SQL} FROM s2")
def ftrl_two_batches(spark, sf_dir):
    first = cut_lineage(first_step(spark, sf_dir))
    second = examples(spark, sf_dir).where(F.col("batch") >= 2)
    return state_out(steps.ftrl_step(first, second, CONFIG, stored=True))


@query("ftrl_approx_batch",
       WITH_EX + chain_sql([FIRST_HALF, SECOND_HALF], counted=True) + f" SELECT {STATE_SQL} FROM s2")
def ftrl_approx_batch(spark, sf_dir):
    first = cut_lineage(first_step(spark, sf_dir, counted=True))
    second = examples(spark, sf_dir).where(F.col("batch") >= 2)
    return state_out(steps.ftrl_step(first, second, CONFIG, counted=True, stored=True))


@query("ogd_two_batches", WITH_EX + sums_sql("a", FIRST_HALF, "SELECT feature, w FROM (" + START_SQL + ")") + """,
  w1 AS (SELECT feature, -g AS w FROM ga),""" + sums_sql("b", SECOND_HALF, "SELECT * FROM w1") + f"""
  SELECT feature, {sql6(f'coalesce(w, 0.0) - coalesce(g, 0.0) * {1 / math.sqrt(2)!r}', 'w')}
  FROM w1 FULL JOIN gb USING (feature)""")
def ogd_two_batches(spark, sf_dir):
    rows = examples(spark, sf_dir)
    first = steps.ogd_step(st.empty_state(spark), rows.where(F.col("batch") < 2), 1)
    second = steps.ogd_step(cut_lineage(first), rows.where(F.col("batch") >= 2), 2, stored=True)
    return second.select("feature", r6("w"))


COUNTS_SQL = ("SELECT feature, CAST(sum(label) AS DOUBLE) AS p_count, "
              "CAST(sum(1 - label) AS DOUBLE) AS n_count FROM ({rows}) GROUP BY feature")


def label_counts(rows):
    return st.label_counts(feat.exploded(rows, ["example_id", "label"]))


@query("pos_neg_counts", WITH_EX.rstrip(",\n") + " " + COUNTS_SQL.format(rows="SELECT * FROM ex"))
def pos_neg_counts(spark, sf_dir):
    return label_counts(examples(spark, sf_dir))


@query("approx_n", WITH_EX + f"c AS ({COUNTS_SQL.format(rows='SELECT * FROM ex')}) SELECT feature, "
       + sql6("p_count * n_count / (p_count + n_count)", "n") + " FROM c")
def approx_n(spark, sf_dir):
    seeded = st.seeded_state(label_counts(examples(spark, sf_dir)))
    return seeded.select("feature", r6("n"))


@query("count_merge", WITH_EX.rstrip(",\n") + " " + COUNTS_SQL.format(rows="SELECT * FROM ex"))
def count_merge(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return st.merge_counts(
        label_counts(rows.where(F.col("batch") < 2)), label_counts(rows.where(F.col("batch") >= 2))
    )


@query("state_upsert", WITH_EX + chain_sql([FIRST_HALF], tag="a") + "," + chain_sql([SECOND_HALF], tag="b") + f"""
  SELECT {STATE_SQL} FROM (SELECT * FROM sb1
    UNION ALL SELECT * FROM sa1 WHERE feature NOT IN (SELECT feature FROM sb1))""")
def state_upsert(spark, sf_dir):
    later = examples(spark, sf_dir).where(F.col("batch") >= 2)
    update = steps.ftrl_step(st.empty_state(spark), later, CONFIG)
    return state_out(st.upsert(first_step(spark, sf_dir), update))


def _average_sql() -> str:
    shards = ",".join(
        chain_sql([f"{SECOND_HALF} AND example_id % {SHARDS} = {i}"], counted=True, tag=f"h{i}")
        for i in range(SHARDS))
    every = " UNION ALL ".join(f"SELECT * FROM sh{i}1" for i in range(SHARDS))
    return WITH_EX + chain_sql([FIRST_HALF], counted=True) + "," + shards + f""",
  every AS ({every}),
  summed AS (SELECT feature, sum(w) AS w_sum, sum(z) AS z_sum, count(*) AS seen,
    sum(p_count) AS p_new, sum(n_count) AS n_new FROM every GROUP BY feature),
  merged AS (SELECT feature, z IS NOT NULL AS known, coalesce(w, 0.0) AS w, coalesce(z, 0.0) AS z,
    coalesce(w_sum, 0.0) AS w_sum, coalesce(z_sum, 0.0) AS z_sum, coalesce(seen, 0) AS seen,
    coalesce(p_count, 0.0) + coalesce(p_new, 0.0) AS p_count,
    coalesce(n_count, 0.0) + coalesce(n_new, 0.0) AS n_count FROM s1 FULL JOIN summed USING (feature))
  SELECT feature,
    {sql6(f'CASE WHEN known THEN (w_sum + ({SHARDS} - seen) * w) / {SHARDS} ELSE w_sum / seen END', 'w')},
    {sql6(f'CASE WHEN known THEN (z_sum + ({SHARDS} - seen) * z) / {SHARDS} ELSE z_sum / seen END', 'z')},
    {sql6('p_count')}, {sql6('n_count')} FROM merged"""


@query("shard_average", _average_sql())
def shard_average(spark, sf_dir):
    """Shards that each made one step of their own, averaged into an earlier state."""
    rows = examples(spark, sf_dir)
    later = rows.where(F.col("batch") >= 2).withColumn("shard", F.col("example_id") % SHARDS)
    own = steps.ftrl_step(
        st.empty_state(spark, {"shard": "bigint"}), later, CONFIG, keys=["shard"], counted=True
    ).select("shard", "feature", "w", "z", F.col("p_count").alias("p_new"),
             F.col("n_count").alias("n_new"), F.col("g_sum").alias("g_new"))
    merged = st.average_shards(first_step(spark, sf_dir, counted=True), own, SHARDS)
    return merged.select("feature", r6("w"), r6("z"), r6("p_count"), r6("n_count"))


# A few features per event, for updates that SQL has to follow one example at a time:
# always, by code, by hour, and the value.
SMALL = 7
SMALL_SQL = f"""small AS (SELECT event_id AS example_id, CAST(event_type = 'purchase' AS BIGINT) AS label,
    's' || CAST(k % 4 AS VARCHAR) AS segment, {sql_hash("CAST(event_id AS VARCHAR)")} % {SHARDS} AS shard,
    [1.0::DOUBLE, CASE WHEN k % 3 = 0 THEN 1.0 END, CASE WHEN k % 3 = 1 THEN 1.0 END, CASE WHEN k % 3 = 2 THEN 1.0 END,
     CASE WHEN hour(ts) < 12 THEN 1.0 END, CASE WHEN hour(ts) >= 12 THEN 1.0 END, value / 100]::DOUBLE[] AS x FROM raw)"""


def small_examples(base):
    one = F.lit(1.0)
    code = (F.col("k") % 3 + 1).cast("bigint")
    half = (4 + (F.hour("ts") >= 12).cast("bigint")).cast("bigint")
    features = F.map_from_arrays(
        F.array(F.lit(0).cast("bigint"), code, half, F.lit(SMALL - 1).cast("bigint")),
        F.array(one, one, one, (F.col("value") / 100).cast("double")))
    return base.select(
        F.col("event_id").alias("example_id"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "purchase").cast("bigint").alias("label"),
        F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("segment"), features.alias("features"))


def in_order_sql(by: list[str], counted: bool, c: L.FtrlConfig = CONFIG, tag: str = "", descent: bool = False) -> str:
    """CTE learned: (by, feature, w, z, n, p, m, g) after each group's examples, one by one; CTE scored: (by, example_id, i, label,
    margin before the example, weights other than zero after it). ``descent``: z is the weight, moved by 1 / sqrt(i)."""
    keys = ", ".join(by)
    places = f"range(1, {SMALL + 1})"

    def each(expr: str) -> str:
        return f"list_transform({places}, lambda j: {expr})"

    w = "z[j]" if descent else _w("z[j]", "n[j]", c)
    new_n = "CASE WHEN p[j] + m[j] > 0 THEN p[j] * m[j] / (p[j] + m[j]) ELSE 0.0 END" if counted else "n[j] + d * x[j] * d * x[j]"
    new_z = (f"z[j] + d * x[j] + {c.sigma_sign} * (sqrt(n2[j]) - sqrt(n[j])) / {c.alpha} * w[j]" if not descent
             else "z[j] - d * x[j] / sqrt(i)")
    if descent:
        new_n = "n[j]"
    start = f"list_transform({places}, lambda j: 0.0::DOUBLE)"
    return f"""{'' if tag else SMALL_SQL + ','}
  numbered{tag} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY example_id) AS i FROM small),
  run{tag} AS (SELECT DISTINCT {keys}, 0::BIGINT AS i, 0::BIGINT AS example_id, 0::BIGINT AS label, 0.0::DOUBLE AS margin,
      {start} AS z, {start} AS n, {start} AS p, {start} AS m, {start} AS g, {start} AS seen FROM small
    UNION ALL
    SELECT {keys}, i, example_id, label, margin, {each(f'CASE WHEN x[j] IS NULL THEN z[j] ELSE {new_z} END')},
      n2, p, m, {each('CASE WHEN x[j] IS NULL THEN g[j] ELSE g[j] + d * x[j] END')},
      {each('CASE WHEN x[j] IS NULL THEN seen[j] ELSE 1.0 END')}
    FROM (SELECT *, {each(f'CASE WHEN x[j] IS NULL THEN n[j] ELSE {new_n} END')} AS n2
      FROM (SELECT *, {_clip('margin')} - label AS d
       FROM (SELECT *, list_sum({each('CASE WHEN x[j] IS NULL THEN 0.0 ELSE w[j] * x[j] END')}) AS margin
        FROM (SELECT {', '.join(f'r.{k}' for k in by)}, r.i, r.example_id, r.label, r.x, z, n, g, seen, {each(w)} AS w,
            {each('CASE WHEN r.x[j] IS NULL THEN p[j] ELSE p[j] + r.label END')} AS p,
            {each('CASE WHEN r.x[j] IS NULL THEN m[j] ELSE m[j] + 1 - r.label END')} AS m
          FROM run{tag} run JOIN numbered{tag} r ON {' AND '.join(f'run.{k} = r.{k}' for k in by)} AND run.i + 1 = r.i))))),
  last{tag} AS (SELECT * FROM run{tag} QUALIFY i = max(i) OVER (PARTITION BY {keys})),
  learned{tag} AS (SELECT {keys}, i AS steps, j - 1 AS feature, {w} AS w, z[j] AS z, n[j] AS n, p[j] AS p, m[j] AS m, g[j] AS g
    FROM last{tag}, (SELECT unnest({places}) AS j) WHERE seen[j] > 0),
  scored{tag} AS MATERIALIZED (SELECT {keys}, example_id, i, label, 1 / (1 + exp(-margin)) AS prob,
      -label * ln({_clip('margin')}) - (1 - label) * ln(1 - ({_clip('margin')})) AS loss,
      CAST(list_sum({each(f'CASE WHEN ({w}) <> 0 THEN 1 ELSE 0 END')}) AS BIGINT) AS nonzero FROM run{tag} WHERE i > 0)"""


def _shard_sql() -> str:
    return f"""WITH RECURSIVE {RAW_SQL}, {in_order_sql(['shard'], True)},
  summed AS (SELECT feature, avg(w) AS w, avg(z) AS z, sum(p) AS p_count, sum(m) AS n_count, sum(g) AS g_sum
    FROM learned GROUP BY feature),
  merged AS (SELECT *, p_count * n_count / (p_count + n_count) AS n FROM summed)
  SELECT {STATE_SQL} FROM merged"""


@query("shard_train", _shard_sql())
def shard_train(spark, sf_dir):
    """In-order training per shard over all events, averaged."""
    rows = small_examples(events(spark, sf_dir))
    return state_out(shard_step(st.empty_state(spark), rows, CONFIG, SHARDS, method=MD5))


def _grid_sql() -> str:
    chains = ",".join(chain_sql(["SELECT * FROM ex"], c, tag=f"c{i}") for i, c in enumerate(GRID))
    return WITH_EX + chains + " " + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS config_id, feature, {sql6('w')}, {sql6('z')}, {sql6('n')} FROM sc{i}1"
        for i in range(len(GRID)))


@query("config_grid", _grid_sql())
def config_grid(spark, sf_dir):
    rows = examples(spark, sf_dir)
    out = steps.ftrl_step(st.empty_state(spark, {"config_id": "bigint"}), rows, GRID)
    return out.select("config_id", "feature", r6("w"), r6("z"), r6("n"))


def _rolled_sql(source: str, by: str, order: str) -> str:
    """Loss, accuracy and AUC over the last 1000 rows of each group, for every row."""

    def rate(k: int, label: int) -> str:
        return (f"coalesce(sum(CAST(prob >= {k} / 10.0::DOUBLE AND label = {label} AS BIGINT)) OVER w "
                f"/ nullif(sum(CAST(label = {label} AS BIGINT)) OVER w, 0), 0.0)")

    rates = ", ".join(f"{rate(k, 1)} AS t{k}, {rate(k, 0)} AS f{k}" for k in range(11))
    area = " + ".join(f"(t{k + 1} + t{k}) / 2 * (f{k} - f{k + 1})" for k in range(10))
    return f"""SELECT *, {area} AS auc FROM (SELECT *, count(*) OVER w AS rows, avg(loss) OVER w AS mean_loss,
      avg(CAST(CAST(prob >= 0.5 AS BIGINT) = label AS INTEGER)) OVER w AS accuracy, {rates} FROM {source}
      WINDOW w AS (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))"""


REPORT_SQL = f"""WITH RECURSIVE {RAW_SQL}, {in_order_sql(['shard'], True)}, rolled AS ({_rolled_sql('scored', 'shard', 'i')})
  SELECT CAST(shard AS INTEGER) AS shard, i AS step, rows, {sql6('mean_loss', 'loss')}, {sql6('accuracy')}, {sql6('auc')}, nonzero
  FROM rolled WHERE i % 100 = 0"""


def reports_out(found):
    return found.select("shard", "step", "rows", r6("loss"), r6("accuracy"), r6("auc"), "nonzero")


@query("progressive_in_order", REPORT_SQL)
def progressive_in_order(spark, sf_dir):
    """Every event scored by its shard's model just before that learns it; a report over the last 1000 at every 100th."""
    rows = small_examples(events(spark, sf_dir))
    _, scored = progressive.progressive_shards(st.empty_state(spark), rows, CONFIG, SHARDS, method=MD5)
    return reports_out(metrics.reports(scored, 100, 1000, ["shard"]))


@query("progressive_rows", f"""WITH RECURSIVE {RAW_SQL}, {in_order_sql(['shard'], False)}
  SELECT CAST(shard AS INTEGER) AS shard, example_id, i AS step, label, {sql6('prob')}, {sql6('loss')}, nonzero FROM scored""")
def progressive_rows(spark, sf_dir):
    """The same with exact squares: every event's probability and loss from before it was learned."""
    rows = small_examples(events(spark, sf_dir))
    _, scored = progressive.progressive_shards(st.empty_state(spark), rows, CONFIG, SHARDS, EXACT, MD5)
    return scored.select("shard", "example_id", "step", "label", r6("prob"), r6("loss"), "nonzero")


def _grid_in_order_sql() -> str:
    chains = ",".join(in_order_sql(["shard"], False, c, tag=f"_{i}") for i, c in enumerate(GRID))
    learned = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS config_id, CAST(shard AS INTEGER) AS shard, feature, {sql6('w')}, {sql6('z')}, {sql6('n')} FROM learned_{i}"
        for i in range(len(GRID)))
    return f"WITH RECURSIVE {RAW_SQL}, {SMALL_SQL}, {chains} {learned}"


@query("config_grid_in_order", _grid_in_order_sql())
def config_grid_in_order(spark, sf_dir):
    """Three configurations that learn side by side in one in-order pass."""
    rows = small_examples(events(spark, sf_dir))
    learned, _ = progressive.progressive_shards(
        st.empty_state(spark, {"config_id": "bigint"}), rows, GRID, SHARDS, EXACT, MD5)
    return learned.select("config_id", "shard", "feature", r6("w"), r6("z"), r6("n"))


@query("ogd_in_order", f"""WITH RECURSIVE {RAW_SQL}, {in_order_sql(['shard'], False, descent=True)}
  SELECT CAST(shard AS INTEGER) AS shard, feature, {sql6('w')} FROM learned""")
def ogd_in_order(spark, sf_dir):
    """Gradient descent example by example, the t-th of a shard with rate 1 / sqrt(t)."""
    rows = with_shard(small_examples(events(spark, sf_dir)), "example_id", SHARDS, method=MD5)
    learned = train_in_order(st.empty_state(spark), rows, CONFIG, {"shard": "int"}, SHARDS, rule=DESCENT)
    return learned.select("shard", "feature", r6("w"))


def _looked_up():
    return [VALUE_FEATURE, 1]


@query("weight_lookup", WITH_EX + chain_sql([ALL_ROWS]) + f""" SELECT feature, {sql6('w')} FROM s1
  WHERE feature IN ({', '.join(map(str, _looked_up()))})""")
def weight_lookup(spark, sf_dir):
    return st.weight_of(trained(spark, sf_dir), _looked_up()).select("feature", r6("w"))


@query("warm_start", WITH_EX + chain_sql([FIRST_HALF]) + "," + step_sql("2", """SELECT feature, 0.0::DOUBLE AS w,
    z, CASE WHEN p_count + n_count > 0 THEN p_count * n_count / (p_count + n_count) ELSE 0.0 END AS n,
    p_count, n_count, 0.0::DOUBLE AS g_sum FROM s1""", SECOND_HALF, counted=True) +
    f" SELECT {STATE_SQL} FROM s2")
def warm_start(spark, sf_dir):
    """Train on from given z and label counts; the rates are seeded from the counts."""
    given = first_step(spark, sf_dir).select("feature", "z", "p_count", "n_count")
    later = examples(spark, sf_dir).where(F.col("batch") >= 2)
    return state_out(steps.ftrl_step(cut_lineage(st.seeded_state(given)), later, CONFIG,
                                     counted=True, stored=True))


@query("published_model", WITH_EX + chain_sql(["SELECT * FROM ex"]) +
       f" SELECT feature, {sql6('w')} FROM s1 WHERE w <> 0")
def published_model(spark, sf_dir):
    state = steps.ftrl_step(st.empty_state(spark), examples(spark, sf_dir), CONFIG)
    return st.published(state).select("feature", r6("w"))


@query("nonzero", WITH_EX + chain_sql(["SELECT * FROM ex"]) +
       " SELECT count(*) FILTER (w <> 0) AS nonzero FROM s1")
def nonzero(spark, sf_dir):
    return st.nonzero_count(steps.ftrl_step(st.empty_state(spark), examples(spark, sf_dir), CONFIG))


# --- metrics ----------------------------------------------------------------------------


def points_sql(source: str, by: str = "") -> str:
    """(by, point, tpr, fpr) from rows of (label, prob)."""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}point,
    coalesce(avg(CAST(prob >= point / 10.0::DOUBLE AS INTEGER)) FILTER (label = 1), 0.0) AS tpr,
    coalesce(avg(CAST(prob >= point / 10.0::DOUBLE AS INTEGER)) FILTER (label = 0), 0.0) AS fpr
  FROM {source}, (SELECT unnest(range(11)) AS point) GROUP BY {lead}point"""


def auc_sql(points: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}sum(area) AS auc FROM (SELECT {lead}
    (lead(tpr) OVER w + tpr) / 2 * (fpr - lead(fpr) OVER w) AS area FROM {points}
    WINDOW w AS ({part}ORDER BY point)) {group}"""


@query("mean_loss", WITH_EX + SCORED_SQL + f" SELECT count(*) AS rows, {sql6('avg(loss)', 'loss')} FROM scored")
def mean_loss(spark, sf_dir):
    return metrics.evaluate(scored(spark, sf_dir)).select("rows", r6("loss"))


@query("accuracy", WITH_EX + SCORED_SQL + f""" SELECT
  {sql6("avg(CAST(CAST(prob >= 0.2 AS BIGINT) = label AS INTEGER))", 'accuracy')} FROM scored""")
def accuracy(spark, sf_dir):
    return metrics.evaluate(scored(spark, sf_dir), threshold=0.2).select(r6("accuracy"))


@query("roc_points", WITH_EX + SCORED_SQL + f""", points AS ({points_sql('scored')})
  SELECT point, {sql6('tpr')}, {sql6('fpr')} FROM points""")
def roc_points(spark, sf_dir):
    return metrics.roc_points(scored(spark, sf_dir)).select("point", r6("tpr"), r6("fpr"))


@query("auc", WITH_EX + SCORED_SQL + f""", points AS ({points_sql('scored')}), area AS ({auc_sql('points')})
  SELECT {sql6('auc')} FROM area""")
def auc(spark, sf_dir):
    return metrics.evaluate(scored(spark, sf_dir)).select(r6("auc"))


def _rolling_sql() -> str:
    def rate(k: int, label: int) -> str:
        return (f"coalesce(sum(CAST(prob >= {k} / 10.0::DOUBLE AND label = {label} AS BIGINT)) OVER w "
                f"/ nullif(sum(CAST(label = {label} AS BIGINT)) OVER w, 0), 0.0)")

    rates = ", ".join(f"{rate(k, 1)} AS t{k}, {rate(k, 0)} AS f{k}" for k in range(11))
    area = " + ".join(f"(t{k + 1} + t{k}) / 2 * (f{k} - f{k + 1})" for k in range(10))
    return WITH_EX + SCORED_SQL + f""", rolled AS (SELECT example_id, avg(loss) OVER w AS loss,
      avg(CAST(CAST(prob >= 0.5 AS BIGINT) = label AS INTEGER)) OVER w AS accuracy, {rates} FROM scored
      WINDOW w AS (ORDER BY example_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
    SELECT example_id, {sql6('loss')}, {sql6('accuracy')}, {sql6(area, 'auc')} FROM rolled"""


@query("rolling_metrics", _rolling_sql())
def rolling_metrics(spark, sf_dir):
    """Metrics over the last 1000 events in order of arrival, for every event."""
    indexed = with_dense_index(scored(spark, sf_dir), ["seq"])
    return metrics.rolling_metrics(indexed, 1000).select(
        "example_id", r6("loss"), r6("accuracy"), r6("auc")
    )


@query("every_k_report", WITH_EX + SCORED_SQL + f""", numbered AS (SELECT *,
    (row_number() OVER (ORDER BY example_id) - 1) // 1000 AS report FROM scored),
  points AS ({points_sql('numbered', 'report')}), area AS ({auc_sql('points', 'report')})
  SELECT report, count(*) AS rows, {sql6('avg(loss)', 'loss')},
    {sql6("avg(CAST(CAST(prob >= 0.5 AS BIGINT) = label AS INTEGER))", 'accuracy')}, {sql6('any_value(auc)', 'auc')}
  FROM numbered JOIN area USING (report) GROUP BY report""")
def every_k_report(spark, sf_dir):
    indexed = with_dense_index(scored(spark, sf_dir), ["seq"])
    return every_k(indexed, 1000, metrics.evaluate).select(
        "report", "rows", r6("loss"), r6("accuracy"), r6("auc")
    )


def _progressive_sql() -> str:
    chain = chain_sql([batch_sql(i) for i in range(BATCHES)])
    scores, unions = [], []
    for i in range(BATCHES):
        weights = START_SQL if i == 0 else f"SELECT * FROM s{i}"
        scores.append(scored_sql(f"v{i}", f"SELECT feature, w FROM ({weights})", batch_sql(i)))
        unions.append(f"SELECT {i + 1} AS version, * FROM v{i}")
    sizes = " UNION ALL ".join(
        f"SELECT {i + 1} AS version, count(*) FILTER (w <> 0) AS nonzero FROM s{i + 1}" for i in range(BATCHES))
    return WITH_EX + chain + "," + ",".join(scores) + f""",
  every AS ({' UNION ALL '.join(unions)}), points AS ({points_sql('every', 'version')}),
  area AS ({auc_sql('points', 'version')}), sizes AS ({sizes})
  SELECT version, count(*) AS rows, {sql6('avg(loss)', 'loss')},
    {sql6("avg(CAST(CAST(prob >= 0.5 AS BIGINT) = label AS INTEGER))", 'accuracy')},
    {sql6('any_value(auc)', 'auc')}, any_value(nonzero) AS nonzero
  FROM every JOIN area USING (version) JOIN sizes USING (version) GROUP BY version"""


@query("progressive_by_batch", _progressive_sql())
def progressive_by_batch(spark, sf_dir):
    """Each batch scored with the model of the batches before it, then learned from."""
    store = StateStore(spark, new_folder(spark, "progressive"))
    training.train_series(store, examples(spark, sf_dir), "batch", CONFIG)
    return training.summary(store).select(
        F.col("version").cast("int").alias("version"), "rows", r6("loss"), r6("accuracy"), r6("auc"), "nonzero"
    )


def _deltas_sql() -> str:
    chain = chain_sql([batch_sql(i) for i in range(BATCHES)])
    return WITH_EX + chain + " " + " UNION ALL ".join(
        f"SELECT {v}::BIGINT AS version, {STATE_SQL} FROM s{v}" for v in (3, BATCHES))


def delta_series(spark, sf_dir, **how):
    """A series of batches on a store that writes only what a batch touched."""
    store = DeltaStore(spark, new_folder(spark, "deltas"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), **how)
    training.train_series(store, examples(spark, sf_dir), "batch", CONFIG)
    return store


@query("state_deltas", _deltas_sql())
def state_deltas(spark, sf_dir):
    """The state of a version from before and one from after the deltas were put into a new base."""
    store = delta_series(spark, sf_dir, compact_every=3, compact_share=BATCHES)
    states = [state_out(store.load(v)).withColumn("version", F.lit(v).cast("bigint")) for v in (3, BATCHES)]
    return states[0].unionByName(states[1])


def _touched_sql() -> str:
    chain = chain_sql([batch_sql(i) for i in range(BATCHES)])
    return WITH_EX + chain + " " + " UNION ALL ".join(
        f"""SELECT {i + 1}::BIGINT AS version, (SELECT count(DISTINCT feature) FROM ({batch_sql(i)})) AS written,
  count(*) AS features, count(*) FILTER (w <> 0) AS nonzero FROM s{i + 1}""" for i in range(BATCHES))


@query("ftrl_bucketed_batches", _touched_sql())
def ftrl_bucketed_batches(spark, sf_dir):
    """Rows that each batch wrote (its features and no others), and the size of the model after it."""
    meta = delta_series(spark, sf_dir).meta()
    return meta.select(F.col("version").cast("bigint").alias("version"), "written", "features", "nonzero")


# --- scoring a table --------------------------------------------------------------------

WORD_SPACE = Namespace("word", 1 << 20)
WORD_CONFIG = L.FtrlConfig(alpha=0.05, beta=1.0, l1=0.5, l2=1.0)


DOC_SQL = f"""WITH {TOKENS_SQL},
ex AS MATERIALIZED (SELECT DISTINCT doc_id AS example_id, quality::BIGINT AS label,
  {sql_bucket('feature', 1 << 20)} AS feature, 1.0::DOUBLE AS value
  FROM tokens LEFT JOIN labels USING (doc_id)),
"""


@query("score_submission", DOC_SQL + chain_sql(["SELECT * FROM ex WHERE label IS NOT NULL"], WORD_CONFIG)
       + "," + scored_sql("scored", "SELECT feature, w FROM s1 WHERE w <> 0",
                          "SELECT * FROM ex WHERE label IS NULL")
       + f" SELECT CAST(example_id AS VARCHAR) || ',' || printf('%.8f', {_clip('margin')}) AS line FROM scored")
def score_submission(spark, sf_dir):
    """Learn quality from the labelled documents and score the others."""
    words = F.array_distinct(F.transform(
        F.filter(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), lambda t: t != ""),
        lambda t: feat.bucket(t, WORD_SPACE, MD5),
    ))
    features = F.map_from_entries(F.transform(words, lambda w: F.struct(w, F.lit(1.0))))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")

    def dealt(rows):
        # A row becomes hundreds, and a file's row groups may be fewer than the cores, so rows are dealt evenly before.
        return rows.hint("rebalance").select(F.col("doc_id").alias("example_id"), "label", features.alias("features"))

    state = stored(steps.ftrl_step(
        st.empty_state(spark), dealt(texts.where(F.col("label").isNotNull())), WORD_CONFIG, stored=True), "state")
    scores = score(dealt(texts.where(F.col("label").isNull())).drop("label"), state, stored=True)
    return scores.select(score_line().alias("line"))
