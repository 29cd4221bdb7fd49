"""Queries for hashed features, feature sets, rare-feature filters, topics and LIBSVM text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions.binning import heavy_user, log_bin
from ...functions.hashing import Namespace, bucket
from ...functions.identity import with_identity
from ...operators import features as feat
from ...operators import frequency
from ...operators.bags import bag_runs
from ...operators.counts import count_by
from ...operators.topics import term_counts, topics_of, user_topics, with_default_topics
from ...session import new_folder
from ...sources.logs import spread_out
from ...sources.examples import libsvm_line, parse_libsvm, unwrap_envelope
from .. import feature_sets as sets
from .. import prepare
from .base import (
    RAW_SQL, clean, events, query, r6, raw_log, sql6, sql_bucket, sql_hash, table,
)
from .preparation import PREPARED_SQL, PREVIOUS_DAY_SQL, VECTORS_SQL, WITH_LOG, prepared, user_vectors

MD5 = "md5"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
LINE_KEYS_SQL = ", ".join(LINE_KEYS)
LINE_TEXTS = {"l_returnflag": "rf-", "l_linestatus": "ls-", "l_suppkey": "sk-"}
LINE_SPACE = Namespace("line", 1000000, 2000000)
CROSS_SPACE = Namespace("cross", 500, 1100)
HOUR_SPACE = Namespace("hour", 1000000, 4000000)


def lines(spark, sf_dir):
    return spread_out(table(spark, sf_dir, "lineitem"), "l_orderkey")


def _line_texts_sql() -> list[str]:
    return [f"'{p}' || CAST({c} AS VARCHAR)" for c, p in LINE_TEXTS.items()]


def _union(select: str, expressions: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {select.format(e=e)} FROM {source}" for e in expressions)


@query("namespaced_hash", _union(LINE_KEYS_SQL + ", {e} AS feature",
                                 [sql_bucket(t, 1000000, 2000000) for t in _line_texts_sql()], "lineitem"))
def namespaced_hash(spark, sf_dir):
    hashed = F.array(*[bucket(t, LINE_SPACE, MD5) for t in feat.prefixed(LINE_TEXTS)])
    return lines(spark, sf_dir).select(*LINE_KEYS, F.explode(hashed).alias("feature"))


@query("one_hot", _union(LINE_KEYS_SQL + ", {e} AS name, 1.0::DOUBLE AS value", _line_texts_sql(), "lineitem"))
def one_hot(spark, sf_dir):
    return feat.one_hot(lines(spark, sf_dir), LINE_KEYS, feat.prefixed(LINE_TEXTS))


NUMERIC = {"l_discount": "l_discount", "l_tax": "l_tax"}


@query("numeric_named", " UNION ALL ".join(
    f"SELECT {LINE_KEYS_SQL}, {sql_bucket(repr(name), 100)} AS feature, {col} AS value FROM lineitem"
    for name, col in NUMERIC.items()))
def numeric_named(spark, sf_dir):
    group = feat.named_values({n: F.col(c) for n, c in NUMERIC.items()}, Namespace("numeric", 100), MD5)
    examples = lines(spark, sf_dir).select(*LINE_KEYS, feat.as_map(group).alias("features"))
    return feat.exploded(examples, LINE_KEYS)


def _cross_sql() -> str:
    parts = [
        f"SELECT rid, {LINE_KEYS_SQL}, " + sql_bucket(
            f"'t' || CAST({sql_bucket(repr(name), 100)} AS VARCHAR) || {text}", 500, 1100
        ) + f" AS feature, {col} AS value, {i * 10 + j} AS place FROM numbered"
        for i, (name, col) in enumerate(NUMERIC.items())
        for j, text in enumerate(_line_texts_sql())
    ]
    # A later feature of an example replaces an earlier one of the same id.
    return f"""WITH numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM lineitem)
      SELECT {LINE_KEYS_SQL}, feature, value FROM ({' UNION ALL '.join(parts)})
      QUALIFY row_number() OVER (PARTITION BY rid, feature ORDER BY place DESC) = 1"""


@query("cross_numeric", _cross_sql())
def cross_numeric(spark, sf_dir):
    group = feat.named_values({n: F.col(c) for n, c in NUMERIC.items()}, Namespace("numeric", 100), MD5)
    crossed = feat.crossed_values(group, feat.prefixed(LINE_TEXTS), CROSS_SPACE, MD5)
    examples = lines(spark, sf_dir).select(*LINE_KEYS, feat.as_map(crossed).alias("features"))
    return feat.exploded(examples, LINE_KEYS)


@query("cross_hour", WITH_LOG + f"""SELECT id, {sql_bucket(
    "CAST(" + sql_bucket("'pId-' || pub_id", 1000000, 1000000) + " AS VARCHAR) || '+' || h", 1000000, 4000000
)} AS feature, 1.0::DOUBLE AS value FROM clean""")
def cross_hour(spark, sf_dir):
    group = feat.indicators(feat.prefixed({"pub_id": "pId-"}), Namespace("pub", 1000000, 1000000), MD5)
    crossed = feat.crossed_tag(group, F.substring("hour", 7, 2), HOUR_SPACE, MD5)
    examples = clean(spark, sf_dir).select("id", feat.as_map(crossed).alias("features"))
    return feat.exploded(examples, ["id"])


@query("merge_last_wins", """SELECT event_id, feature, value FROM (
    SELECT event_id, user_id % 10 AS feature, 1.0::DOUBLE AS value, 0 AS place FROM events
    UNION ALL SELECT event_id, event_id % 10, value, 1 FROM events)
  QUALIFY row_number() OVER (PARTITION BY event_id, feature ORDER BY place DESC) = 1""")
def merge_last_wins(spark, sf_dir):
    first = F.create_map(F.col("user_id") % 10, F.lit(1.0))
    second = F.create_map(F.col("event_id") % 10, F.col("value"))
    examples = table(spark, sf_dir, "events").select("event_id", feat.merged(first, second).alias("features"))
    return feat.exploded(examples, ["event_id"])


@query("log_bin", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
  CAST(floor(ln(l_quantity + 1)) AS BIGINT) AS bin FROM lineitem""")
def log_bins(spark, sf_dir):
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", log_bin("l_quantity").alias("bin")
    )


@query("heavy_user_rule", """SELECT user_id, n, CASE WHEN n >= 66 THEN CAST(user_id AS VARCHAR)
  ELSE CAST(n AS VARCHAR) END AS category FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
def heavy_user_rule(spark, sf_dir):
    n = count_by(table(spark, sf_dir, "events"), ["user_id"])
    return n.select("user_id", "n", heavy_user("user_id", "n", 66).alias("category"))


@query("topic_vector_features", f"""WITH {VECTORS_SQL} """ + " UNION ALL ".join(
    f"SELECT event_id, {sql_bucket(repr(f't{i}'), 2147483647)} AS feature, "
    + sql6(f"coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0.0)", "value")
    + " FROM events LEFT JOIN vectors USING (user_id)" for i in range(10)))
def topic_vector_features(spark, sf_dir):
    rows = prepare_vectors(spark, sf_dir)
    group = feat.vector_entries("topics", 10, sets.WHOLE_RANGE, method=MD5)
    examples = rows.select("event_id", feat.as_map(group).alias("features"))
    return feat.exploded(examples, ["event_id"]).select("event_id", "feature", r6("value"))


def prepare_vectors(spark, sf_dir):
    return with_default_topics(table(spark, sf_dir, "events"), user_vectors(spark, sf_dir), ["event_id"])


# --- whole feature sets -----------------------------------------------------------------


def _indicator_rows(source: str, texts: list[str], space: Namespace, place: int) -> list[str]:
    return [
        f"SELECT id, {sql_bucket(t, space.size, space.offset)} AS feature, 1.0::DOUBLE AS value, "
        f"{place * 100 + i} AS place FROM {source}"
        for i, t in enumerate(texts)
    ]


def _feature_set_sql(with_clause: str, parts: list[str]) -> str:
    return f"""{with_clause} SELECT id, feature, {sql6('value')} FROM ({' UNION ALL '.join(parts)})
      WHERE feature IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY id, feature ORDER BY place DESC) = 1"""


def _user_texts_sql(day: str, hour: str) -> list[str]:
    def rule(count: str, limit: int) -> str:
        return (f"CASE WHEN coalesce({count}, 0) >= {limit} THEN user_id "
                f"ELSE CAST(CAST(coalesce({count}, 0) AS BIGINT) AS VARCHAR) END")

    return [f"'userIdCtr' || {rule(day, sets.HEAVY_DAY)}", f"'userIdHctr' || {rule(hour, sets.HEAVY_HOUR)}"]


def _tagged_sql(texts: list[str], space: Namespace) -> list[str]:
    return [f"CAST({sql_bucket(t, space.size, space.offset)} AS VARCHAR) || '+' || h" for t in texts]


def _bag_set_sql() -> str:
    s, users = sets.BAG_SPACES, _user_texts_sql("day_count", "hour_count")
    return _feature_set_sql(f"{WITH_LOG}, {PREPARED_SQL}", [
        *_indicator_rows("prepared", users, s["user"], 0),
        *_indicator_rows("prepared", ["'pub' || CAST(bag_id AS VARCHAR)"], s["pub"], 1),
        *_indicator_rows("prepared", ["'imp' || impression"], s["impression"], 2),
        *_indicator_rows("prepared", ["'hour' || h"], s["hour"], 3),
        *_indicator_rows("prepared", _tagged_sql(users, s["user"]), s["user_hour"], 4),
    ])


def _set_rows(log, features, value=None):
    # A row becomes about a hundred. The joins before leave a key's rows together, so they are dealt anew, evenly.
    examples = log.hint("rebalance").select("id", features.alias("features"))
    return feat.exploded(examples, ["id"]).select("id", "feature", r6("value") if value is None else value)


@query("bag_feature_set", _bag_set_sql())
def bag_feature_set(spark, sf_dir):
    return _set_rows(prepared(spark, sf_dir), sets.bag_features(MD5))


def _prefixed_sql(prefixes: dict[str, str]) -> list[str]:
    return [f"'{p}' || {c}" for c, p in prefixes.items()]


def _count_set_sql() -> str:
    s, users = sets.COUNT_SPACES, _user_texts_sql("user_count", "user_hour_count")
    bins = [f"'{n}' || CAST(CAST(floor(ln(coalesce({n}, 0) + 1)) AS BIGINT) AS VARCHAR)"
            for n in prepare.COUNTED_KEYS.values()]
    return _feature_set_sql(f"{WITH_LOG}, {PREVIOUS_DAY_SQL}", [
        *_indicator_rows("counted", users, s["user"], 0),
        *_indicator_rows("counted", bins, s["ad"], 1),
        *_indicator_rows("counted", _prefixed_sql(sets.AD_PREFIXES), s["category"], 2),
        *_indicator_rows("counted", _tagged_sql(bins, s["ad"]), s["ad_hour"], 3),
        *_indicator_rows("counted", ["h"], s["hour"], 4),
    ])


@query("count_feature_set", _count_set_sql())
def count_feature_set(spark, sf_dir):
    log = prepare.prepare_with_day_counts(clean(spark, sf_dir))
    return _set_rows(log, sets.count_features(MD5))


def _rate_ctes() -> str:
    ctes = [
        f"""r{i} AS (SELECT {key}, dt, CAST(sum(p) OVER w AS DOUBLE) / sum(a) OVER w AS {name}
        FROM (SELECT {key}, dt, count(*) AS a, sum(CAST(click AS BIGINT)) AS p FROM clean GROUP BY ALL)
        WINDOW w AS (PARTITION BY {key} ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
        for i, (key, name) in enumerate(prepare.RATED_KEYS.items())
    ]
    joins = " ".join(f"LEFT JOIN r{i} USING ({key}, dt)" for i, key in enumerate(prepare.RATED_KEYS))
    return f"{', '.join(ctes)}, rated AS (SELECT * FROM clean {joins})"


def _rate_set_sql() -> str:
    s = sets.RATE_SPACES
    texts = _prefixed_sql(sets.PUBLISHER_PREFIXES) + _prefixed_sql(sets.AD_PREFIXES)
    crossed = _prefixed_sql(sets.PUBLISHER_PREFIXES) + _prefixed_sql(
        {c: sets.AD_PREFIXES[c] for c in ("C15", "C16", "C18", "C19", "C20", "C21")})
    numbers = [
        f"SELECT id, {sql_bucket(repr(n), s['rate'].size, s['rate'].offset)} AS feature, "
        f"coalesce({n}, 0.0) AS value, {i} AS place FROM rated" for i, n in enumerate(sets.RATE_COLUMNS)
    ]
    crosses = []
    for i, n in enumerate(sets.RATE_COLUMNS):
        key = f"CAST({sql_bucket(repr(n), s['rate'].size, s['rate'].offset)} AS VARCHAR)"
        for j, t in enumerate(crossed):
            crosses.append(
                f"SELECT id, {sql_bucket(f'''{repr('t')} || {key} || {t}''', s['cross'].size, s['cross'].offset)} "
                f"AS feature, coalesce({n}, 0.0) AS value, {1000 + i * 20 + j} AS place FROM rated")
    return _feature_set_sql(f"{WITH_LOG}, {_rate_ctes()}", [
        *numbers,
        *_indicator_rows("rated", ["'userId' || user_id"], s["user"], 1),
        *_indicator_rows("rated", texts, s["category"], 2),
        *crosses,
    ])


@query("rate_feature_set", _rate_set_sql())
def rate_feature_set(spark, sf_dir):
    return _set_rows(prepare.prepare_with_rates(clean(spark, sf_dir)), sets.rate_features(MD5))


def _topic_log(spark, sf_dir):
    # The log text of device_ip is "ip" and the user number.
    log = with_identity(raw_log(spark, sf_dir), drop_sources=False).withColumn(
        "number", F.substring(F.col("device_ip"), 3, 20).cast("bigint")
    )
    vectors = user_vectors(spark, sf_dir).withColumnRenamed("user_id", "number")
    # Rounded here, as every topic becomes several features.
    return with_default_topics(log, vectors, ["id"], key="number").withColumn("topics", F.transform("topics", lambda t: r6(t)))


TOPIC_LOG_SQL = f"""{VECTORS_SQL}, topical AS (SELECT clean.*,
    {', '.join(f'coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0.0) AS t{i}' for i in range(10))}
  FROM clean LEFT JOIN vectors ON vectors.user_id = CAST(substr(device_ip, 3) AS BIGINT))"""


def _entry_rows(space: Namespace, place: int) -> list[str]:
    return [
        f"SELECT id, {sql_bucket(repr(f't{i}'), space.size, space.offset)} AS feature, t{i} AS value, "
        f"{place * 100 + i} AS place FROM topical" for i in range(10)
    ]


def _topic_set_sql() -> str:
    s = sets.TOPIC_SPACES
    texts = (_prefixed_sql(sets.AD_PREFIXES) + _prefixed_sql(sets.CREATIVE_PREFIXES)
             + _prefixed_sql(sets.PUBLISHER_PREFIXES))
    crossed = (_prefixed_sql(sets.PUBLISHER_PREFIXES) + _prefixed_sql(sets.CREATIVE_PREFIXES)
               + ["'c21-' || C21"])
    crosses = []
    for i in range(10):
        key = f"CAST({sql_bucket(repr(f't{i}'), s['topic'].size, s['topic'].offset)} AS VARCHAR)"
        for j, t in enumerate(crossed):
            text = f"'t' || {key} || {t}"
            crosses.append(f"SELECT id, {sql_bucket(text, s['cross'].size, s['cross'].offset)} AS feature, "
                           f"t{i} AS value, {1000 + i * 10 + j} AS place FROM topical")
    return _feature_set_sql(f"{WITH_LOG}, {TOPIC_LOG_SQL}", [
        *_entry_rows(s["topic"], 0), *_indicator_rows("topical", texts, s["category"], 1), *crosses,
    ])


@query("topic_feature_set", _topic_set_sql())
def topic_feature_set(spark, sf_dir):
    return _set_rows(_topic_log(spark, sf_dir), sets.topic_features(MD5), "value")


def _category_set_sql() -> str:
    texts = ["'d-' || CAST(dayofweek(dt) AS VARCHAR)", "'h-' || h",
             *_prefixed_sql(sets.AD_PREFIXES), *_prefixed_sql(sets.CREATIVE_PREFIXES),
             *_prefixed_sql(sets.PUBLISHER_PREFIXES), *_prefixed_sql(sets.DOMAIN_PREFIX)]
    return _feature_set_sql(f"{WITH_LOG}, {TOPIC_LOG_SQL}", [
        *_indicator_rows("topical", texts, sets.WHOLE_RANGE, 0), *_entry_rows(sets.WHOLE_RANGE, 1),
    ])


@query("category_feature_set", _category_set_sql())
def category_feature_set(spark, sf_dir):
    return _set_rows(_topic_log(spark, sf_dir), sets.category_features(MD5), "value")


# --- rare features ----------------------------------------------------------------------

TOKENS_SQL = """tokens AS (SELECT doc_id, place, feature FROM (
    SELECT doc_id, unnest(words) AS feature, generate_subscripts(words, 1) - 1 AS place
    FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS words FROM documents))
  WHERE feature <> '')"""


def tokens(spark, sf_dir):
    """Every word of every document with its place."""
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")
    # A row becomes hundreds, and a file's row groups may be fewer than the cores, so rows are dealt evenly before.
    return table(spark, sf_dir, "documents").select("doc_id", "text").hint("rebalance").select(
        "doc_id", F.posexplode(words).alias("place", "feature")
    ).where(F.col("feature") != "").withColumn("place", F.col("place").cast("bigint"))


PER_DOC = "SELECT doc_id, count(*) AS kept, sum(length(feature))::BIGINT AS letters FROM kept GROUP BY doc_id"


def _per_doc(kept):
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.length("feature")).cast("bigint").alias("letters")
    )


@query("rare_filter_exact", f"""WITH {TOKENS_SQL}, kept AS (SELECT * FROM tokens
  QUALIFY count(*) OVER (PARTITION BY feature) >= 10) {PER_DOC}""")
def rare_filter_exact(spark, sf_dir):
    return _per_doc(frequency.keep_frequent(tokens(spark, sf_dir), 10, ["doc_id", "place"]))


@query("rare_filter_progressive", f"""WITH {TOKENS_SQL}, kept AS (SELECT * FROM tokens
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY doc_id, place) >= 10) {PER_DOC}""")
def rare_filter_progressive(spark, sf_dir):
    return _per_doc(frequency.keep_after_sightings(tokens(spark, sf_dir), 10, ["doc_id", "place"]))


OVER, MISS = 5, 0.01
DEPTH = frequency.sketch_size(1, OVER, MISS)[0]


def md5_pair(feature):
    def part(start):
        return F.conv(F.substring(F.md5(feature), start, 8), 16, 10).cast("bigint")

    return part(1), part(9)


def _sketch_sql() -> str:
    """CTE estimates: (feature, n, estimate) with the sketch's own cells."""
    first, second = (f"CAST('0x' || substr(md5(feature), {i}, 8) AS BIGINT) % width" for i in (1, 9))
    return f"""WITH {TOKENS_SQL}, words AS (SELECT feature, count(*) AS n FROM tokens GROUP BY feature),
      size AS (SELECT CAST(ceil(exp(1.0::DOUBLE) * sum(n) / {OVER}) AS BIGINT) AS width FROM words),
      cells AS (SELECT feature, n, r * width + ({first} + r * ({second})) % width AS cell
        FROM words, size, (SELECT unnest(range({DEPTH})) AS r)),
      sketch AS (SELECT cell, sum(n) AS n FROM cells GROUP BY cell),
      estimates AS (SELECT feature, any_value(cells.n) AS n, min(sketch.n) AS estimate
        FROM cells JOIN sketch USING (cell) GROUP BY feature)"""


@query("rare_filter_count_min", f"""{_sketch_sql()}, kept AS (SELECT * FROM tokens
  JOIN (SELECT feature FROM estimates WHERE estimate >= 10) USING (feature)) {PER_DOC}""")
def rare_filter_count_min(spark, sf_dir):
    return _per_doc(frequency.keep_frequent_approx(
        tokens(spark, sf_dir), 10, ["doc_id", "place"], over=OVER, miss=MISS, hashes=md5_pair))


@query("sketch_estimates", f"{_sketch_sql()} SELECT feature, n, CAST(estimate AS BIGINT) AS estimate FROM estimates")
def sketch_estimates(spark, sf_dir):
    """Every feature's count as the sketch has it, next to the true one."""
    rows = tokens(spark, sf_dir)
    depth, width = frequency.sketch_size(rows.count(), OVER, MISS)
    sketch = frequency.count_min_table(rows, "feature", depth, width, md5_pair)
    counts = count_by(rows, ["feature"])
    return frequency.count_min_estimate(counts.select("feature"), sketch, "feature", depth, width, md5_pair).join(counts, "feature").select(
        "feature", "n", "estimate")


@query("sketch_within_bound", f"""WITH {TOKENS_SQL} SELECT count(DISTINCT feature) AS features,
  0::BIGINT AS too_low, true AS within_bound FROM tokens""")
def sketch_within_bound(spark, sf_dir):
    """The sketch against true counts: none too low, and at most ``MISS`` of them over by more than ``OVER``."""
    rows = tokens(spark, sf_dir)
    depth, width = frequency.sketch_size(rows.count(), OVER, MISS)
    sketch = frequency.count_min_table(rows, "feature", depth, width)
    estimated = frequency.count_min_estimate(rows, sketch, "feature", depth, width)
    both = estimated.join(count_by(rows, ["feature"]), "feature")
    return both.agg(
        F.count(F.lit(1)).alias("features"), F.count_if(F.col("estimate") < F.col("n")).alias("too_low"),
        (F.count_if(F.col("estimate") > F.col("n") + OVER) <= F.count(F.lit(1)) * MISS).alias("within_bound"),
    )


# --- text forms -------------------------------------------------------------------------


def line_examples(spark, sf_dir):
    """Events with three features, as examples."""
    pairs = F.map_from_arrays(
        F.array(F.lit(0).cast("bigint"), F.col("k") + 1, F.col("v") + 1000),
        F.array(F.lit(1.0), F.col("value"), F.lit(0.5)),
    )
    label = (F.col("event_type") == "purchase").cast("int")
    return events(spark, sf_dir).select("event_id", label.alias("label"), pairs.alias("features"))


LINES_SQL = f"""{RAW_SQL}, lines AS (SELECT event_id, value, k, v,
  CAST(event_type = 'purchase' AS INTEGER) AS label FROM raw)"""


@query("libsvm_line", f"""WITH {LINES_SQL} SELECT event_id, CAST(label AS VARCHAR) || ' 0:1.0 '
  || CAST(k + 1 AS VARCHAR) || ':' || CAST(value AS VARCHAR) || ' ' || CAST(v + 1000 AS VARCHAR) || ':0.5' AS line
  FROM lines""")
def libsvm_lines(spark, sf_dir):
    return line_examples(spark, sf_dir).select("event_id", libsvm_line().alias("line"))


ROUNDTRIP_SQL = f"""WITH {LINES_SQL} SELECT event_id, label, 0::BIGINT AS feature, 1.0::DOUBLE AS value FROM lines
  UNION ALL SELECT event_id, label, k + 1, value FROM lines
  UNION ALL SELECT event_id, label, v + 1000, 0.5::DOUBLE FROM lines"""


@query("libsvm_roundtrip", ROUNDTRIP_SQL)
def libsvm_roundtrip(spark, sf_dir):
    parsed = parse_libsvm(libsvm_lines(spark, sf_dir)).where("valid")
    return feat.exploded(parsed, ["event_id", "label"])


@query("envelope_unwrap", f"""WITH {LINES_SQL}, sent AS (SELECT *, event_id % 7 <> 0 AS sound FROM lines)
  SELECT event_id, sound AS valid, CASE WHEN sound THEN label END AS label,
    CASE WHEN sound THEN {sql6('1.0 + value + 0.5', 'x').removesuffix(' AS x')} END AS total FROM sent""")
def envelope_unwrap(spark, sf_dir):
    """LIBSVM lines sent in envelopes, every seventh of them cut short on the way."""
    whole = F.to_json(F.struct(F.col("line").alias("payload")))
    sent = libsvm_lines(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, whole).otherwise(F.substring(whole, 1, 12)).alias("value"),
    )
    parsed = parse_libsvm(unwrap_envelope(sent))
    total = F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, b: a + b)
    return parsed.select("event_id", "valid", "label", r6(total, "total"))


TERM_BUCKETS = 4096


@query("term_counts", WITH_LOG + f"""SELECT user_id, {sql_hash('lower(C14)')} % {TERM_BUCKETS} AS bucket,
  count(*) AS n FROM clean GROUP BY ALL""")
def term_counts_by_user(spark, sf_dir):
    """Hashed counts of the ads (``C14``) each user was shown."""
    return term_counts(bag_runs(clean(spark, sf_dir), "user_id", "C14"), "user_id", "C14", TERM_BUCKETS, MD5)


@query("topic_distribution", WITH_LOG + """SELECT DISTINCT user_id, 10::BIGINT AS shares,
  1.0::DOUBLE AS total FROM clean""")
def topic_distribution(spark, sf_dir):
    """Topics of users from the ads they were shown: shares between 0 and 1 that add up to 1."""
    topics = user_topics(clean(spark, sf_dir), item="C14", num_features=TERM_BUCKETS)
    proper = F.filter("topics", lambda t: (t >= 0) & (t <= 1))
    return topics.select(
        "user_id", F.size(proper).cast("bigint").alias("shares"),
        r6(F.aggregate("topics", F.lit(0.0), lambda a, t: a + t), "total"),
    )


@query("topic_groups", f"""WITH {RAW_SQL}, seen AS (SELECT user_id, user_id % 2 AS side, count(*) AS n FROM raw GROUP BY ALL)
  SELECT user_id, side, n, true AS agrees FROM seen""")
def topic_groups(spark, sf_dir):
    """Two halves of the users who never see the same item: everyone's largest topic, under the model stored and
    loaded again, is that of most of the half, and the halves' topics differ."""
    log = events(spark, sf_dir).withColumn("side", F.col("user_id") % 2).withColumn(
        "item", F.concat(F.lit("i"), F.col("side").cast("string"), F.lit("-"), (F.col("k") % 7).cast("string")))
    path = new_folder(spark, "topic-model")
    user_topics(log, item="item", num_features=TERM_BUCKETS, iterations=30, k=2, method=MD5, model_path=path)
    shares = topics_of(log, path, item="item", method=MD5)
    largest = shares.select("user_id", (F.col("user_id") % 2).alias("side"),
                            (F.array_position("topics", F.array_max("topics")) - 1).alias("topic"))
    common = largest.groupBy("side").agg(F.mode("topic").alias("usual")).withColumn(
        "apart", F.count(F.lit(1)).over(Window.partitionBy("usual")) == 1)
    counts = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return largest.join(F.broadcast(common), "side").join(counts, "user_id").select(
        "user_id", "side", "n", ((F.col("topic") == F.col("usual")) & F.col("apart")).alias("agrees"))
