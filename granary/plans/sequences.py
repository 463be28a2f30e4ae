"""Series, joins by time, packing, streams, items and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing, render, series
from ..sources import items as I  # noqa: E741
from ..sources.tables import table
from ..streaming import monitors

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def metric_log(spark: SparkSession, d: str) -> DataFrame:
    """events as a metric log: run, step, loss, bucket."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("bucket"), "ts", "event_id")


LOG = "log AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss, event_type AS bucket FROM events)"


@query(f"WITH {LOG} SELECT run, (ceil(step / 10) * 10)::BIGINT AS upto, round(avg(loss), 6) AS mean FROM log GROUP BY 1, 2 HAVING count(*) = 10")
def online_windows(spark: SparkSession, d: str) -> DataFrame:
    return series.full_windows(metric_log(spark, d), "run", "step", "loss", 10).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {LOG}, w AS (SELECT run, (ceil(step / 10) * 10)::BIGINT AS upto, avg(loss) AS mean FROM log GROUP BY 1, 2 HAVING count(*) = 10),
b AS (SELECT min(run) AS base FROM log), d AS (SELECT x.run, x.mean - y.mean AS d FROM w x JOIN w y ON x.upto = y.upto, b WHERE y.run = base AND x.run <> base)
SELECT run, round(avg(d), 6) AS delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, count(*) AS n FROM d GROUP BY run HAVING count(*) >= 3""")
def paired_window_delta(spark: SparkSession, d: str) -> DataFrame:
    w = series.full_windows(metric_log(spark, d), "run", "step", "loss", 10)
    base = w.agg(F.min("run")).first()[0]
    b = w.where(F.col("run") == F.lit(base)).select("upto", F.col("mean").alias("base"))
    x = w.where(F.col("run") != F.lit(base)).join(b, "upto").select("run", (F.col("mean") - F.col("base")).alias("d"))
    return x.groupBy("run").agg(F.round(F.avg("d"), 6).alias("delta"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 6).alias("se"), F.count("*").alias("n")).where("n >= 3")


@query(f"WITH {LOG}, e AS (SELECT run, max(step) AS last FROM log GROUP BY run) SELECT run, count(*) AS n, round(sum(loss * step) / sum(step), 9) AS weighted, round(avg(loss), 9) AS mean FROM log JOIN e USING (run) WHERE step > 1 AND step < last GROUP BY run")
def steady_step_stats(spark: SparkSession, d: str) -> DataFrame:
    """Duration-weighted means without each run's first and last row."""
    x = metric_log(spark, d)
    last = x.groupBy("run").agg(F.max("step").alias("last"))
    s = x.join(last, "run").where("step > 1 and step < last")
    return s.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum(F.col("loss") * F.col("step")) / F.sum("step"), 9).alias("weighted"), F.round(F.avg("loss"), 9).alias("mean"))


@query("""WITH p AS (SELECT l_linenumber::DOUBLE AS x, avg(l_extendedprice) / 10000 AS y, l_returnflag AS g FROM lineitem GROUP BY 1, 3)
SELECT g, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM p GROUP BY g""")
def line_fit(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("x"), F.col("l_returnflag").alias("g")).agg((F.avg("l_extendedprice") / 10000).alias("y"))
    return p.groupBy("g").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_linenumber::DOUBLE AS x, l_returnflag AS g, avg(l_extendedprice) / 10000 AS y FROM lineitem GROUP BY 1, 2),
s AS (SELECT g, count(*)::DOUBLE AS n, sum(x) AS x1, sum(x ** 2) AS x2, sum(x ** 3) AS x3, sum(x ** 4) AS x4, sum(y) AS y0, sum(x * y) AS y1, sum(x ** 2 * y) AS y2 FROM p GROUP BY g),
d AS (SELECT *, n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2) AS d FROM s),
f AS (SELECT g, (y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - y2 * x3) + x2 * (y1 * x3 - y2 * x2)) / d AS a, (n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1)) / d AS b, (n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)) / d AS c FROM d)
SELECT g, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(-b / (2 * c), 6) AS vertex FROM f""")
def lr_curve_fit(spark: SparkSession, d: str) -> DataFrame:
    """A parabola in a knob and its vertex, by sums."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("x"), F.col("l_returnflag").alias("g")).agg((F.avg("l_extendedprice") / 10000).alias("y"))
    return series.parabola(p, ["g"], "x", "y").select("g", *[F.round(c, 6).alias(c) for c in ("a", "b", "c", "vertex")])


@query("SELECT l_suppkey, (min(struct_pack(p := l_extendedprice, o := l_orderkey, l := l_linenumber))).o AS l_orderkey, min(l_extendedprice) AS price FROM lineitem GROUP BY l_suppkey")
def argmin_per_group(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("m"))
    return m.select("l_suppkey", F.col("m.l_orderkey").alias("l_orderkey"), F.col("m.l_extendedprice").alias("price"))


@query(f"""WITH {LOG}, w AS (SELECT run, step, list(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM log),
m AS (SELECT run, step, v, list_median(v) AS m FROM w) SELECT run, step, round(m, 6) AS median, round(list_median([abs(x - m) FOR x IN v]), 6) AS mad FROM m""")
def rolling_median_mad(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_median(metric_log(spark, d), "run", "step", "loss").select("run", "step", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(f"""WITH {LOG}, i AS (SELECT run, step, (loss < 50)::INT AS h, sum((loss >= 50)::INT) OVER (PARTITION BY run ORDER BY step) AS island FROM log), s AS (SELECT run, island, sum(h) AS n FROM i GROUP BY 1, 2)
SELECT run, max(n)::BIGINT AS longest FROM s GROUP BY run""")
def longest_negative_run(spark: SparkSession, d: str) -> DataFrame:
    return series.longest_run(metric_log(spark, d), "run", "step", F.col("loss") < 50)


_DAY = "(epoch({}) // 86400)::BIGINT"


@query(f"""SELECT count(*) AS n, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND {_DAY.format('l_shipdate')} >= {_DAY.format('o_orderdate')} AND {_DAY.format('l_shipdate')} < {_DAY.format('o_orderdate')} + 30 GROUP BY o_orderpriority""")
def validity_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Shipments within 30 days of their order, as a half-open interval join by key and bucket of days."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("long")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", day("o_orderdate").alias("s")).withColumn("e", F.col("s") + 30)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), day("l_shipdate").alias("t"))
    return series.bucketed_range_join(li, o, "t", "s", "e", 32, ["k"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT p.event_id, max(v.ts) AS found_at FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY p.event_id""")
def as_of_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of each purchase the user's latest view at or before it."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value")
    return series.as_of(left, right, "user_id", "ts", "event_id").select("event_id", "found_at")


@query(f"WITH {LOG} SELECT run, round(avg(loss) FILTER (r <= k), 6) AS first, round(avg(loss) FILTER (b <= k), 6) AS last FROM (SELECT *, step AS r, n - step + 1 AS b, greatest(1, least(10, n // 4)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM log)) GROUP BY run")
def first_last_means(spark: SparkSession, d: str) -> DataFrame:
    x = metric_log(spark, d)
    n = x.groupBy("run").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n") / 4)))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("loss"))), 6)
    return x.join(n, "run").groupBy("run").agg(mean(F.col("step") <= k).alias("first"), mean(F.col("n") - F.col("step") + 1 <= k).alias("last"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.size(T.words("text")).cast("long").alias("n"))
    return n.where("n > 0").withColumn("shard", F.pmod("idx", F.lit(8)))


@query(r"""SELECT doc_id, CASE WHEN n <= 256 THEN 256 WHEN n <= 1024 THEN 1024 WHEN n <= 4096 THEN 4096 ELSE -1 END::BIGINT AS bucket FROM (SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')) AS n FROM documents)""")
def bucket_assign(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.keys import range_bucket

    n = F.size(T.words("text"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(range_bucket(n, (256, 1024, 4096)), F.lit(-1)).cast("long").alias("bucket"))


_PACK = {"buckets": (256, 1024, 4096), "budget": 8192, "slots": 32}


@query()
def pack_offline_longest_first(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_segments(spark, d), longest_first=True, **_PACK)


@query()
def pack_stream_bucket(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_segments(spark, d), bins=4, **_PACK)


@query()
def pack_stream_best_fit(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_segments(spark, d), bins=4, best_fit=True, **_PACK)


@query()
def pack_fill_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Filled share of the microbatches by bucket and placement."""
    seg = _segments(spark, d)
    out = None
    for name, fit in (("bucket", False), ("best_fit", True)):
        p = packing.pack(seg, bins=4, best_fit=fit, **_PACK).join(seg, ["shard", "idx"]).where("bucket is not null")
        m = p.groupBy("bucket", "shard", "micro").agg(F.sum("n").alias("used"))
        r = m.groupBy("bucket").agg(F.count("*").alias("microbatches"), F.round(F.sum("used") / F.sum(F.greatest(F.lit(1), F.floor(8192 / F.col("bucket"))) * F.col("bucket")), 6).alias("fill")).withColumn("placement", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query()
def spike_flags(spark: SparkSession, d: str) -> DataFrame:
    return monitors.spikes(metric_log(spark, d), "run", "step", "loss")


@query()
def spike_stream(spark: SparkSession, d: str) -> DataFrame:
    """The spike detector on a stream of the events, to a table in the shared folder, read back."""
    import uuid

    from ..operators.tables import written

    log = written(metric_log(spark, d).select("run", "step", "loss"), "log")
    base = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    at, name = log.inputFiles()[0].rsplit("/", 1)[0], uuid.uuid4().hex
    s = spark.readStream.schema(log.schema).parquet(at)
    q = monitors.spike_stream(s, "run", "step", "loss").writeStream.format("parquet").option("path", f"{base}/spikes-{name}").option("checkpointLocation", f"{base}/spikes-state-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/spikes-{name}")


@query()
def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    x = metric_log(spark, d).withColumn("grad", F.col("loss") + 1)
    return monitors.health(x, "run", "step", "loss", "grad")


@query()
def microbatch_counts(spark: SparkSession, d: str) -> DataFrame:
    return monitors.microbatches(table(spark, d, "events"), "event_id", 64, 3600, "ts", "user_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return monitors.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 6)).withColumn("start", F.to_timestamp_ntz(F.col("start").cast("string")))


@query("""WITH l AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w > INTERVAL 30 MINUTE)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, s""")
def sessionized_events(spark: SparkSession, d: str) -> DataFrame:
    s = monitors.sessions(table(spark, d, "events"))
    return s.select("user_id", "n", F.to_timestamp_ntz(F.col("start").cast("string")).alias("start"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY 1, 2")
def dedup_within_watermark(spark: SparkSession, d: str) -> DataFrame:
    return monitors.dedup_events(table(spark, d, "events"), ["user_id", "event_type", "value"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", (F.col("p_size") % 3).alias("t"))


@query("""WITH o AS (SELECT p_partkey AS id, ['red', 'green', 'blue', 'none'] AS l FROM part), h AS (SELECT id, l, list_sort([md5(id || '|' || x || '|0') || ':' || x FOR x IN l]) AS s FROM o)
SELECT id, md5('part ' || id || chr(10) || 'Which colour?' || chr(10) || 'A) ' || string_split(s[1], ':')[2] || chr(10) || 'B) ' || string_split(s[2], ':')[2] || chr(10) || 'C) ' || string_split(s[3], ':')[2] || chr(10) || 'D) ' || string_split(s[4], ':')[2]) AS prompt_md5 FROM h""")
def render_prompts(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("red", "green", "blue", "none")])
    p = _parts(spark, d).select("id", labels.alias("l")).withColumn("o", render.shown_order(F.col("l"), F.col("id"), F.lit("choice")))
    return p.select("id", F.md5(render.prompt(F.concat(F.lit("part "), F.col("id")), F.lit("Which colour?"), F.col("l"), F.col("o"))).alias("prompt_md5"))


@query("SELECT p_partkey AS id, j::BIGINT AS view, array_to_string([(x + j * 4 // 2) % 4 FOR x IN range(4)], ',') AS shown FROM part, range(2) r(j)")
def option_rotations(spark: SparkSession, d: str) -> DataFrame:
    r = render.rotations(F.sequence(F.lit(0), F.lit(3)), 2)
    return _parts(spark, d).select("id", F.posexplode(r).alias("view", "o")).select("id", F.col("view").cast("long").alias("view"), F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("shown"))


@query("""WITH u AS (SELECT p_partkey AS id, 3 + p_size % 5 AS a, 2 + p_size % 4 AS b FROM part) SELECT id, round((a * (a - 1.0)) / ((a + b) * (a + b - 1.0)), 9) AS both_a, round(a / (a + b)::DOUBLE, 9) AS one_a FROM u""")
def exact_posterior_worlds(spark: SparkSession, d: str) -> DataFrame:
    """Draws without replacement from an urn of a and b: exact probabilities as labels."""
    u = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (3 + F.col("p_size") % 5).alias("a"), (2 + F.col("p_size") % 4).alias("b"))
    n = F.col("a") + F.col("b")
    return u.select("id", F.round(F.col("a") * (F.col("a") - 1.0) / (n * (n - 1.0)), 9).alias("both_a"), F.round(F.col("a") / n, 9).alias("one_a"))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_DAY.format('l_shipdate')} - {_DAY.format('o_orderdate')} AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, days, CASE WHEN days < 0 THEN 'unknown' WHEN days <= 30 THEN 'yes' ELSE 'no' END AS label FROM x""")
def return_window_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Is a shipment within its return window: the label follows from the dates."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("long")
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (day("l_shipdate") - day("o_orderdate")).alias("days"))
    return x.withColumn("label", F.when(F.col("days") < 0, "unknown").when(F.col("days") <= 30, "yes").otherwise("no"))


@query("""WITH p AS (SELECT name, row_number() OVER (ORDER BY substr(md5(name), 1, 2), name) - 1 AS number FROM (SELECT DISTINCT n_name AS name FROM nation)), m AS (SELECT count(*) AS m FROM p),
x AS (SELECT c_custkey AS id, n_name, j, (('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT + j) % m AS number FROM customer JOIN nation ON c_nationkey = n_nationkey, range(4) r(j), m),
y AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY j) AS r FROM x JOIN p USING (number) WHERE name <> n_name)
SELECT id, string_agg(name, ',' ORDER BY r) AS others FROM y WHERE r <= 3 GROUP BY id""")
def distractor_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("name"))
    return render.distractors(c, n.select(F.col("n_name").alias("name")), 3).select("id", F.array_join("others", ",").alias("others"))


@query("SELECT doc_id AS id, 'noul' AS type, ['no', 'yes'][quality + 1] AS expected, CASE WHEN doc_id % 7 = 0 THEN 'probability_sum' END AS reject_reason FROM labels")
def parse_items_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as JSON lines (every seventh with a broken target) and parsed back."""
    q = F.struct(F.lit("noul").alias("type"), F.lit("Good?").alias("instructions"), F.create_map(F.lit("false"), F.lit("bad"), F.lit("true"), F.lit("good")).alias("criteria"))
    bad = F.col("doc_id") % 7 == 0
    target = F.when(bad, F.create_map(F.lit("no"), F.lit(0.2), F.lit("yes"), F.lit(0.3)))
    lines = table(spark, d, "labels").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("some text").alias("state"), q.alias("question"), F.when(~bad, F.element_at(F.array(F.lit("no"), F.lit("yes")), F.col("quality") + 1)).alias("expected"), target.alias("target"), F.col("quality").alias("q"))).alias("line"))
    p = I.parse_items(lines)
    want = table(spark, d, "labels").select("doc_id", F.element_at(F.array(F.lit("no"), F.lit("yes")), F.col("quality") + 1).alias("want"))
    j = p.join(want, F.col("id") == F.col("doc_id").cast("string"))
    from ..functions.probs import argmax

    return j.select("doc_id", "type", F.coalesce(F.get("labels", argmax(F.col("target"))), "want").alias("expected"), "reject_reason").withColumnRenamed("doc_id", "id")
