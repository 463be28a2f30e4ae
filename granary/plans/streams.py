"""Queries over sources and streams of the library's own: traces, folders of files, tokens, streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, contrast, fitting, reservoir
from ..operators.tables import work_path
from ..functions.tokens import PromptTokenizer
from ..sources import traces
from ..sources.repos import Registry, Repository
from ..sources.tables import PRED, predictions, table

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def written_traces(spark: SparkSession, d: str) -> str:
    """events as eight traces of one line each: processes and threads first, then the events, in the shared folder."""
    names = [("process_name", p, 0, name) for p, name in enumerate(("/device:TPU:0", "/host:CPU"))] + [("thread_name", p, t, name) for p in range(2) for t, name in enumerate(("XLA Ops", "Steps", "Other"))]
    head = '{"note": "a \\" and [", "traceEvents": [' + ", ".join(f'{{"ph": "M", "name": "{n}", "pid": {p}, "tid": {t}, "args": {{"name": "{x}"}}}}' for n, p, t, x in names)
    e = table(spark, d, "events").select((F.col("event_id") % 8).alias("shard"), F.lit(1).alias("kind"), F.concat(F.lit(","), F.to_json(F.struct(
        F.lit("X").alias("ph"), F.col("event_type").alias("name"), (F.col("user_id") % 2).alias("pid"), (F.col("user_id") % 3).alias("tid"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts"), F.col("value").alias("dur"), F.struct((F.col("user_id") % 10).alias("scope"), F.lit('{"\\').alias("text")).alias("args")))).alias("value"))
    shards = e.select("shard").distinct()
    frame = shards.select("shard", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("kind"), F.lit("]}").alias("value")))).alias("x")).select("shard", "x.*")
    path = work_path(spark, "traces")
    e.union(frame).repartition("shard").sortWithinPartitions("shard", "kind").select("shard", "value").write.partitionBy("shard").option("lineSep", " ").text(path)
    return path


@query("""SELECT user_id % 10 AS scope, event_type AS op, count(*) AS n, round(sum(value), 4) AS total, max(epoch_us(ts))::DOUBLE AS last FROM events WHERE user_id % 2 = 0 AND user_id % 3 < 2 GROUP BY 1, 2""")
def trace_scopes(spark: SparkSession, d: str) -> DataFrame:
    """A device's time by scope and operation, from traces that are one JSON line each."""
    x = traces.device_events(traces.trace_events(spark, written_traces(spark, d), {"ph": ["M", "X"]}, range_bytes=1 << 20))
    scope = F.get_json_object("args", "$.scope").cast("long")
    return x.groupBy(scope.alias("scope"), F.col("name").alias("op")).agg(F.count("*").alias("n"), F.round(F.sum("dur"), 4).alias("total"), F.max("ts").alias("last"))


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 1000 AND 9000 AND o_custkey > 100 GROUP BY 1""")
def ranged_repository(spark: SparkSession, d: str) -> DataFrame:
    """A repository of range-dealt files, of which those outside a range of keys are never opened."""
    root = work_path(spark, "repository")
    table(spark, d, "orders").repartitionByRange(16, "o_orderkey").write.parquet(f"{root}/main")
    registry = Registry()
    registry.register(Repository("orders", root, {"main": {"train": "main/*"}}))
    registry.index(spark, "orders", ["o_orderkey"])
    rows = registry.load(spark, "orders", "main", "train", columns=["o_orderpriority", "o_totalprice"], where=F.col("o_custkey") > 100, between={"o_orderkey": (1000, 9000)})
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of texts by a public vocabulary whose answer letters are tokens of their own."""
    import public_tokenizers

    tokens = PromptTokenizer.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens.letter_ids()
    return table(spark, d, "documents").select("doc_id", tokens.count(F.col("text")).alias("n_tokens"))


@query()
def contrastive_returns(spark: SparkSession, d: str) -> DataFrame:
    """Groups of contrastive rows on returns, one for each order, whole or rejected."""
    worlds = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("customer"))
    return contrast.contrastive(worlds, "key", contrast.return_group, contrast.in_time)


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id, doc_id || ' ' || md5(text) AS line FROM documents),
t AS (SELECT place, line FROM o WHERE doc_id % 3 <> 1), f AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, line FROM o WHERE doc_id % 41 <> 7),
c AS (SELECT -1 AS place, -1 AS i UNION ALL SELECT place, i FROM t JOIN f USING (line)),
g AS (SELECT i AS i0, place AS at0, lead(i) OVER (ORDER BY i) - i AS size, lead(i) OVER (ORDER BY i) - i = lead(place) OVER (ORDER BY place) - place AS even FROM c),
r AS (SELECT at0 + f.i - i0 AS place, line FROM f JOIN g ON f.i > i0 AND f.i < i0 + size WHERE even)
SELECT place, line, false AS restored FROM t UNION ALL SELECT place, line, true FROM r WHERE place NOT IN (SELECT place FROM t)""")
def realigned_lines(spark: SparkSession, d: str) -> DataFrame:
    """A file of which a third of the lines was thinned out, restored from a later build that lacks some others."""
    x = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5("text")).alias("line"))
    places = lambda df, name: align.running(align.in_parts(df, "doc_id"), "doc_id", name, F.lit(1), "sum").withColumn(name, F.col(name) - 1)
    return align.realigned(places(x.where("doc_id % 41 <> 7"), "i"), places(x, "at").where("doc_id % 3 <> 1")).withColumnRenamed("at", "place")


@query()
def thinned_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """A sample of fixed size of which all English rows and a thirty-third of the others are eligible; no sort of the input."""
    return reservoir.reservoir(table(spark, d, "documents"), 200, kept=F.col("lang") == "en", share=1 / 33, ident="doc_id", seed=1234).select("doc_id", "lang", F.md5("text").alias("text"))


@query()
def vector_scaling_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Temperature and place biases of choices, fitted for each tier on all other tiers, and the mean loss there."""
    x = predictions(spark, d).where("type = 'choice'")
    return fitting.vector_scaling(x, "tier", places=4, left_out=True).select("tier", F.round(1 / F.col("t"), 4).alias("inverse_t"), F.transform("bias", lambda b: F.round(b, 4)).alias("bias"), F.round("nll", 6).alias("nll"), "n")


@query()
def beta_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Beta calibration of yes-or-no rows by tier."""
    x = predictions(spark, d).where("type = 'noul'").select("tier", F.get("p", F.lit(1)).alias("p"), F.col("gold").cast("double").alias("y"))
    return fitting.beta_scaling(x, "tier").select("tier", *[F.round(c, 4).alias(c) for c in "abc"], F.round("nll", 6).alias("nll"), "n")


@query("""WITH p AS (SELECT type, k, i - 1 AS place, avg(exp(logits[i] - list_max(logits)) / list_sum([exp(x - list_max(logits)) FOR x IN logits])) AS m FROM (SELECT *, unnest(range(1, len(logits) + 1)) AS i FROM pred WHERE type IN ('choice', 'noul')) GROUP BY 1, 2, 3 HAVING count(*) >= 20)
SELECT id, place, round(logits[place + 1] - ln(m), 6) AS logit FROM pred JOIN p USING (type, k)""".replace("WITH p", f"WITH {PRED}, p", 1))
def batch_calibrated_logits(spark: SparkSession, d: str) -> DataFrame:
    """Logits less the log of the mean probability of their place, without labels."""
    x = fitting.batch_calibrated(predictions(spark, d).select("id", "type", "logits")).where("type <> 'score'")
    return x.select("id", F.posexplode("logits").alias("place", "logit")).select("id", F.col("place").cast("long").alias("place"), F.round("logit", 6).alias("logit"))
