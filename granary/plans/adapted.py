"""Adapters and generators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probs import argmax
from ..sources import adapters as A
from ..sources.tables import table

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def _gold(items: DataFrame) -> DataFrame:
    return items.select("id", "type", F.get("labels", argmax(F.col("target"))).alias("gold"), F.round(F.array_max("target"), 6).alias("p"))


@query("SELECT l_orderkey || '-' || l_linenumber AS id, 'choice' AS type, CASE l_returnflag WHEN 'A' THEN 'returned' WHEN 'N' THEN 'kept' ELSE 'refunded' END AS gold, 1.0::DOUBLE AS p FROM lineitem WHERE l_linestatus <> 'X'")
def adapt_classified(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn("y", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    return _gold(A.classified("id", F.concat(F.lit("part "), F.col("l_partkey")), F.col("y"), ("returned", "kept", "refunded"), "What became of it?")(x))


@query("SELECT c_custkey::VARCHAR AS id, 'choice' AS type, n_name AS gold, 1.0::DOUBLE AS p, 4::BIGINT AS n_options FROM customer JOIN nation ON c_nationkey = n_nationkey")
def adapt_menu(spark: SparkSession, d: str) -> DataFrame:
    """The gold nation among three distractors; the names come from the small dimension table."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    names = n.agg(F.array_sort(F.collect_set("n_name")).alias("names"))
    x = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(names))
    items = A.menu("c_custkey", F.col("c_name"), F.col("n_name"), F.col("names"), "Which nation?", size=4)(x)
    return items.select("id", "type", F.get("labels", argmax(F.col("target"))).alias("gold"), F.array_max("target").alias("p"), F.size("labels").cast("long").alias("n_options"))


@query("SELECT doc_id::VARCHAR AS id, 'noul' AS type, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS gold, 1.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id)")
def adapt_yes_no(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return _gold(A.yes_no("doc_id", F.col("text"), F.col("toxic"), "Is the text toxic?")(x))


@query("SELECT doc_id || '-not' AS id, 'noul' AS type, CASE WHEN toxic = 1 THEN 'no' ELSE 'yes' END AS gold, 1.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id)")
def adapt_negated(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    a = A.yes_no("doc_id", F.col("text"), F.col("toxic"), "Is the text toxic?")
    return _gold(A.negated(a, lambda s: F.replace(s, F.lit("Is the text"), F.lit("Is the text free of anything")))(x))


@query("""WITH m AS (SELECT l_suppkey, least(greatest(avg(l_quantity) / 12, 0), 4) AS x FROM lineitem GROUP BY 1)
SELECT l_suppkey::VARCHAR AS id, 'score' AS type, (CASE WHEN x - floor(x) > 0.5 THEN floor(x) + 1 ELSE floor(x) END)::INT::VARCHAR AS gold, round(greatest(x - floor(x), 1 - (x - floor(x))), 6) AS p FROM m""")
def adapt_rating(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 12).alias("m"))
    return _gold(A.rating("l_suppkey", F.concat(F.lit("supplier "), F.col("l_suppkey")), F.col("m"), ("tiny", "small", "middling", "large", "huge"), "How large are its orders?")(m))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'purchase') AS t FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS id, 'choice' AS type, CASE WHEN a >= b AND a >= t THEN 'A' WHEN b >= t THEN 'B' ELSE 'tie' END AS gold, round((greatest(a, b, t) + 0.5 / 3) / (a + b + t + 0.5), 6) AS p FROM c""")
def adapt_preference(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.array(*[F.count_if(F.col("event_type") == n).cast("double") for n in ("click", "view", "purchase")]).alias("c"))
    return _gold(A.preference("user_id", F.lit("Which?"), F.lit("one"), F.lit("two"), F.col("c"), "Which reply is better?")(c))


@query("SELECT conv_id || '-' || turn AS id, 'noul' AS type, CASE WHEN len(regexp_extract_all(text, '[0-9]+')) > 0 THEN 'yes' ELSE 'no' END AS gold, 1.0::DOUBLE AS p FROM conversations WHERE text <> ''")
def adapt_answerable(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversations").where("text <> ''").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return _gold(A.answerable("id", F.col("text"), F.lit("Which number is named?"), F.regexp_extract_all("text", F.lit("([0-9]+)"), 1))(x))


@query("SELECT doc_id, md5(substr(text, greatest(strpos(text, ' ') - 1 - 5, 0) + 1, least(strpos(text, ' ') - 1 + 1 + 5, length(text)) - greatest(strpos(text, ' ') - 1 - 5, 0))) AS window_md5 FROM documents WHERE strpos(text, ' ') > 0")
def span_windows(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", " ") - 1
    return table(spark, d, "documents").where(F.instr("text", " ") > 0).select("doc_id", F.md5(A.window(F.col("text"), at, F.lit(1), 5)).alias("window_md5"))


@query("""SELECT o_orderkey::VARCHAR AS id, 'noul' AS type, CASE WHEN o_orderkey % 60 <= 30 THEN 'yes' ELSE 'no' END AS gold, 1.0::DOUBLE AS p FROM orders""")
def generate_return_window(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("bought")).withColumn("returned", F.date_add("bought", (F.col("id") % 60).cast("int"))).withColumn("days", F.lit(30))
    return _gold(A.return_window(x, "bought", "returned", "days"))


@query("""WITH c AS (SELECT l_orderkey, list(round(l_extendedprice)::BIGINT) AS c FROM lineitem GROUP BY l_orderkey), t AS (SELECT l_orderkey, list_sum(c)::BIGINT AS s FROM c)
SELECT l_orderkey::VARCHAR AS id, 'noul' AS type, CASE WHEN s - floor(s * 15 / 100)::BIGINT <= 150000 THEN 'yes' ELSE 'no' END AS gold, 1.0::DOUBLE AS p FROM t""")
def generate_within_budget(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.round("l_extendedprice").cast("long")).alias("c"))
    return _gold(A.within_budget(x, F.col("c"), F.lit(15), F.lit(150000)))


@query("""WITH c AS (SELECT l_orderkey, list('line ' || l_linenumber ORDER BY l_linenumber) AS n, list(l_quantity::BIGINT ORDER BY l_linenumber) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey::VARCHAR AS id, 'choice' AS type, n[list_position(v, CASE WHEN l_orderkey % 10 < 7 THEN list_max(v) ELSE list_min(v) END)] AS gold, 1.0::DOUBLE AS p FROM c WHERE len(list_distinct(v)) = len(v) AND len(v) > 1""")
def generate_table_argmax(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("x")).where(F.size("x") > 1)
    names, values = F.transform("x", lambda s: F.concat(F.lit("line "), s["l_linenumber"].cast("string"))), F.transform("x", lambda s: s["q"])
    return _gold(A.table_argmax(c, names, values, F.col("id") % 10 < 7))


@query("""SELECT p_partkey::VARCHAR AS id, round((a / (a + b)::DOUBLE) * (greatest(a - 1, 0) / (a + b - 1)::DOUBLE) * (greatest(a - 2, 0) / (a + b - 2)::DOUBLE), 9) AS p_yes FROM (SELECT p_partkey, 1 + p_size % 6 AS a, 2 + p_size % 5 AS b FROM part)""")
def generate_urn(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (1 + F.col("p_size") % 6).alias("a"), (2 + F.col("p_size") % 5).alias("b"))
    return A.urn(x, F.col("a"), F.col("b"), 3).select("id", F.round(F.get("target", F.lit(1)), 9).alias("p_yes"))


@query("SELECT i AS id, 5 + ('0x' || substr(md5('7|x|' || i), 1, 8))::BIGINT % 16 AS x FROM range(500) r(i)")
def generate_draws(spark: SparkSession, d: str) -> DataFrame:
    return A.drawn(spark, 500, 7, x=(5, 20))
