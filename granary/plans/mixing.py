"""Sampling, mixtures, votes and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import mixture, sampling, votes
from ..sources.tables import table

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def _order(seed: int) -> str:
    return f"md5(doc_id || chr(31) || '{seed}'), doc_id"


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_order(0)}) AS r FROM documents) WHERE r <= 20")
def cap_per_source(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cap_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", 20, ident="doc_id")


STRATA = """c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), w AS (SELECT *, 100 * n / sum(n) OVER () AS want FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY round(want - floor(want), 9) DESC, quality, toxic) AS r, 100 - sum(floor(want)) OVER () AS rest FROM w),
q AS (SELECT quality, toxic, n, (floor(want) + (r <= rest)::INT)::BIGINT AS take FROM r)"""


@query(f"WITH {STRATA} SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, n, take FROM q")
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "labels").groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"))
    return sampling.largest_remainder(c, ["quality", "toxic"], 100)


@query(f"WITH {STRATA}, o AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY {_order(3)}) AS k FROM labels) SELECT doc_id FROM o JOIN q USING (quality, toxic) WHERE k <= take")
def stratified_k(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "labels"), ["quality", "toxic"], 100, ident="doc_id", seed=3).select("doc_id")


@query("""WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no FROM documents JOIN labels USING (doc_id) GROUP BY source),
k AS (SELECT *, yes / (yes + no) AS p, round_even(least(yes, no) * 0.7 / (1 - 0.7), 0)::BIGINT AS keep FROM c),
x AS (SELECT *, CASE WHEN p > 0.7 OR p < 1 - 0.7 THEN greatest(least(greatest(yes, no) - keep, floor((yes + no) * 0.6)), 0) ELSE 0 END::BIGINT AS gone FROM k)
SELECT source, yes, no, yes - CASE WHEN p > 0.7 THEN gone ELSE 0 END AS keep_yes, no - CASE WHEN p < 1 - 0.7 THEN gone ELSE 0 END AS keep_no FROM x""")
def rebalance_binary(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return sampling.rebalance_quota(j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("yes"), F.count_if(F.col("quality") == 0).alias("no")))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT 0.4 * sum(n) AS total FROM c), g AS (SELECT i * (64.0 / 4096) AS c FROM range(1, 4097) r(i)),
s AS (SELECT g.c, sum(least(n, g.c * sqrt(n), 0.15 * floor(total))) AS s FROM c, g, t GROUP BY g.c), b AS (SELECT coalesce(min(c), 64.0) AS c FROM s, t WHERE s >= floor(total))
SELECT source, n, floor(least(n, b.c * sqrt(n), 0.15 * floor(total)) + 1e-9)::BIGINT AS quota FROM c, b, t""")
def sqrt_quota(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = int(0.4 * (c.agg(F.sum("n")).first()[0] or 0))
    return sampling.sqrt_quotas_grid(c, total)


SOURCES = """src AS (SELECT source, count(*) AS n, avg((lang = 'fr')::INT) AS fr_share, substr(source, 4)::INT % 4 AS block FROM documents GROUP BY source),
sh AS (SELECT *, 0.4 - 0.1 * block AS share, sqrt(n) AS s FROM src), tot AS (SELECT sum(share) AS t FROM (SELECT DISTINCT block, share FROM sh)),
w AS (SELECT source, block, n, fr_share, share / t * s / sum(s) OVER (PARTITION BY block) AS weight FROM sh, tot)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("lang") == "fr").cast("int")).alias("fr_share"))
    s = s.withColumn("block", F.substring("source", 4, 9).cast("int") % 4)
    return s.withColumn("share", F.lit(0.4) - 0.1 * F.col("block"))


@query(f"WITH {SOURCES} SELECT source, block::BIGINT AS block, round(weight, 6) AS weight FROM w")
def block_weights(spark: SparkSession, d: str) -> DataFrame:
    return mixture.block_weights(_sources(spark, d)).select("source", F.col("block").cast("long").alias("block"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {SOURCES}, lng AS (SELECT *, CASE WHEN block = substr(source, 4)::INT % 4 AND substr(source, 4)::INT % 8 < 4 THEN 1.0 ELSE fr_share END AS fr FROM w),
m AS (SELECT *, sum(weight) OVER b AS mass, sum(CASE WHEN fr >= 1 THEN weight ELSE 0 END) OVER b AS om, sum(CASE WHEN fr >= 1 THEN 0 ELSE weight * fr END) OVER b AS fixed FROM lng WINDOW b AS (PARTITION BY block)),
k AS (SELECT *, greatest(0.4 * mass - fixed, 0) AS want FROM m)
SELECT source, round(CASE WHEN want > 0 AND want < mass AND om > 0 AND om < mass THEN CASE WHEN fr >= 1 THEN weight * want / om ELSE weight * (mass - want) / (mass - om) END ELSE weight END, 6) AS weight FROM k""")
def lang_target_rescale(spark: SparkSession, d: str) -> DataFrame:
    s = mixture.block_weights(_sources(spark, d)).withColumn("fr_share", F.when(F.substring("source", 4, 9).cast("int") % 8 < 4, 1.0).otherwise(F.col("fr_share")))
    return mixture.lang_target(s, target=0.4).select("source", F.round("weight", 6).alias("weight"))


@query(f"""WITH {SOURCES}, c AS (SELECT *, sum(greatest(weight - 0.06, 0)) OVER b AS cut, sum(CASE WHEN weight > 0.06 THEN 0 ELSE weight END) OVER b AS room FROM w WINDOW b AS (PARTITION BY block))
SELECT source, round(CASE WHEN weight > 0.06 THEN 0.06 WHEN room > 0 THEN weight * (1 + cut / room) ELSE weight END, 6) AS weight FROM c""")
def capped_weights(spark: SparkSession, d: str) -> DataFrame:
    return mixture.capped(mixture.block_weights(_sources(spark, d)), 0.06).select("source", F.round("weight", 6).alias("weight"))


@query(f"""WITH {SOURCES}, g AS (SELECT *, 'g' || (substr(source, 4)::INT % 3) AS grp FROM w), s AS (SELECT block, grp, sum(sqrt(n)) AS s FROM g GROUP BY 1, 2), k AS (SELECT block, count(*) AS k FROM s GROUP BY 1)
SELECT source, round((SELECT sum(weight) FROM w w2 WHERE w2.block = g.block) / k * sqrt(n) / s, 6) AS weight FROM g JOIN s USING (block, grp) JOIN k USING (block)""")
def group_weights(spark: SparkSession, d: str) -> DataFrame:
    """Equal shares of the groups within a block, n^0.5 within a group."""
    w = mixture.block_weights(_sources(spark, d)).withColumn("grp", F.concat(F.lit("g"), F.substring("source", 4, 9).cast("int") % 3))
    groups = w.groupBy("block", "grp").agg(F.sum(F.sqrt("n")).alias("s"))
    k = groups.groupBy("block").agg(F.count("*").alias("k"))
    mass = w.groupBy("block").agg(F.sum("weight").alias("mass"))
    return w.join(groups, ["block", "grp"]).join(k, "block").join(mass, "block").select("source", F.round(F.col("mass") / F.col("k") * F.sqrt("n") / F.col("s"), 6).alias("weight"))


@query(f"WITH {SOURCES} SELECT source, n, round(weight * 5000 / n, 6) AS epochs, weight * 5000 > 4 * n AS over FROM w")
def epochs_by_source(spark: SparkSession, d: str) -> DataFrame:
    w = mixture.block_weights(_sources(spark, d))
    return w.select("source", "n", F.round(F.col("weight") * 5000 / F.col("n"), 6).alias("epochs"), (F.col("weight") * 5000 > 4 * F.col("n")).alias("over"))


@query()
def epoch_cap(spark: SparkSession, d: str) -> DataFrame:
    """Weights under which no source is drawn more than 4 times its rows; the source table is the driver's, its rows aren't."""
    rows = mixture.block_weights(_sources(spark, d)).select("source", "block", "n", "weight").collect()
    w = mixture.cap_epochs({r.source: r.weight for r in rows}, {r.source: r.n for r in rows}, 5000, most=4.0, blocks={r.source: str(r.block) for r in rows})
    return spark.createDataFrame(sorted((k, round(v, 9)) for k, v in w.items()), "source string, weight double")


@query(f"SELECT doc_id FROM documents ORDER BY {_order(11)} LIMIT 100")
def reservoir_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 rows in hash order: a bounded top-k of each task, and of those."""
    return table(spark, d, "documents").select("doc_id").orderBy(sampling.draw_order("doc_id", 11), "doc_id").limit(100)


@query("SELECT source, count(*) AS n, count(*) FILTER (substr(source, 4)::INT % 5 <> 0) AS kept FROM documents GROUP BY source HAVING count(*) FILTER (substr(source, 4)::INT % 5 <> 0) > 0")
def drop_by_licence_class(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a licence class go; sources left empty leave the mix."""
    open_ = F.substring("source", 4, 9).cast("int") % 5 != 0
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(open_).alias("kept")).where("kept > 0")


@query(f"""WITH {SOURCES}, c AS (SELECT source, sum(weight) OVER (ORDER BY source) - weight AS lo, sum(weight) OVER (ORDER BY source) AS hi FROM w),
o AS (SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey || chr(31) || '5'), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders)
SELECT source, count(*) AS n FROM o JOIN c ON u >= lo AND u < hi GROUP BY source""")
def weighted_draw_range_join(spark: SparkSession, d: str) -> DataFrame:
    """A source for each order by its place among cumulative weights: a range join to the (small) table of sources, as one sorted array in each row's reach."""
    from ..functions.keys import hash01

    w = mixture.block_weights(_sources(spark, d))
    c = w.select("source", F.sum("weight").over(W.orderBy("source")).alias("hi")).orderBy("source").collect()  # a row for each source
    u = table(spark, d, "orders").select(hash01(F.col("o_orderkey"), 5).alias("u"))
    pick = F.lit(None).cast("string")
    for r in reversed(c):
        pick = F.when(F.col("u") < r.hi, F.lit(r.source)).otherwise(pick)
    return u.select(pick.alias("source")).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))


_PAIR = "least(l_suppkey, l_partkey % 100 + 1) AS x, greatest(l_suppkey, l_partkey % 100 + 1) AS y"


@query(f"""WITH v AS (SELECT {_PAIR}, CASE WHEN l_returnflag = 'N' THEN 'tie' WHEN (l_returnflag = 'A') = (l_suppkey <= l_partkey % 100 + 1) THEN 'a' ELSE 'b' END AS w FROM lineitem)
SELECT x, y, count(*) FILTER (w = 'a') AS wins_x, count(*) FILTER (w = 'b') AS wins_y, count(*) FILTER (w = 'tie') AS ties FROM v GROUP BY x, y""")
def canonical_pair_votes(spark: SparkSession, d: str) -> DataFrame:
    """Battles between a supplier and a part's stand-in; the return flag votes."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"), F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "b").otherwise("tie").alias("v"))
    return votes.canonical_votes(rows, "a", "b", F.col("v"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT user_id, round((c + 0.5 / 3) / (c + v + p + 0.5), 6) AS click, round((v + 0.5 / 3) / (c + v + p + 0.5), 6) AS "view", round((p + 0.5 / 3) / (c + v + p + 0.5), 6) AS purchase FROM c""")
def vote_target(spark: SparkSession, d: str) -> DataFrame:
    names = ("click", "view", "purchase")
    c = table(spark, d, "events").groupBy("user_id").agg(F.array(*[F.count_if(F.col("event_type") == n).cast("double") for n in names]).alias("c"))
    t = c.select("user_id", P.vote_target(F.col("c")).alias("t"))
    return t.select("user_id", *[F.round(F.col("t")[i], 6).alias(n) for i, n in enumerate(names)])


@query("SELECT user_id, count(*) AS n, round((count(*) FILTER (event_type = 'purchase') + 0.5 * count(*) FILTER (event_type = 'click')) / count(*), 6) AS share FROM events GROUP BY user_id HAVING count(*) >= 5")
def rater_share(spark: SparkSession, d: str) -> DataFrame:
    r = votes.rater_share(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "click")
    return r.withColumn("share", F.round("share", 6))


@query("""WITH m AS (SELECT l_suppkey, least(greatest(avg(l_quantity) / 10, 0), 4) AS x FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(x, 6) AS mean, floor(x)::BIGINT AS lo, round(1 - (x - floor(x)), 6) AS at_lo FROM m""")
def interpolated_levels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 10).alias("m"))
    x = F.least(F.greatest("m", F.lit(0.0)), F.lit(4.0))
    t = m.select("l_suppkey", x.alias("x"), P.interpolated(F.col("m"), 5).alias("t"))
    return t.select("l_suppkey", F.round("x", 6).alias("mean"), F.floor("x").cast("long").alias("lo"), F.round(F.get("t", F.floor("x").cast("int")), 6).alias("at_lo"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, conv_id * 1000 + turn AS node, CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent FROM conversations),
w AS (SELECT node AS root, node, 0 AS depth FROM m WHERE parent IS NULL UNION ALL SELECT root, m.node, depth + 1 FROM m JOIN w ON m.parent = w.node)
SELECT root, node, depth::BIGINT AS depth FROM w""")
def conversation_paths(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    m = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return votes.tree_paths(m).select("root", "node", F.col("depth").cast("long").alias("depth"))


@query("""SELECT conv_id, turn, lag(role) OVER w AS before_role, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS context_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_context(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before_role"), F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("context_chars"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS score FROM conversations WHERE role <> 'user'), b AS (SELECT conv_id, max(struct_pack(score := score, t := -turn)) AS best, min(struct_pack(score := score, t := -turn)) AS worst, count(*) AS n FROM r GROUP BY conv_id)
SELECT conv_id, -best.t AS best_turn, -worst.t AS other_turn FROM b WHERE n > 1 AND best.score > worst.score""")
def best_vs_other_reply(spark: SparkSession, d: str) -> DataFrame:
    """Of each tree its best ranked reply against another, found by one partial aggregate."""
    r = table(spark, d, "conversations").where("role <> 'user'").select("conv_id", F.struct(F.length("text").alias("score"), (-F.col("turn")).alias("t")).alias("k"))
    b = r.groupBy("conv_id").agg(F.max("k").alias("best"), F.min("k").alias("worst"), F.count("*").alias("n"))
    return b.where("n > 1 and best.score > worst.score").select("conv_id", (-F.col("best.t")).alias("best_turn"), (-F.col("worst.t")).alias("other_turn"))
