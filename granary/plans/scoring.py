"""Metrics, calibration and statistics over a prediction dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import metrics as M
from ..sources.tables import PRED, predictions, table

Q: dict[str, tuple] = {}
WITH = f"WITH {PRED}"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ITEM = """item AS (SELECT *, list_sum([-target[i] * ln(p[i] + 1e-12) FOR i IN range(1, k + 1)]) AS nll, list_sum([(p[i] - target[i]) ** 2 FOR i IN range(1, k + 1)]) AS brier FROM pred)"""


@query(f"{WITH}, {ITEM} SELECT id, round(nll, 6) AS nll, round(nll, 6) AS kl, round(brier, 6) AS brier FROM item")
def nll_kl_brier(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.per_item(predictions(spark, d)).select("id", "nll", "kl", "brier"))


@query(f"""{WITH}, {ITEM}, u AS (SELECT 'all' AS grp, 'all' AS value, * FROM item UNION ALL SELECT 'type', type, * FROM item UNION ALL SELECT 'lang', lang, * FROM item UNION ALL SELECT 'tier', tier, * FROM item)
SELECT grp, value, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(nll), 6) AS kl, round(avg(brier), 6) AS brier, round(avg(conf), 6) AS conf FROM u GROUP BY 1, 2""")
def grouped_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.grouped_report(predictions(spark, d), ["type", "lang", "tier"]))


def _ece(bin_: str) -> str:
    return f"{WITH}, b AS (SELECT type, {bin_} AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM pred GROUP BY 1, 2) SELECT type, round(sum(n * abs(c - h)) / sum(n), 6) AS ece FROM b GROUP BY type"


@query(_ece("least(greatest(ceil(round(conf * 15, 12)) - 1, 0), 14)"))
def ece15(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ece(predictions(spark, d), ["type"], M.bin_right_closed(F.col("conf"), 15)))


@query(_ece("least(floor(round(conf * 10, 12)), 9)"))
def ece10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ece(predictions(spark, d), ["type"], M.bin_left_closed(F.col("conf"), 10)))


@query(f"{WITH} SELECT type, round(avg(conf), 6) AS conf, round(avg(hit), 6) AS accuracy, floor(round(conf * 10, 12))::BIGINT AS bin, count(*) AS n FROM pred GROUP BY type, bin")
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(predictions(spark, d).groupBy("type", F.floor(F.round(F.col("conf") * 10, 12)).cast("long").alias("bin")).agg(F.avg("conf").alias("conf"), F.avg("hit").alias("accuracy"), F.count("*").alias("n")))


TYPED = """ts AS (SELECT *, CASE type WHEN 'choice' THEN hit WHEN 'noul' THEN ((p[2] >= 0.8 AND gold = 1) OR (p[2] <= 0.2 AND gold = 0))::INT ELSE abs(list_sum([(i - 1) * p[i] FOR i IN range(1, k + 1)]) - gold) / (k - 1) END AS score,
  CASE type WHEN 'choice' THEN 1.0 / k WHEN 'noul' THEN 0.5 ELSE list_sum([abs(i - gold) FOR i IN range(k)]) / (k * (k - 1)) END AS chance FROM pred),
cell AS (SELECT type, tier, count(*) AS n, CASE WHEN type = 'score' THEN 100 * (1 - avg(score) / avg(chance)) ELSE 100 * (avg(score) - avg(chance)) / (1 - avg(chance)) END AS cc FROM ts GROUP BY type, tier)"""


@query(f"{WITH}, {TYPED} SELECT type, tier, n, round(cc, 5) AS cc FROM cell")
def chance_corrected_cells(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.chance_corrected(M.typed_scores(predictions(spark, d)), ["tier"]), 5)


@query(f"{WITH}, {TYPED} SELECT type, sum(n)::BIGINT AS n, round(sum(cc * w) / sum(w), 5) AS cc FROM (SELECT *, CASE tier WHEN 'easy' THEN 0.1::DOUBLE WHEN 'standard' THEN 0.2 WHEN 'judge' THEN 0.3 ELSE 0.4 END AS w FROM cell) GROUP BY type")
def typed_intelligence(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.intelligence(M.typed_scores(predictions(spark, d))), 5)


@query(f"""{WITH}, e AS (SELECT type, least(floor(round(conf * 10, 12)), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM pred GROUP BY 1, 2)
SELECT type, round(greatest(0, 100 * (1 - sum(n * abs(c - h)) / sum(n) / 0.5)), 5) AS points FROM e GROUP BY type""")
def typed_calibration(spark: SparkSession, d: str) -> DataFrame:
    e = M.ece(predictions(spark, d), ["type"], M.bin_left_closed(F.col("conf"), 10))
    return e.select("type", F.round(F.greatest(F.lit(0.0), 100 * (1 - F.col("ece") / 0.5)), 5).alias("points"))


@query(f"""{WITH} SELECT id, round(list_sum([(list_sum(p[1:i]) - (i - 1 >= gold)::INT) ** 2 FOR i IN range(1, k)]) / (k - 1), 6) AS rps, round(list_sum([abs(p[i] - target[i]) FOR i IN range(1, k + 1)]) / 2, 6) AS tvd FROM pred WHERE type = 'score'""")
def rps_tvd(spark: SparkSession, d: str) -> DataFrame:
    s = predictions(spark, d).where("type = 'score'")
    return _rounded(s.select("id", P.rps(F.col("p"), F.col("gold")).alias("rps"), P.tvd(F.col("p"), F.col("target")).alias("tvd")))


@query(f"{WITH} SELECT type, round(avg(-list_sum([CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END FOR x IN p]) / ln(k)), 6) AS entropy FROM pred GROUP BY type")
def entropy_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(predictions(spark, d).groupBy("type").agg(F.avg(P.normalised_entropy(F.col("p"))).alias("entropy")))


@query(f"""{WITH}, y AS (SELECT id, gold, p[2] AS y FROM pred WHERE type = 'noul'), g AS (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS margin),
s AS (SELECT margin, gold, CASE WHEN y <= 0.2 OR y >= 0.8 OR (margin > 0 AND abs(y - 0.5) <= margin) THEN y WHEN y >= 0.5 THEN 0.8 + 1e-6 ELSE 0.2 - 1e-6 END AS y FROM y, g)
SELECT round(margin, 2)::DOUBLE AS margin, round(avg((y >= 0.8 AND gold = 1 OR y <= 0.2 AND gold = 0)::INT), 6) AS accuracy, round(avg((y > 0.2 AND y < 0.8)::INT), 6) AS abstained FROM s GROUP BY margin""")
def policy_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Committing in-band answers under a grid of margins."""
    y = predictions(spark, d).where("type = 'noul'").select("gold", F.get("p", F.lit(1)).alias("y"))
    out = None
    for m in (0.0, 0.05, 0.1, 0.2):
        s = y.select("gold", P.snap_policy(F.col("y"), margin=m).alias("y"))
        ok = ((F.col("y") >= 0.8) & (F.col("gold") == 1)) | ((F.col("y") <= 0.2) & (F.col("gold") == 0))
        r = s.agg(F.avg(ok.cast("int")).alias("accuracy"), F.avg(((F.col("y") > 0.2) & (F.col("y") < 0.8)).cast("int")).alias("abstained")).withColumn("margin", F.lit(m))
        out = r if out is None else out.unionByName(r)
    return _rounded(out)


@query(f"""{WITH} SELECT CASE WHEN p[2] <= 0.2 THEN 'no' WHEN p[2] >= 0.8 THEN 'yes' ELSE 'open' END AS band, count(*) AS n, round(avg(gold), 6) AS yes_rate FROM pred WHERE type = 'noul' GROUP BY 1""")
def noul_band(spark: SparkSession, d: str) -> DataFrame:
    y = F.get("p", F.lit(1))
    return _rounded(predictions(spark, d).where("type = 'noul'").groupBy(F.when(y <= 0.2, "no").when(y >= 0.8, "yes").otherwise("open").alias("band")).agg(F.count("*").alias("n"), F.avg("gold").alias("yes_rate")))


@query(f"""{WITH}, r AS (SELECT type, avg(1 - hit) OVER (PARTITION BY type ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS risk, avg(1 - hit) OVER (PARTITION BY type ORDER BY hit DESC, id ROWS UNBOUNDED PRECEDING) AS ideal FROM pred)
SELECT type, round(avg(risk), 6) AS aurc, round(avg(risk) - avg(ideal), 6) AS e_aurc FROM r GROUP BY type""")
def aurc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.aurc(predictions(spark, d), ["type"]))


BINS = "bn AS (SELECT *, ntile(15) OVER (PARTITION BY type ORDER BY conf, id) AS bin FROM pred), bs AS (SELECT type, bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h, sum(hit) AS hits FROM bn GROUP BY 1, 2)"


@query(f"{WITH}, {BINS} SELECT type, round(sum(n * abs(c - h)) / sum(n), 6) AS ece FROM bs GROUP BY type")
def adaptive_ece(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ece(M.equal_mass(predictions(spark, d), ["type"], 15), ["type"], F.col("bin")))


@query(f"""{WITH}, {BINS}, t AS (SELECT type, sum(hits) / sum(n) AS rate, sum(n) AS total FROM bs GROUP BY type)
SELECT type, round(sum(n / total * (c - h) ** 2), 6) AS reliability, round(sum(n / total * (h - rate) ** 2), 6) AS resolution, round(any_value(rate * (1 - rate)), 6) AS uncertainty FROM bs JOIN t USING (type) GROUP BY type""")
def brier_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.brier_parts(M.equal_mass(predictions(spark, d), ["type"], 15), ["type"]))


@query(f"""{WITH}, pre AS (SELECT round(conf, 6) AS f, sum(hit - conf) AS r, count(*) AS n FROM pred GROUP BY 1), g AS (SELECT i / 1000.0::DOUBLE AS t FROM range(1001) x(i)),
k AS (SELECT t, r, n, exp(-0.5 * ((t - f) / 0.05) ** 2) + exp(-0.5 * ((t + f) / 0.05) ** 2) + exp(-0.5 * ((t - 2 + f) / 0.05) ** 2) AS k FROM pre, g)
SELECT round(sum(abs(a)) / sum(b), 6) AS smece FROM (SELECT t, sum(k * r) AS a, sum(k * n) AS b FROM k GROUP BY t)""")
def smooth_ece(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.smooth_ece(predictions(spark, d)))


def _poisson(ident: str, draw: str) -> str:
    u = f"('0x' || substr(md5({ident} || '|' || {draw}), 1, 8))::BIGINT / 4294967296.0"
    return f"(SELECT CASE {' '.join(f'WHEN u < {c}::DOUBLE THEN {k}' for k, c in enumerate(M.POISSON_CUTS))} ELSE 7 END FROM (SELECT {u} AS u))"


BOOT = f"bt AS (SELECT draw, sum(w * hit) / sum(w) AS mean FROM (SELECT hit, draw, {_poisson('id', 'draw')} AS w FROM pred, range(100) r(draw)) GROUP BY draw)"


@query(f"{WITH}, {BOOT} SELECT round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS se, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM bt")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.interval(M.bootstrap_mean(predictions(spark, d), "hit", draws=100)))


@query(f"""{WITH}, b AS (SELECT id, hit - (gold = 0)::INT AS delta FROM pred), bt AS (SELECT draw, sum(w * delta) / sum(w) AS mean FROM (SELECT delta, draw, {_poisson('id', 'draw')} AS w FROM b, range(100) r(draw)) GROUP BY draw)
SELECT round(avg(mean), 6) AS delta, round(stddev_samp(mean), 6) AS se, round(avg(CASE WHEN mean > 0 THEN 1 WHEN mean = 0 THEN 0.5 ELSE 0 END), 6) AS p_better FROM bt""")
def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    """Predictions against always choosing the first option, on shared resamples."""
    a = predictions(spark, d).select("id", "hit")
    b = predictions(spark, d).select("id", (F.col("gold") == 0).cast("int").alias("other"))
    m = M.bootstrap_mean(a.join(b, "id").withColumn("delta", F.col("hit") - F.col("other")), "delta", draws=100)
    return _rounded(m.agg(F.avg("mean").alias("delta"), F.stddev_samp("mean").alias("se"), F.avg(F.when(F.col("mean") > 0, 1.0).when(F.col("mean") == 0, 0.5).otherwise(0.0)).alias("p_better")))


GRID = """tg AS (SELECT 0.25::DOUBLE * pow(pow(16.0::DOUBLE, 1.0::DOUBLE / 24), i) AS t FROM range(25) r(i)),
tn AS (SELECT type, t, avg(list_max(logits) / t + ln(list_sum([exp((x - list_max(logits)) / t) FOR x IN logits])) - logits[gold + 1] / t) AS nll FROM pred, tg GROUP BY type, t)"""


@query(f"{WITH}, {GRID} SELECT type, round(t, 6) AS t, round(nll, 6) AS nll FROM tn")
def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.temperature_grid(predictions(spark, d), ["type"]))


@query(f"{WITH}, {GRID} SELECT type, round((min(struct_pack(nll := round(nll, 9), t := t))).t, 6) AS t, round(min(nll), 6) AS nll FROM tn GROUP BY type")
def per_type_temperature(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.best_temperature(M.temperature_grid(predictions(spark, d), ["type"]), ["type"]))


@query()
def fitted_temperature(spark: SparkSession, d: str) -> DataFrame:
    t = M.fit_temperature(predictions(spark, d))
    return spark.createDataFrame([(round(t, 4),)], "t double")


@query(f"""{WITH}, b AS (SELECT type, floor(conf * 200) AS bin, avg(conf) AS x, avg(hit) AS y, count(*)::DOUBLE AS w FROM pred GROUP BY 1, 2),
s AS (SELECT type, x, w, y * w AS v, row_number() OVER (PARTITION BY type ORDER BY x) AS i, sum(w) OVER (PARTITION BY type ORDER BY x) AS sw, sum(y * w) OVER (PARTITION BY type ORDER BY x) AS sv FROM b),
m AS (SELECT l.type, l.i AS lo, h.i AS hi, min((h.sv - l.sv + l.v) / (h.sw - l.sw + l.w)) OVER (PARTITION BY l.type, l.i ORDER BY h.i DESC) AS least FROM s l JOIN s h ON l.type = h.type AND l.i <= h.i)
SELECT s.type, round(any_value(s.x), 6) AS x, round(max(least), 6) AS fit FROM s JOIN m ON m.type = s.type AND m.hi = s.i GROUP BY s.type, s.i""")
def isotonic_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.isotonic(predictions(spark, d), ["type"]))


@query(f"""{WITH}, v AS (SELECT id, gold, [logits[1:k], [logits[(i % k) + 1] FOR i IN range(1, k + 1)]] AS views, k FROM pred),
s AS (SELECT id, gold, k, [[exp(x - list_max(z)) / list_sum([exp(y - list_max(z)) FOR y IN z]) FOR x IN z] FOR z IN views] AS p FROM v)
SELECT id, round((p[1][gold + 1] + p[2][gold + 1]) / 2, 6) AS p_gold FROM s""")
def order_averaged_probs(spark: SparkSession, d: str) -> DataFrame:
    """The mean over two displayed orders of each view's softmax."""
    v = predictions(spark, d).select("id", "gold", F.array(F.col("logits"), P.rotate(F.col("logits"), F.lit(1))).alias("v"))
    return _rounded(v.select("id", F.get(P.view_probs(F.col("v")), F.col("gold").cast("int")).alias("p_gold")))


@query(f"{WITH} SELECT type, (max(struct_pack(n := n, g := -gold))).g * -1 AS majority, round(max(n) / sum(n), 6) AS share FROM (SELECT type, gold::BIGINT AS gold, count(*) AS n FROM pred GROUP BY 1, 2) GROUP BY type")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    c = predictions(spark, d).groupBy("type", F.col("gold").cast("long").alias("gold")).agg(F.count("*").alias("n"))
    return _rounded(c.groupBy("type").agg((-F.max(F.struct("n", (-F.col("gold")).alias("g")))["g"]).alias("majority"), (F.max("n") / F.sum("n")).alias("share")))


@query(f"""{WITH}, x AS (SELECT type, k, unnest(range(k)) AS pos, gold FROM pred), c AS (SELECT type, pos, count(*) FILTER (gold = pos) / count(*) AS share, avg(1.0::DOUBLE / k) AS chance FROM x GROUP BY type, pos)
SELECT type, pos::BIGINT AS pos, round(share, 6) AS share, round(chance, 6) AS chance FROM c""")
def label_position_balance(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).select("type", "k", "gold", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("pos"))
    return _rounded(x.groupBy("type", F.col("pos").cast("long").alias("pos")).agg((F.count_if(F.col("gold") == F.col("pos")) / F.count("*")).alias("share"), F.avg(1.0 / F.col("k")).alias("chance")))


@query(f"""{WITH}, s AS (SELECT id, k, gold, [CASE WHEN x > 0 THEN pow(x, 1.0 / 0.5) ELSE 0 END FOR x IN p] AS q FROM pred) SELECT id, round(q[gold + 1] / list_sum(q), 6) AS p_gold FROM s""")
def sharpened(spark: SparkSession, d: str) -> DataFrame:
    s = predictions(spark, d).select("id", "gold", P.sharpen(F.col("p"), 0.5).alias("q"))
    return _rounded(s.select("id", F.get("q", F.col("gold").cast("int")).alias("p_gold")))


@query(f"""{WITH}, o AS (SELECT type, hit, conf, id % 5 AS fold FROM pred), a AS (SELECT type, fold, avg(hit) AS inside, count(*) AS n FROM o GROUP BY 1, 2)
SELECT x.type, x.fold, round(sum(y.inside * y.n) / sum(y.n), 6) AS rest, any_value(round(x.inside, 6)) AS inside FROM a x JOIN a y ON x.type = y.type AND x.fold <> y.fold GROUP BY 1, 2""")
def leave_one_fold_out(spark: SparkSession, d: str) -> DataFrame:
    """Of each fold the mean of the others, from sums: total less own."""
    a = predictions(spark, d).groupBy("type", (F.col("id") % 5).alias("fold")).agg(F.sum("hit").alias("s"), F.count("*").alias("n"))
    t = a.groupBy("type").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return _rounded(a.join(t, "type").select("type", "fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("rest"), (F.col("s") / F.col("n")).alias("inside")))


@query("""SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, round((quality * 0.9 + toxic * 0.1) * 0.7 + 0.3 * 0.5, 6) AS mixed, round(1.0 / nullif(0.5 / greatest(quality, 0.01) + 0.5 / greatest(1 - toxic, 0.01), 0), 6) AS harmonic, count(*) AS n FROM labels GROUP BY quality, toxic""")
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """A mixed target and a weighted harmonic mean of two axes."""
    q, t = F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")
    c = table(spark, d, "labels").groupBy(q, t).agg(F.count("*").alias("n"))
    mixed = (F.col("quality") * 0.9 + F.col("toxic") * 0.1) * 0.7 + 0.15
    harmonic = 1.0 / (0.5 / F.greatest(F.col("quality").cast("double"), F.lit(0.01)) + 0.5 / F.greatest((1 - F.col("toxic")).cast("double"), F.lit(0.01)))
    return _rounded(c.withColumn("mixed", mixed).withColumn("harmonic", harmonic))
