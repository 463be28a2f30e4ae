"""Rules, schedules and structured texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import rules as R
from ..functions import structured as S
from ..operators import calibration as C
from ..operators import fixes, packing, sampling
from ..sources.tables import PRED, predictions, table, train_items
from .sequences import LOG, metric_log

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "day")
    return table(spark, d, "lineitem").join(o, "l_orderkey").withColumn("days", F.datediff(F.to_date("l_shipdate"), "day"))


# ---- dates

@query("SELECT o_orderkey AS id, dayname(o_orderdate::DATE + (o_custkey % 30)::INT) AS label FROM orders")
def generate_weekday(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select(F.col("o_orderkey").alias("id"), R.weekday(F.col("day"), F.col("o_custkey") % 30).alias("label"))


UNIT = "(['day', 'week', 'month'])[o_orderkey % 3 + 1]"
ENDS = f"""e AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_custkey % 9 + 1 AS n, {UNIT} AS unit FROM orders),
l AS (SELECT *, (CASE unit WHEN 'month' THEN d + to_months(n::INT) WHEN 'week' THEN d + (7 * n)::INT ELSE d + n::INT END)::DATE AS last FROM e)"""


def _delays(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("day"), F.lit("week"), F.lit("month")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return orders(spark, d).select(F.col("o_orderkey").alias("id"), "day", (F.col("o_custkey") % 9 + 1).alias("n"), unit.alias("unit"))


@query(f"WITH {ENDS} SELECT id, strftime(last, '%Y-%m-%d') AS deadline, strftime(last - 1, '%Y-%m-%d') AS period_end FROM l")
def delay_deadlines(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    args = F.col("day"), F.col("n"), F.col("unit")
    return _delays(spark, d).select("id", day(R.deadline(*args)).alias("deadline"), day(R.period_end(*args)).alias("period_end"))


@query(f"WITH {ENDS}, a AS (SELECT l_orderkey AS id, max(l_shipdate)::DATE AS done FROM lineitem GROUP BY 1) SELECT id, CASE WHEN done <= last THEN 'yes' ELSE 'no' END AS label FROM l JOIN a USING (id)")
def delay_kept(spark: SparkSession, d: str) -> DataFrame:
    """Is an order shipped within its delay."""
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("done"))
    return _delays(spark, d).join(done, "id").select("id", F.when(F.col("done") <= R.deadline(F.col("day"), F.col("n"), F.col("unit")), "yes").otherwise("no").alias("label"))


SLOTS = "s AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 20)::INT AS b FROM orders)"


@query(f"""WITH {SLOTS}, w AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM s WHERE b > a)
SELECT o_custkey AS id, CASE WHEN bool_or(coalesce(a < busy, false)) THEN 'yes' ELSE 'no' END AS label, count(*) FILTER (a < busy) AS late FROM w GROUP BY 1""")
def generate_schedule_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Do a customer's half-open intervals overlap anywhere: each begins before the latest end of those before it, without a pair of rows."""
    s = orders(spark, d).select("o_custkey", "o_orderkey", F.col("day").alias("a"), F.date_add("day", (F.col("o_orderkey") % 20).cast("int")).alias("b")).where("b > a")
    busy = F.max("b").over(W.partitionBy("o_custkey").orderBy("a", "o_orderkey").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("late", F.coalesce(F.col("a") < busy, F.lit(False)))
    return s.groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.bool_or("late"), "yes").otherwise("no").alias("label"), F.count_if("late").alias("late"))


@query(f"""WITH {SLOTS}, c AS (SELECT o_custkey AS id, min(a) + 5 AS c, min(a) + 15 AS d FROM s GROUP BY 1)
SELECT id, CASE WHEN bool_or(a < d AND c < b) THEN 'yes' ELSE 'no' END AS label FROM s JOIN c ON o_custkey = id GROUP BY id""")
def slot_is_taken(spark: SparkSession, d: str) -> DataFrame:
    """Does a proposed interval overlap one of the customer's own."""
    s = orders(spark, d).select(F.col("o_custkey").alias("id"), F.col("day").alias("a"), F.date_add("day", (F.col("o_orderkey") % 20).cast("int")).alias("b"))
    slots = s.groupBy("id").agg(F.min("a").alias("start"), F.collect_list(F.struct("a", "b")).alias("busy"))
    taken = F.exists("busy", lambda x: R.overlap(x["a"], x["b"], F.date_add("start", 5), F.date_add("start", 15)))
    return slots.select("id", F.when(taken, "yes").otherwise("no").alias("label"))


# ---- policies

REFUND = """WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_shipdate::DATE - o_orderdate::DATE AS days, l_returnflag = 'R' AS final, o_custkey % 3 = 0 AS member, l_linestatus = 'O' AS opened, l_partkey % 2 = 0 AS sealed, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN final OR days > 60 + CASE WHEN member THEN 15 ELSE 0 END OR (opened AND sealed) THEN 'deny' WHEN amount > 40000 THEN 'escalate' ELSE 'approve' END AS label FROM x"""


@query(REFUND)
def generate_refund_policy(spark: SparkSession, d: str) -> DataFrame:
    label = R.refund(final_sale=F.col("l_returnflag") == "R", days=F.col("days"), window=F.lit(60), bonus=F.lit(15), member=F.col("o_custkey") % 3 == 0, opened=F.col("l_linestatus") == "O", sealed_only=F.col("l_partkey") % 2 == 0, amount=F.col("l_extendedprice"), limit=F.lit(40000))
    return lines(spark, d).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), label.alias("label"))


@query("""WITH x AS (SELECT c_custkey AS id, c_nationkey % 3 AS t, c_custkey % 3 AS c, c_custkey % 5 + 1 AS pax, c_nationkey % 13 AS bags FROM customer)
SELECT id, greatest(bags - ([[0, 1, 2], [1, 2, 3], [2, 3, 3]])[t + 1][c + 1] * pax, 0) * 50 AS fee, (['cancelled', 'delayed', 'kept'])[c + 1] AS event, ([100, 50, 0])[c + 1] * pax AS paid FROM x""")
def travel_policies(spark: SparkSession, d: str) -> DataFrame:
    """Bag fees by membership and cabin, and what a passenger is paid."""
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), pick(tuple(R.FREE_BAGS), F.col("c_nationkey") % 3).alias("tier"), pick(R.CABINS, F.col("c_custkey") % 3).alias("cabin"), (F.col("c_custkey") % 5 + 1).alias("pax"), (F.col("c_nationkey") % 13).alias("bags"), pick(("cancelled", "delayed", "kept"), F.col("c_custkey") % 3).alias("event"))
    return x.select("id", R.bag_fee(F.col("tier"), F.col("cabin"), F.col("pax"), F.col("bags")).cast("long").alias("fee"), "event", R.compensation(F.col("event"), F.col("pax")).cast("long").alias("paid"))


@query("""SELECT o_orderkey AS id, o_custkey % 60 <= 24 OR o_orderkey % 7 = 0 OR o_custkey % 3 = 2 OR (o_orderkey % 2 = 0 AND o_custkey % 5 < 2) AS label FROM orders""")
def cancel_policy(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("o_custkey") % 5 == 0, "health").when(F.col("o_custkey") % 5 == 1, "weather").otherwise("plans")
    cabin = F.element_at(F.array(*map(F.lit, R.CABINS)), (F.col("o_custkey") % 3 + 1).cast("int"))
    return orders(spark, d).select(F.col("o_orderkey").alias("id"), R.may_cancel(hours=F.col("o_custkey") % 60, by_airline=F.col("o_orderkey") % 7 == 0, cabin=cabin, insured=F.col("o_orderkey") % 2 == 0, reason=reason).alias("label"))


@query("""WITH t AS (SELECT l_orderkey AS id, sum(l_quantity::DECIMAL(10, 2) * l_extendedprice::DECIMAL(14, 2)) AS total FROM lineitem GROUP BY 1),
x AS (SELECT id, o_totalprice, round(total * (100 - id % 20)::DECIMAL(5, 0) / 100, 2) AS due FROM t JOIN orders ON o_orderkey = id),
y AS (SELECT id, due, CASE WHEN hash_of % 2 = 0 THEN due ELSE due + 0.01 END AS shown FROM (SELECT *, ('0x' || substr(md5(o_totalprice::DECIMAL(18, 2)::VARCHAR), 1, 6))::BIGINT AS hash_of FROM x))
SELECT id, round(due, 2)::DOUBLE AS due, CASE WHEN abs(due - shown) < 0.005 THEN 'yes' ELSE 'no' END AS label FROM y""")
def generate_invoice_total(spark: SparkSession, d: str) -> DataFrame:
    """What is due, and whether the total that is shown (by a hash a cent too high) is that.  Decimal arithmetic."""
    money = lambda c, p: F.col(c).cast(f"decimal({p},2)")
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(money("l_quantity", 10).alias("qty"), money("l_extendedprice", 14).alias("price"))).alias("lines"))
    x = x.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id").withColumn("due", R.invoice_due(F.col("lines"), F.col("id") % 20))
    wrong = F.conv(F.substring(F.md5(money("o_totalprice", 18).cast("string")), 1, 6), 16, 10).cast("long") % 2
    shown = F.col("due") + F.when(wrong == 0, F.lit(0)).otherwise(F.lit(0.01).cast("decimal(4,2)"))
    return x.select("id", F.col("due").cast("double").alias("due"), F.when(R.invoice_matches(F.col("lines"), F.col("id") % 20, shown), "yes").otherwise("no").alias("label"))


@query("""SELECT p_partkey AS id, CASE (['>=', '>', '<', '<='])[p_partkey % 4 + 1] WHEN '>=' THEN p_size >= 25 WHEN '>' THEN p_size > 25 WHEN '<' THEN p_size < 25 ELSE p_size <= 25 END AS label FROM part""")
def threshold_rules(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, (">=", ">", "<", "<="))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.compare(F.col("p_size"), op, F.lit(25)).alias("label"))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('der', 'die', 'und', 'nicht', 'ist', 'ich', 'ein', 'eine', 'mit', 'für', 'auf', 'sie', 'wie', 'was'))) AS g FROM documents)
SELECT doc_id, n >= 3 AND g >= greatest(2, n // 12) AS german FROM w""")
def german_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.looks_german(F.col("text")).alias("german"))


# ---- schedules and shares

@query(f"""WITH {LOG}, m AS (SELECT max(step) AS total FROM log), e AS (SELECT DISTINCT step, total, total - round_even(0.2 * total, 0) AS tail FROM log, m),
f AS (SELECT step, step = total OR CASE WHEN step > tail THEN step % 5 = 0 ELSE step % 20 = 0 END AS checkpoint, CASE WHEN step > tail THEN step % 2 = 0 ELSE step % 10 = 0 END AS quick, step % 40 = 0 AND step >= 40 AS kept, total FROM e)
SELECT step::BIGINT AS step, checkpoint OR kept AS checkpoint, quick AND NOT checkpoint AS quick_eval, kept, round(greatest(0, 0.3 * (1 - step / (0.5 * total))), 6) AS aux FROM f""")
def run_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Which steps of a run checkpoint, are evaluated quickly, and stay; and an auxiliary share that fades out."""
    steps = metric_log(spark, d).select("step").distinct()
    total = metric_log(spark, d).agg(F.max("step")).first()[0]
    s, tail = F.col("step"), total - round(0.2 * total)
    checkpoint = (s == total) | R.every(s, 20, 5, tail)
    kept = (s % 40 == 0) & (s >= 40)
    return steps.select(s.cast("long").alias("step"), (checkpoint | kept).alias("checkpoint"), (R.every(s, 10, 2, tail) & ~checkpoint).alias("quick_eval"), kept.alias("kept"), F.round(R.share_at(s, total, 0.3, 0.5), 6).alias("aux"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) SELECT source, CASE WHEN source LIKE '%1' THEN 1.0 WHEN n > 0.1 * t THEN 4.0 ELSE 1.5 END::DOUBLE AS cap FROM c, t""")
def tier_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps on epochs by tier, with overrides."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    names = [r.source for r in n.select("source").collect()]  # one row for each source
    n = n.withColumn("block", F.when(F.col("n") > 0.1 * F.sum("n").over(W.partitionBy()), "main").otherwise("rest"))
    return n.select("source", R.tier_cap(F.col("source"), F.col("block"), first_blocks=("main",), cap=4.0, other=1.5, overrides={s: 1.0 for s in names if s.endswith("1")}).alias("cap"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS t FROM c), e AS (SELECT source, n, 2.0 * t / k / n AS epochs FROM c, t),
k AS (SELECT *, CASE WHEN epochs < 0.9 * 1.5 AND n > 1 THEN greatest(1, round_even(n * epochs / 1.5, 0)) ELSE n END::BIGINT AS keep FROM e),
o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || chr(31) || '5'), doc_id) AS r FROM documents)
SELECT source, n, any_value(keep) AS keep, count(*) FILTER (r <= keep) AS kept, round(any_value(epochs), 6) AS epochs FROM o JOIN k USING (source) GROUP BY source, n""")
def min_epoch_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Sources that a mixture draws less than `least` epochs of are cut to the rows that it draws."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    epochs = n.withColumn("epochs", 2.0 * F.sum("n").over(W.partitionBy()) / F.count("*").over(W.partitionBy()) / F.col("n"))
    quota = sampling.epoch_quota(epochs, least=1.5)
    kept = sampling.take_quota(docs, quota.select("source", F.col("keep").alias("take")), ["source"], ident="doc_id", seed=5).groupBy("source").agg(F.count("*").alias("kept"))
    return quota.join(kept, "source").select("source", "n", "keep", "kept", F.round("epochs", 6).alias("epochs"))


@query("""WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no FROM documents JOIN labels USING (doc_id) GROUP BY source),
k AS (SELECT *, yes / (yes + no) AS p, round_even(least(yes, no) * 0.6 / (1 - 0.6), 0)::BIGINT AS keep FROM c),
x AS (SELECT *, CASE WHEN p > 0.6 OR p < 1 - 0.6 THEN greatest(least(greatest(yes, no) - keep, floor((yes + no) * 0.6)), 0) ELSE 0 END::BIGINT AS gone FROM k),
q AS (SELECT source, 1 AS quality, yes - CASE WHEN p > 0.6 THEN gone ELSE 0 END AS take FROM x UNION ALL SELECT source, 0, no - CASE WHEN p < 1 - 0.6 THEN gone ELSE 0 END FROM x),
o AS (SELECT doc_id, source, quality, text, row_number() OVER (PARTITION BY source, quality ORDER BY md5(doc_id || chr(31) || '2'), doc_id) AS r FROM documents JOIN labels USING (doc_id))
SELECT doc_id, md5(text) AS line FROM o JOIN q USING (source, quality) WHERE r <= take""")
def rebalanced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a binary file after rebalancing; the kept lines are the same bytes."""
    j = table(spark, d, "documents").select("doc_id", "source", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    q = sampling.rebalance_quota(j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("yes"), F.count_if(F.col("quality") == 0).alias("no")), hi=0.6)
    quota = q.select("source", F.explode(F.array(F.struct(F.lit(1).alias("quality"), F.col("keep_yes").alias("take")), F.struct(F.lit(0).alias("quality"), F.col("keep_no").alias("take")))).alias("x")).select("source", "x.quality", "x.take")
    return sampling.take_quota(j, quota, ["source", "quality"], ident="doc_id", seed=2).select("doc_id", F.md5("text").alias("line"))


# ---- packing, whole against resumed

@query()
def pack_resume_check(spark: SparkSession, d: str) -> DataFrame:
    """Placements with a break after half of a shard, its state carried over, against placements without one."""
    n = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("idx"), F.greatest(F.length("text") / 4, F.lit(1)).cast("long").alias("n"))
    how = {"buckets": (256, 1024, 4096), "budget": 8192, "slots": 32, "bins": 3, "best_fit": True}
    half = n.groupBy("shard").agg(F.percentile_approx("idx", 0.5).alias("cut"))
    split = n.join(half, "shard")
    first = packing.pack_part(split.where("idx <= cut").drop("cut"), **how)
    rest = packing.pack_part(split.where("idx > cut").drop("cut"), state=first.select("shard", "state").where("state is not null"), **how)
    whole = packing.pack(n, **how)
    both = whole.join(first.drop("state").unionByName(rest.drop("state")).where("idx is not null").toDF(*[c if c in ("shard", "idx") else f"{c}_too" for c in whole.columns]), ["shard", "idx"], "left")
    same = F.lit(True)
    for c in whole.columns[2:]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_too"))
    return both.agg(F.count("*").alias("segments"), F.countDistinct("shard").alias("shards"), F.count_if(~same).alias("differing"))


# ---- structured texts

@query("""SELECT s_suppkey AS id, s_name || ': rank ' || (s_suppkey % 5) || '; Nation: ' || s_nationkey || '; Region: ' || (s_nationkey % 5) AS text FROM supplier""")
def criterion_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = F.create_map(F.lit("region"), (F.col("s_nationkey") % 5).cast("string"), F.lit("main"), F.concat(F.lit("rank "), F.col("s_suppkey") % 5), F.lit("nation"), F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.criterion_text(F.col("s_name"), parts).alias("text"))


@query("""WITH x AS (SELECT p_partkey AS id, p_name AS name, p_type AS t, p_brand AS b FROM part)
SELECT id, name || '(brand: string, size?: int – in inches): ' || CASE WHEN length(t || ' ' || b) > 20 THEN rtrim(substr(t || ' ' || b, 1, 19)) || '…' ELSE t || ' ' || b END AS text FROM x""")
def tool_texts(spark: SparkSession, d: str) -> DataFrame:
    param = lambda n, t, r, x: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required"), F.lit(x).alias("description"))
    params = F.array(param("size", "int", False, "in inches"), param("brand", "string", True, ""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.tool_text(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"), params, description_chars=20).alias("text"))


@query("""SELECT n_nationkey, '{"name":"' || CASE WHEN n_name = 'FRANCE' THEN 'Frankreich' ELSE n_name END || '","key":' || n_nationkey || ',"inner":{"name":"' || CASE WHEN n_name = 'FRANCE' THEN 'Frankreich' ELSE n_name END || '"}}' AS json FROM nation""")
def substituted_json(spark: SparkSession, d: str) -> DataFrame:
    """String values of JSON texts exchanged by a table, the rest byte for byte."""
    j = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name")).alias("inner")))
    swap = S.substituted_udf({"FRANCE": "Frankreich", "name": "never"})
    return table(spark, d, "nation").select("n_nationkey", swap(j).alias("json"))


@query()
def edited_words(spark: SparkSession, d: str) -> DataFrame:
    """Edits that turn whole texts into those with some words exchanged and the last line gone."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", S.edit_words_udf("text", F.regexp_replace(F.regexp_replace("text", r"(?<![\p{L}\p{N}_])(the|le|de)(?![\p{L}\p{N}_])", "one more"), r"\n[^\n]*\z", "")).alias("edits"))


@query("SELECT 'documents' AS name, array_to_string(list_sort(list(DISTINCT source)), ',') AS labels FROM documents")
def label_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels in order."""
    return table(spark, d, "documents").select("source").distinct().agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("labels")).select(F.lit("documents").alias("name"), "labels")


@query()
def fixed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts with planted damage mended: control characters, references, literals, the language tag."""
    x = train_items(spark, d).withColumn("state", F.concat(F.lit("\u0001"), "state", F.when(F.col("id") % 2 == 0, " &amp;amp; {'a': None, 'b': 'c'}").otherwise("")))
    return fixes.fixed_items(x, retag=True).select(F.col("id").alias("doc_id"), F.md5("state").alias("md5"), "lang", F.array_join("fixes", ",").alias("fixes"))


@query()
def fix_report(spark: SparkSession, d: str) -> DataFrame:
    return fixes.fix_counts(fixes.fixed_items(train_items(spark, d), retag=True))


# ---- reports

@query(f"""WITH {PRED}, a AS (SELECT type, lang, avg(hit) AS accuracy, count(*) AS n FROM pred GROUP BY 1, 2)
SELECT x.type, x.lang, x.n, round(x.accuracy, 6) AS accuracy, round(x.accuracy - c.accuracy, 6) AS delta FROM a x JOIN a c ON c.type = x.type AND c.lang = 'en'""")
def against_control(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's accuracy, and the difference to the control (English)."""
    a = predictions(spark, d).groupBy("type", "lang").agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n"))
    control = a.where("lang = 'en'").select("type", F.col("accuracy").alias("base"))
    return a.join(control, "type").select("type", "lang", "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.col("accuracy") - F.col("base"), 6).alias("delta"))


@query("""WITH t AS (SELECT user_id % 10 AS phase, event_type AS op, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, total / sum(total) OVER (PARTITION BY phase) AS share, row_number() OVER (PARTITION BY phase ORDER BY total DESC, op) AS r FROM t)
SELECT phase, op, n, round(total, 4) AS total, round(share, 6) AS share FROM r WHERE r <= 3""")
def time_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """A trace's time by phase: the three largest operations and their shares."""
    t = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("phase"), F.col("event_type").alias("op")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    w = W.partitionBy("phase")  # a row for each operation
    r = t.withColumn("share", F.col("total") / F.sum("total").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("total"), "op"))).where("r <= 3")
    return r.select("phase", "op", "n", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS op FROM documents)
SELECT op, count(*) AS n, count(DISTINCT doc_id) AS texts FROM m WHERE regexp_full_match(op, '[A-Za-z]{3,8}(ing|ed|tion)') GROUP BY op HAVING count(*) >= 5""")
def text_counters(spark: SparkSession, d: str) -> DataFrame:
    """How often each name of a form stands in text dumps, as a whole word, and in how many."""
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("op")).where(F.col("op").rlike(r"\A[A-Za-z]{3,8}(ing|ed|tion)\z"))
    return m.groupBy("doc_id", "op").agg(F.count("*").alias("n")).groupBy("op").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n >= 5")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::VARCHAR AS at FROM events GROUP BY user_id")
def later_part_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of parts that hold the same key the row of the latest."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("event_type"), F.regexp_replace(F.max("ts").cast("string"), r"(\.\d*?)0+$", "$1").alias("at"))


@query("""WITH m AS (SELECT conv_id, turn, greatest(length(text), 1) AS w, (conv_id * 7 + turn) % 101 / 100.0 AS q FROM conversations)
SELECT conv_id, round(sum(w * q) / sum(w), 6) AS mean, round(min(q), 6)::DOUBLE AS worst, arg_min(turn, (q, turn))::BIGINT AS worst_turn FROM m GROUP BY conv_id""")
def segment_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of a text's segments: the mean by length, and the worst one."""
    q = ((F.col("conv_id") * 7 + F.col("turn")) % 101 / 100.0).alias("q")
    m = table(spark, d, "conversations").select("conv_id", "turn", F.greatest(F.length("text"), F.lit(1)).alias("w"), q)
    return m.groupBy("conv_id").agg(F.round(F.sum(F.col("w") * F.col("q")) / F.sum("w"), 6).alias("mean"), F.round(F.min("q"), 6).alias("worst"), F.min_by("turn", F.struct("q", "turn")).cast("long").alias("worst_turn"))


@query(f"""WITH {PRED}, g AS (SELECT id, type, [i - 1 FOR i IN range(1, k + 1) IF p[i] >= list_max(p) - 0.02] AS best FROM pred)
SELECT type, count(*) FILTER (len(best) = 1) AS n, count(*) FILTER (len(best) > 1) AS tied, sum(CASE WHEN len(best) = 1 THEN best[1] END)::BIGINT AS gold_sum FROM g GROUP BY type""")
def untied_golds(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose target has one largest option; ties (here within 0.02) are counted and left out."""
    at = F.filter(F.transform("p", lambda x, i: F.when(x >= F.array_max("p") - 0.02, i)), lambda i: i.isNotNull())
    g = predictions(spark, d).select("type", at.alias("best"))
    one = F.size("best") == 1
    return g.groupBy("type").agg(F.count_if(one).alias("n"), F.count_if(~one).alias("tied"), F.sum(F.when(one, F.get("best", F.lit(0)))).cast("long").alias("gold_sum"))


@query()
def feature_temperatures(spark: SparkSession, d: str) -> DataFrame:
    """log T from a row's features, and the NLL with it against one temperature for all."""
    p = predictions(spark, d).withColumn("x", F.array(F.log("k"), (F.col("lang") == "fr").cast("double"), F.col("conf")))
    fit = C.fit_features(p, "x", ridge=1.0)
    return spark.createDataFrame([(round(fit["start"], 4), round(fit["nll"], 4), [round(w, 4) for w in fit["w"]])], "start double, nll double, w array<double>")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT source, CASE WHEN n > 30 THEN 'A' ELSE 'B' END AS block, n, sqrt(n) / sum(sqrt(n)) OVER () AS weight FROM c)
SELECT source, round(CASE WHEN weight * 4000 > 3 * n THEN 3 * n / 4000 ELSE weight END, 9) AS first_cut FROM s""")
def first_epoch_cut(spark: SparkSession, d: str) -> DataFrame:
    """The first round of an epoch cap: no source above three times its rows in 4,000 draws."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("weight", F.sqrt("n") / F.sum(F.sqrt("n")).over(W.partitionBy()))
    return n.select("source", F.round(F.least(F.col("weight"), 3 * F.col("n") / 4000), 9).alias("first_cut"))


@query("""SELECT part, count(*) AS n, count(DISTINCT doc_id) AS ids FROM (SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id || '|select'), 1, 8))::BIGINT % 10 = 0 THEN 'selection' WHEN ('0x' || substr(sha256(doc_id || '|report'), 1, 8))::BIGINT % 10 = 0 THEN 'reporting' ELSE 'train' END AS part FROM documents) GROUP BY part""")
def disjoint_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Selection and reporting sets from two seeds; a row is in one of them at most."""
    tenth = lambda seed: K.sha_int(F.concat(F.col("doc_id").cast("string"), F.lit(f"|{seed}"))) % 10 == 0
    part = F.when(tenth("select"), "selection").when(tenth("report"), "reporting").otherwise("train")
    return table(spark, d, "documents").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
