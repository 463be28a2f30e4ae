"""Calibrators, jobs, dictionaries, translation checks and whole reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import translation as X
from ..operators import calibration as C
from ..operators import campaign
from ..operators import metrics as M
from ..sources import store
from ..sources.tables import PRED, held_items, predictions, table, train_items
from . import build
from ..functions.text import ARTEFACTS
from .dedup import CLEAN, JACCARD, REF, _bands, _sig
from .keys_text import DOC_KEY, WORDS
from .scoring import GRID
from .sequences import LOG, metric_log

Q: dict[str, tuple] = {}
WITH = f"WITH {PRED}"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""{WITH}, b AS (SELECT type, least(floor(round(conf * 10, 12)), 9)::BIGINT AS bin, count(*) AS n, sum(hit) AS hits FROM pred GROUP BY 1, 2), r AS (SELECT type, sum(hits) / sum(n) AS rate FROM b GROUP BY 1)
SELECT type, bin, n, round((hits + rate) / (n + 1), 6) AS value FROM b JOIN r USING (type)""")
def histogram_binning(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.histogram_bins(predictions(spark, d), ["type"]).withColumn("bin", F.col("bin").cast("long")))


@query()
def platt_scaling(spark: SparkSession, d: str) -> DataFrame:
    y = predictions(spark, d).where("type = 'noul'").select((F.get("logits", F.lit(1)) - F.get("logits", F.lit(0))).alias("s"), F.col("gold").alias("y"))
    a, b = C.platt(y, "s", "y")
    return spark.createDataFrame([(round(a, 4), round(b, 4))], "a double, b double")


CELLS = GRID.replace("FROM pred, tg GROUP BY type, t)", "FROM pred, tg GROUP BY type, t), cn AS (SELECT type, lang, t, count(*) AS n, avg(list_max(logits) / t + ln(list_sum([exp((x - list_max(logits)) / t) FOR x IN logits])) - logits[gold + 1] / t) AS nll FROM pred, tg GROUP BY 1, 2, 3)")


@query(f"""{WITH}, {CELLS}, ty AS (SELECT type, (min(struct_pack(nll := round(nll, 9), t := t))).t AS t0 FROM tn GROUP BY type),
c AS (SELECT type, lang, n, t0, t, n * nll + 30 * (ln(t) - ln(t0)) ** 2 AS cost FROM cn JOIN ty USING (type))
SELECT type, lang, max(n) AS n, round(CASE WHEN max(n) >= 50 THEN (min(struct_pack(cost := round(cost, 9), t := t))).t ELSE any_value(t0) END, 6) AS t FROM c GROUP BY type, lang""")
def shrunk_cell_temperatures(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    types = M.best_temperature(M.temperature_grid(p, ["type"]), ["type"])
    return _rounded(C.shrunk_cells(C.cell_grid(p), types, tau=30.0))


@query(f"""{WITH}, {GRID}, f AS (SELECT id % 5 AS fold, t, count(*) AS n, sum(list_max(logits) / t + ln(list_sum([exp((x - list_max(logits)) / t) FOR x IN logits])) - logits[gold + 1] / t) AS s FROM pred, tg GROUP BY 1, 2),
r AS (SELECT fold, t, s / n AS nll, (sum(s) OVER (PARTITION BY t) - s) / (sum(n) OVER (PARTITION BY t) - n) AS rest FROM f)
SELECT fold, round((min(struct_pack(r := round(rest, 9), t := t, nll := nll))).t, 6) AS t, round((min(struct_pack(r := round(rest, 9), t := t, nll := nll))).nll, 6) AS nll FROM r GROUP BY fold""")
def cross_validated_temperature(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.cross_validated(predictions(spark, d), F.col("id") % 5, 5))


@query(f"{WITH} SELECT id, round(0.7 * target[gold + 1] + 0.3 * p[gold + 1], 6) AS mixed, round(0.9 * target[gold + 1] + 0.1 / k, 6) AS smoothed FROM pred")
def teacher_and_smoothing(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("gold").cast("int")
    return _rounded(predictions(spark, d).select("id", F.get(C.mixed_target(F.col("target"), F.col("p"), 0.3), g).alias("mixed"), F.get(C.smoothed_target(F.col("target"), 0.1), g).alias("smoothed")))


@query("SELECT source, lang, dense_rank() OVER (ORDER BY source) - 1 AS source_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang_id FROM (SELECT DISTINCT source, lang FROM documents)")
def vocab_encode(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary ids by sorted name, over the distinct names only."""
    x = table(spark, d, "documents").select("source", "lang").distinct()
    rank = lambda c: (F.dense_rank().over(W.orderBy(c)) - 1).cast("long")
    return x.select("source", "lang", rank("source").alias("source_id"), rank("lang").alias("lang_id"))


@query("SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND md5(d.text) = (SELECT md5(text) FROM documents x WHERE x.doc_id = l.doc_id)")
def teacher_annotate(spark: SparkSession, d: str) -> DataFrame:
    """Annotations joined by position, taken over only where the text is still the same."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("now"))
    notes = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")).join(table(spark, d, "documents").select("doc_id", F.md5("text").alias("seen")), "doc_id")
    return docs.join(notes, "doc_id").where("now = seen").select("doc_id", "quality")


@query(f"WITH {LOG}, r AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM log) SELECT run, step FROM r WHERE r <= 2 OR step % 25 = 0")
def checkpoint_retention(spark: SparkSession, d: str) -> DataFrame:
    return campaign.retained(metric_log(spark, d).select("run", "step"), 2, F.col("step") % 25 == 0)


@query("""WITH j AS (SELECT s_suppkey AS job, CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'new' END AS status FROM supplier), n AS (SELECT s_suppkey AS job, s_suppkey - 1 AS after FROM supplier WHERE s_suppkey > 1 AND s_suppkey % 2 = 0)
SELECT job, status FROM j WHERE status = 'new' AND job NOT IN (SELECT n.job FROM n LEFT JOIN j ON j.job = n.after WHERE j.status IS NULL OR j.status <> 'done')""")
def ready_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("job"))
    jobs = s.withColumn("status", F.when(F.col("job") % 3 == 0, "done").otherwise("new"))
    return campaign.ready(jobs, s.where("job > 1 and job % 2 = 0").withColumn("after", F.col("job") - 1))


@query("""WITH RECURSIVE n AS (SELECT s_suppkey AS job, s_suppkey // 2 AS after FROM supplier WHERE s_suppkey > 1), c AS (SELECT * FROM n UNION SELECT c.job, n.after FROM c JOIN n ON n.job = c.after) SELECT job, after FROM c""")
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("job"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("after"))
    return campaign.closure(n)


@query("""SELECT s_nationkey::BIGINT AS s_nationkey, round(avg(s_acctbal), 6) AS effect, round(sqrt(sum((s_acctbal / 10) ** 2)) / count(*), 6) AS se, avg(s_acctbal) < -greatest(0.007, 2 * sqrt(sum((s_acctbal / 10) ** 2)) / count(*)) AS adopted FROM supplier GROUP BY s_nationkey""")
def combined_effects(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("s_nationkey"), F.col("s_acctbal").alias("effect"), (F.col("s_acctbal") / 10).alias("se"))
    return _rounded(campaign.combined(e, "s_nationkey").withColumn("adopted", campaign.adopted(F.col("effect"), F.col("se"))))


@query("""WITH a AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 20 AS y FROM part)
SELECT p_partkey, round(1.0 / (0.6 / x + 0.4 / y) * CASE WHEN x < 25 THEN (x / 25) ** 2 ELSE 1 END * CASE WHEN y < 50 THEN (y / 50) ** 2 ELSE 1 END, 6) AS score FROM a""")
def gated_harmonic(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", campaign.gated_harmonic([F.col("p_size").cast("double"), F.col("p_retailprice") / 20], [0.6, 0.4], [25.0, 50.0]).alias("score"))
    return _rounded(p)


@query("""WITH h AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), n AS (SELECT user_id, count(*) AS k FROM h GROUP BY 1)
SELECT event_type, round(sum(1.0 / k), 6) AS spread FROM h JOIN n USING (user_id) GROUP BY event_type""")
def spread_votes(spark: SparkSession, d: str) -> DataFrame:
    """A rater's one vote, spread over the labels given."""
    h = table(spark, d, "events").select("user_id", "event_type").distinct()
    k = h.groupBy("user_id").agg(F.count("*").alias("k"))
    return _rounded(h.join(k, "user_id").groupBy("event_type").agg(F.sum(1.0 / F.col("k")).alias("spread")))


@query(f"""WITH {LOG}, m AS (SELECT run, step, loss FROM log WHERE step <= 30) SELECT run, count(*) AS n, round(max(loss), 6) AS last FROM m GROUP BY run""")
def resumed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log whose rows after the resume step are void, the last write of each counting."""
    log = metric_log(spark, d).select("run", "step", F.lit("loss").alias("name"), F.col("loss").alias("value"), F.lit(1).alias("seq"))
    again = log.withColumn("value", F.col("value") - 1).withColumn("seq", F.lit(0))
    return _rounded(store.latest_metrics(log.unionByName(again), F.lit(30)).groupBy("run").agg(F.count("*").alias("n"), F.max("value").alias("last")))


@query("SELECT doc_id, length(text) > 0 AS ok FROM documents WHERE doc_id % 2 = 0 OR doc_id % 2 = 1")
def translation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each text passes the gate against itself."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (X.verdict(t, t) == "ok").alias("ok"))


@query(r"SELECT item_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: s <> ''))::BIGINT AS n FROM benchmark")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, source, {DOC_KEY} AS key, len({WORDS}) AS n FROM documents), f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key)
SELECT source, count(*) AS n_rows, count(*) FILTER (doc_id > first) AS duplicates, count(*) FILTER (n < 10) AS short, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.99), 6) AS p99 FROM k JOIN f USING (key) GROUP BY source""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    r = build.quality_report(train_items(spark, d), held_items(spark, d))
    return _rounded(r.select("source", "n_rows", "duplicates", "short", "p50", "p99"))


@query(f"""WITH {REF}, hit AS (SELECT DISTINCT id FROM tg JOIN ref USING (gram)),
k AS (SELECT doc_id, source, {DOC_KEY} AS key, len({WORDS}) AS n, contains(text, '�') OR regexp_matches(text, '{ARTEFACTS['mojibake']}') AS damaged, {' OR '.join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in ARTEFACTS.values())} AS flagged FROM documents),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
r AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id > first) AS duplicates, count(*) FILTER (doc_id IN (SELECT id FROM hit)) AS hits, count(*) FILTER (n < 10) AS short, count(*) FILTER (damaged) AS damaged, count(*) FILTER (flagged) AS flagged FROM k JOIN f USING (key) GROUP BY source),
a AS (SELECT source, 5.0 AS w, hits / n AS share, 0.0 AS least, 'drop rows that hold benchmark text' AS advice FROM r UNION ALL SELECT source, 3, duplicates / n, 0.05, 'remove duplicates' FROM r UNION ALL SELECT source, 3, damaged / n, 0, 'repair or drop damaged texts' FROM r
  UNION ALL SELECT source, 2, flagged / n, 0.02, 'clean artefacts' FROM r UNION ALL SELECT source, 1, short / n, 0.1, 'check short texts' FROM r)
SELECT source, round(w * (1 + share), 6)::DOUBLE AS severity, advice FROM a WHERE share > least""")
def report_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return build.recommendations(build.quality_report(train_items(spark, d), held_items(spark, d)))


@query(rf"""WITH u AS (SELECT *, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents), refs AS (SELECT 'd' || doc_id AS rid, doc_id AS ref, text FROM u WHERE h % 1000 < 100 UNION ALL SELECT 'b' || item_id, item_id, text FROM benchmark),
bg AS (SELECT DISTINCT rid, unnest([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)]) AS gram FROM (SELECT rid, {WORDS} AS w FROM refs)),
ref AS (SELECT DISTINCT gram FROM bg WHERE gram NOT IN (SELECT gram FROM bg GROUP BY gram HAVING count(*) >= greatest(5, ceil(0.01 * (SELECT count(*) FROM refs))))),
x AS (SELECT doc_id, source, text, {DOC_KEY} AS key, {WORDS} AS w FROM u WHERE h % 1000 >= 100), hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)]) AS gram FROM x) JOIN ref USING (gram)),
r AS (SELECT doc_id, source, key, CASE WHEN key IN (SELECT {DOC_KEY} FROM refs) THEN 'equals_heldout' WHEN doc_id IN (SELECT doc_id FROM hit) THEN 'shares_8gram'
  WHEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g')) < 40 THEN 'too_short' WHEN contains(text, '�') OR regexp_matches(text, '{ARTEFACTS['mojibake']}') THEN 'damaged' END AS reason FROM x),
f AS (SELECT key, min(doc_id) AS first FROM r WHERE reason IS NULL GROUP BY key), c AS (SELECT source, CASE WHEN reason IS NULL AND doc_id > first THEN 'duplicate' ELSE reason END AS reason FROM r LEFT JOIN f USING (key))
SELECT 'train' AS part, source, least(count(*), 1000) AS n FROM c WHERE reason IS NULL GROUP BY source UNION ALL SELECT 'dropped:' || reason, source, count(*) FROM c WHERE reason IS NOT NULL GROUP BY reason, source
UNION ALL SELECT (['validation', 'calibration', 'test'])[h % 3 + 1], source, count(*) FROM u WHERE h % 1000 < 100 GROUP BY 1, 2""")
def built_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix built from documents against benchmark: rows by part, and the drops by reason."""
    m = build.build_mix(train_items(spark, d), held_items(spark, d), cap=1000)
    train = m["train"].groupBy("source").agg(F.count("*").alias("n")).select(F.lit("train").alias("part"), "source", "n")
    held = m["held"].groupBy("part", "source").agg(F.count("*").alias("n"))
    drops = m["drops"].select(F.concat(F.lit("dropped:"), "reason").alias("part"), "source", "n")
    return train.unionByName(held).unionByName(drops)


@query(f"""{CLEAN.replace('FROM documents),\nf AS', 'FROM documents WHERE doc_id % 2 = 1),\nf AS')}, s AS MATERIALIZED (SELECT * FROM {_sig('documents', 'doc_id')}), kb AS MATERIALIZED (SELECT * FROM {_bands('s')}),
nc AS (SELECT DISTINCT x.id AS id, y.id AS ref FROM kb x JOIN kb y USING (band, key) WHERE x.id % 2 = 1 AND y.id % 2 = 0),
near AS (SELECT DISTINCT nc.id FROM nc JOIN s a ON a.id = nc.id JOIN s b ON b.id = nc.ref WHERE {JACCARD.format(a='a.sig', b='b.sig')} >= 0.8),
fresh AS (SELECT c.doc_id, c.source FROM c JOIN r USING (doc_id, source) WHERE c.reason IS NULL AND r.key NOT IN (SELECT {DOC_KEY} FROM documents WHERE doc_id % 2 = 0) AND c.doc_id NOT IN (SELECT id FROM near))
SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source FROM fresh) GROUP BY source""")
def extended_mix(spark: SparkSession, d: str) -> DataFrame:
    """The even documents extended by the odd ones: exact and near duplicates of the base stay out."""
    items = train_items(spark, d)
    out = build.extend_mix(items.where("id % 2 = 0"), items.where("id % 2 = 1"), held_items(spark, d))
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query()
def simulated_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Draws of a weighted mixture packed best-fit: by source the draws, epochs and dropped segments."""
    from ..functions import text as T
    from ..operators import mixture, packing
    from .mixing import _sources

    w = {r.source: r.weight for r in mixture.block_weights(_sources(spark, d)).select("source", "weight").collect()}  # a row for each source
    lengths = table(spark, d, "documents").select("source", F.size(T.words("text")).alias("n"), "doc_id").where("n > 0")
    seg = packing.drawn_segments(lengths, w, 2000, seed=1)
    placed = packing.pack(seg, buckets=(256, 1024, 4096), budget=8192, slots=32, bins=4, best_fit=True).select("shard", "idx", "bucket")
    rows = lengths.groupBy("source").agg(F.count("*").alias("rows"))
    g = seg.join(placed, ["shard", "idx"]).groupBy("source").agg(F.count("*").alias("draws"), F.count_if(F.col("bucket").isNull()).alias("dropped"))
    return g.join(rows, "source").select("source", "draws", "dropped", F.round(F.col("draws") / F.col("rows"), 6).alias("epochs"))
