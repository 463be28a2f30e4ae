"""Keys, duplicates, splits and text quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..operators import near
from ..sources.tables import table

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
DOC_KEY = NORM.format("text")
SHA = "('0x' || substr(sha256({}), 1, 8))::BIGINT"
WORDS = f"list_filter(string_split({DOC_KEY}, ' '), lambda w: w <> '')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"SELECT doc_id, {DOC_KEY} AS key FROM documents")
def norm_key(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.norm_key("text").alias("key"))


@query(f"SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, coalesce(list_max([length(x) FOR x IN w]), 0)::BIGINT AS longest FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", T.words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).cast("long").alias("longest"))


@query(f"SELECT doc_id, (['validation', 'calibration', 'test'])[{SHA.format('doc_id::VARCHAR')} % 3 + 1] AS part FROM documents")
def hash_split_3way(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", K.part_of(F.col("doc_id")).alias("part"))


@query(f"SELECT source, {SHA.format('source')} % 1000 < 100 AS held, count(*) AS n FROM documents GROUP BY 1, 2")
def group_split_by_source(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("source", K.group_held_out(F.col("source")).alias("held")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, round({SHA.format("doc_id || chr(31) || '7'")} / 4294967296.0, 9) AS u FROM documents")
def hash01_order(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.round(K.hash01(F.col("doc_id"), 7), 9).alias("u"))


@query(f"SELECT min(doc_id) AS doc_id, md5({DOC_KEY}) AS key, count(*) AS n FROM documents GROUP BY 2")
def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first by ordinal as a partial aggregate: a hot key is one row for each task before the shuffle."""
    return docs(spark, d).groupBy(F.md5(T.norm_key("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"SELECT key, count(*) AS n, count(DISTINCT source) AS n_sources, min(doc_id) AS first_id FROM (SELECT doc_id, source, md5({DOC_KEY}) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.md5(T.norm_key("text")).alias("key")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""WITH k AS (SELECT DISTINCT md5({DOC_KEY}) AS key, source FROM documents),
g AS (SELECT key, string_agg(source, ' + ' ORDER BY source) AS sources FROM k GROUP BY key HAVING count(*) > 1)
SELECT sources, count(*) AS n FROM g GROUP BY sources""")
def shared_text_cross_source(spark: SparkSession, d: str) -> DataFrame:
    k = docs(spark, d).select(F.md5(T.norm_key("text")).alias("key"), "source").distinct()
    g = k.groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    return g.groupBy(F.array_join("s", " + ").alias("sources")).agg(F.count("*").alias("n"))


@query(f"""WITH j AS (SELECT doc_id, md5({DOC_KEY}) AS key, source AS label FROM documents),
bad AS (SELECT key FROM j GROUP BY key HAVING count(DISTINCT label) > 1) SELECT doc_id, key, label FROM j WHERE key IN (SELECT key FROM bad)""")
def conflicting_labels(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a key with more than one label: here texts that are filed under several sources."""
    j = docs(spark, d).select("doc_id", F.md5(T.norm_key("text")).alias("key"), F.col("source").alias("label"))
    bad = j.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    return j.join(bad, "key", "left_semi")


@query(f"""WITH k AS (SELECT doc_id, source, lang, md5({DOC_KEY}) AS state, md5(source || chr(31) || {DOC_KEY}) AS state_source, md5(lang || chr(31) || {DOC_KEY}) AS state_lang FROM documents)
SELECT doc_id, state, state_source, state_lang, md5(state || state_source || state_lang) AS "full" FROM k""")
def item_keys(spark: SparkSession, d: str) -> DataFrame:
    n = T.norm_key("text")
    k = docs(spark, d).select("doc_id", F.md5(n).alias("state"), F.md5(F.concat("source", F.lit(K.SEP), n)).alias("state_source"), F.md5(F.concat("lang", F.lit(K.SEP), n)).alias("state_lang"))
    return k.withColumn("full", F.md5(F.concat("state", "state_source", "state_lang")))


@query(f"""WITH k AS (SELECT doc_id, md5({DOC_KEY}) AS key, source FROM documents), g AS (SELECT key, count(*) AS size, count(DISTINCT source) AS n_values FROM k GROUP BY key)
SELECT doc_id, size, n_values FROM k JOIN g USING (key)""")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each row its key's size and number of different values."""
    k = docs(spark, d).select("doc_id", F.md5(T.norm_key("text")).alias("key"), "source")
    g = k.groupBy("key").agg(F.count("*").alias("size"), F.countDistinct("source").alias("n_values"))
    return k.join(g, "key").select("doc_id", "size", "n_values")


_EN = ", ".join(f"'{w}'" for w in T.EN_WORDS)
_FR = ", ".join(f"'{w}'" for w in T.FR_WORDS)
GUESS = f"""(SELECT doc_id, lang, CASE WHEN en + fr < 6 THEN NULL WHEN fr >= 4 * greatest(en, 0.5) THEN 'fr' WHEN en >= 4 * greatest(fr, 0.5) THEN 'en' END AS guess
  FROM (SELECT doc_id, lang, len(list_filter(w, lambda x: x IN ({_EN}))) AS en, len(list_filter(w, lambda x: x IN ({_FR}))) AS fr
    FROM (SELECT doc_id, lang, [regexp_replace(x, '^''+|''+$', '', 'g') FOR x IN regexp_extract_all(lower(text), '{T.GUESS_WORD.replace("'", "''")}')] AS w FROM documents)))"""


@query(f"SELECT doc_id, guess FROM {GUESS}")
def lang_guess(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.guess_lang("text").alias("guess"))


@query(f"SELECT lang, coalesce(guess, 'none') AS guess, count(*) AS n FROM {GUESS} GROUP BY 1, 2")
def lang_mismatch_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("lang", F.coalesce(T.guess_lang("text"), F.lit("none")).alias("guess")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, coalesce(guess, lang) AS lang FROM {GUESS}")
def lang_retag(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.coalesce(T.guess_lang("text"), "lang").alias("lang"))


HOST = "split_part(split_part(url, '://', 2), '/', 1)"


def _flags(column: str) -> str:
    return " UNION ALL ".join(f"SELECT {HOST} AS source, '{n}' AS flag FROM pages WHERE regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for n, p in sorted(T.ARTEFACTS.items()))


@query(f"SELECT source, flag, count(*) AS n FROM ({_flags('html')}) GROUP BY 1, 2")
def artefact_flags_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Artefacts of raw pages, by host."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, d, "pages").select(host.alias("source"), F.explode(T.artefact_flags("html")).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("n"))


#: documents, every seventh of which is encoded twice.
TWICE = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(replace(text, 'é', 'Ã©'), 'ü', 'Ã¼') ELSE text END AS text FROM documents)"


@query(f"SELECT doc_id FROM {TWICE} WHERE contains(text, '�') OR regexp_matches(text, '{T.ARTEFACTS['mojibake']}')")
def damaged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with encoding damage, after every seventh text was read with the wrong encoding."""
    twice = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    only = F.regexp_replace("text", "[^éü]", "")  # what the planted damage concerns
    planted = F.when((F.col("doc_id") % 7 == 0) & (F.length(only) > 0), twice).otherwise(F.col("text"))
    return docs(spark, d).where(T.damaged(planted)).select("doc_id")


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{T.ARTEFACTS['control_char']}', '', 'g')) AS fixed, regexp_matches(text, '{T.ARTEFACTS['control_char']}') AS changed FROM documents")
def control_char_fix(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(T.strip_control("text")).alias("fixed"), F.col("text").rlike(T.ARTEFACTS["control_char"]).alias("changed"))


@query(r"SELECT source, count(*) FILTER (length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) < 40) AS short, count(*) AS n FROM documents GROUP BY source")
def short_state_flags(spark: SparkSession, d: str) -> DataFrame:
    short = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}_]", "")) < 40
    return docs(spark, d).groupBy("source").agg(F.count_if(short).alias("short"), F.count("*").alias("n"))


@query(f"""SELECT source, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest
FROM (SELECT source, len({WORDS})::BIGINT AS n FROM documents) GROUP BY source""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).select("source", F.size(T.words("text")).cast("long").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return n.groupBy("source").agg(F.round(F.avg("n"), 6).alias("mean"), p.alias("p"), F.max("n").alias("longest")).select("source", "mean", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p90", "p99"))], "longest")


@query("""WITH p AS (SELECT source, quantile_cont(n_chars, 0.99) AS p99 FROM documents GROUP BY source)
SELECT doc_id, source, n_chars, n_chars > 4 * p99 AS outlier, n_chars > 16384 AS over_largest FROM documents JOIN p USING (source) WHERE n_chars > 4 * p99 OR n_chars > 16384""")
def length_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = docs(spark, d).groupBy("source").agg(F.percentile("n_chars", F.lit(0.99)).alias("p99"))
    far, over = F.col("n_chars") > 4 * F.col("p99"), F.col("n_chars") > 16384
    return docs(spark, d).join(p, "source").where(far | over).select("doc_id", "source", "n_chars", far.alias("outlier"), over.alias("over_largest"))


@query(f"""SELECT CASE WHEN n <= 128 THEN 128 WHEN n <= 512 THEN 512 WHEN n <= 2048 THEN 2048 ELSE -1 END AS bucket, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT len({WORDS}) AS n FROM documents) GROUP BY 1""")
def bucket_shares(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).groupBy(F.coalesce(K.range_bucket(F.size(T.words("text")), (128, 512, 2048)), F.lit(-1)).alias("bucket")).agg(F.count("*").alias("n_rows"))
    return n.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()), 6))  # a row for each bucket


@query(r"""SELECT page_id, length(html) - length(replace(html, '&amp;', '')) AS amp_chars, regexp_matches(html, '(?i)&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{2,5}|#x[0-9a-f]{2,4});') AS has_entity, regexp_matches(html, '(?i)<script') AS has_script FROM pages""")
def html_entity_pages(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", (F.length(h) - F.length(F.replace(h, F.lit("&amp;"), F.lit("")))).cast("long").alias("amp_chars"), h.rlike(T.ARTEFACTS["html_entity"]).alias("has_entity"), h.rlike("(?i)<script").alias("has_script"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.html_text("html")).alias("text_md5"))


@query()
def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.unescape_udf("html")).alias("fixed"), (T.unescape_udf("html") != F.col("html")).alias("changed"))


@query()
def norm_text_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(T.norm_text_udf("text")).alias("key"))


@query(r"""SELECT doc_id, len(q)::BIGINT AS n, array_to_string(q, ' ') AS quantities FROM (
SELECT doc_id, list_sort([replace(x, ',', '') FOR x IN regexp_extract_all(text, '([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)')]) AS q FROM documents)""")
def text_quantities(spark: SparkSession, d: str) -> DataFrame:
    q = docs(spark, d).select("doc_id", T.quantities("text").alias("q"))
    return q.select("doc_id", F.size("q").cast("long").alias("n"), F.array_join("q", " ").alias("quantities"))


@query(r"""SELECT n_regionkey::BIGINT AS n_regionkey, n_name, round(CASE WHEN n_nationkey % 3 = 0 THEN -(n_nationkey * 1234.5) WHEN n_nationkey % 3 = 1 THEN n_nationkey * 1234.5 END, 4) AS value FROM nation""")
def number_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Accounting, money and blank spellings of a number, parsed back."""
    x = F.format_number(F.col("n_nationkey") * 1234.5, 2)
    spelt = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("("), x, F.lit(")"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("$"), x)).otherwise(F.lit("n/a"))
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("n_regionkey"), "n_name", F.round(T.parse_number(spelt), 4).alias("value"))


@query(f"""WITH w AS (SELECT source, {WORDS} AS w FROM documents),
g AS (SELECT source, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS gram FROM w)
SELECT source, count(*) AS n, count(DISTINCT gram) AS n_distinct, round(count(DISTINCT gram) / count(*), 6) AS ratio FROM g GROUP BY source""")
def ngram_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Distinct share of all word 3-grams by source: counted by gram (96 bits of its hash) first, so a hot source is dealt over all tasks."""
    w = near.spread(docs(spark, d).select("source", "text")).select("source", T.words("text").alias("w")).where(F.size("w") >= 3)
    three = lambda i: [F.get("w", i + k) for k in range(3)]
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(*three(i)).alias("a"), F.hash(*three(i)).alias("b")))
    g = w.select("source", F.explode(grams).alias("gram")).groupBy("source", "gram.a", "gram.b").agg(F.count("*").alias("c"))
    return g.groupBy("source").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct")).withColumn("ratio", F.round(F.col("n_distinct") / F.col("n"), 6))


@query("""WITH t AS (SELECT item_id, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') AS t FROM benchmark), x AS (SELECT a.item_id, a.t AS h, b.t AS r FROM t a JOIN t b ON a.item_id = b.item_id + 1),
g AS (SELECT item_id, n, 'h' AS side, unnest([substr(h, i, n) FOR i IN range(1, length(h) - n + 2)]) AS gram FROM x, range(1, 7) q(n) UNION ALL SELECT item_id, n, 'r', unnest([substr(r, i, n) FOR i IN range(1, length(r) - n + 2)]) FROM x, range(1, 7) q(n)),
c AS (SELECT item_id, n, gram, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b FROM g GROUP BY 1, 2, 3),
s AS (SELECT item_id, n, sum(least(a, b)) / sum(a) AS p, sum(least(a, b)) / sum(b) AS q FROM c GROUP BY 1, 2 HAVING sum(a) > 0 AND sum(b) > 0)
SELECT item_id, round(100 * avg(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) ELSE 0 END), 6) AS chrf FROM s GROUP BY item_id""")
def chrf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """chrF of each benchmark item against the one before it."""
    b = table(spark, d, "benchmark")
    prior = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before"))
    return b.join(prior, "item_id").select("item_id", F.round(T.chrf_udf("text", "before"), 6).alias("chrf"))


@query("""SELECT event_id, 'see ' || props AS fixed FROM events""")
def repr_to_json(spark: SparkSession, d: str) -> DataFrame:
    """Python reprs within texts as JSON; made from the events' properties."""
    e = table(spark, d, "events")
    return e.select("event_id", T.repr_to_json_udf(F.concat(F.lit("see "), F.replace("props", F.lit('"'), F.lit("'")))).alias("fixed"))


@query(f"""WITH w AS (SELECT doc_id, n_chars, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) AS gram FROM w) GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, coalesce(most, 0)::BIGINT AS most_repeated, coalesce(most, 0) > 8 AS degenerate FROM w LEFT JOIN g USING (doc_id)""")
def degenerate_loops(spark: SparkSession, d: str) -> DataFrame:
    """The most often repeated word 4-gram of a text; more than 8 is a loop."""
    w = docs(spark, d).select("doc_id", T.words("text").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))
    sorted_ = F.array_sort(F.when(F.size("w") >= 4, grams).otherwise(F.array().cast("array<string>")))
    run = F.aggregate(sorted_, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), lambda a, g: F.struct(g.alias("last"), F.when(a["last"] == g, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(a["last"] == g, a["run"] + 1).otherwise(1)).alias("best")), lambda a: a["best"])
    return w.select("doc_id", run.cast("long").alias("most_repeated")).withColumn("degenerate", F.col("most_repeated") > 8)
