"""Quality rules with host-level verdicts, in DataFrame operations only.

Each text is measured (words, symbols, repeated lines, repeated five-word windows) and
held to document rules.  Failures are summed by host; a host's failure rate is shrunk to
the corpus by a beta prior fitted to the hosts' rates (moments, with the binomial noise
of small hosts taken out); a host whose shrunk rate is above max_host_rate is bad, and
its documents are not kept.

The measures are written once and read twice.  The verdicts of bad hosts are a written
table as well: Spark sends it to the tasks where its size is under its broadcast limit,
else deals both sides by host and splits a hot host's partition.

Defined results.  A null text has no words, which fails the document.  A null host is a
host of its own.  An empty table has no hosts and no rows.  Rows are neither dropped nor
merged.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written

#: Characters that split words, and those that count as symbols.
_SPACES = r"' \t\n\u000b\u000c\r'"
_SYMBOLS = "'#*$%&|<>'"

# The array names within lambdas are bound once for each row: transform(array(x), name -> ...)[0].
_WORDS = r"filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_LINES = f"filter(split(t, '\\n'), l -> translate(l, {_SPACES}, '') <> '')"
_REPEATED = """
  if(size(words) < {n}, 0L,
    transform(array(transform(sequence(1, size(words) - {n} + 1), i -> array_join(slice(words, i, {n}), ' '))), wins ->
      if(size(array_distinct(wins)) = size(wins), 0L,
        transform(array(sort_array(transform(wins, (w, i) -> named_struct('w', w, 'i', i)))), s ->
          aggregate(
            sort_array(transform(filter(sequence(0, size(s) - 1),
              k -> (k > 0 and s[greatest(k - 1, 0)].w = s[k].w) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].w = s[k].w)), k -> s[k].i)),
            named_struct('n', 0L, 'last', -{n}),
            (a, p) -> named_struct('n', a.n + least({n}, p - a.last), 'last', p),
            a -> a.n))[0]))[0])
"""


def measured(docs: DataFrame, *columns: str, window: int = 5) -> DataFrame:
    """The given columns and m: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row's text."""
    repeated = _REPEATED.format(n=window)
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("t")).select(
        *columns,
        F.expr(f"""
          transform(array({_WORDS}), words -> named_struct(
            'n_words', cast(size(words) AS long),
            'word_chars', cast(length(translate(t, {_SPACES}, '')) AS long),
            'n_symbols', cast(length(t) - length(translate(t, {_SYMBOLS}, '')) AS long),
            'n_dup_lines', transform(array({_LINES}), l -> cast(size(l) - size(array_distinct(l)) AS long))[0],
            'n_repeat_words', {repeated}))[0]""").alias("m"),
    )


def beta_prior(hosts: DataFrame, *, least_strength: float = 2.0, most_strength: float = 1000.0) -> tuple[float, float]:
    """alpha and beta from (n, failed) of each host: the mean and the between-host variance of the rates."""
    r = hosts.select((F.col("failed") / F.col("n")).alias("rate"), F.col("n")).agg(
        F.avg("rate").alias("mean"), F.var_pop("rate").alias("var"), F.avg(1.0 / F.col("n")).alias("inverse"))
    mean, var, inverse = r.first()
    if mean is None:
        return 1.0, 1.0
    between = var - mean * (1 - mean) * inverse
    strength = most_strength if between <= 0 else min(max(mean * (1 - mean) / between - 1, least_strength), most_strength)
    return mean * strength, (1 - mean) * strength


def verdicts(docs: DataFrame, *, host: str | Column = "source", min_words: int = 10, max_repeat_percent: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each row."""
    column = F.col(host) if isinstance(host, str) else host
    rows = measured(docs.select("doc_id", column.cast("string").alias("host"), "text"), "doc_id", "host").select("doc_id", "host", "m.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed), "measures")
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    shrunk = (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    bad = written(hosts.where(shrunk > max_host_rate).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad")), "bad_hosts")
    return rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("host", "bad_host", "bad")


def op3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
wins AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) WHERE n > 1),
cover AS (SELECT r, sum(least(5, i - before)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -10) AS before FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY host),
p AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS var, avg(1.0 / n) AS inverse FROM h),
s AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * inverse <= 0 THEN 1000.0
  ELSE least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inverse) - 1, 2.0), 1000.0) END AS strength FROM p),
bad AS (SELECT host FROM h, s WHERE (failed + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM b.host) AS kept
FROM b
"""
