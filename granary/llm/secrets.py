"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Each text is a blob, named by its SHA-256.  The ledger is a written table of (blob,
rule_version, findings).  A scan hashes all texts, takes one row of each blob whose
(blob, rule version) pair the ledger doesn't have, finds the spans of all rules in it,
appends them to the ledger, and joins the findings back to every row (path) that holds
the blob, now or in a later scan.  A rule's change makes a new version, and so new pairs.

Hot blobs: the text that is scanned is picked by a partial aggregate of ids, so a blob
with a third of all rows costs as much as any other; the last join is a plain join of
two written tables whose large partitions Spark splits.

Defined results.  A null text counts as empty: no findings, the hash of the empty
string.  Rows are neither dropped nor merged: repeated ids give repeated rows.  Spans
are in code points, the end exclusive.  Extra columns are ignored by scan() and kept by
redact(); their names mustn't begin with two underscores.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import session, table, work_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those count whose group has least characters or more.  hint: text that any match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    hint: str = ""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds in the order in which ties are sorted.  A maximal run of 24 or more is a match of [0-9a-f]+ that counts.
BASE_RULES = (
    Rule("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, True),
)
#: Further kinds: key blocks, signed web tokens, tokens of hosting and chat services.
MORE_RULES = (
    # no repeated group, for which Java's engine recurses once a word
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False, "-----BEGIN "),
    # where a run's first eyJ begins no token, no later one does: the other branch takes the run, as a match that doesn't count
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})|eyJ[A-Za-z0-9_-]*", 1, 1, False, "eyJ"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False, "gh"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False, "xox"),
)
RULES = BASE_RULES + MORE_RULES


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _runs(items: str, first: str, value: str, make: str, out: str) -> str:
    """SQL: array<out> that make extends, x.out to the next x.out, for each item i; x.at is a running value over the items before it.

    value is the running value after item i, from `a`, the one before it.  Items are
    dealt into blocks of about the square root of their number, whose first values come
    from one pass, so that arrays that grow by one item at a time stay short.
    """
    return f"""
      transform(array(named_struct('items', {items}, 'step', cast(ceil(sqrt(size({items}))) AS int))), z -> if(size(z.items) = 0, cast(array() AS array<{out}>), flatten(transform(
        aggregate(sequence(0, size(z.items) - 1, z.step), named_struct('at', {first}, 'out', cast(array() AS array<struct<i:int,at:int>>)),
          (s, i) -> named_struct('at', aggregate(slice(z.items, i + 1, z.step), s.at, (a, i) -> {value}), 'out', concat(s.out, array(named_struct('i', i, 'at', s.at)))), s -> s.out),
        b -> aggregate(slice(z.items, b.i + 1, z.step), named_struct('at', b.at, 'out', cast(array() AS array<{out}>)),
          (x, i) -> named_struct('at', transform(array(x.at), a -> {value})[0], 'out', {make}), x -> x.out)))))[0]"""


def spans_sql(rule: Rule, text: str = "text") -> str:
    """SQL: array<struct<start,end>> of the matches that count.  The pieces between matches give the positions."""
    rx = _quoted(rule.pattern)
    none = "cast(array() AS array<struct<start:int,end:int>>)"
    counted = f"regexp_extract_all({text}, {rx}, {rule.group})" if rule.group else "m"
    sizes = f"zip_with(zip_with(m, slice(split({text}, {rx}, -1), 1, size(m)), (m, p) -> named_struct('p', length(p), 'm', length(m))), {counted}, (s, g) -> named_struct('p', s.p, 'm', s.m, 'g', length(g)))"
    span = "array(named_struct('start', x.at + i.p, 'end', x.at + i.p + i.m))"
    walk = _runs("y", "0", "a + i.p + i.m", f"if(i.g >= {rule.least}, concat(x.out, {span}), x.out)", "struct<start:int,end:int>")
    sql = f"transform(array(regexp_extract_all({text}, {rx}, 0)), m -> if(size(m) = 0, {none}, transform(array({sizes}), y -> {walk})[0]))[0]"
    return f"if(contains({text}, {_quoted(rule.hint)}), {sql}, {none})" if rule.hint else sql


def findings_sql(rules: tuple[Rule, ...], text: str = "text") -> str:
    """SQL: sorted array<struct<start,ord,end>>, ord the rule's place in rules."""
    parts = ", ".join(f"transform({spans_sql(r, text)}, s -> named_struct('start', s.start, 'ord', {k}, 'end', s.end))" for k, r in enumerate(rules))
    return f"sort_array(concat({parts}))"


FINDINGS = "array<struct<start:int,ord:int,end:int>>"
PIECE = "struct<`from`:int,start:int,`end`:int,ord:int>"


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(f"blob string, rule_version string, findings {FINDINGS}").parquet(path)


def _found(spark: SparkSession, path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and findings of the blobs with any; a pair that two scans at the same time have appended twice counts once."""
    rows = _ledger(spark, path).where((F.col("rule_version") == rule_version(rules)) & (F.size("findings") > 0))
    return rows.groupBy("blob").agg(F.first("findings").alias("findings"))


def update_ledger(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, *, path: str = "doc_id") -> None:
    """Scans the blobs of docs that the ledger at ledger_path doesn't have under these rules, and appends their findings."""
    spark = session(docs)
    version = rule_version(rules)
    held = docs.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    held = held.withColumn("blob", F.sha2("text", 256))
    picks = held.groupBy("blob").agg(F.min("path").alias("path"))
    if (seen := _ledger(spark, ledger_path)) is not None:
        picks = picks.join(seen.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    # picks is the small side: its rows are hashed, and no text is sorted
    unseen = held.join(picks.hint("shuffle_hash"), ["blob", "path"]).select("blob", F.expr(findings_sql(rules)).alias("findings"))
    unseen.groupBy("blob").agg(F.first("findings").alias("findings")).select("blob", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, *, path: str = "doc_id") -> DataFrame:
    """path and findings of every row of docs.  Without ledger_path the ledger is a new table in the shared folder."""
    spark = session(docs)
    ledger_path = ledger_path or work_path(spark, "ledger")
    update_ledger(docs, ledger_path, rules, path=path)
    found = _found(spark, ledger_path, rules)
    rows = docs.select(F.col(path), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return rows.join(found, "blob", "left").select(path, F.coalesce("findings", F.expr(f"cast(array() AS {FINDINGS})")).alias("findings"))


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, *, path: str = "doc_id") -> DataFrame:
    """docs with every found span replaced by its kind in brackets (n_chars, if there, follows), all columns and rows kept.

    Of spans that overlap the union is replaced, by the kind of the first.
    """
    session(docs)
    ledger_path = ledger_path or work_path(docs.sparkSession, "ledger")
    update_ledger(docs, ledger_path, rules, path=path)
    found = _found(docs.sparkSession, ledger_path, rules).toDF("__blob", "__findings")
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    # blocks of findings, each with the stretch of text from the last end before it: a character is passed over once for each block, not for each finding
    pieces = _runs("__findings", "0", "greatest(a, i.end)", "concat(x.out, array(named_struct('from', x.at, 'start', i.start, 'end', i.end, 'ord', i.ord)))", PIECE)
    block = f"""
      transform(array(substring(text, w[0].from + 1, array_max(transform(w, s -> greatest(s.start, s.end))) - w[0].from)), part ->
        array_join(transform(w, s -> if(s.start < s.from, '', concat(substring(part, s.from - w[0].from + 1, s.start - s.from), '[', {kinds}[s.ord], ']'))), ''))[0]"""
    cut = f"""
      transform(array(named_struct('p', {pieces}, 'step', cast(ceil(sqrt(size(__findings))) AS int))), q ->
        concat(array_join(transform(transform(sequence(1, size(q.p), q.step), i -> slice(q.p, i, q.step)), w -> {block}), ''),
          substring(text, array_max(transform(q.p, s -> greatest(s.from, s.end))) + 1)))[0]"""
    joined = docs.join(found, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("__blob"), "left")
    text = F.when(F.col("__findings").isNull(), docs["text"]).otherwise(F.expr(cut))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__findings").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _joined(findings: str, kinds: str, where: str = "true") -> str:
    return f"array_join(transform(filter({findings}, s -> {where}), s -> concat({kinds}[s.ord], ':', s.start, ':', s.end)), ',')"


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in RULES) + ")"
    count = lambda k: F.expr(f"size(filter(findings, s -> s.ord = {k}))").cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_joined("findings", kinds, f"s.ord < {len(BASE_RULES)}")), 256).alias("base_sha256"),
        F.expr(_joined("findings", kinds)).alias("spans"),
    )


def _duck_spans(rule: Rule, k: int) -> str:
    rx = "'" + rule.pattern.replace("'", "''") + "'"
    size = f"length(regexp_extract_all(text, {rx}, {rule.group})[i])"
    return f"""
      SELECT doc_id, {k} AS ord, '{rule.kind}' AS kind, start, start + length(m[i]) AS "end"
      FROM (SELECT doc_id, text, m, i, (list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::BIGINT AS start
            FROM (SELECT doc_id, text, m, regexp_split_to_array(text, {rx}) AS p, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT doc_id, text, regexp_extract_all(text, {rx}) AS m FROM t)))
      WHERE {size} >= {rule.least}"""


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_duck_spans(r, k) for k, r in enumerate(RULES))}),
g AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) FILTER (ord < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS spans
  FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""
