"""Near duplicates, decontamination and hygiene."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decontam, hygiene, keepfirst, near
from ..operators.tables import work_path, written
from ..sources.tables import held_items, table, train_items
from .keys_text import DOC_KEY, NORM, WORDS

Q: dict[str, tuple] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = (f, sql)
        return f

    return add


def _grams(relation: str, ident: str, n: int = 8) -> str:
    return f"(SELECT DISTINCT id, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS gram FROM (SELECT {ident} AS id, {WORDS} AS w FROM {relation}))"


REF = f"""bg AS (SELECT id AS ref, gram FROM {_grams('benchmark', 'item_id')}),
bt AS (SELECT gram FROM bg GROUP BY gram HAVING count(*) >= greatest(5, ceil(0.01 * (SELECT count(*) FROM benchmark)))),
ref AS (SELECT * FROM bg WHERE gram NOT IN (SELECT gram FROM bt)),
tg AS (SELECT * FROM {_grams('documents', 'doc_id')})"""


@query(f"WITH {REF} SELECT id AS doc_id, ref AS item_id, count(*) AS shared FROM tg JOIN ref USING (gram) GROUP BY 1, 2")
def benchmark_8gram_hits(spark: SparkSession, d: str) -> DataFrame:
    return decontam.gram_hits(train_items(spark, d), decontam.ref_grams(held_items(spark, d))).select(F.col("id").alias("doc_id"), F.col("ref").alias("item_id"), "shared")


@query(f"WITH {REF} SELECT id AS doc_id, min(ref) AS item_id FROM (SELECT id, ref FROM tg JOIN ref USING (gram) GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY 1")
def benchmark_first_hit(spark: SparkSession, d: str) -> DataFrame:
    hits = decontam.gram_hits(train_items(spark, d), decontam.ref_grams(held_items(spark, d)), need=3)
    return hits.groupBy(F.col("id").alias("doc_id")).agg(F.min("ref").alias("item_id"))


@query(f"""WITH {REF}, n AS (SELECT id, count(*) AS n FROM tg GROUP BY id), s AS (SELECT id, count(*) AS shared FROM tg WHERE gram IN (SELECT gram FROM ref) GROUP BY id)
SELECT id AS doc_id, shared, n FROM s JOIN n USING (id) WHERE shared >= 25 OR shared >= 0.2 * n""")
def benchmark_loose_hits(spark: SparkSession, d: str) -> DataFrame:
    return decontam.loose_hits(train_items(spark, d), decontam.ref_grams(held_items(spark, d))).select(F.col("id").alias("doc_id"), "shared", F.col("n").cast("long").alias("n"))


@query(f"SELECT gram, count(*) AS df FROM {_grams('documents', 'doc_id')} GROUP BY gram HAVING count(*) >= 5")
def template_grams(spark: SparkSession, d: str) -> DataFrame:
    """Grams of five documents or more, where documents are the reference set."""
    return decontam.template_grams(train_items(spark, d), share=0.0, least=5)


@query(f"SELECT gram, count(*) AS df FROM {_grams('documents', 'doc_id')} GROUP BY gram HAVING count(*) >= greatest(20, ceil(0.0005 * (SELECT count(*) FROM documents)))")
def train_template_grams(spark: SparkSession, d: str) -> DataFrame:
    return decontam.template_grams(train_items(spark, d), share=0.0005, least=20)


@query(f"SELECT key, count(*) AS n FROM (SELECT {DOC_KEY} AS key FROM documents) GROUP BY key HAVING length(key) < 60 OR count(*) >= 20")
def generic_key_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keys too short or too common to name an item."""
    return train_items(spark, d).groupBy(T.norm_key("state").alias("key")).agg(F.count("*").alias("n")).where((F.length("key") < 60) | (F.col("n") >= 20))


CLEAN = f"""WITH {REF}, hit AS (SELECT DISTINCT id FROM tg JOIN ref USING (gram)), bk AS (SELECT {NORM.format('text')} AS key FROM benchmark),
r AS (SELECT doc_id, source, {DOC_KEY} AS key, CASE WHEN {DOC_KEY} IN (SELECT key FROM bk) THEN 'equals_heldout' WHEN doc_id IN (SELECT id FROM hit) THEN 'shares_8gram'
  WHEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) < 40 THEN 'too_short' WHEN contains(text, '�') OR regexp_matches(text, '{T.ARTEFACTS['mojibake']}') THEN 'damaged' END AS reason FROM documents),
f AS (SELECT key, min(doc_id) AS first FROM r WHERE reason IS NULL GROUP BY key),
c AS (SELECT doc_id, source, CASE WHEN reason IS NULL AND doc_id > first THEN 'duplicate' ELSE reason END AS reason FROM r LEFT JOIN f USING (key))"""


@query(f"{CLEAN} SELECT doc_id, source, coalesce(reason, 'kept') AS verdict FROM c")
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents as train against benchmark as held-out: the first reason, then keep-first duplicates."""
    c = hygiene.clean(train_items(spark, d), held_items(spark, d))
    return c.select(F.col("id").alias("doc_id"), "source", F.coalesce("reason", F.lit("kept")).alias("verdict"))


@query(f"{CLEAN} SELECT coalesce(reason, 'kept') AS verdict, count(*) AS n FROM c GROUP BY 1")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return clean_documents(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


P_, B_ = near.PERMS, near.BANDS


def _sig(relation: str, ident: str) -> str:
    ab = ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in near.coefficients(P_))
    return f"""(SELECT id, [list_min([(c.a * h + c.b) % {near.PRIME} FOR h IN hs]) FOR c IN [{ab}]] AS sig FROM (
      SELECT id, list_distinct([('0x' || substr(md5(s), 1, 7))::BIGINT FOR s IN CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END]) AS hs
      FROM (SELECT {ident} AS id, {WORDS} AS w FROM {relation})) WHERE len(hs) > 0)"""


def _bands(sig: str) -> str:
    return f"(SELECT id, b AS band, md5(array_to_string(sig[b * 4 + 1:b * 4 + 4], ',')) AS key FROM (SELECT id, sig, unnest(range({B_})) AS b FROM {sig}))"


JACCARD = f"len(list_filter(range(1, {P_ + 1}), lambda i: {{a}}[i] = {{b}}[i])) / {P_}.0"
PAIRS = f"""s AS MATERIALIZED (SELECT * FROM {_sig('documents', 'doc_id')}), k AS MATERIALIZED (SELECT * FROM {_bands('s')}),
f AS (SELECT band, key, min(id) AS a FROM k GROUP BY 1, 2),
c AS (SELECT DISTINCT a, id AS b FROM k JOIN f USING (band, key) WHERE id <> a),
pairs AS (SELECT a, b, {JACCARD.format(a='x.sig', b='y.sig')} AS j FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE {JACCARD.format(a='x.sig', b='y.sig')} >= 0.8)"""


#: The same beside other names.
PAIRS_TOO = PAIRS.replace("\nf AS (", "\npf AS (").replace("JOIN f USING", "JOIN pf USING").replace("\nc AS (", "\npc AS (").replace("FROM c JOIN", "FROM pc JOIN")


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return near.signatures(train_items(spark, d), "state", "id")


@query(f"SELECT id AS doc_id, md5(array_to_string(sig, ',')) AS sig_md5, sig[1] AS first FROM {_sig('documents', 'doc_id')}")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select(F.col("id").alias("doc_id"), F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")).alias("sig_md5"), F.col("sig")[0].alias("first"))


@query(f"SELECT band::BIGINT AS band, key, count(*) AS n FROM {_bands(_sig('documents', 'doc_id'))} GROUP BY 1, 2 HAVING count(*) > 1")
def lsh_band_keys(spark: SparkSession, d: str) -> DataFrame:
    k = _signatures(spark, d).select(F.explode(near.band_keys(F.col("sig"))).alias("k"))
    return k.groupBy(F.col("k.band").cast("long").alias("band"), F.col("k.key").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {PAIRS} SELECT a, b, round(j, 6) AS j FROM pairs")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(_signatures(spark, d)).select("a", "b", F.round("j", 6).alias("j"))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk(id, to_id) AS (SELECT a, a FROM e UNION SELECT id, b FROM walk JOIN e ON e.a = to_id)
SELECT id, min(to_id) AS cluster FROM walk GROUP BY id""")
def near_clusters(spark: SparkSession, d: str) -> DataFrame:
    return near.components(near.near_pairs(_signatures(spark, d)))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk(id, to_id) AS (SELECT a, a FROM e UNION SELECT id, b FROM walk JOIN e ON e.a = to_id),
cl AS (SELECT id, min(to_id) AS cluster FROM walk GROUP BY id),
r AS (SELECT doc_id, source, cluster, (row_number() OVER (PARTITION BY cluster, source ORDER BY doc_id) > 1)::INT AS again FROM documents JOIN cl ON id = doc_id),
kept AS (SELECT doc_id, source, row_number() OVER (PARTITION BY cluster ORDER BY again, doc_id) AS r FROM r)
SELECT doc_id, source FROM kept WHERE r <= 2 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM cl)""")
def cluster_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = train_items(spark, d).select("id", "source")
    return near.cluster_cap(rows, near.components(near.near_pairs(_signatures(spark, d))), cap=2, question="source").select(F.col("id").alias("doc_id"), "source")


def _lines(relation: str, ident: str) -> str:
    return f"(SELECT {ident} * 100000 + i AS line_id, string_split(text, chr(10))[i] AS text FROM (SELECT {ident}, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {relation}))"


@query(f"""WITH s AS MATERIALIZED (SELECT * FROM {_sig(_lines('documents', 'doc_id'), 'line_id')}), h AS MATERIALIZED (SELECT * FROM {_sig(_lines('benchmark', 'item_id'), 'line_id')}),
c AS (SELECT DISTINCT x.id AS id, y.id AS ref FROM {_bands('s')} x JOIN {_bands('h')} y USING (band, key))
SELECT c.id AS line_id, ref AS item_line, round({JACCARD.format(a='s.sig', b='h.sig')}, 6) AS j FROM c JOIN s ON s.id = c.id JOIN h ON h.id = ref WHERE {JACCARD.format(a='s.sig', b='h.sig')} >= 0.5""")
def near_hits_vs_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are near a line of a benchmark item (id * 100000 + the line's number)."""
    lines = lambda x: x.select("id", F.posexplode(F.split("state", "\n")).alias("i", "state")).select((F.col("id") * 100000 + F.col("i") + 1).alias("id"), "state")
    held = written(near.signatures(lines(held_items(spark, d)), "state", "id"), "signatures")
    hits = near.near_hits(near.signatures(lines(train_items(spark, d)), "state", "id", meets=near.band_filter(held)), held, threshold=0.5)
    return hits.select(F.col("id").alias("line_id"), F.col("ref").alias("item_line"), F.round("j", 6).alias("j"))


@query(f"""WITH s AS MATERIALIZED (SELECT x.*, lang AS tag FROM {_sig('documents', 'doc_id')} x JOIN documents ON doc_id = id), h AS MATERIALIZED (SELECT * FROM s WHERE id % 10 = 3), q AS MATERIALIZED (SELECT * FROM s WHERE id % 10 <> 3),
c AS (SELECT DISTINCT x.id AS id, y.id AS ref FROM {_bands('q')} x JOIN {_bands('h')} y USING (band, key))
SELECT c.id AS doc_id, ref, round({JACCARD.format(a='q.sig', b='h.sig')}, 6) AS j FROM c JOIN q ON q.id = c.id JOIN h ON h.id = ref WHERE {JACCARD.format(a='q.sig', b='h.sig')} >= 0.8 AND q.tag = h.tag""")
def near_hits_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Rows near a held-out row (a tenth of the ids) of the same key; the key keeps other rows out of its buckets."""
    s = written(near.signatures(train_items(spark, d), "state", "id", "lang"), "signatures")
    hits = near.near_hits(s.where("id % 10 <> 3"), s.where("id % 10 = 3"), key="lang")
    return hits.select(F.col("id").alias("doc_id"), "ref", F.round("j", 6).alias("j"))


@query(f"""WITH s AS MATERIALIZED (SELECT x.*, source AS tag FROM {_sig('documents', 'doc_id')} x JOIN documents ON doc_id = id), h AS MATERIALIZED (SELECT * FROM s WHERE id % 10 = 3), q AS MATERIALIZED (SELECT * FROM s WHERE id % 10 <> 3),
c AS (SELECT DISTINCT x.id AS id, y.id AS ref FROM {_bands('q')} x JOIN {_bands('h')} y USING (band, key))
SELECT c.id AS doc_id, min(ref) AS ref FROM c JOIN q ON q.id = c.id JOIN h ON h.id = ref WHERE {JACCARD.format(a='q.sig', b='h.sig')} >= 0.8 AND q.tag IS DISTINCT FROM h.tag GROUP BY 1""")
def state_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose state is near one of another origin in the index."""
    s = written(near.signatures(train_items(spark, d), "state", "id", "source"), "signatures")
    hits = near.near_hits(s.where("id % 10 <> 3"), s.where("id % 10 = 3"), tag="source")
    return hits.groupBy(F.col("id").alias("doc_id")).agg(F.min("ref").alias("ref"))


TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


@query(f"SELECT doc_id, {TOKENS.format('text')} > 400 AS too_long FROM documents")
def too_long(spark: SparkSession, d: str) -> DataFrame:
    return train_items(spark, d).select(F.col("id").alias("doc_id"), hygiene.too_long("state", 400).alias("too_long"))


HELD_Q = "CASE WHEN item_id % 4 = 0 THEN 'en' ELSE 'fr' END"


def _refs(name: str, rest: int) -> str:
    """Grams of the benchmark items whose id leaves `rest` modulo 2, as the set `name`, without that set's templates."""
    rows = f"(SELECT * FROM benchmark WHERE item_id % 2 = {rest})"
    return f"""{name}_g AS (SELECT id AS ref, gram FROM {_grams(rows, 'item_id')}),
{name} AS (SELECT '{name}' AS set, ref, gram FROM {name}_g WHERE gram NOT IN (SELECT gram FROM {name}_g GROUP BY gram HAVING count(*) >= greatest(5, ceil(0.01 * (SELECT count(*) FROM {rows})))))"""


#: The chain: reasons of the held-out rows and lengths first, then a walk through the rows that are left, in order, with the list of kept ids.
CHAIN = f"""WITH RECURSIVE tg AS MATERIALIZED (SELECT * FROM {_grams('documents', 'doc_id')}), {_refs('even', 0)}, {_refs('odd', 1)},
hit AS (SELECT DISTINCT id FROM tg JOIN even USING (gram)),
own AS (SELECT source, gram FROM tg JOIN documents ON doc_id = id WHERE gram IN (SELECT gram FROM odd) GROUP BY source, gram HAVING count(*) >= greatest(20, ceil(0.0005 * any_value((SELECT count(*) FROM documents o WHERE o.source = documents.source))))),
named AS (SELECT DISTINCT id FROM tg JOIN documents ON doc_id = id JOIN odd USING (gram) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.source = documents.source AND own.gram = tg.gram)),
held AS (SELECT item_id, text, {HELD_Q} AS q, {NORM.format('text')} AS key FROM benchmark WHERE item_id % 2 = 0),
s AS MATERIALIZED (SELECT * FROM {_sig('documents', 'doc_id')}), h AS MATERIALIZED (SELECT * FROM {_sig('held', 'item_id')}),
k AS MATERIALIZED (SELECT * FROM {_bands('s')}), hb AS MATERIALIZED (SELECT * FROM {_bands('h')}),
hc AS (SELECT DISTINCT x.id AS id, y.id AS ref FROM k x JOIN hb y USING (band, key)),
nh AS (SELECT hc.id, bool_or(d.lang = i.q) AS asked FROM hc JOIN s ON s.id = hc.id JOIN h ON h.id = ref JOIN documents d ON d.doc_id = hc.id JOIN held i ON i.item_id = ref WHERE {JACCARD.format(a='s.sig', b='h.sig')} >= 0.8 GROUP BY hc.id),
r AS MATERIALIZED (SELECT doc_id, source, lang, {DOC_KEY} AS key, CASE
  WHEN EXISTS (SELECT 1 FROM held WHERE held.key = {NORM.format('documents.text')} AND held.q = lang) THEN 'equals_heldout'
  WHEN doc_id IN (SELECT id FROM nh WHERE asked) THEN 'train_near_heldout' WHEN {DOC_KEY} IN (SELECT key FROM held) THEN 'train_state_in_heldout' WHEN doc_id IN (SELECT id FROM nh) THEN 'train_state_near_heldout'
  WHEN doc_id IN (SELECT id FROM hit) THEN 'shares_8gram' WHEN strlen(text) > 600 AND {TOKENS.format('text')} > 600 THEN 'prompt_too_long'
  WHEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) < 40 THEN 'too_short' WHEN contains(text, '�') OR regexp_matches(text, '{T.ARTEFACTS['mojibake']}') THEN 'damaged'
  WHEN doc_id IN (SELECT id FROM named) THEN 'decontam_8gram:odd' END AS reason FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM r WHERE reason IS NULL),
ko AS MATERIALIZED (SELECT * FROM k WHERE id IN (SELECT doc_id FROM o)),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ko x JOIN ko y USING (band, key) WHERE x.id < y.id),
e AS MATERIALIZED (SELECT a, b, oa.lang = ob.lang AS asked FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b JOIN o oa ON oa.doc_id = a JOIN o ob ON ob.doc_id = b
  WHERE {JACCARD.format(a='x.sig', b='y.sig')} >= 0.8 AND (oa.lang = ob.lang OR oa.source <> ob.source)),
g AS MATERIALIZED (SELECT o.i, o.doc_id, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS before FROM o LEFT JOIN e ON e.b = o.doc_id GROUP BY o.i, o.doc_id),
walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.i, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, doc_id) END FROM walk JOIN g ON g.i = walk.i + 1),
kept AS MATERIALIZED (SELECT unnest(kept) AS doc_id FROM walk WHERE i = (SELECT count(*) FROM o)),
blocked AS (SELECT e.b, bool_or(asked) AS asked FROM e JOIN kept ON kept.doc_id = e.a GROUP BY e.b),
firsts AS (SELECT o.key, o.lang, min(o.doc_id) AS first FROM o JOIN kept USING (doc_id) GROUP BY ALL)
SELECT r.doc_id, r.source, coalesce(r.reason, CASE WHEN r.doc_id IN (SELECT doc_id FROM kept) THEN 'kept' WHEN first < r.doc_id THEN 'duplicate' WHEN asked THEN 'train_near_duplicate' ELSE 'train_cross_source_state' END) AS verdict
FROM r LEFT JOIN blocked ON b = r.doc_id LEFT JOIN firsts ON firsts.key = r.key AND firsts.lang = r.lang"""


def _chain_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents with their language as the question; half of the benchmark as held-out rows, the other half as a reference set."""
    b = held_items(spark, d)
    held = b.where("id % 2 = 0").withColumn("lang", F.when(F.col("id") % 4 == 0, "en").otherwise("fr"))
    return train_items(spark, d), held, decontam.named_ref_grams({"odd": b.where("id % 2 = 1")})


@query(CHAIN)
def clean_v7(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning chain, and a limit of 600 tokens: near duplicates against kept rows only, in order."""
    train, held, refs = _chain_parts(spark, d)
    c = hygiene.clean_near(train, held, limit=600, question="lang", refs=refs)
    return c.select(F.col("id").alias("doc_id"), "source", F.coalesce("reason", F.lit("kept")).alias("verdict"))


@query(CHAIN)
def clean_v7_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same, each third of the rows a batch that is compared with a growing index of the kept rows of those before."""
    train, held, refs = _chain_parts(spark, d)
    index = keepfirst.KeptIndex(spark, work_path(spark, "kept"))
    own = written(hygiene.own_frames(train, refs), "own")  # of all rows, once for all batches
    cut = [r[0] for r in train.agg(F.percentile_approx("ordinal", F.array(F.lit(1 / 3), F.lit(2 / 3)))).collect()][0] or [0, 0]
    edges = [F.lit(True), F.col("ordinal") > cut[0], F.col("ordinal") > cut[1], F.lit(False)]
    parts = [hygiene.clean_near(train.where(a & ~b), held, limit=600, question="lang", refs=refs, index=index, own=own) for a, b in zip(edges, edges[1:], strict=False)]
    return functools.reduce(DataFrame.unionByName, parts).select(F.col("id").alias("doc_id"), "source", F.coalesce("reason", F.lit("kept")).alias("verdict"))


@query(f"""WITH tg AS (SELECT * FROM {_grams('documents', 'doc_id')}), {_refs('even', 0)}, {_refs('odd', 1)}, e AS (SELECT id, ref, set FROM tg JOIN (SELECT * FROM even UNION ALL SELECT * FROM odd) USING (gram))
SELECT set, count(DISTINCT id) AS rows_hit, count(DISTINCT ref) AS items_hit, count(*) AS shared FROM e GROUP BY set""")
def named_set_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits by named reference set; each set has its own templates."""
    b = held_items(spark, d)
    hits = decontam.gram_hits(train_items(spark, d), decontam.named_ref_grams({"even": b.where("id % 2 = 0"), "odd": b.where("id % 2 = 1")}))
    return hits.groupBy("set").agg(F.countDistinct("id").alias("rows_hit"), F.countDistinct("ref").alias("items_hit"), F.sum("shared").alias("shared"))


@query(f"""WITH a AS (SELECT * FROM {_grams('documents', 'doc_id', 5)}), b AS (SELECT * FROM {_grams('benchmark', 'item_id', 5)}),
na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
s AS (SELECT a.id, b.id AS ref, count(*) AS both_n FROM a JOIN b USING (gram) GROUP BY 1, 2)
SELECT s.id AS doc_id, ref AS item_id, round(both_n / (na.n + nb.n - both_n), 6) AS j FROM s JOIN na ON na.id = s.id JOIN nb ON nb.id = ref WHERE both_n / (na.n + nb.n - both_n) >= 0.1""")
def exact_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near.exact_jaccard(train_items(spark, d), held_items(spark, d), threshold=0.1).select(F.col("id").alias("doc_id"), F.col("ref").alias("item_id"), F.round("j", 6).alias("j"))


@query(f"""WITH {PAIRS}, dk AS (SELECT doc_id, source, {DOC_KEY} AS key FROM documents), g AS (SELECT key, count(*) AS n, count(DISTINCT source) AS ns FROM dk GROUP BY key),
r AS (SELECT dk.source, (g.n > 1)::INT AS exact, (g.ns > 1)::INT AS shared, (doc_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs))::INT AS near FROM dk JOIN g USING (key))
SELECT coalesce(source, '(all)') AS source, count(*) AS n, sum(exact)::BIGINT AS exact, sum(shared)::BIGINT AS shared, sum(near)::BIGINT AS near FROM r GROUP BY GROUPING SETS ((), (source))""")
def duplication_report(spark: SparkSession, d: str) -> DataFrame:
    rows = train_items(spark, d).select("id", "source", F.md5(T.norm_key("state")).alias("key"))
    g = rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("source").alias("ns"))
    p = written(near.near_pairs(_signatures(spark, d)), "pairs")
    ids = p.select("a").union(p.select("b")).distinct().toDF("id").withColumn("near", F.lit(1))
    flat = rows.join(g, "key").join(ids, "id", "left").select("source", (F.col("n") > 1).cast("int").alias("exact"), (F.col("ns") > 1).cast("int").alias("shared"), F.coalesce("near", F.lit(0)).alias("near"))
    return flat.rollup("source").agg(F.count("*").alias("n"), F.sum("exact").alias("exact"), F.sum("shared").alias("shared"), F.sum("near").alias("near")).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query(f"""WITH {REF}, hit AS (SELECT id, count(DISTINCT ref) AS n_items FROM tg JOIN ref USING (gram) GROUP BY id), bk AS (SELECT {NORM.format('text')} AS key FROM benchmark)
SELECT source, count(*) AS n, count(*) FILTER ({DOC_KEY} IN (SELECT key FROM bk)) AS exact, count(n_items) AS grams, coalesce(sum(n_items), 0)::BIGINT AS pairs FROM documents LEFT JOIN hit ON id = doc_id GROUP BY source""")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    train, held = train_items(spark, d), held_items(spark, d)
    hit = decontam.gram_hits(train, decontam.ref_grams(held)).groupBy("id").agg(F.count("*").alias("n_items"))
    equal = held.select(F.md5(T.norm_key("state")).alias("key")).distinct().withColumn("equal", F.lit(1))
    rows = train.select("id", "source", F.md5(T.norm_key("state")).alias("key")).join(hit, "id", "left").join(equal, "key", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("equal").alias("exact"), F.count("n_items").alias("grams"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("pairs"))


@query(f"""WITH k AS (SELECT doc_id, {DOC_KEY} AS key, (['validation', 'calibration', 'test'])[('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 3 + 1] AS part FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE part WHEN 'validation' THEN 0 WHEN 'calibration' THEN 1 ELSE 2 END, doc_id) AS r FROM k)
SELECT doc_id, part FROM r WHERE r = 1""")
def dedup_parts(spark: SparkSession, d: str) -> DataFrame:
    """Held-out parts without duplicates between them; the least (part, id) of a key stays, found by a partial aggregate."""
    from ..functions.keys import part_of

    rows = train_items(spark, d).select("id", F.md5(T.norm_key("state")).alias("key"), part_of(F.col("id")).alias("part"))
    rank = F.when(F.col("part") == "validation", 0).when(F.col("part") == "calibration", 1).otherwise(2)
    return rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "id", "part")).alias("m")).select(F.col("m.id").alias("doc_id"), "m.part")


@query("""WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), b AS (SELECT item_id, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark)
SELECT DISTINCT l.doc_id FROM l JOIN b USING (line) WHERE length(line) >= 40""")
def shared_long_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a line of 40 characters or more that a held-out text has."""
    line = lambda c: F.explode(F.transform(F.split(c, "\n"), F.trim)).alias("line")
    b = held_items(spark, d).select(line("state")).where(F.length("line") >= 40).distinct()
    return train_items(spark, d).select("id", line("state")).where(F.length("line") >= 40).join(b, "line", "left_semi").select(F.col("id").alias("doc_id")).distinct()


@query("""SELECT doc_id, conv_id FROM (SELECT d.doc_id, c.conv_id FROM labels d JOIN conversations c ON c.conv_id = d.doc_id % 50 AND c.turn = 0) WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = 2)""")
def drop_orphan_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Members of a group all of whose roles survive."""
    c = table(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.countDistinct("role").alias("n")).where("n = 2").select("conv_id")
    first = c.where("turn = 0").select("conv_id")
    return table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 50).alias("conv_id")).join(first, "conv_id").join(whole, "conv_id", "left_semi").select("doc_id", "conv_id")



