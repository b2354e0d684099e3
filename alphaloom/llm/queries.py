"""Registered queries of this package and their DuckDB SQL: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import collocations, decontaminate, hmm, line_dedup, near_dedup, ns_clusters, packing, quality_rules, simhash, substring_dedup, token_counts, toxicity, warc_zip
from alphaloom.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: DuckDB: words between ASCII white space
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def native(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query that runs no Python on the executors."""
    QUERIES[build.__name__] = build
    return build


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query whose tasks import this package."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier document has too."""
    out = substring_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
f AS (SELECT k, min(doc_id) AS first_doc FROM g GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN f USING (k) WHERE first_doc < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM t ANTI JOIN hit USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


@native
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), "source", "text")
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op2_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT doc_id, source, unnest(ls) AS line FROM d),
n AS (SELECT source, line, count(*) AS pages_with FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
bad AS (SELECT n.source, list(line) AS lines FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source
        WHERE pages_with >= {line_dedup.MIN_PAGES} AND pages_with > {line_dedup.RATIO} * pages GROUP BY 1),
k AS (SELECT d.*, CASE WHEN bad.lines IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad.lines, x)) END AS kept
      FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, CAST(coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k"""


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to ZIP packages and read back by byte ranges."""
    out = warc_zip.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a quarter of the labels is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    out = toxicity.score(docs, toxicity.train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@native
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the weakly supervised verdict for every document."""
    out = quality_rules.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    out = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


@native
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op9_decontaminate"] = r"""
WITH low AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
       FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n)),
hit AS (SELECT DISTINCT dw.id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cover AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY id)
SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.id = cover.id LEFT JOIN items ON d.id = items.id"""


@query
def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document; a fifth of the documents is held out of the training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = hmm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_ns_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three exact rounds, with the inertia and the centroid's digest."""
    out = ns_clusters.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op11_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """A pair of CTEs for each round: vectors to their nearest centroid, then the floors of the means."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS (SELECT rid, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS m
  FROM (SELECT rid, v, j, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM q, c{t}) GROUP BY rid)""")
        if t < rounds:
            steps.append(f"""
s{t} AS (SELECT j, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT m.j AS j, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM a{t}) GROUP BY j, i),
n{t} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{t} GROUP BY j),
c{t + 1} AS (SELECT j, coalesce(n{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN n{t} USING (j))""")
    return f"""
WITH q AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS j, v AS c FROM q WHERE vec_id IS NOT NULL QUALIFY j < {k}),{",".join(steps)},
t AS (SELECT m.j AS j, CAST(sum(m.d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(m.j AS INT) AS cluster, m.d AS distance, cluster_inertia, (SELECT CAST(sum(m.d) AS BIGINT) FROM a{rounds}) AS inertia,
  sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN q USING (rid) JOIN t ON t.j = m.j JOIN c{rounds} ON c{rounds}.j = m.j"""


ORACLE["op11_ns_clusters"] = _op11_sql()


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component that links of at most two differing bits make."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored phrases of two and three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE["op13_collocations"] = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(x, '[ 	]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS x FROM t)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p) GROUP BY ALL),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {collocations.LEAST}),
x AS (SELECT lang, phrase, k, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT x.lang, x.phrase, x.k, a, min(struct_pack(s := CAST((1000000::HUGEINT * a * a) // (fl.n::HUGEINT * fr.n) AS BIGINT), cut := cut, l := fl.n, r := fr.n)) AS m
  FROM x JOIN f AS fl ON fl.lang = x.lang AND fl.phrase = lp JOIN f AS fr ON fr.lang = x.lang AND fr.phrase = rp GROUP BY ALL),
g AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT s.lang, s.phrase, a, m.l AS l, m.r AS r, m.s AS score, row_number() OVER (PARTITION BY s.lang ORDER BY m.s DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN g ON g.lang = s.lang AND g.phrase = s.phrase AND s.k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= {collocations.TOP}),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT o.lang, rank, phrase, a, l, r, n.n AS n, score FROM o JOIN n USING (lang)"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
