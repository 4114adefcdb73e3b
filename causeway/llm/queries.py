"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, decontaminate, embeddedup, linededup, packing, quality, sharding, simhash, suffixdedup, tokencount, toxicity, urlfilter
from .common import keep_only, table

SHARDS = 24
#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
THRESHOLD = 0.3


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), overlap=0.8)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(
        table(spark, sf_dir, "documents"), sharding.regular_tree(SHARDS), sharding.regular_tree(SHARDS + 1)
    )
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = toxicity.fit(docs, labels, ~held_out)
    scored = toxicity.score(keep_only(docs, doc_id="long", text="string"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, URL_RULES), default="allow")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keep_only(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    out = linededup.dedup_lines(docs, min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), reach=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # many repeated passages of over 50 words are under 400 bytes: they are told (n_shared), not removed
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), width=400)
    return out.select(
        "doc_id", "n_bytes", "n_removed", suffixdedup.span_count("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared"
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = quality.fit(docs, labels, ~held_out)
    scored = quality.score(keep_only(docs, doc_id="long", text="string"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, dims=64, rounds=10, scale=1024, salt="3:")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_decontamination,
            op2_sharding,
            op3_packing,
            op4_toxicity,
            op5_url_filter,
            op6_line_dedup,
            op7_simhash,
            op8_suffix_dedup,
            op9_embedding_dedup,
            op10_quality,
            op11_centroids,
            op12_collocations,
            op13_token_counts,
        )
    }


def _u(level: str, child: str) -> str:
    return f"ln((CAST('0x' || md5('{level}' || {child} || ':' || doc_id)[1:13] AS BIGINT) + CAST(0.5 AS DOUBLE)) / pow(2, 52))"


#: CRC-32 by its table; the draws of the tree of 24 shards, and of 25, whose last region has one rack and one shard.
SQL_SHARDING = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
r AS (SELECT doc_id, arg_max(region, {_u('region', 'region')} / 8) AS region, max({_u('region', 'region')} / 8) AS best FROM documents, range(3) x(region) GROUP BY doc_id),
k AS (SELECT doc_id, arg_max(rack, {_u('rack', 'rack')} / 4) AS rack FROM r, range(6) x(rack) WHERE rack // 2 = region GROUP BY doc_id),
s AS (SELECT doc_id, arg_max(shard, {_u('shard', 'shard')}) AS shard FROM k, range(24) x(shard) WHERE shard // 4 = rack GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || md5('slot:' || doc_id)[1:3] AS INT) % 1024, doc_id) - 1 AS slot,
    CAST(CASE WHEN {_u('region', '3')} > best THEN 24 ELSE shard END AS INT) AS grown_shard
FROM c JOIN r USING (doc_id) JOIN s USING (doc_id)
"""

SQL_URL_FILTER = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                                           ('allow','com','/fr/'), ('block','com','/de/')),
u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM u),
f AS (SELECT p.n, arg_max(r.host || r.path, (length(r.host || r.path), r.verdict = 'block', r.host || r.path)) AS rule,
             arg_max(r.verdict, (length(r.host || r.path), r.verdict = 'block', r.host || r.path)) AS verdict
      FROM p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""

SQL_LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: Anchors: the leftmost gram of 8 bytes of the least hash in each window of 147; pieces: 128 bytes from an anchor on.
SQL_SUFFIX_DEDUP = rf"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 399)) AS s, b FROM d WHERE n >= 400),
h AS (SELECT doc_id, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM h SEMI JOIN r USING (h)),
g AS (SELECT doc_id, s, count(*) FILTER (gap IS NULL OR gap > 400) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM m),
c AS (SELECT doc_id, span, min(s) AS a, max(s) + 400 AS e FROM g GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM c
      UNION ALL SELECT doc_id, max(e), max(n) FROM c JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, coalesce(string_agg(hex(array_slice(b, f + 1, t)), '' ORDER BY f) FILTER (t > f), '') AS x
         FROM k JOIN d USING (doc_id) GROUP BY doc_id),
tot AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id),
same AS (SELECT b FROM d GROUP BY b HAVING count(*) > 1),
q AS (SELECT min(doc_id) AS one, b, any_value(n) AS n FROM d WHERE n >= 154 GROUP BY b),
y AS (SELECT one, n, b, i, hex(array_slice(b, i + 1, i + 8)) AS x FROM (SELECT one, n, b, unnest(range(0, n - 7)) AS i FROM q)),
u AS (SELECT one, i, n, CAST((CAST(CAST('0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS UBIGINT) AS UHUGEINT)
      * CAST('11400714819323198485' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) // CAST('4294967296' AS UHUGEINT) AS UBIGINT) | CAST(1 AS UBIGINT) AS v FROM y),
o AS (SELECT one, i, n, min(CAST(v AS HUGEINT) * 4294967296 + i) OVER (PARTITION BY one ORDER BY i ROWS BETWEEN CURRENT ROW AND 146 FOLLOWING) AS best FROM u),
a AS (SELECT DISTINCT one, CAST(best % 4294967296 AS BIGINT) AS a FROM o WHERE i + 154 <= n),
z AS (SELECT one, a, md5(array_slice(b, a + 1, a + 128)) AS h FROM a JOIN q USING (one) WHERE a + 128 <= n),
t AS (SELECT one, a FROM z SEMI JOIN (SELECT h FROM z GROUP BY h HAVING count(*) > 1) USING (h)),
s AS (SELECT one, CAST(sum(least(128, coalesce(next - a, 128))) AS BIGINT) AS n_shared FROM (SELECT *, lead(a) OVER (PARTITION BY one ORDER BY a) AS next FROM t) GROUP BY one)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(x), d.b)) AS kept_sha256,
       CASE WHEN same.b IS NOT NULL AND d.n >= 128 THEN CAST(d.n AS BIGINT) ELSE coalesce(n_shared, 0) END AS n_shared
FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN same ON same.b = d.b LEFT JOIN s ON one = d.doc_id
"""

SQL_EMBEDDING_DEDUP = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON n = vec_id LEFT JOIN k ON a = vec_id
"""


def _sql_centroids() -> str:
    """Ten rounds, each a step of its own: d is the distance of each vector to each centroid, floor division by hand."""
    nearest = "SELECT n, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT n, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, {c}) GROUP BY n, x"
    steps = [
        "e AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)",
        "v AS MATERIALIZED (SELECT vec_id, n, list_transform(e, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS x FROM e WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY k LIMIT 8)",
    ]
    for i in range(10):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})",
            f"s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS m FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY k, j)",
            f"m{i} AS (SELECT k, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))",
        ]
    return f"""WITH {", ".join(steps)}, a AS ({nearest.format(c='c10')})
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN v USING (n) JOIN c10 USING (k)"""


SQL_COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM w),
g AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM t),
x1 AS MATERIALIZED (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
x2 AS MATERIALIZED (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
x3 AS MATERIALIZED (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(a) AS n FROM x1 GROUP BY lang),
u AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.a, 1 AS j, l.a AS l, r.a AS r FROM x2 c
          JOIN x1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN x1 r ON r.lang = c.lang AND r.w1 = c.w2
      UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, 1, l.a, r.a FROM x3 c
          JOIN x1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN x2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
      UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, 2, l.a, r.a FROM x3 c
          JOIN x2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2 JOIN x1 r ON r.lang = c.lang AND r.w1 = c.w3),
s AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM u),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM x3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM x3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_centroids": _sql_centroids(),
        "op12_collocations": SQL_COLLOCATIONS,
        "op2_sharding": SQL_SHARDING,
        "op8_suffix_dedup": SQL_SUFFIX_DEDUP,
        "op9_embedding_dedup": SQL_EMBEDDING_DEDUP,
        "op5_url_filter": SQL_URL_FILTER,
        "op6_line_dedup": SQL_LINE_DEDUP,
    }
