"""The registered queries of this subpackage and their SQL.

Each ``opN`` query applies operator N to its whole table. SQL twins exist
where SQL can express the result; the other queries are held against
brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, filter_audit, imatch, kmeans_tree, langid, nbest, near_dup, packing, periodic, \
    pieces, pii, url_filter, warc
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


# The rules of op1 as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op1_url_rules", """
WITH r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
        ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
    AS v(rhost, rpath, rverdict)),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
        ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.k, p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.rverdict,
        row_number() OVER (PARTITION BY p.k ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST,
                           length(r.rhost) DESC NULLS LAST) AS rn
    FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost))
        AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE rn = 1
""")
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged by the five fixed rules, ``allow`` by default."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans,
    all spans (also those found by deobfuscation) as text."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.find_spans(F.col("text")).alias("spans"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.filter(base, lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Eight draws, from a quarter of the lexicon down by halves: also a long text has subsets with one to three of its terms.
IMATCH_SUBSETS = [tuple(1 / 2 ** (2 + k) for k in range(8))] * 8


@query("op3_imatch")
def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprints(read_table(spark, sf_dir, "documents"), subsets=IMATCH_SUBSETS)


#: A SentencePiece vocabulary file; any other can be given to the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op4_nbest")
def op4_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document: score, number of pieces,
    digest of the ids, and whether decoding them gives the text back."""
    docs = read_table(spark, sf_dir, "documents")
    paths = nbest.encoded(spark, F.col("text"), pieces.read_model(PIECES), n=4, with_ids=False)
    return docs.select("doc_id", F.posexplode(paths).alias("rank", "path")).select(
        "doc_id", (F.col("rank") + 1).alias("rank"), "path.score", "path.n_pieces", "path.ids_sha256", "path.decoded")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces and score of the best segmentation of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.token_counts(spark, F.col("text"), pieces.read_model(PIECES)).alias("c")) \
        .select("doc_id", F.col("c.n").alias("n_tokens"), F.col("c.score").alias("score"))


@query("op6_neighbours")
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of each vector whose id is divisible by 50."""
    return kmeans_tree.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CASE WHEN url IS NULL THEN '' ELSE split_part(
        CASE WHEN regexp_matches(url, '(?s)://.') THEN url[strpos(url, '://') + 3:] ELSE url END, '#', 1) END AS u FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest, CASE WHEN u = '' THEN '' ELSE lower(array_to_string(list_reverse(
        string_split(split_part(u, '/', 1), '.')), ',') || ')' || CASE WHEN strpos(u, '/') > 0
        THEN u[strpos(u, '/'):] ELSE '' END) END AS urlkey,
        strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to, urlkey, timestamp,
    row_number() OVER (ORDER BY urlkey, timestamp, page_id) AS position FROM m
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their merged
    index, with its place in the global order of captures. The pages have no
    capture time: one second a page id stands in."""
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    index = warc.archive_and_index(read_table(spark, sf_dir, "pages"), time)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "urlkey", "timestamp", "position")


NEAR_DUP_SQL = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS z FROM s UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.z = e.u),
c AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY 1)"""


@query("op8_near_duplicates", "WITH RECURSIVE" + NEAR_DUP_SQL.format(docs="documents") + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)""")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of five-word shingles are linked at 85%."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> langid.Model:
    """Fitted on rows that aren't held out."""
    return langid.fit(docs, ~langid.held_out(F.col("doc_id")))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that never sees the held-out
    quarter; also the number of one-language spans."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", langid.identify(docs, language_model(docs)).alias("found"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
                        F.size("found.spans").alias("n_spans"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in length-bucketed batches: at most 4096 words a
    sequence, 16 buckets, 65,536 padded words a batch."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(F.col("text")))


@query("op11_filter_audit", r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)) AS good, max(coalesce(toxic = 1, FALSE)) AS toxic
    FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
        CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS mask
    FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM m GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, b)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
    WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, letter, b, coalesce(sum(b) OVER (PARTITION BY filter_order ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
    FROM (SELECT filter_order, CAST(i AS INT) AS step, substr(filter_order, i, 1) AS letter
        FROM o, range(1, 6) r(i)) JOIN f USING (letter)),
x AS (SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER ((mask & (before | b)) = 0), 0) AS kept,
        coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & b) <> 0), 0) AS removed,
        coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & b) <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
        coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & b) <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & b) <> 0), 0) AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM x
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders: what each step removes, by language."""
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op12_chat_format")
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, written by
    the instruction template and read back, with the verdict on its turn order."""
    own = ["conv_id", "turn", "role", "text"]
    tricky = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = read_table(spark, sf_dir, "conversations").select(own)
    turns = turns.unionByName(spark.createDataFrame(tricky, "conv_id long, turn long, role string, text string"))
    order = chat_format.turn_order(turns).select(F.col("conv_id").alias("id"), "valid", "first_bad")
    read = chat_format.digests(chat_format.format_turns(turns))
    return read.join(order, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


@query("op13_periodic")
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document (of one in ten with a repeated end):
    their number and digest, the one of greatest exponent, and the digest of
    the words without the repetitions."""
    docs = read_table(spark, sf_dir, "documents")
    words = docs.select("doc_id", periodic.split_words(F.col("text")).alias("words"))
    found = periodic.periodic_runs(words, periodic.repeated_tail(F.col("words"), F.col("doc_id")))
    top = F.when(F.size("runs") > 0, periodic.greatest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    collapsed = F.sha2(F.array_join(periodic.kept_words(F.col("words"), F.col("runs")), " "), 256)
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"top.{c}") for c in ("start", "length", "period")],
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.when(F.size("runs") > 0, collapsed).otherwise(F.col("plain_sha256")).alias("collapsed_sha256"))
