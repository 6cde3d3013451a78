"""One registered query for each operator of this package, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chats import format_chats
from .decontaminate import find_passages
from .jaccard import jaccard_groups
from .lexical import rank_documents
from .lines import dedup_lines
from .mixing import mix
from .quality import THRESHOLD, held_out, score_quality
from .secrets import KINDS, scan
from .substrings import dedup_substrings
from .texts import table
from .topk import integers, top_k
from .tokens import Vocabulary, count_tokens
from .toxicity import THRESHOLD as TOXIC
from .toxicity import score_toxicity
from .whitening import whiten

#: The piece table with scores that op7 counts by.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by inner product for every fiftieth vector."""
    points = integers(table(spark, sf_dir, "embeddings"))
    return top_k(points, points.where("vec_id % 50 = 0"))


OP1_SQL = """
WITH points AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
    FROM points q JOIN points p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored
)
WHERE rank <= 5
"""


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without lines that occur before, within two edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "row.doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of which documents lie in a ten-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


#: DuckDB text of a column with only A to Z in lower case.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), wanted AS (
    SELECT DISTINCT item_id, size, array_to_string(ws[start:start + size - 1], ' ') AS run
    FROM (
        SELECT item_id, ws, least(len(ws), 10) AS size,
               unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS start
        FROM items WHERE len(ws) > 0
    )
), placed AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM words
), ahead AS (
    SELECT doc_id, place, list(word) OVER (
        PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS following
    FROM placed
), found AS (
    SELECT doc_id, place, wanted.size, item_id
    FROM (
        SELECT doc_id, place, size, array_to_string(following[1:size], ' ') AS run
        FROM ahead, (SELECT DISTINCT size FROM wanted) sizes
        WHERE len(following) >= size
    ) runs JOIN wanted ON runs.size = wanted.size AND runs.run = wanted.run
), hits AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(place, place + size)) AS spot FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(item_list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by fixed patterns and by the randomness battery."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return scan(docs, keep=("doc_id",)).select(
        "row.doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


#: Shares of tokens by domain that op5 mixes to.
TARGETS = {"clean": 0.95, "junk": 0.05, "toxic": 0.0}


def domains_of(labels: DataFrame) -> DataFrame:
    """The labelled table as one domain for each document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(
        (F.col("toxic") == 0) & (F.col("quality") == 1), "clean"
    )
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is wanted so that domains reach their shares of tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, domains_of(table(spark, sf_dir, "labels")), TARGETS, exact=True)
    return mixed.select(
        "row.doc_id", "n_tokens",
        *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))],
        "rate", "copies",
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated passages of twenty words and more."""
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), placed AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place, len(ws) AS n
    FROM words
), windows AS (
    SELECT doc_id, word, place, place <= n - 19 AS whole, md5(string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS run
    FROM placed
), judged AS (
    SELECT doc_id, word, place, whole AND row_number() OVER (
        PARTITION BY run, whole ORDER BY doc_id, place) > 1 AS again
    FROM windows
), covered AS (
    SELECT doc_id, word, place, bool_or(again) OVER (
        PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM judged
), left_over AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
           string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept
    FROM covered GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)
"""


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the piece table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, Vocabulary.load(VOCABULARY), keep=("doc_id",))
    return counted.select("row.doc_id", "n_tokens")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of linked documents that each document belongs to."""
    return jaccard_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id"
    )


OP8_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''),
        '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), sets AS (
    SELECT doc_id, list_sort(CASE
        WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(
            range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
    END) AS own
    FROM words
), classes AS (
    SELECT doc_id, own, len(own) AS n, CASE WHEN len(own) = 0 THEN doc_id
        ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(own, chr(10)))) END AS class_id
    FROM sets
), entries AS (
    SELECT class_id, n, unnest(own) AS shingle FROM classes WHERE doc_id = class_id
), links AS (
    SELECT a.class_id AS a, b.class_id AS b
    FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.class_id <> b.class_id
    GROUP BY a.class_id, b.class_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
    SELECT DISTINCT class_id, class_id AS other FROM classes
    UNION
    SELECT reached.class_id, links.b FROM reached JOIN links ON reached.other = links.a
), components AS (
    SELECT class_id, min(other) AS component_id FROM reached GROUP BY class_id
)
SELECT doc_id, n AS n_shingles, component_id, class_id
FROM classes JOIN components USING (class_id)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document as learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order, without quotes."""
    chats = format_chats(table(spark, sf_dir, "conversations"))
    return chats.select(
        "conv_id", F.col("part.opening").alias("opening_block"), F.col("part.turn").alias("block"),
        "n_messages", "n_quotes", "n_linked", "chat",
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents that match each benchmark item's terms best."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sizes AS (
    SELECT place, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), counts AS (
    SELECT place, term, count(*) AS tf
    FROM (SELECT place, unnest(terms) AS term FROM words) GROUP BY place, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts CROSS JOIN totals GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) //
        (1000 * tf + 20 * (50 + (50 * n * docs) // totals.terms))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (place)
    CROSS JOIN totals
    GROUP BY item_id, place, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0 AND doc_id IS NOT NULL
)
WHERE rank <= 50
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the sixteen main components, scaled to unit variance."""
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(
        F.col("row.vec_id").alias("vec_id"), "n", "deviation", "explained", "identity_error",
        F.posexplode("whitened").alias("place", "whitened"),
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("place")).alias("explained"),
        "identity_error",
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document as learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


QUERIES = (
    op1_topk, op2_lines, op3_decontaminate, op4_secrets, op5_mixing, op6_substrings, op7_tokens,
    op8_jaccard, op9_quality, op10_chats, op11_lexical, op12_whitening, op13_toxicity,
)


def registered() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_texts() -> dict[str, str]:
    return {
        "op1_topk": OP1_SQL,
        "op3_decontaminate": OP3_SQL,
        "op6_substrings": OP6_SQL,
        "op8_jaccard": OP8_SQL,
        "op11_lexical": OP11_SQL,
    }
