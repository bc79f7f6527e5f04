"""One query per training-data operator, over its whole table.

Each applies the operator with production parameters and derives the columns
its contract asks for from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, chat_template, hard_negatives, jaccard_trie, mixing, order_minhash, pivot_index, quality_gam, sharding, spelling, toxicity_nb, training_order
from .common import Scratch, held_out, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


#: Shares of the tokens: sources follow from the data (large ones are brought down,
#: by any name), the topics are evened out.
MIX_TARGETS = {
    "source": mixing.Tempered(power=0.7, most=1000),
    "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    "topic": {f"t{i}": 0.125 for i in range(8)},
}
#: Share of the tokens that may be missing because a cell is too scarce.
MIX_SHORTFALL = 0.05


def op1_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity_nb.fit(docs, labels.filter(~out))
    return toxicity_nb.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, BYTE_BPE, decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_template.digest(chat_template.format_conversations(turns))


def op5_sharding_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op6_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    known = Scratch(spark, "mixing").put(mixing.describe(docs).drop("text"), "described")
    return mixing.mix(known, MIX_TARGETS, shortfall=MIX_SHORTFALL).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "taken")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_and_next(table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op8").path("out")
    manifest = training_order.write(table(spark, sf_dir, "documents"), path, RANKS, public_tokenizers.PATTERN)
    found = training_order.read(spark, path).drop("ids", "shard", "offset", "n_tokens")
    return manifest.join(found, "slot").select("slot", "shard", "offset", "n_tokens", "crc32", "doc_ids")


def op9_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_trie.components_by_jaccard(docs, n=5, percent=80)


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality_gam.fit(docs, labels.filter(~out))
    return quality_gam.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.counted(spelling.misspelt(spelling.runs(docs))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel=relabel)


QUERIES = {
    "op1_pivot_index": op1_pivot_index,
    "op2_toxicity_nb": op2_toxicity_nb,
    "op3_bpe_trie": op3_bpe_trie,
    "op4_chat_template": op4_chat_template,
    "op5_sharding_bfd": op5_sharding_bfd,
    "op6_mixing_ipf": op6_mixing_ipf,
    "op7_order_minhash": op7_order_minhash,
    "op8_training_order": op8_training_order,
    "op9_jaccard_trie": op9_jaccard_trie,
    "op10_quality_gam": op10_quality_gam,
    "op11_spelling": op11_spelling,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_pivot_index": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op9_jaccard_trie": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c.b, doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id""",
    "op11_spelling": """
        WITH RECURSIVE t AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        d AS (SELECT doc_id, run, count(*) AS k FROM t GROUP BY ALL),
        -- crc32, bit by bit
        x AS (SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS x FROM d),
        h AS (SELECT run, k, xor(4294967295, list_reduce(
                list_transform(range(0, 4 * length(x)), lambda i: (('0x' || substr(x, (2 * (i // 8) + 1)::INT, 2))::INT >> (i % 8)::INT) & 1),
                lambda c, b: xor(c >> 1, (xor(c, b::BIGINT) & 1) * 3988292384), 4294967295::BIGINT)) AS h FROM x),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, k FROM h),
        v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        -- words that differ by one letter share what is left when it is gone
        c AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
        g AS MATERIALIZED (SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS rest FROM c),
        l AS MATERIALIZED (
            SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM g a JOIN g b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM g a JOIN v b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM g a JOIN v b ON a.rest = b.word),
        f AS MATERIALIZED (
            SELECT v.word, v.n, count(l.b) AS n_near, arg_max(l.b, (l.bn, -o.o)) AS other, max(l.bn) AS m
            FROM v LEFT JOIN l ON l.a = v.word LEFT JOIN (SELECT word, row_number() OVER (ORDER BY word) AS o FROM v) o ON o.word = l.b
            GROUP BY v.word, v.n),
        e AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM f),
        r(word, root) AS (SELECT word, word FROM e UNION ALL SELECT r.word, e.form FROM r JOIN e ON e.word = r.root WHERE e.form IS NOT NULL)
        SELECT e.word, e.form, r.root, e.n, e.n_near, e.form_n
        FROM e JOIN r ON r.word = e.word JOIN e z ON z.word = r.root WHERE z.form IS NULL""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (
            SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
                   row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
            FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id,
               ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5""",
}
