"""The queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import audit
from .common import read
from .decontaminate import contaminated
from .exact_dedup import deduplicate
from .language import predict
from .licenses import scan_licenses
from .merkle import manifest
from .ngram_join import jaccard_components
from .pieces import encode_decode
from .quality import score_quality
from .substrings import remove_repeats
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .urls import judge

#: Files of public tokenizers (parameters of the queries).
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 1024


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("matches", lambda m: m["start"])
    return scan_licenses(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("matches").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("expressions", ";").alias("expressions"),
        "permissive",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"), BYTE_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), PIECE_BPE).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("restored").cast("long").alias("n_restored"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a benchmark passage in them: a row for each such pair."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).withColumn("words", F.array_join("words", " "))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM h) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE [x FOR x, i IN w IF NOT list_contains(ps, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE
c AS (SELECT *, list_reduce(flatten([[CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, (a % 2) * 3988292384) END, 4294967295) AS raw FROM documents),
f AS (SELECT doc_id, source, text, coalesce(xor(raw, 4294967295) % 5 = 0, false) AS tampered,
        coalesce(concat(octet_length(encode(CAST(doc_id AS VARCHAR))), ':', CAST(doc_id AS VARCHAR)), '-') AS f1, CASE WHEN source IS NULL THEN '-' ELSE concat(octet_length(encode(source)), ':', source) END AS f2,
        CASE WHEN lang IS NULL THEN '-' ELSE concat(octet_length(encode(lang)), ':', lang) END AS f3, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(length(CAST(n_chars AS VARCHAR)), ':', n_chars) END AS f4,
        CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END AS f5,
        CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS low FROM c),
d AS (SELECT doc_id, source, sha256(concat(f1, f2, f3, f4, f5)) AS leaf, CASE WHEN tampered THEN sha256(concat(f1, f2, f3, f4, low)) END AS other FROM f),
r AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
        count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT g, 0 AS l, p, leaf AS h, n FROM r
      UNION ALL SELECT g, l + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY g, l, p // 16),
s AS (SELECT g, h AS subroot, l AS height FROM t WHERE n = 1),
u AS (SELECT 0 AS l, g AS p, subroot AS h, count(*) OVER () AS n FROM s
      UNION ALL SELECT l + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY l, p // 16),
a AS (SELECT g, l, p, concat(coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '|',
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS x FROM t WHERE n > 1 WINDOW w AS (PARTITION BY g, l, p // 16 ORDER BY p)),
b AS (SELECT l, p, concat(coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '|',
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS x FROM u WHERE n > 1 WINDOW w AS (PARTITION BY l, p // 16 ORDER BY p)),
q AS (SELECT r.g, r.p, list(a.x ORDER BY a.l) AS xs FROM r JOIN a ON a.g = r.g AND a.p = r.p // CAST(16 ** a.l AS BIGINT) GROUP BY r.g, r.p),
o AS (SELECT s.g, list(b.x ORDER BY b.l) AS xs FROM s JOIN b ON b.p = s.g // CAST(16 ** b.l AS BIGINT) GROUP BY s.g),
z AS (SELECT doc_id, leaf, other, subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(q.xs, []), coalesce(o.xs, [])) AS xs
      FROM r JOIN s USING (g) LEFT JOIN q ON q.g = r.g AND q.p = r.p LEFT JOIN o ON o.g = r.g),
v AS (SELECT *, sha256(replace(array_to_string(xs, ''), '|', '')) AS proof_sha256,
        list_reduce(xs, lambda h, x: sha256(concat(split_part(x, '|', 1), h, split_part(x, '|', 2))), coalesce(other, leaf)) AS folded_root FROM z)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM v
"""


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(read(spark, sf_dir, "documents"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY t) AS repeats FROM w),
m AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
        [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
         regexp_matches(t, '[#$%&*|]'), repeats] AS f FROM e LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, CAST(unnest(range(1, 6)) AS INT) AS step FROM p),
x AS (SELECT part, good, toxic, n, o, step, f[o[step]] AS fails, list_bool_or([f[k] FOR k IN o[1:step - 1]]) AS gone, len([k FOR k IN f IF k]) AS total FROM c, s),
r AS (SELECT part, o, step, coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT fails), 0) AS kept,
        coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false)), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
        coalesce(sum(n) FILTER (fails AND total = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false) AND good), 0) AS good_lost,
        coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false) AND toxic), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, array_to_string(['ABCDE'[k] FOR k IN o], '') AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM r
"""


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_pieces": op5_pieces,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_urls": op9_urls,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_language": op12_language,
    "op13_audit": op13_audit,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op10_substrings": OP10_SQL, "op11_merkle": OP11_SQL, "op13_audit": OP13_SQL}
