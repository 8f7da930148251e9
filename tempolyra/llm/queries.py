"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .bpe import encode_documents
from .common import crc_mod, table
from .decontaminate import find_overlaps
from .exact_dedup import exact_dedup
from .line_dedup import drop_recurring_lines
from .lm import lm_scores
from .negatives import mine_negatives
from .periodic import find_runs
from .pii import BASE_KINDS, KINDS, find_pii
from .quality import fit_quality, score_quality
from .simhash import simhash_dedup
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("p_toxic").alias("score"),
        (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"),
        F.to_json("p_links").alias("links"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS if k not in BASE_KINDS],
        F.size("spans").cast("long").alias("n_all"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("__dropped").alias("n_dropped"), "text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "overlap").distinct()


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a tenth of the documents are made periodic from a word on; only there the words are counted in SQL
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.size(F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")).cast("long")
    fold = F.expr("CASE WHEN h % 10 = 0 AND n > 0 THEN struct(g % n AS start, 1 + (n - g % n) div (3 + g % 8) AS period) END")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), g.cast("long").alias("g"))
    docs = docs.withColumn("n", F.when(F.col("h") % 10 == 0, words))
    return find_runs(docs, fold=fold, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_lm": op2_lm,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe": op9_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = r"""regexp_split_to_array(trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')"""

def _recurring(rows: str, key: str) -> str:
    """SQL for the keys of rows (key, own, lo, hi) that stand in five classes: rows that are not own and share lo
    or hi are one, here by the smallest number of the rows that each reaches."""
    return f"""
        SELECT {key} FROM (
            WITH RECURSIVE p AS (SELECT DISTINCT {key}, own, lo, hi FROM {rows}),
            n AS (SELECT *, row_number() OVER (ORDER BY {key}, own, lo, hi) AS i FROM p),
            reach AS (SELECT {key}, i, i AS j FROM n WHERE NOT own
                      UNION SELECT r.{key}, r.i, b.i FROM reach r JOIN n a ON a.i = r.j JOIN n b ON b.{key} = a.{key} AND NOT b.own AND (b.lo = a.lo OR b.hi = a.hi) AND b.i < r.i)
            SELECT {key}, lo AS class FROM p WHERE own
            UNION ALL SELECT DISTINCT {key}, CAST(min(j) AS VARCHAR) FROM reach GROUP BY {key}, i)
        GROUP BY {key} HAVING count(DISTINCT class) >= 5"""


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op7_line_dedup": f"""
        WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split),
        t AS (SELECT doc_id, pos, list_transform(regexp_split_to_array(trim(line, {_BLANKS}), '[\\x20\\x09-\\x0D]+'),
                  lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
        f AS (SELECT doc_id, pos, w, md5(len(w) || chr(31) || array_to_string(w[1:3], chr(31))) AS leaf FROM t WHERE len(w) >= 3),
        often AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
        o AS (SELECT doc_id, count(DISTINCT leaf) AS n, coalesce(list_sort(list(DISTINCT leaf) FILTER (leaf IN (SELECT leaf FROM often))), []) AS h FROM f GROUP BY doc_id),
        c AS (SELECT o.doc_id, h, len(h) < n AND (len(h) <= 3 OR n - len(h) >= n / 3) AS own, md5(coalesce(text, '')) AS whole FROM o JOIN documents USING (doc_id)),
        keys AS (SELECT doc_id, pos, w, leaf, own,
                     CASE WHEN own THEN whole ELSE coalesce(CASE WHEN leaf = h[1] THEN h[2] ELSE h[1] END, '') END AS lo,
                     CASE WHEN own THEN whole ELSE coalesce(CASE WHEN leaf = h[-1] THEN CASE WHEN len(h) > 1 THEN h[-2] END ELSE h[-1] END, '') END AS hi
                 FROM f JOIN often USING (leaf) JOIN c USING (doc_id)),
        near AS (SELECT * FROM keys WHERE leaf IN ({_recurring("keys", "leaf")})),
        placed AS (SELECT doc_id, pos, leaf, own, lo, hi, unnest(range(len(w))) AS k, unnest(w) AS token FROM near),
        const AS (SELECT leaf, k, token FROM placed WHERE token <> '<*>'
                  GROUP BY leaf, k, token HAVING count(DISTINCT lo) >= 5),
        tmpl AS (SELECT doc_id, pos, any_value(own) AS own, any_value(lo) AS lo, any_value(hi) AS hi,
                     string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.k) AS template
                 FROM placed p LEFT JOIN const c ON p.leaf = c.leaf AND p.k = c.k AND p.token = c.token
                 GROUP BY doc_id, pos HAVING count(c.token) >= 0.7::DOUBLE * count(*) FILTER (p.token <> '<*>') AND count(c.token) * 2 >= count(*)),
        gone AS (SELECT doc_id, list(pos) AS g FROM tmpl WHERE template IN ({_recurring("tmpl", "template")}) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(g), 0) AS n_dropped,
               CASE WHEN g IS NULL THEN text
                    ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(g, i)), lambda i: ls[i + 1]), chr(10)) END AS text
        FROM split LEFT JOIN gone USING (doc_id)
    """,
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        masks(m, a, b, c, d, e) AS (VALUES (0, 0, 1, 2, 3, 4), (1, 0, 1, 3, 5, 6), (2, 0, 2, 3, 4, 7)),
        dp AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
        bp AS (SELECT item_id, w, unnest(range(len(w))) AS p FROM b WHERE len(w) > 4),
        dk AS (SELECT doc_id, p, m, concat_ws(' ', w[p+1+a], w[p+1+b], w[p+1+c], w[p+1+d], w[p+1+e]) AS k
               FROM dp, masks WHERE p + e < len(w)),
        bk AS (SELECT item_id, p, m, concat_ws(' ', w[p+1+a], w[p+1+b], w[p+1+c], w[p+1+d], w[p+1+e]) AS k
               FROM bp, masks WHERE p + e < len(w)),
        lines AS (SELECT DISTINCT doc_id, item_id, dk.p - bk.p AS shift FROM dk JOIN bk USING (m, k)),
        steps AS (SELECT doc_id, item_id, shift, d.w AS dw, b.w AS bw,
                         unnest(range(greatest(0, -shift), least(len(b.w), len(d.w) - shift))) AS k
                  FROM lines JOIN d USING (doc_id) JOIN b USING (item_id)),
        sums AS (SELECT doc_id, item_id, shift, k, len(bw) AS n,
                        sum(CASE WHEN bw[k+1] = dw[k+shift+1] THEN 1 ELSE -4 END)
                            OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS s
                 FROM steps),
        runs AS (SELECT doc_id, item_id, n, s - least(0, min(s) OVER (
                     PARTITION BY doc_id, item_id, shift ORDER BY k)) AS run FROM sums)
        SELECT doc_id, item_id, CAST(max(run) AS BIGINT) AS overlap FROM runs
        GROUP BY doc_id, item_id, n HAVING max(run) >= least(10, n)
    """,
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(s) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "op11_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
                   CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
    """,
}
