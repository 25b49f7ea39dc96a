"""The registered queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import (
    bpe,
    chat,
    decontamination,
    lexical,
    line_dedup,
    merkle,
    near_dedup,
    neighbours,
    quality,
    sharding,
    site_style,
    substring_dedup,
    toxicity,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the fifth held out is never learnt from."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), _remainder(5) != 0)
    return toxicity.score_toxicity(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formatted conversations say, read back, with one that quotes the template."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(own), BYTE_BPE), BYTE_BPE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the third held out is never learnt from."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), _remainder(3) != 1)
    return quality.score_quality(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_lines(docs, line_dedup.repeated_lines(docs), removed="removed_lines")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = site_style.extract(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of the same mixture of sources."""
    rows = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their word pairs."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents without passages that earlier ones have."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs, substring_dedup.repeats(docs)).drop("text")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and tampered versions of the documents' Merkle tree."""
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("copied")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontamination,
        op3_nearest_neighbours,
        op4_bpe,
        op5_chat_formatting,
        op6_quality,
        op7_line_dedup,
        op8_html_extraction,
        op9_sharding,
        op10_near_dedup,
        op11_substring_dedup,
        op12_lexical_search,
        op13_merkle_manifest,
    )
}

#: Exact containment of items in whole documents, which the search must find in full.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), x -> x <> '') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), i -> array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) >= 5
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), x -> x <> '') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), i -> array_to_string(w[i:i + 4], ' '))) AS s
  FROM b WHERE len(w) >= 5
), n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles
HAVING count(*) / item_shingles >= 0.8
"""

#: Windows of 13 words as texts, each with the least document that has it.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT row_id, doc_id, unnest(range(1, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS said
  FROM d WHERE len(w) >= 13
), f AS (SELECT said, min(doc_id) AS least FROM s GROUP BY said
), g AS (
  SELECT DISTINCT row_id, unnest(range(pos, pos + 13)) AS place FROM s JOIN f USING (said) WHERE doc_id > least
), u AS (SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d
), k AS (SELECT row_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM u ANTI JOIN g USING (row_id, place) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row_id)
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), d AS (SELECT row_number() OVER () AS row_id, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0
), total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), p AS (
  SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, total GROUP BY term, docs
), s AS (
  SELECT item_id, row_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (row_id), total GROUP BY item_id, row_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s JOIN d USING (row_id) WHERE score > 0
QUALIFY rank <= 50
"""


def _merkle_sql(levels: int = 6) -> str:
    """The tree of up to 16 ** levels rows of a source, and as many sources.

    ``prefix`` gathers the siblings, ``folded`` follows the (tampered) leaf upwards.
    """
    field = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    plain = " || ".join(field.format(f"{n}::VARCHAR") for n in merkle.FIELDS)
    forged = plain.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    # The check sum of the decimal id, bit by bit.
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )
    parts = [
        f"""WITH l0 AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, sha256({plain}) AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN sha256({forged}) ELSE sha256({plain}) END AS folded
  FROM documents
), n0 AS (
  SELECT source, leaf AS node, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_id FROM l0
), p0 AS (
  SELECT l0.row_id, l0.doc_id, l0.source, leaf, folded, '' AS proof, place, leaf AS top
  FROM l0 JOIN n0 ON l0.row_id = n0.row_id
)"""
    ]

    def raise_(k: int) -> str:
        # A run's nodes in one list; the node's own place in it splits the siblings.
        return f"""r{k} AS (
  SELECT source, place // 16 AS up, list(node ORDER BY place) AS nodes, max(among) AS among
  FROM (SELECT source, place, node, count(*) OVER (PARTITION BY source) AS among FROM n{k}) GROUP BY ALL
), n{k + 1} AS (
  SELECT source, up AS place, CASE WHEN among > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM r{k}
), p{k + 1} AS (
  SELECT row_id, doc_id, p{k}.source, leaf, sub, place // 16 AS place,
    CASE WHEN among > 1 THEN sha256(array_to_string(nodes[:place % 16], '') || folded || array_to_string(nodes[place % 16 + 2:], '')) ELSE folded END AS folded,
    proof || CASE WHEN among > 1 THEN array_to_string(nodes[:place % 16], '') || array_to_string(nodes[place % 16 + 2:], '') ELSE '' END AS proof
  FROM p{k} JOIN r{k} ON p{k}.source IS NOT DISTINCT FROM r{k}.source AND place // 16 = up
)"""

    parts[0] = parts[0].replace("place, leaf AS top", "place, '' AS sub")
    parts += [raise_(k) for k in range(levels)]
    at = levels + 1
    parts.append(f"""n{at} AS (
  SELECT NULL::VARCHAR AS source, node, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, source AS of FROM n{levels}
), p{at} AS (
  SELECT row_id, doc_id, NULL::VARCHAR AS source, leaf, node AS sub, n{at}.place, folded, proof
  FROM p{levels} JOIN n{at} ON p{levels}.source IS NOT DISTINCT FROM of
)""")
    parts += [raise_(k) for k in range(at, at + levels)]
    end = at + levels
    return ", ".join(parts) + f"""
SELECT doc_id, leaf, sub AS subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM p{end} JOIN n{end} USING (place)"""


OP13_SQL = _merkle_sql()

SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op11_substring_dedup": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
