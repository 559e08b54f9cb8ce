"""One query per operator over its whole table, with production parameters.

SQL stands beside a query only where SQL over whole tables can express it in reasonable time; the
others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscan.llm import (
    bpe,
    decontaminate,
    edit_embedding,
    fill_in_middle,
    html_extract,
    importance,
    jaccard_join,
    line_dedup,
    prefix_trie,
    quality_rules,
    suffix_dedup,
    token_files,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(build):
    QUERIES[build.__name__] = build
    return build


def trusted(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the documents that labels call good: the trusted target of the quality operators."""
    return table(spark, sf, "labels").filter("quality = 1").select("doc_id")


@query
def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the token files of ``documents`` and lists what they hold."""
    folder = token_files.new_folder(spark, "tokens")
    path = tokenizer_path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf, "documents"), path, folder, end_id=2)
    return token_files.token_index(spark, folder)


@query
def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf, "documents"), percent=90, shingle_words=3)


@query
def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf, "documents"), min_docs=10)


SQL["op4_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, pos, unnest AS line, trim(translate(unnest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(ls) AS unnest, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM hot)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""


@query
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf, "documents"))


@query
def op6_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf, "pages"))


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = quality_rules.quality_rules(docs, trusted(spark, sf))
    return found.select("doc_id", *quality_rules.RESULTS)


@query
def op10_importance(spark: SparkSession, sf: str) -> DataFrame:
    """A sample as large as the share of trusted documents among the labelled ones."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    k = -int(-importance.trusted_share(labels) * docs.count() // 1)
    return importance.importance_sample(docs, trusted(spark, sf), k)


@query
def op11_edit_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and the class of near copies it belongs to."""
    return edit_embedding.fingerprint_classes(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL["op12_fill_in_middle"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents),
tokens AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM texts),
cut AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


SQL["op13_prefix_trie"] = r"""
WITH original AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns FROM original GROUP BY conv_id),
steps AS (
  SELECT conv_id, turns, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda d: list_prepend(CAST(1000 + ascii(d) AS UBIGINT), list_transform(range(8), lambda i: CAST(0 AS UBIGINT)))))),
    lambda c, x: CASE WHEN x >= 1000 THEN xor(c, CAST(x - 1000 AS UBIGINT)) ELSE xor(c >> 1, CAST(3988292384 * (c & 1) AS UBIGINT)) END) AS crc FROM lists),
h AS (SELECT conv_id, turns, CAST(xor(crc, CAST(4294967295 AS UBIGINT)) % 4 AS BIGINT) AS h FROM steps),
built AS (
  SELECT h.conv_id, list_concat(coalesce(f.turns, [])[1:h.h], h.turns[h.h + 1:]) AS seq
  FROM h LEFT JOIN lists f ON f.conv_id = h.conv_id - h.conv_id % 20),
paths AS (SELECT conv_id, len(seq) AS size, d, md5(CAST(seq[1:d] AS VARCHAR)) AS node, seq[d] AS last
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(len(regexp_extract_all(any_value(last.text), '[^ 	-
]+')), 0) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM paths GROUP BY d, node),
links AS (SELECT n.d, n.node, p.node AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM links GROUP BY ALL),
own AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * n.words END AS saved
  FROM nodes n LEFT JOIN kids k USING (d, node)),
totals AS (
  SELECT p.d, p.node, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(o.saved) AS saved_tokens
  FROM own o JOIN paths p ON p.conv_id = o.conv_id AND p.d <= o.d GROUP BY ALL)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN totals t USING (d, node) LEFT JOIN links l ON l.d = o.d AND l.node = o.node
  LEFT JOIN nodes q ON q.d = o.d - 1 AND q.node = l.parent
"""
