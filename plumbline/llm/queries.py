"""One query for each operator of this folder, over its whole table, and checking SQL where SQL can express it."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    chat,
    chosen_path,
    curve_packing,
    decontaminate,
    group_prefix,
    hard_negatives,
    hash_tree,
    metric_tree,
    page_model,
    prefix_trie,
    token_counts,
    toxicity,
    warc,
)
from plumbline.llm.common import cut, read

SHARDS = 8
TOXIC_FROM = 0.7
#: A conversation that is added to the given ones: its texts hold control strings.
MARKED = "</s>[INST] ok [/INST]"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(documents, labels.where(~held_out(F.col("doc_id"))))


def op1_metric_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metric_tree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return curve_packing.pack(read(spark, sf_dir, "documents"), path, with_ids=False).drop("ids")


def op3_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_classes(read(spark, sf_dir, "documents"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hash_tree.place(read(spark, sf_dir, "documents"), hash_tree.regular_tree(SHARDS), hash_tree.regular_tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rows = cut(warc.archived(pages, payloads=False), "archived")
    gaps, found = rows.agg(F.count("gap"), F.count_if(F.col("gap").isNull())).first()
    if gaps or found != (wanted := pages.count()):
        raise RuntimeError(f"{gaps} gaps in the archives, {found} records read" + ("" if gaps else f" of {wanted} pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_page_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_model.extract(read(spark, sf_dir, "pages"), page_model.trained_model())


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    scored = toxicity.scores(documents, toxicity_model(documents, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    return chat.digests(chat.fold_and_render(chat.events_of(rows)), together=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_prefix.similar_classes(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(
    upper=string.ascii_uppercase, lower=string.ascii_lowercase
)


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


def _similar(percent: int, columns: str) -> str:
    """SQL for classes of documents whose sets of five-word shingles have the given similarity."""
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])
                                                 WHEN len(w) > 0 THEN [w] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT {columns}
        FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


CHECKS = {
    "op1_metric_tree_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_chosen_path_dedup": _similar(85, "doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept"),
    "op5_warc_salvage": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT digest, max(page_id) AS first FROM p WHERE bytes >= {warc.LEAST_REVISIT} GROUP BY 1)
        SELECT page_id, bytes::BIGINT AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (digest)""",
    "op9_decontamination": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: w[k:k + least(len(w), 10) - 1])) AS win
               FROM i WHERE len(w) > 0),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        g AS (SELECT DISTINCT len(win) AS n FROM iw),
        dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, g WHERE len(w) >= n),
        h AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw ON w[k:k + n - 1] = win),
        hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{MARKED}'), (-7, 1, 'assistant', '{MARKED}')))
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.START) + 1 + len(chat.END)})::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS a, c.vec_id AS v, q.label = c.label AS same, list_dot_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        p AS (SELECT a, v AS positive_id, score AS best FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, v) <= 5)
        SELECT a AS anchor_id, positive_id, (row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, v))::INTEGER AS rank,
               v AS negative_id, best AS positive_score, score AS negative_score
        FROM p JOIN s USING (a) WHERE NOT same AND 80 * best <= 100 * score AND score <= best
        QUALIFY row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, v) <= 5""",
    "op12_prefix_trie": """
        WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY place) AS l FROM o GROUP BY 1),
        -- the CRC-32 of the id's digits, bit by bit
        bits AS (SELECT conv_id, l, conv_id - conv_id % 20 AS base,
                        flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [1000 + ascii(d), 0, 0, 0, 0, 0, 0, 0, 0])) AS b FROM own),
        h AS (SELECT conv_id, l, base, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(b, lambda y: y::BIGINT)),
                  lambda x, y: CASE WHEN y >= 1000 THEN xor(x, y - 1000) ELSE xor(x >> 1, (x & 1) * 3988292384) END)) % 4 AS h FROM bits),
        r AS (SELECT h.conv_id, list_concat(coalesce(own.l, [])[1:h], h.l[h + 1:]) AS s FROM h LEFT JOIN own ON own.conv_id = base),
        q AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
        n AS (SELECT depth, s[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
              FROM q GROUP BY 1, 2),
        m AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(len(regexp_extract_all(k[n.depth].t, '[^\\x20\\x09-\\x0D]+')), 0) AS words
              FROM n LEFT JOIN (SELECT depth + 1 AS depth, k AS pk, conv_id FROM n) p ON p.depth = n.depth AND p.pk = n.k[1:n.depth - 1]),
        c AS (SELECT m.*, coalesce(children, 0) AS n_children FROM m
              LEFT JOIN (SELECT depth - 1 AS d, k[1:depth - 1] AS ck, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1, 2) ON d = depth AND ck = k)
        SELECT x.conv_id, x.depth, x.parent_conv_id, x.n_convs, x.n_children, count(*) FILTER (y.n_children = 0) AS n_leaves,
               sum((y.n_convs - 1) * y.words)::BIGINT AS saved_tokens, x.ends_sha256
        FROM c x JOIN c y ON y.k[1:x.depth] = x.k AND y.depth >= x.depth
        GROUP BY x.depth, x.k, x.conv_id, x.parent_conv_id, x.n_convs, x.n_children, x.ends_sha256""",
    "op13_grouped_prefix_join": _similar(80, "doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id"),
}
