"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import contamination, conversation_repair, exact_dedup, hnsw, jaccard_join, quality, secrets, sentencepiece_scan, suffix_dedup, token_counts, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def exact_dedup_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents after texts labelled toxic are taken out and all pages put in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("labelled"))
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))  # texts stay out of the join
    gone = digests.join(toxic, F.col("doc_id") == F.col("labelled"), "left_semi").select("digest")
    index = exact_dedup.build_index(docs)
    return exact_dedup.update_index(index, exact_dedup.build_index(table(spark, sf_dir, "pages"), "page_id", "html"), gone)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_scan.encode(docs, round_trip="round_trip")
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"), "round_trip")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secrets(docs, secrets.learn(docs))
    s = F.col("secrets")
    return found.select("doc_id", s["n_assign"].alias("n_assign"), s["n_access"].alias("n_access"), s["n_hex"].alias("n_hex"), F.sha2(s["base"], 256).alias("base_sha256"), s["spans"].alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    scored = quality.quality(docs, model, out="score")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    scored = toxicity.toxicity(docs, model, out="score")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    text = F.try_validate_utf8(F.col("kept").cast("string"))  # null where a cut parts a character
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").alias("n_kept"), text.alias("kept_text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = w.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "exact_dedup_update": exact_dedup_update,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc": op8_warc,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)""",
    "exact_dedup_update": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             gone AS (SELECT DISTINCT text FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
             live AS (SELECT doc_id, text FROM d ANTI JOIN gone USING (text) UNION ALL SELECT page_id, coalesce(html, '') FROM pages)
        SELECT sha256(text) AS digest, max(doc_id) AS keep_id, count(*) AS group_size FROM live GROUP BY text""",
    "op9_benchmark_decontamination": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
             i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
             iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[p : p + least(len(ws), 13) - 1], ' ') AS win
                    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
             lens AS (SELECT DISTINCT n FROM iw),
             dw AS (SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS win
                    FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS p FROM w, lens)),
             occ AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
             hit AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS at_word FROM occ) GROUP BY doc_id),
             its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM occ GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
               coalesce(its.h, sha256('')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(w.ws) AS contaminated
        FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r ]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
             links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
             reach AS (SELECT a AS u, b AS v FROM links UNION SELECT reach.u, links.b FROM reach JOIN links ON reach.v = links.a),
             cls AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(v), d.doc_id)) AS class_id FROM d LEFT JOIN reach ON u = d.doc_id GROUP BY 1),
             deg AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM cls LEFT JOIN deg ON a = doc_id""",
    "op10_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
             w AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM d)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
             s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1))::INT AS fresh FROM r)),
             cut AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM s GROUP BY doc_id, run),
             gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM cut UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN cut USING (doc_id) GROUP BY d.doc_id),
             kept AS (SELECT doc_id, unhex(string_agg(hex(b[f + 1 : t]), '' ORDER BY f)) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
             n AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans FROM cut GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(k) AS kept_sha256, octet_length(k) AS n_kept, try(decode(k)) AS kept_text
        FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
             bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
             tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
             crc AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(k) + 1), lambda i: ascii(decode(k[i:i]))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 20 AS of FROM x, tab),
             dam AS (SELECT conv_id, turn, CASE WHEN of = 4 THEN 'user' ELSE role END AS role, CASE of WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN of = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE of <> 0),
             o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
             f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, lag(left(role, 1)) OVER w AS before, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, count(*) OVER (PARTITION BY conv_id) AS n FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
             g AS (SELECT conv_id, i, role, text, r, n, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS cut FROM f),
             v AS (SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS v0, {'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']} AS v1, {'c': 3, 'a': 'I', 'l': ['assistant:']} AS v2, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS v3 FROM g
                   UNION ALL
                   SELECT conv_id, i, CASE WHEN c2 + 3 < w0.c OR c2 + 3 = w0.c AND 'I' || u2.a < w0.a THEN {'c': c2 + 3, 'a': 'I' || u2.a, 'l': list_prepend('user:', u2.l)} ELSE w0 END,
                          CASE WHEN c2 + 3 < w1.c OR c2 + 3 = w1.c AND 'I' || u2.a < w1.a THEN {'c': c2 + 3, 'a': 'I' || u2.a, 'l': list_prepend('user:', u2.l)} ELSE w1 END, u2, u3
                   FROM (SELECT *, u2.c AS c2 FROM (SELECT conv_id, i, w0, w1,
                       least(w2, {'c': w3.c + 3, 'a': 'I' || w3.a, 'l': list_prepend('assistant:', w3.l)}) AS u2, least(w3, {'c': w2.c + 3, 'a': 'I' || w2.a, 'l': list_prepend('user:', w2.l)}) AS u3
                     FROM (SELECT g.conv_id, g.i,
                       list_min(list_filter([{'c': v0.c + 4, 'a': 'D' || v0.a, 'l': v0.l}, CASE WHEN NOT gone AND r IN ('s', 'u', '') THEN {'c': CASE r WHEN 's' THEN v1.c WHEN 'u' THEN v2.c ELSE v0.c END + cut, 'a': 'K' || CASE r WHEN 's' THEN v1.a WHEN 'u' THEN v2.a ELSE v0.a END, 'l': list_prepend(role || ':' || text, CASE r WHEN 's' THEN v1.l WHEN 'u' THEN v2.l ELSE v0.l END)} END, CASE WHEN NOT gone THEN {'c': v2.c + 3 + cut, 'a': 'R' || v2.a, 'l': list_prepend('user:' || text, v2.l)} END], lambda z: z IS NOT NULL)) AS w0,
                       list_min(list_filter([{'c': v1.c + 4, 'a': 'D' || v1.a, 'l': v1.l}, CASE WHEN NOT gone AND r IN ('u', '') THEN {'c': CASE r WHEN 'u' THEN v2.c ELSE v1.c END + cut, 'a': 'K' || CASE r WHEN 'u' THEN v2.a ELSE v1.a END, 'l': list_prepend(role || ':' || text, CASE r WHEN 'u' THEN v2.l ELSE v1.l END)} END, CASE WHEN NOT gone THEN {'c': v2.c + 3 + cut, 'a': 'R' || v2.a, 'l': list_prepend('user:' || text, v2.l)} END], lambda z: z IS NOT NULL)) AS w1,
                       list_min(list_filter([{'c': v2.c + 4, 'a': 'D' || v2.a, 'l': v2.l}, CASE WHEN NOT gone AND r IN ('a', '') THEN {'c': CASE r WHEN 'a' THEN v3.c ELSE v2.c END + cut, 'a': 'K' || CASE r WHEN 'a' THEN v3.a ELSE v2.a END, 'l': list_prepend(role || ':' || text, CASE r WHEN 'a' THEN v3.l ELSE v2.l END)} END, CASE WHEN NOT gone THEN {'c': v3.c + 3 + cut, 'a': 'R' || v3.a, 'l': list_prepend('assistant:' || text, v3.l)} END], lambda z: z IS NOT NULL)) AS w2,
                       list_min(list_filter([{'c': v3.c + 4, 'a': 'D' || v3.a, 'l': v3.l}, CASE WHEN NOT gone AND r IN ('u', '') THEN {'c': CASE r WHEN 'u' THEN v2.c ELSE v3.c END + cut, 'a': 'K' || CASE r WHEN 'u' THEN v2.a ELSE v3.a END, 'l': list_prepend(role || ':' || text, CASE r WHEN 'u' THEN v2.l ELSE v3.l END)} END, CASE WHEN NOT gone THEN {'c': v2.c + 3 + cut, 'a': 'R' || v2.a, 'l': list_prepend('user:' || text, v2.l)} END], lambda z: z IS NOT NULL)) AS w3
                     FROM g JOIN v ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i - 1)))),
             s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN v ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i = 1""",
    "op13_nearest_neighbours": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
             n AS (SELECT vec_id, x, sqrt(list_reduce(list_transform(x, lambda c: c * c), lambda s, c: s + c)) AS len FROM e WHERE NOT list_bool_or(list_transform(x, lambda c: c IS NULL OR NOT isfinite(c)))),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(c.x, q.x), lambda z: z[1] * z[2]), lambda s, y: s + y) / (c.len * q.len) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND q.len > 0 AND c.len > 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
             m AS (SELECT page_id, h, list_transform(string_split(x, ''), lambda c: instr('0123456789abcdef', c) - 1) AS nibbles, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, strlen(h) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((nibbles[5 * i // 4 + 1] * 16 + nibbles[5 * i // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m""",
}
