"""Registered queries of this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed, exact_dedup, filter_audit, fim, langid, lines, mixing, ngram_join, revisit, spm, substring, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_package(spark: SparkSession) -> SparkSession:
    """Python workers started from here on find this package where the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def op1_revisit(spark, sf_dir):
    r = revisit.resolve(revisit.captures_of_pages(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name].alias(name.replace("-", "_"))
    return r.select("record_id", "url_key", "ts", "outcome", "refers_to", "locator", *map(header, ("etag", "last-modified", "content-type", "content-length", "date", "cache-control", "expires")))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(with_package(spark), sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return embed.near_vectors(table(with_package(spark), sf_dir, "embeddings"))


def op4_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


#: The rules of the query's contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark, sf_dir):
    literal = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "action"), rule, strict=True)]) for rule in RULES])
    rules = spark.range(1).select(F.inline(literal))
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark, sf_dir):
    docs = table(with_package(spark), sf_dir, "documents")
    model = langid.fit(docs)
    held = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    return langid.identify(held, model, passing=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark, sf_dir):
    r = substring.remove_repeats(table(with_package(spark), sf_dir, "documents"))
    n = F.size("words").cast("long")
    return r.select("doc_id", n.alias("n_words"), (n - F.size("kept")).alias("n_removed"), F.sha2(F.array_join("kept", " "), 256).alias("kept_sha256"))


def op9_exact_dedup(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    return exact_dedup.deduplicate(spark, path, schema).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_sentencepiece(spark, sf_dir):
    return spm.encode_decode(table(with_package(spark), sf_dir, "documents"), model_path(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation of the query's contract, whose texts hold what templates use as marks.
MARKED = "</s>[INST] ok [/INST]"


def op12_chat_format(spark, sf_dir):
    turns = table(with_package(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], turns.schema)
    return chat.read_back(chat.render(turns.unionByName(more)))


def op13_fill_in_middle(spark, sf_dir):
    out = fim.transform(table(with_package(spark), sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES = {f.__name__: f for f in (op1_revisit, op2_ngram_join, op3_embedding_dedup, op4_line_dedup, op5_url_filter, op6_language_id, op7_mixing, op8_substring_dedup, op9_exact_dedup, op10_sentencepiece, op11_filter_audit, op12_chat_format, op13_fill_in_middle)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_revisit": r"""
WITH p AS (
  SELECT page_id AS id, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST(page_id AS VARCHAR) AS modified, octet_length(encode(coalesce(html, ''))) AS bytes,
         lower(split_part(url, '://', 1)) AS scheme, regexp_extract(substr(url, instr(url, '://') + 3), '^[^#]*') AS rest
  FROM pages WHERE instr(url, '://') > 0
), q AS (
  SELECT *, lower(regexp_extract(rest, '^[^/?]*')) AS host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
  FROM p
), u AS (
  SELECT *, regexp_replace(CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END, '^www\.', '')
            || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key
  FROM q
), f AS (SELECT id * 3 AS record_id, id * 10 AS ts, * FROM u WHERE id % 7 <> 0),
r AS (
  SELECT id * 3 + 1 AS record_id, id * 10 + 5 AS ts, url_key, tag AS rtag, CAST(NULL AS VARCHAR) AS rmod, CAST(id * 10 + 5 AS VARCHAR) AS rdate, 'max-age=60' AS rcache, CAST(NULL AS VARCHAR) AS rexp, 'W/' || tag AS rraw FROM u
  UNION ALL
  SELECT id * 3 + 2, id * 10 + 7, url_key, CASE WHEN id % 2 = 1 THEN '"other"' END, CASE WHEN id % 2 = 0 THEN modified END, NULL, NULL, CASE WHEN id % 2 = 0 THEN '0' END, CASE WHEN id % 2 = 1 THEN '"other"' END FROM u
), j AS (
  SELECT r.*, f.record_id AS fid, f.id AS fpage, f.tag, f.modified, f.bytes, f.ts AS fts,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
  FROM r LEFT JOIN f ON r.url_key = f.url_key AND f.ts < r.ts
), o AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'no_response' WHEN rtag IS NOT NULL THEN CASE WHEN rtag = tag THEN 'resolved' ELSE 'changed' END
                 WHEN rmod = modified THEN 'resolved' ELSE 'changed' END AS outcome
  FROM j WHERE k = 1
)
SELECT record_id, url_key, ts, outcome,
       CASE WHEN outcome = 'resolved' THEN fid END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN 'page:' || fpage END AS locator,
       CASE WHEN outcome = 'resolved' THEN coalesce(rraw, tag) END AS etag,
       CASE WHEN outcome = 'resolved' THEN modified END AS last_modified,
       CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN outcome = 'resolved' THEN CAST(bytes AS VARCHAR) END AS content_length,
       CASE WHEN outcome = 'resolved' THEN coalesce(rdate, CAST(fts AS VARCHAR)) END AS date,
       CASE WHEN outcome = 'resolved' THEN rcache END AS cache_control,
       CASE WHEN outcome = 'resolved' THEN rexp END AS expires
FROM o""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(seen) FROM r WHERE node = vec_id), vec_id)) AS component_id,
       vec_id <= coalesce((SELECT min(seen) FROM r WHERE node = vec_id), vec_id) AS kept
FROM embeddings""",
    "op4_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), t AS (
  SELECT doc_id, pos, list_sort(list_distinct({_WORDS.format("line")})) AS s FROM l
), f AS (
  SELECT s, len(s) AS n, min(struct_pack(d := doc_id, p := pos)) AS first FROM t WHERE len(s) > 0 GROUP BY s
), e AS (
  SELECT s, n, first, unnest(s) AS w FROM f WHERE n > 8
), c AS (SELECT w, count(*) AS c FROM e GROUP BY w),
p AS (
  SELECT s, n, first, w FROM (SELECT e.*, row_number() OVER (PARTITION BY s ORDER BY c, w) AS k FROM e JOIN c USING (w)) WHERE k <= n - ceil(0.9 * n) + 2
), late AS (
  SELECT DISTINCT s FROM (SELECT DISTINCT y.s, x.s AS xs, x.n AS xn, y.n FROM p y JOIN p x USING (w) WHERE x.first < y.first AND x.n * 10 >= 9 * y.n AND y.n * 10 >= 9 * x.n)
  WHERE 100 * len(list_intersect(xs, s)) >= 90 * (xn + n - len(list_intersect(xs, s)))
), d AS (
  SELECT t.doc_id, t.pos, len(t.s) > 0 AND (late.s IS NOT NULL OR f.first <> struct_pack(d := t.doc_id, p := t.pos)) AS removed
  FROM t LEFT JOIN f USING (s) LEFT JOIN late ON late.s = t.s
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (removed), '') AS removed
  FROM d GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN g USING (doc_id)""",
    "op5_url_filter": r"""
WITH r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, action := action), len(rhost || rpath)) AS best
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op8_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM s),
again AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT k) AS k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM again) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w),
covered AS (SELECT doc_id, unnest(k) AS k FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN covered USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (SELECT s, count(*) AS group_size, arg_max(doc_id, struct_pack(n := n, d := -doc_id)) AS keep_id FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)""",
    "op11_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
f AS (
  SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS fails
  FROM d
), y AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (x = 1) AS toxic FROM f LEFT JOIN y USING (doc_id) GROUP BY part, fails),
l(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS past
  FROM o, range(1, 6) AS r(step)
), m AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (fails & (past | own) = 0) AS kept, sum(n) FILTER (fails & past = 0 AND fails & own > 0) AS removed,
         sum(n) FILTER (fails & past > 0 AND fails & own > 0) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
         sum(good) FILTER (fails & past = 0 AND fails & own > 0) AS good_lost, sum(toxic) FILTER (fails & past = 0 AND fails & own > 0) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM m""",
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(k)
), n AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(/?s>|<SYS>>|</SYS>>)|\[\\*(/?INST\]|/?ROLE\]|TEXT\])')) AS escapes,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                   ELSE 19 + length(role) + len(regexp_extract_all(role, '<\\*(/?s>|<SYS>>|</SYS>>)|\[\\*(/?INST\]|/?ROLE\]|TEXT\])')) END AS marks
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + escapes + marks) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id""",
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), s AS (
  SELECT *, array_to_string(w[1 : least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1 :], '') AS s FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s""",
}
