"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, langid, media, near_dedup, packing, piece_sampling, quality, resampling, token_counts, token_store, url_filter
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.format_chats(turns))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model, spans=True).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedupe(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.document_sums(spark, token_store.write_store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("n_lines")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_packing, op3_token_counts, op4_piece_sampling, op5_language_id, op6_near_dedup, op7_exact_dedup, op8_url_filter, op9_token_store, op10_media, op11_source_divergence, op12_quality_rules, op13_importance_resampling, pipeline)}

# The escapes of chat.escape() add a backslash for each backslash and each control string of a text.
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]|\[END\]|\[NEXT\]"

ORACLE = {
    "op1_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
         length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{_CONTROL}')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 WHEN role = 'user' THEN 18 WHEN role = 'assistant' THEN 14 WHEN role = 'system' THEN 20 ELSE 23 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)""",
    # Links are followed in their plain form, rel="canonical" href="<absolute url>"; pages with any other are an error here.
    "op8_url_filter": r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_extract(html, '<link rel="canonical" href="([a-z]+://[^"]+)">', 1), '') AS to_,
         len(regexp_extract_all(coalesce(html, ''), '(?is)<link[^>]*canonical|<meta[^>]*http-equiv[^>]*refresh|<base[^>]*href')) > (nullif(regexp_extract(html, '<link rel="canonical" href="([a-z]+://[^"]+)">', 1), '') IS NOT NULL)::INT AS other
  FROM pages
), u AS (
  SELECT url, host || chr(10) || path || chr(10) || regexp_extract(url, '(?s)^[^#?]*(\?[^#]*)', 1) AS node, host, path FROM (
    SELECT DISTINCT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT url FROM p UNION ALL SELECT to_ FROM p) WHERE url IS NOT NULL) WHERE host <> ''
), e AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM p JOIN u a ON a.url = p.url JOIN u b ON b.url = p.to_ WHERE a.node <> b.node
), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON t.a = r.b),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
mu AS (SELECT node, arg_max(v, length(h || q)) AS v FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY node),
bad AS (SELECT DISTINCT reach.a AS node FROM reach JOIN mu ON mu.node = reach.b WHERE v = 'block'),
m AS (
  SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, CASE WHEN other THEN error('this SQL follows plain canonical links alone') WHEN v IS NOT NULL THEN v WHEN u.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (host, path) LEFT JOIN u ON u.url = p.url""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n::HUGEINT + 5)) // (t.total + 5 * v.v) AS p, 1 + (1000000000 * (f.all_n::HUGEINT + 5)) // (v.total + 5 * v.v) AS q
  FROM f JOIN t USING (lang, source) JOIN v USING (lang)
), apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x QUALIFY part = 'pair' OR rank <= 50""",
    # The fences follow quality.RULES, REACH, LEAST_ROWS and DIGITS.
    "op12_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
), b AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
rules(rule, slack, lower_) AS (VALUES ('word_length', 1000, true), ('symbols', 100, false), ('dup_lines', 500, false), ('repeats', 400, false)),
x AS (
  SELECT r, lang, source, base_failed, rule, slack, lower_, CASE rule WHEN 'word_length' THEN 1000 * word_chars // n_words WHEN 'symbols' THEN 1000 * n_symbols // n_words WHEN 'dup_lines' THEN 1000 * n_dup_lines // n_lines ELSE 1000 * n_repeat_words // n_words END AS v
  FROM b, rules WHERE n_words > 0
), s AS (SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket FROM x WHERE NOT base_failed),
own AS (SELECT lang, source, rule, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM s GROUP BY ALL),
wide AS (SELECT lang, rule, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM s GROUP BY ALL),
every AS (SELECT rule, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM s GROUP BY ALL),
q AS (
  SELECT x.*, CASE WHEN own.n >= 100 THEN own.q1 WHEN wide.n >= 100 THEN wide.q1 ELSE every.q1 END AS q1, CASE WHEN own.n >= 100 THEN own.q3 WHEN wide.n >= 100 THEN wide.q3 ELSE every.q3 END AS q3
  FROM x JOIN own USING (lang, source, rule) JOIN wide USING (lang, rule) JOIN every USING (rule)
), bad AS (SELECT DISTINCT r FROM q WHERE v > q3 + greatest(3 * (q3 - q1), slack) OR lower_ AND v < q1 - greatest(3 * (q3 - q1), slack))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM b LEFT JOIN bad USING (r)""",
    # crc32 byte by byte, from its table of 256 entries, once for each distinct feature.
    "op13_importance_resampling": r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
rows_ AS (SELECT true AS doc, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), null, text FROM benchmark),
w AS (SELECT doc, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM rows_),
f AS (SELECT doc, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
bytes AS (SELECT f, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS b FROM u),
bucket AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc),
n AS (SELECT bucket, count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t FROM f JOIN bucket USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1.0::DOUBLE) * (total.s + 10000)::DOUBLE / ((n.s + 1.0::DOUBLE) * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, total),
weight AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight, count(*) AS n_features FROM f JOIN bucket USING (f) JOIN gain USING (bucket) WHERE doc GROUP BY r),
scored AS (
  SELECT w.r, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (r) WHERE doc
), ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS drawn FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)""",
}
