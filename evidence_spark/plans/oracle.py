"""DuckDB SQL for the queries of catalogue.py, over the same tables. WITH parts are shared; each is written once here."""

from __future__ import annotations

from ..operators.tasks import KEYWORDS, STEPS
from ..sources.views import PHRASES

# --- views -------------------------------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT 'DOC-' || doc_id AS ref_id, doc_id, text, source AS section, lang AS page FROM documents)"


def prefix(kind: str) -> str:
    return f"'[' || ref_id || '|' || coalesce(nullif(page, ''), '-') || '|' || coalesce(nullif(section, ''), '-') || '|type({kind})]'"


def chunk_id(kind: str, body: str) -> str:
    return f"substr(sha256(ref_id || '|' || coalesce(nullif(page, ''), '-') || '|' || coalesce(nullif(section, ''), '-') || '|' || {kind} || '|' || substr(sha256({body}), 1, 16)), 1, 24)"


def n_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\s+|\\S+'))"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')"


WINDOWS = f"""{DOCS},
tok AS (SELECT ref_id, section, page, {prefix("文本")} AS prefix, regexp_extract_all(text, '\\s+|\\S+') AS t FROM docs),
room AS (SELECT *, 512 - {n_tokens("prefix")} - 1 AS body FROM tok),
steps AS (SELECT *, body - least(64, body - 1) AS step FROM room),
spread AS (SELECT *, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= body THEN 1 ELSE ceil((len(t) - body) / step)::BIGINT + 1 END)) AS idx FROM steps),
win AS (SELECT ref_id, section, page, prefix, idx, t[idx * step + 1 : idx * step + body] AS w FROM spread),
fine AS (SELECT ref_id, section, page, idx, {chunk_id("'text:' || idx", "array_to_string(w, '')")} AS chunk_id, len(w) AS n_tokens, prefix || ' ' || array_to_string(w, '') AS payload FROM win)"""

CHUNKS = f"""{WINDOWS},
coarse AS (SELECT ref_id, page, {chunk_id("'summary'", "summary")} AS chunk_id, {n_tokens("summary")} AS n_tokens, summary AS payload FROM (SELECT ref_id, NULL::VARCHAR AS section, page, array_to_string(list_sort(list_distinct({words("text")})), ' ') AS summary FROM docs)),
chunks AS (SELECT ref_id, chunk_id, 'fine' AS level, payload, coalesce(section, page) AS locator FROM fine UNION ALL SELECT ref_id, chunk_id, 'coarse', payload, NULL FROM coarse)"""


BM25 = f"""{CHUNKS},
ct AS (SELECT chunk_id, ref_id, level, {words("payload")} AS t FROM chunks),
posts AS (SELECT chunk_id, ref_id, level, len(t) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, ref_id, level, t, unnest(t) AS term FROM ct) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct),
q AS (SELECT item_id AS query_id, text FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words("text")}) AS term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
scores AS (
  SELECT query_id, chunk_id, ref_id, level,
         round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM qt JOIN df USING (term) JOIN posts USING (term), corpus GROUP BY ALL)"""


def top(name: str, rows: str, k: int | None, alias: str = "rank") -> str:
    limit = f" WHERE {alias} <= {k}" if k else ""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS {alias} FROM ({rows})){limit})"


HITS10 = top("hits", "SELECT * FROM scores WHERE score > 0", 10)

VECTORS = """vq AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT query_id, 'V-' || e.vec_id AS chunk_id, 'DOC-' || e.vec_id AS ref_id, vq.label = e.label AS same, round(list_inner_product(vq.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM vq, embeddings e)"""


def rrf(name: str, channels: str, k: int) -> str:
    return f"""{name}_best AS (SELECT query_id, chunk_id, ref_id, channel, min(rank) AS r FROM ({channels}) WHERE rank >= 1 GROUP BY ALL),
{name}_sum AS (SELECT query_id, chunk_id, ref_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, count(*) AS n_channels FROM {name}_best GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, ref_id) AS rank FROM {name}_sum) WHERE rank <= {k})"""


HYBRID = f"""{BM25},
{top("ck", "SELECT * FROM scores WHERE score > 0 AND level = 'coarse'", 20)},
{rrf("picked", "SELECT *, 'keyword' AS channel FROM ck", 20)},
status AS (SELECT q.query_id, count(p.chunk_id) AS coarse_hits FROM q LEFT JOIN picked p USING (query_id) GROUP BY q.query_id),
{top("fk", "SELECT s.* FROM scores s JOIN status t USING (query_id) WHERE score > 0 AND level = 'fine' AND (coarse_hits = 0 OR EXISTS (SELECT 1 FROM picked p WHERE p.query_id = s.query_id AND p.ref_id = s.ref_id))", 10)},
{rrf("final", "SELECT *, 'keyword' AS channel FROM fk", 10)}"""

EXPANDED = r"""s(term, e) AS (VALUES ('the', 'der'), ('the', 'le'), ('of', 'von'), ('and', 'und')), w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM benchmark), x AS (SELECT item_id, string_agg(DISTINCT e, ' ' ORDER BY e) AS extra FROM w JOIN s USING (term) GROUP BY item_id),
wide AS (SELECT b.item_id, concat_ws(' ', text, extra) AS text FROM benchmark b LEFT JOIN x USING (item_id))"""

ASKED = "(SELECT b.item_id AS query_id, b.text FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id * 50)"
BOTH = f"""{BM25.replace("FROM benchmark)", f"FROM {ASKED} b)").replace("SELECT item_id AS query_id, text", "SELECT query_id, text")},
near AS (SELECT b.query_id, 'V-' || e.vec_id AS chunk_id, 'DOC-' || e.vec_id AS ref_id, round(list_inner_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q b JOIN embeddings v ON v.vec_id = b.query_id * 50, embeddings e),
{top("ck", "SELECT query_id, chunk_id, ref_id, score FROM scores WHERE score > 0 AND level = 'coarse'", 20)}, {top("dense", "SELECT * FROM near", 20)},
{rrf("picked", "SELECT query_id, chunk_id, ref_id, rank, 'keyword' AS channel FROM ck UNION ALL SELECT query_id, chunk_id, ref_id, rank, 'vector' FROM dense", 20)},
refs AS (SELECT DISTINCT query_id, ref_id FROM picked),
empty AS (SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM picked)),
{top("fk", "SELECT query_id, chunk_id, ref_id, score FROM scores s WHERE score > 0 AND level = 'fine' AND (query_id IN (SELECT query_id FROM empty) OR EXISTS (SELECT 1 FROM refs p WHERE p.query_id = s.query_id AND p.ref_id = s.ref_id))", 10)},
{top("fd", "SELECT n.* FROM near n JOIN refs USING (query_id, ref_id)", 10)},
{rrf("final", "SELECT query_id, chunk_id, ref_id, rank, 'keyword' AS channel FROM fk UNION ALL SELECT query_id, chunk_id, ref_id, rank, 'vector' FROM fd", 10)}"""

VERSIONS = """vs AS (SELECT DISTINCT 'kbv-' || strftime(ts, '%Y%m%d') AS version_id, 'kbv-' || strftime(ts::DATE - 1, '%Y%m%d') AS p FROM events),
ver AS (SELECT a.version_id, b.version_id AS prior_version_id FROM vs a LEFT JOIN vs b ON a.p = b.version_id)"""
ANCESTORS = f"""{VERSIONS},
anc AS (SELECT version_id, version_id AS ancestor_id, 0::BIGINT AS distance FROM ver UNION ALL SELECT a.version_id, v.prior_version_id, a.distance + 1 FROM anc a JOIN ver v ON v.version_id = a.ancestor_id WHERE v.prior_version_id IS NOT NULL)"""
BRANCHES = """bv AS (SELECT event_id AS v, event_type, CASE WHEN lag(event_type) OVER w = 'error' THEN lag(event_id, 2) OVER w ELSE lag(event_id) OVER w END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
line AS (SELECT v, v AS a, 0::BIGINT AS steps FROM bv UNION ALL SELECT line.v, bv.p, steps + 1 FROM line JOIN bv ON bv.v = line.a WHERE bv.p IS NOT NULL)"""
LIFE = """life AS (SELECT 'LC-' || event_id AS lifecycle_id, 'DOC-' || user_id AS ref_id,
  CASE event_type WHEN 'error' THEN 'retracted' WHEN 'view' THEN 'archived' WHEN 'purchase' THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN NOT (event_type = 'purchase' AND user_id % 2 = 1) THEN 'kbv-' || strftime(ts, '%Y%m%d') END AS effective_version_id, event_id AS created_seq FROM events)"""
LATEST = f"""{LIFE}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY created_seq DESC, lifecycle_id DESC) AS n FROM life WHERE effective_version_id IS NOT NULL) WHERE n = 1)"""

# --- curation ----------------------------------------------------------------------------------------------------------

CURATION = """cdocs AS (SELECT 'S' || s_suppkey AS ref_id, s_suppkey AS k,
  CASE WHEN s_suppkey % 10 = 0 THEN 'C' WHEN s_suppkey % 10 = 1 THEN 'D' WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS grade,
  s_suppkey % 11 = 0 OR coalesce(s_name, '') = '' OR (NOT s_acctbal > 0 AND s_suppkey % 3 <> 0) AS lacking,
  s_suppkey % 13 = 0 AS no_data, s_suppkey % 7 = 0 OR s_suppkey % 17 = 0 AS charts_low,
  CASE WHEN s_suppkey % 2 = 0 THEN greatest(0.0, least(1.0, s_nationkey / 25.0::DOUBLE)) ELSE 1.0 END::DOUBLE AS s_schema FROM supplier),
asr AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'S' || (l_suppkey - CASE WHEN l_suppkey % 19 = 0 THEN 1 ELSE 0 END) AS ref_id, 'P' || l_partkey AS entity, l_returnflag AS property,
  l_linenumber = 7 AS relation, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / l_quantity END AS v, CASE WHEN l_linenumber = 7 THEN CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END END AS vt, l_tax AS u,
  CASE WHEN l_discount <> 0 THEN 'USD' END AS unit, l_linestatus AS cond, CASE WHEN l_tax <> 0 THEN 'T' || l_linenumber END AS locator, l_linestatus = 'F' AS firsthand,
  ['hypothesis', 'medium', 'high', 'verified'][(l_linenumber % 4 + 1)::INT] AS confidence, l_quantity > 45 AS speculative, l_shipdate >= TIMESTAMP '1998-01-01' AS is_new
  FROM lineitem),
rules(property, lo, hi, rule_id) AS (VALUES ('A', 1500.0::DOUBLE, 60000.0::DOUBLE, 'R-A'), ('N', 1200.0, 1900.0, 'R-N'), ('R', 0.0, 2000.0, 'R-R')),
pairs AS (SELECT n.id AS new_id, e.id AS existing_id, n.ref_id AS new_ref, CASE
    WHEN n.cond <> e.cond THEN 'condition_difference'
    WHEN n.relation OR e.relation THEN CASE WHEN lower(coalesce(n.vt, n.v::VARCHAR)) = lower(coalesce(e.vt, e.v::VARCHAR)) THEN 'consistent' ELSE 'relation_conflict' END
    WHEN n.v - n.u <= e.v + e.u + greatest(0.05::DOUBLE * greatest(abs(e.v - e.u), abs(e.v + e.u)), 1e-9) AND e.v - e.u - greatest(0.05::DOUBLE * greatest(abs(e.v - e.u), abs(e.v + e.u)), 1e-9) <= n.v + n.u THEN 'consistent'
    ELSE 'numeric_conflict' END AS conflict_type
  FROM asr n JOIN asr e ON n.entity = e.entity AND n.property = e.property AND n.ref_id <> e.ref_id WHERE n.is_new AND NOT e.is_new),
viol AS (SELECT id, ref_id, rule_id FROM asr JOIN rules USING (property) WHERE is_new AND (v < lo OR v > hi))"""


def complete(rows: str) -> str:
    return f"""per AS (SELECT ref_id, count(*) AS n, count(*) FILTER (NOT relation AND unit IS NULL) AS mu, count(*) FILTER (locator IS NULL) AS ml, count(*) FILTER (firsthand) AS fh FROM asr {rows} GROUP BY ref_id),
cm0 AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(mu, 0) AS mu, coalesce(ml, 0) AS ml, coalesce(fh, 0) AS fh FROM cdocs d LEFT JOIN per USING (ref_id)),
cm AS (SELECT *, CASE WHEN lacking THEN 'metadata_incomplete' WHEN grade = 'D' THEN 'parsed_doc_not_formal' WHEN n = 0 AND no_data THEN 'explicit_no_data' WHEN n = 0 THEN 'no_assertions' WHEN mu > 0 THEN 'missing_units'
  WHEN grade = 'C' THEN 'manual_review' WHEN ml > 0 THEN 'missing_locators' WHEN charts_low THEN 'chart_quality_low' ELSE 'ok' END AS status FROM cm0)"""


FLAGS = """flags AS (SELECT id, ref_id, bool_or(t = 'consistent') AS consistent, bool_or(t = 'condition_difference') AS condition_diff, bool_or(t = 'numeric_conflict') AS numeric_, bool_or(t = 'relation_conflict') AS relation_, bool_or(t = 'mechanism') AS mechanism
  FROM (SELECT new_id AS id, new_ref AS ref_id, conflict_type AS t FROM pairs UNION ALL SELECT id, ref_id, 'mechanism' FROM viol) GROUP BY id, ref_id)"""
QUALITY = """fd AS (SELECT ref_id, count(*) FILTER (consistent) AS same, bool_or(numeric_ OR relation_) AS hang, bool_or(mechanism) AS mech FROM flags GROUP BY ref_id),
qv AS (SELECT cm.ref_id, CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.4 ELSE 0.0 END::DOUBLE AS p_parse, s_schema,
  CASE WHEN n = 0 THEN 0.0 ELSE ((n - ml) / n::DOUBLE + fh / n::DOUBLE) / 2 END::DOUBLE AS e_evidence, CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.0, 1 - coalesce(same, 0) / n::DOUBLE) END::DOUBLE AS n_novelty,
  greatest(0.0::DOUBLE, 1 - CASE WHEN hang THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN mech THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN charts_low THEN 0.2 ELSE 0 END::DOUBLE) AS penalty FROM cm LEFT JOIN fd USING (ref_id)),
quality AS (SELECT ref_id, round(p_parse, 9) AS p_parse, round(s_schema, 9) AS s_schema, round(e_evidence, 9) AS e_evidence, round(n_novelty, 9) AS n_novelty, round(penalty, 9) AS penalty,
  round(greatest(0.0, least(1.0, 0.25::DOUBLE * p_parse + 0.25::DOUBLE * s_schema + 0.30::DOUBLE * e_evidence + 0.10::DOUBLE * n_novelty + 0.10::DOUBLE * penalty)), 9) AS total FROM qv)"""
DECIDE = """dec0 AS (SELECT a.*, status, grade = 'C' AS manual, coalesce(consistent, false) AS c, coalesce(condition_diff, false) AS cd, coalesce(numeric_, false) AS nu, coalesce(relation_, false) AS re, coalesce(mechanism, false) AS me,
  CASE WHEN confidence IN ('high', 'verified') THEN 'medium' ELSE confidence END AS capped FROM asr a JOIN cm USING (ref_id) LEFT JOIN flags f ON f.id = a.id WHERE is_new),
dec1 AS (SELECT *, CASE WHEN status = 'metadata_incomplete' THEN 1 WHEN status = 'parsed_doc_not_formal' THEN 2 WHEN status = 'explicit_no_data' THEN 3 WHEN me THEN 4 WHEN nu THEN 5 WHEN re THEN 6 WHEN NOT relation AND unit IS NULL THEN 7
  WHEN locator IS NULL THEN 8 WHEN speculative THEN 9 WHEN status = 'manual_review' THEN 10 WHEN c AND NOT firsthand THEN 11 WHEN c AND confidence = 'hypothesis' THEN 12 WHEN c THEN 13 WHEN cd THEN 14 ELSE 15 END AS k FROM dec0),
decisions AS (SELECT id AS assertion_id, ref_id,
  ['return_upstream', 'reject', 'reject', 'reject', 'pending_review', 'pending_review', 'downgrade', 'downgrade', 'downgrade', 'pending_review', 'accept', 'accept', 'accept', 'accept', 'accept'][k] AS action,
  CASE WHEN k < 10 OR k = 12 THEN 'hypothesis' WHEN k = 10 THEN 'medium' WHEN k = 13 THEN 'high' ELSE capped END AS confidence,
  CASE k WHEN 4 THEN 'mechanism_violation' WHEN 5 THEN 'numeric_conflict' WHEN 6 THEN 'relation_conflict' WHEN 11 THEN 'consistent' WHEN 12 THEN 'consistent' WHEN 13 THEN 'consistent' WHEN 14 THEN 'condition_difference' END AS conflict_type,
  ['metadata_incomplete', 'not_formal', 'no_data', 'mechanism_violation', 'conflict', 'conflict', 'missing_unit', 'missing_locator', 'speculative', 'grade_c', 'consistent_secondary', 'consistent_hypothesis', 'consistent_primary', 'condition_difference', 'single_source'][k] AS reason FROM dec1)"""
REPORT = """rep0 AS (SELECT ref_id, count(*) AS n, count(*) FILTER (action = 'accept') AS n_accept, count(*) FILTER (action = 'downgrade') AS n_downgrade, count(*) FILTER (action = 'pending_review') AS n_pending_review, count(*) FILTER (action = 'reject') AS n_reject, count(*) FILTER (action = 'return_upstream') AS n_return_upstream FROM decisions GROUP BY ref_id),
rep1 AS (SELECT d.ref_id, coalesce(n, 0) AS n, coalesce(n_accept, 0) AS n_accept, coalesce(n_downgrade, 0) AS n_downgrade, coalesce(n_pending_review, 0) AS n_pending_review, coalesce(n_reject, 0) AS n_reject, coalesce(n_return_upstream, 0) AS n_return_upstream, total FROM cdocs d LEFT JOIN rep0 USING (ref_id) LEFT JOIN quality USING (ref_id)),
report AS (SELECT *, CASE WHEN n_return_upstream > 0 THEN 'return_upstream' WHEN n = 0 THEN 'no_assertions' WHEN n_accept = n THEN 'successful' WHEN n_reject = n THEN 'rejected' WHEN n_pending_review > 0 THEN 'pending_review' WHEN n_downgrade > 0 THEN 'downgraded' ELSE 'partial' END AS report_status FROM rep1)"""
CURATE = f"{CURATION}, {complete('WHERE is_new')}, {FLAGS}, {QUALITY}, {DECIDE}, {REPORT}"
ADMITTED = f"{CURATE}, adm AS (SELECT assertion_id AS id, ref_id, action, confidence AS decided_confidence, CASE action WHEN 'accept' THEN 'active' WHEN 'downgrade' THEN 'downgraded' ELSE 'pending' END AS visibility FROM decisions WHERE action IN ('accept', 'downgrade', 'pending_review'))"

def set_hash(x: str) -> str:
    """Of an aggregate: count, and the sums of four pieces of 60 bits of the items' digests."""
    sums = ", ".join(f"coalesce(sum(('0x' || substr(sha256({x}), {15 * k + 1}, 15))::BIGINT), 0)::VARCHAR" for k in range(4))
    return f"sha256(concat_ws(',', count({x})::VARCHAR, {sums}))"


def packed(*columns: str) -> str:
    return " || ',' || ".join(f"coalesce(length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns)


# --- identity and deltas -----------------------------------------------------------------------------------------------

SOURCES = r"""hist AS (SELECT doc_id AS seq, 'REF-' || doc_id AS ref_id, sha256(text) AS fp, CASE WHEN doc_id % 2 = 0 THEN 'preprint' ELSE 'journal' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (n_chars % 400) END AS doi, CASE WHEN doc_id % 3 = 1 THEN 'ST-' || (n_chars % 300) END AS sid, CASE WHEN doc_id % 3 = 2 THEN nullif(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '') END AS ttl FROM documents),
firsts AS (SELECT *, min(seq) OVER (PARTITION BY doi, sid, ttl) AS first FROM hist),
reg AS (SELECT *, 'W-' || first AS work_id, 'SV-' || seq AS svid, CASE WHEN seq = first THEN 'none' ELSE 'revision_of' END AS rel FROM firsts WHERE doi IS NOT NULL OR sid IS NOT NULL OR seq = first),
sub AS (SELECT doc_id AS seq, CASE WHEN doc_id % 8 <= 2 THEN 'REF-' ELSE 'NEW-' END || doc_id AS ref_id, sha256(text) AS fp, CASE WHEN doc_id % 2 = 0 THEN 'preprint' ELSE 'journal' END AS kind,
  nullif(lower(trim(regexp_replace(CASE WHEN doc_id % 8 = 5 THEN '  ' || text || chr(10) WHEN doc_id % 8 = 2 THEN 'Another title' WHEN doc_id % 8 = 0 AND doc_id % 3 = 2 THEN text END, '\s+', ' ', 'g'))), '') AS ttl,
  CASE WHEN doc_id % 8 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (n_chars % 400) END WHEN doc_id % 8 IN (1, 7) THEN '10.9/' || doc_id WHEN doc_id % 8 IN (3, 6) THEN '10.1000/' || (n_chars % 400) END AS doi,
  CASE WHEN doc_id % 8 = 0 THEN CASE WHEN doc_id % 3 = 1 THEN 'ST-' || (n_chars % 300) END WHEN doc_id % 8 IN (4, 6) THEN 'ST-' || (n_chars % 300) END AS sid, NULL::VARCHAR AS ework, NULL::VARCHAR AS eprior, NULL::VARCHAR AS erel FROM documents),
lin AS (SELECT doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN 'REF-' ELSE 'NEW-' END || doc_id AS ref_id, sha256(text) AS fp, CASE WHEN doc_id % 2 = 0 THEN 'preprint' ELSE 'journal' END AS kind, NULL::VARCHAR AS ttl,
  CASE WHEN doc_id % 7 = 0 THEN '10.1000/' || (n_chars % 400) END AS doi, CASE WHEN doc_id % 7 = 1 THEN 'ST-' || (n_chars % 300) END AS sid,
  CASE WHEN doc_id % 5 = 0 THEN 'W-' || doc_id WHEN doc_id % 5 = 1 THEN 'W-' || (doc_id + 1) WHEN doc_id % 25 = 2 THEN 'W-none' END AS ework,
  CASE WHEN doc_id % 10 < 4 THEN 'SV-' || doc_id WHEN doc_id % 10 = 4 THEN 'SV-' || (doc_id + 1) WHEN doc_id % 50 = 5 THEN 'SV-none' END AS eprior,
  [NULL, 'none', 'revision_of', 'preprint_to_journal', 'corrected_version', 'explicit_same_work'][(doc_id % 6 + 1)::INT] AS erel FROM documents)"""


def intake(rows: str) -> str:
    """Decisions on rows, rule by rule as the registry's owner states them."""
    return f"""{SOURCES},
seen AS (SELECT c.*, k.work_id AS kw, k.rel AS krel, c.kind <> k.kind AS kdiff, coalesce(c.doi <> k.doi, false) OR coalesce(c.sid <> k.sid, false) OR coalesce(c.ttl <> k.ttl, false) AS mdiff,
  (SELECT min(work_id) FROM reg r WHERE r.doi = c.doi) AS dw, (SELECT max(work_id) FROM reg r WHERE r.doi = c.doi) AS dw2, (SELECT min(work_id) FROM reg r WHERE r.sid = c.sid) AS sw, (SELECT max(work_id) FROM reg r WHERE r.sid = c.sid) AS sw2,
  EXISTS (SELECT 1 FROM reg r WHERE r.ttl = c.ttl) AS tknown, EXISTS (SELECT 1 FROM reg r WHERE r.work_id = c.ework) AS wknown, p.work_id AS pw, p.kind AS pkind
  FROM {rows} c LEFT JOIN reg k ON k.ref_id = c.ref_id AND k.fp = c.fp LEFT JOIN reg p ON p.svid = c.eprior),
named AS (SELECT *, coalesce(ework, pw) AS w, coalesce(erel, CASE WHEN eprior IS NOT NULL THEN 'revision_of' ELSE 'explicit_same_work' END) AS r, ework IS NOT NULL OR eprior IS NOT NULL OR coalesce(erel, 'none') <> 'none' AS stated FROM seen),
why AS (SELECT *, CASE WHEN kw IS NOT NULL THEN CASE
    WHEN ework IS NOT NULL AND NOT wknown THEN 'work not found on replay' WHEN ework <> kw THEN 'work contradicts replay' WHEN eprior IS NOT NULL AND pw IS NULL THEN 'prior not found on replay' WHEN pw <> kw THEN 'prior of another work on replay'
    WHEN eprior IS NOT NULL THEN 'prior contradicts replay' WHEN erel <> krel THEN 'relation contradicts replay' WHEN kdiff THEN 'kind contradicts replay' WHEN mdiff THEN 'material contradiction on replay' END
  WHEN dw <> dw2 THEN 'doi of several works' WHEN sw <> sw2 THEN 'stable id of several works' WHEN dw <> sw THEN 'doi and stable id of different works'
  WHEN stated THEN CASE WHEN erel = 'none' AND (ework IS NOT NULL OR eprior IS NOT NULL) THEN 'none contradicts stated lineage' WHEN ework IS NULL AND eprior IS NULL THEN 'relation without target' WHEN ework IS NOT NULL AND NOT wknown THEN 'work not found'
    WHEN eprior IS NOT NULL AND pw IS NULL THEN 'prior not found' WHEN pw <> ework THEN 'prior of another work' WHEN dw <> w THEN 'doi of another work' WHEN sw <> w THEN 'stable id of another work'
    WHEN eprior IS NULL AND r IN ('revision_of', 'corrected_version', 'preprint_to_journal') THEN 'relation needs a prior' WHEN r = 'preprint_to_journal' AND pkind <> 'preprint' THEN 'prior is no preprint' WHEN r = 'preprint_to_journal' AND kind <> 'journal' THEN 'candidate is no journal' END END AS conflict_reason FROM named),
intake AS (SELECT *, CASE WHEN conflict_reason IS NOT NULL THEN 'identity_conflict' WHEN kw IS NOT NULL THEN 'exact_replay' WHEN stated OR dw IS NOT NULL OR sw IS NOT NULL THEN 'same_work_new_version' WHEN tknown THEN 'review_required' ELSE 'new_work' END AS disposition,
  CASE WHEN kw IS NOT NULL THEN kw WHEN conflict_reason IS NOT NULL THEN NULL WHEN stated THEN w ELSE coalesce(dw, sw) END AS work_id, CASE WHEN kw IS NULL AND conflict_reason IS NULL AND stated THEN r END AS relation FROM why)"""


UNITS = """c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id * 10 + turn AS k FROM conversations),
up AS (SELECT conv_id AS pair_id, 'U' || turn AS unit_id, sha256(role || chr(10) || text) AS h FROM c),
un AS (SELECT conv_id AS pair_id, CASE WHEN k % 5 = 1 THEN 'N' ELSE 'U' END || turn AS unit_id, sha256(role || chr(10) || text || CASE WHEN k % 3 = 0 THEN ' (rev)' ELSE '' END) AS h, CASE WHEN k % 5 = 1 THEN CASE WHEN conv_id % 13 = 5 THEN 'U99' WHEN conv_id % 17 = 3 THEN 'U0' ELSE 'U' || turn END END AS claim, 'L' || turn AS locator FROM c WHERE k % 7 <> 3
  UNION ALL SELECT conv_id, 'X' || turn, sha256(role || chr(10) || reverse(text)), NULL, 'X' || turn FROM c WHERE k % 11 = 0),
pa AS (SELECT conv_id AS pair_id, CASE WHEN conv_id % 19 = 4 AND turn = 1 THEN 'U77' ELSE 'U' || turn END AS unit_id, 'A' || conv_id || '.' || turn || '.' || n AS aid, CASE WHEN n = 1 OR k % 4 = 0 THEN role ELSE 'note' END AS slot, sha256(text) AS ph FROM c, (VALUES (1), (2)) v(n)),
na AS (SELECT conv_id AS pair_id, CASE WHEN k % 5 = 1 THEN 'N' ELSE 'U' END || turn AS unit_id, 'B' || conv_id || '.' || turn || '.' || n AS aid, CASE WHEN n = 1 THEN role WHEN k % 8 = 2 THEN 'other' ELSE 'note' END AS slot FROM c, (VALUES (1), (2)) v(n) WHERE k % 7 <> 3
  UNION ALL SELECT conv_id, 'X' || turn, 'X' || conv_id || '.' || turn || '.' || n, CASE WHEN n = 1 THEN role WHEN k % 8 = 2 THEN 'other' ELSE 'note' END FROM c, (VALUES (1), (2)) v(n) WHERE k % 11 = 0),
err AS (SELECT un.pair_id, up.unit_id AS unit, 'claimed_twice' AS error FROM un JOIN up ON up.pair_id = un.pair_id AND up.unit_id = coalesce(claim, un.unit_id) GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT DISTINCT pair_id, claim, 'unknown_prior' FROM un WHERE claim IS NOT NULL AND (pair_id, claim) NOT IN (SELECT pair_id, unit_id FROM up)
  UNION ALL SELECT pair_id, unit_id, 'repeated_prior' FROM up GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT pair_id, unit_id, 'repeated_unit' FROM (SELECT pair_id, unit_id FROM un) GROUP BY ALL HAVING count(*) > 1),
al AS (SELECT coalesce(p.pair_id, n.pair_id) AS pair_id, p.unit_id AS prior_unit, n.unit_id AS unit, CASE WHEN p.unit_id IS NULL THEN 'added' WHEN n.unit_id IS NULL THEN 'removed' WHEN p.h = n.h THEN 'unchanged' ELSE 'modified' END AS category
  FROM un n FULL JOIN up p ON p.pair_id = n.pair_id AND p.unit_id = coalesce(n.claim, n.unit_id) WHERE coalesce(p.pair_id, n.pair_id) NOT IN (SELECT pair_id FROM err)),
unsafe AS (SELECT DISTINCT conv_id AS pair_id, 'segmentation_reset' AS reason FROM c WHERE conv_id % 23 = 6 UNION ALL SELECT DISTINCT pair_id, 'unresolved_unit' FROM pa WHERE pair_id % 23 <> 6 AND (pair_id, unit_id) NOT IN (SELECT pair_id, unit_id FROM up)),
plan0 AS (SELECT al.*, reason FROM al LEFT JOIN unsafe USING (pair_id)),
plan AS (SELECT pair_id, count(*) FILTER (category = 'unchanged' AND reason IS NULL) AS n_unchanged, count(*) FILTER (category = 'modified' AND reason IS NULL) AS n_modified, count(*) FILTER (category = 'added' AND reason IS NULL) AS n_added, count(*) FILTER (category = 'removed' AND reason IS NULL) AS n_removed,
  CASE WHEN any_value(reason) IS NULL THEN 'delta_safe' ELSE 'full_reextract_required' END AS mode, any_value(reason) AS reason, coalesce(string_agg(unit, ',' ORDER BY unit) FILTER (category IN ('modified', 'added') OR reason IS NOT NULL), '') AS extract FROM plan0 GROUP BY pair_id),
carried AS (SELECT al.pair_id, al.unit, aid AS assertion_id, aid || '@' || substr(sha256(al.pair_id || '|' || al.unit || '|' || aid), 1, 12) AS carried_id, slot AS slot_key, ph AS payload_hash FROM al JOIN pa ON pa.pair_id = al.pair_id AND pa.unit_id = al.prior_unit WHERE category = 'unchanged')"""
MOVES = f"""{UNITS}, safe AS (SELECT al.* FROM al JOIN plan USING (pair_id) WHERE mode = 'delta_safe'), full_ AS (SELECT pair_id FROM plan WHERE mode <> 'delta_safe'),
old_ AS (SELECT s.pair_id, s.unit, slot, aid FROM safe s JOIN pa ON pa.pair_id = s.pair_id AND pa.unit_id = s.prior_unit WHERE category = 'modified'),
new_ AS (SELECT s.pair_id, s.unit, slot, aid FROM safe s JOIN na ON na.pair_id = s.pair_id AND na.unit_id = s.unit WHERE category = 'modified'),
dup AS (SELECT DISTINCT pair_id, unit FROM (SELECT pair_id, unit FROM old_ GROUP BY pair_id, unit, slot HAVING count(*) > 1 UNION ALL SELECT pair_id, unit FROM new_ GROUP BY pair_id, unit, slot HAVING count(*) > 1)),
moves AS (SELECT pair_id, 'supersede' AS action, assertion_id AS old_id, carried_id AS new_id, 'unchanged_unit_carry_forward' AS reason FROM carried WHERE pair_id NOT IN (SELECT pair_id FROM full_)
  UNION ALL SELECT coalesce(o.pair_id, n.pair_id), CASE WHEN n.aid IS NULL THEN 'archive' WHEN o.aid IS NULL THEN 'added' ELSE 'supersede' END, o.aid, n.aid, 'modified_unit_' || CASE WHEN n.aid IS NULL THEN 'old_slot_unmatched' WHEN o.aid IS NULL THEN 'new_slot_unmatched' ELSE 'slot_match' END
    FROM old_ o FULL JOIN new_ n ON o.pair_id = n.pair_id AND o.unit = n.unit AND o.slot = n.slot WHERE (coalesce(o.pair_id, n.pair_id), coalesce(o.unit, n.unit)) NOT IN (SELECT pair_id, unit FROM dup)
  UNION ALL SELECT pair_id, 'review_required', NULL, NULL, 'duplicate_slot' FROM dup
  UNION ALL SELECT s.pair_id, 'archive', aid, NULL, 'removed_unit' FROM safe s JOIN pa ON pa.pair_id = s.pair_id AND pa.unit_id = s.prior_unit WHERE category = 'removed'
  UNION ALL SELECT s.pair_id, 'added', NULL, aid, 'added_unit' FROM safe s JOIN na ON na.pair_id = s.pair_id AND na.unit_id = s.unit WHERE category = 'added'
  UNION ALL SELECT pair_id, 'archive', aid, NULL, 'full_reextract_prior_archived' FROM pa WHERE pair_id IN (SELECT pair_id FROM full_) UNION ALL SELECT pair_id, 'added', NULL, aid, 'full_reextract_new_added' FROM na WHERE pair_id IN (SELECT pair_id FROM full_))"""

# --- evidence ----------------------------------------------------------------------------------------------------------

RECORDS = f"""{BM25}, {top("h8", "SELECT * FROM scores WHERE score > 0", 8)},
rec0 AS (SELECT query_id, rank, h8.chunk_id, h8.ref_id, payload[1:240] AS excerpt, CASE WHEN h8.chunk_id[2] <> '0' THEN locator END AS locator,
  CASE WHEN h8.chunk_id[1] IN ('0', '1', '2') THEN 'high' WHEN h8.chunk_id[1] IN ('3', '4') THEN 'verified' WHEN h8.chunk_id[1] IN ('5', '6', '7') THEN 'medium' WHEN h8.chunk_id[1] IN ('8', '9', 'a', 'b') THEN 'hypothesis' END AS confidence,
  CASE WHEN h8.chunk_id[3] = 'f' THEN NULL WHEN h8.chunk_id[3] = 'e' THEN 'graph' ELSE 'literature' END AS evidence_type FROM h8 JOIN (SELECT DISTINCT chunk_id, payload, locator FROM chunks) c ON c.chunk_id = h8.chunk_id),
rec AS (SELECT *, concat_ws(',', CASE WHEN coalesce(trim(locator), '') = '' THEN 'missing_locator' END, CASE WHEN confidence IS NULL THEN 'missing_confidence' END, CASE WHEN evidence_type IS NULL THEN 'invalid_evidence_type' END) AS reasons,
  NOT (coalesce(trim(locator), '') = '' OR confidence IS NULL OR evidence_type IS NULL) AS guardable FROM rec0)"""
CLAIMS = f"""{RECORDS},
firsts AS (SELECT query_id, list(chunk_id ORDER BY rank, chunk_id) AS ids FROM rec WHERE rank <= 3 GROUP BY query_id),
cl AS (SELECT q.query_id AS i, list_concat(CASE WHEN q.query_id % 7 = 6 THEN [] ELSE coalesce(ids, []) END, CASE WHEN q.query_id % 5 = 0 THEN ['nowhere'] ELSE [] END) AS ids FROM q LEFT JOIN firsts USING (query_id)),
anchors AS (SELECT i, a AS chunk_id, ref_id, locator, confidence, evidence_type FROM (SELECT i, unnest(ids) AS a FROM cl) x JOIN rec r ON r.query_id = x.i AND r.chunk_id = x.a WHERE guardable),
lev AS (SELECT i, count(*) AS n, min(k) AS lo, max(k) AS hi FROM (SELECT i, list_position(['hypothesis', 'medium', 'high', 'verified'], confidence) - 1 AS k FROM anchors) GROUP BY i),
pol AS (SELECT cl.i, coalesce(n, 0) AS n, lo, hi, CASE WHEN n IS NULL THEN 'abstain' WHEN cl.i % 6 = 0 THEN 'conflict_disclosure_required' WHEN lo >= 2 THEN 'factual_allowed' WHEN lo = 1 THEN 'caveated_only' ELSE 'pending_hypothesis_only' END AS policy FROM cl LEFT JOIN lev USING (i)),
meta AS (SELECT 'DOC-' || doc_id AS ref_id, CASE WHEN doc_id % 2 = 0 THEN 'a title' ELSE 'another' END AS title, CASE WHEN doc_id % 3 <> 0 THEN '10.1000/' || (doc_id % 5) END AS doi FROM documents WHERE doc_id % 10 <> 9),
clm AS (SELECT i, ids, CASE WHEN i % 2 = 0 THEN 'DOC-' || i END AS cref, CASE WHEN i % 3 <> 1 THEN '10.1000/' || (i % 5) END AS cdoi, CASE WHEN i % 4 <> 1 THEN 'A Title' END AS ctitle, CASE WHEN i % 2 = 1 THEN 'A' || i END AS assertion_id FROM cl),
locs AS (SELECT 'DOC-' || doc_id AS ref_id, CASE WHEN doc_id % 4 = 2 THEN 'p.1' ELSE source END AS locator FROM documents WHERE doc_id % 4 <> 3)"""

PACKAGES = """cust AS (SELECT c_custkey AS k, lower(c_name) AS nm FROM customer),
pk AS (SELECT k, 'P-' || k AS package_id, CASE WHEN k % 41 = 0 THEN 'PV-none' ELSE 'PV-' || k END AS prior_id, 'NV-' || k AS new_id, 'R' || k AS prior_ref, CASE WHEN k % 19 = 0 THEN 'N0' ELSE 'N' || k END AS new_ref, CASE WHEN k % 23 = 0 THEN 'corrected_version' ELSE 'revision_of' END AS relation,
  CASE WHEN k % 29 = 0 THEN 'W0' ELSE 'W' || k END AS work_id, CASE WHEN k % 31 = 0 THEN 'kbv-2' ELSE 'kbv-1' END AS bound, k % 17 = 0 AS manual, CASE WHEN k % 37 <> 0 THEN 'N' || k END AS source_ref, CASE WHEN k % 13 = 0 THEN 'fp9' ELSE 'fp2' END AS fp, 'N' || k AS set_ref,
  CASE WHEN k % 43 = 0 THEN 'Z' ELSE 'N' || k END AS report_ref, CASE WHEN k % 7 = 0 THEN 'rejected' ELSE 'successful' END AS report_status, (k % 47 = 0)::INT AS returned, CASE WHEN k % 53 = 0 THEN 'other' ELSE nm END AS title, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 11 = 0 THEN 'rejected' ELSE 'approved' END AS decision,
  CASE WHEN k % 59 = 0 THEN 'P-0' ELSE 'P-' || k END AS apkg, CASE WHEN k % 61 = 0 THEN '' ELSE 'someone' END AS approver, CASE WHEN k % 10 = 3 THEN 'other' ELSE 'P-' || k || '/N' || k || '/fp2' END AS scope, k % 73 <> 0 AS asks FROM cust),
rg AS (SELECT 'PV-' || k AS sv, 'W' || k AS work_id, 'R' || k AS ref_id, 'none' AS relation, NULL AS prior, 'fp1' AS fp, 'kbv-1' AS kb, CASE WHEN k % 67 <> 0 THEN 's' || k END AS snap, nm FROM cust
  UNION ALL SELECT 'NV-' || k, 'W' || k, 'N' || k, 'revision_of', CASE WHEN k % 71 = 0 THEN 'PV-0' ELSE 'PV-' || k END, 'fp2', NULL, NULL, nm FROM cust),
tg AS (SELECT 'P-' || o_custkey AS package_id, 'A' || o_orderkey AS id, o_orderpriority AS m, o_orderkey AS o FROM orders),
rq AS (SELECT package_id, id, CASE WHEN o % 89 = 0 THEN 'changed' ELSE m END AS m FROM tg WHERE o % 97 <> 0),
dc AS (SELECT package_id, CASE WHEN o % 79 = 0 THEN 'Z' || o ELSE id END AS id, CASE WHEN o % 83 = 0 THEN 'pending_review' WHEN o % 3 = 0 THEN 'downgrade' ELSE 'accept' END AS action FROM tg, (VALUES (1), (2)) v(n) WHERE o % 61 <> 0 AND (n = 1 OR o % 67 = 0))"""

_R = "WITH RECURSIVE "
ORACLE: dict[str, str] = {
    "chunk_text_windows": f"WITH {WINDOWS} SELECT ref_id, idx, chunk_id, n_tokens, sha256(payload) AS payload_hash FROM fine",
    "chunk_document_summary": f"WITH {CHUNKS} SELECT ref_id, chunk_id, n_tokens, payload FROM coarse",
    "chunk_evidence_card": f"""WITH {CURATION}, card AS (SELECT ref_id, id, NULL::VARCHAR AS page, locator AS section, 'Subject: ' || entity || chr(10) || 'Property: ' || property || chr(10) || rtrim('Value: ' || coalesce(v::VARCHAR, vt) || ' ' || coalesce(unit, '')) || chr(10) || 'Conditions: LineStatus=' || cond || chr(10) || 'Ref: ' || ref_id || chr(10) || 'Locator: ' || coalesce(locator, '-') || chr(10) || 'Confidence: ' || confidence AS c FROM asr),
        full_ AS (SELECT *, {prefix("证据卡")} || ' ' || c AS payload FROM card) SELECT ref_id, {chunk_id("'evidence:' || id", "c")} AS chunk_id, {n_tokens("payload")} AS n_tokens, sha256(payload) AS payload_hash FROM full_""",
    "chunk_table_card": f"""WITH t AS (SELECT 'T-' || r_name AS ref_id, '1' AS page, NULL::VARCHAR AS section, r_name, 'Caption: Nations of ' || r_name || chr(10) || 'Headers: nation, key' || chr(10) || 'Rows: ' || string_agg(n_name, chr(10) ORDER BY n_name) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
        f AS (SELECT *, {prefix("表")} || ' ' || c AS payload FROM t) SELECT ref_id, {chunk_id("'table:' || r_name", "c")} AS chunk_id, {n_tokens("payload")} AS n_tokens, payload FROM f""",
    "chunk_chart_card": f"""WITH t AS (SELECT 'C-' || r_name AS ref_id, NULL::VARCHAR AS page, 'figures' AS section, r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'Caption: ' || r_name || CASE WHEN r_regionkey % 4 = 0 THEN chr(10) || 'Axes: x: nation, y: key' ELSE '' END ELSE 'Chart ' || r_regionkey END AS c FROM region),
        f AS (SELECT *, {prefix("图")} || ' ' || c AS payload FROM t) SELECT ref_id, {chunk_id("'chart:' || r_regionkey", "c")} AS chunk_id, {n_tokens("payload")} AS n_tokens, payload FROM f""",
    "bm25_term_stats": f"WITH {BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term",
    "bm25_topk": f"WITH {BM25}, {HITS10} SELECT query_id, chunk_id, ref_id, score, rank FROM hits",
    "vector_topk": f"WITH {VECTORS}, {top('t', 'SELECT query_id, chunk_id, ref_id, score FROM near', 10)} SELECT * FROM t",
    "vector_filtered_topk": f"WITH {VECTORS}, {top('t', 'SELECT query_id, chunk_id, ref_id, score FROM near WHERE same', 5)} SELECT * FROM t",
    "rrf_fusion": f"WITH {BM25}, {top('a', 'SELECT * FROM scores WHERE score > 0', 20)}, {top('f', chr(39).join(['SELECT * FROM scores WHERE score > 0 AND level = ', 'fine', '']), 20)}, {rrf('r', 'SELECT query_id, chunk_id, ref_id, rank, 1 AS channel FROM a UNION ALL SELECT query_id, chunk_id, ref_id, rank, 2 FROM f', 10)} SELECT * FROM r",
    "hybrid_coarse_to_fine": f"WITH {HYBRID} SELECT query_id, chunk_id, ref_id, score, rank FROM final",
    "hybrid_diagnostics": f"WITH {HYBRID} SELECT s.query_id, coarse_hits, count(f.chunk_id) AS fine_hits, CASE WHEN coarse_hits > 0 THEN 'ok' ELSE 'fallback' END AS coarse_status, coarse_hits = 0 AS fallback_used, 'keyword' AS channels_used FROM status s LEFT JOIN final f USING (query_id) GROUP BY s.query_id, coarse_hits",
    "hybrid_vector_keyword": f"WITH {BOTH} SELECT query_id, chunk_id, ref_id, score, n_channels, rank FROM final",
    "retrieval_metrics": f"WITH {BM25}, {HITS10}, f AS (SELECT q.query_id, min(rank) AS r FROM q LEFT JOIN hits h ON h.query_id = q.query_id AND h.ref_id = 'DOC-' || q.query_id GROUP BY q.query_id) SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 9) AS recall_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 9) AS recall_at_3, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr FROM f",
    "query_expansion": f"WITH {EXPANDED} SELECT item_id AS query_id, text FROM wide",
    "hybrid_expanded_reranked": f"""WITH {EXPANDED}, {HYBRID.replace("FROM benchmark)", "FROM wide)")}, o AS (SELECT f.query_id, f.chunk_id, f.ref_id, f.score, round(len(list_intersect(list_distinct({words("q.text")}), regexp_split_to_array(lower(c.payload), '\\s+'))) / len(list_distinct({words("q.text")}))::DOUBLE, 9) AS rerank_score FROM final f JOIN q USING (query_id) JOIN chunks c ON c.chunk_id = f.chunk_id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM o""",
    "rerank_scores": f"""WITH {BM25}, {HITS10}, o AS (SELECT h.query_id, h.chunk_id, h.score, round(len(list_intersect(list_distinct({words("q.text")}), regexp_split_to_array(lower(c.payload), '\\s+'))) / len(list_distinct({words("q.text")}))::DOUBLE, 9) AS rerank_score FROM hits h JOIN q USING (query_id) JOIN chunks c ON c.chunk_id = h.chunk_id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM o""",
    "eligible_hits_progressive": f"""WITH {VECTORS}, {LATEST}, {top("all_", "SELECT query_id, chunk_id, ref_id, score FROM near", None)}, sz AS (SELECT query_id, max(rank) AS size FROM all_ GROUP BY query_id),
        el AS (SELECT a.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM all_ a WHERE ref_id NOT IN (SELECT ref_id FROM latest WHERE status <> 'active')), tr AS (SELECT query_id, min(rank) FILTER (seen >= 30) AS t FROM el GROUP BY query_id)
        SELECT query_id, chunk_id, ref_id, rank FROM el JOIN tr USING (query_id) JOIN sz USING (query_id) WHERE rank <= CASE WHEN t IS NULL THEN size ELSE 50 * pow(2, ceil(log2(greatest(t / 50.0::DOUBLE, 1)))) END""",
    "eligible_hits_as_of_version": f"""{_R}{ANCESTORS}, {LIFE}, {VECTORS}, mid AS (SELECT list(version_id ORDER BY version_id)[count(*) // 2 + 1] AS v FROM ver),
        seen AS (SELECT l.* FROM mid JOIN anc a ON a.version_id = mid.v JOIN life l ON l.effective_version_id = a.ancestor_id),
        docs AS (SELECT ref_id, arg_max(status, created_seq) AS s FROM seen GROUP BY ref_id), own AS (SELECT 'V-' || created_seq AS chunk_id FROM seen WHERE status IN ('archived', 'superseded')),
        {top("all_", "SELECT query_id, chunk_id, ref_id, score FROM near", None)}, sz AS (SELECT query_id, max(rank) AS size FROM all_ GROUP BY query_id),
        el AS (SELECT a.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM all_ a WHERE ref_id NOT IN (SELECT ref_id FROM docs WHERE s <> 'active') AND chunk_id NOT IN (SELECT chunk_id FROM own)), tr AS (SELECT query_id, min(rank) FILTER (seen >= 30) AS t FROM el GROUP BY query_id)
        SELECT query_id, chunk_id, ref_id, rank FROM el JOIN tr USING (query_id) JOIN sz USING (query_id) WHERE rank <= CASE WHEN t IS NULL THEN size ELSE 50 * pow(2, ceil(log2(greatest(t / 50.0::DOUBLE, 1)))) END""",
    "lifecycle_latest_document_state": f"WITH {LATEST} SELECT ref_id, lifecycle_id, status, effective_version_id, created_seq FROM latest",
    "version_ancestors": f"{_R}{ANCESTORS} SELECT * FROM anc",
    "lifecycle_state_as_of_version": f"{_R}{ANCESTORS}, {LIFE} SELECT version_id, ref_id, lifecycle_id, status FROM (SELECT a.version_id, l.*, row_number() OVER (PARTITION BY a.version_id, ref_id ORDER BY created_seq DESC, lifecycle_id DESC) AS n FROM anc a JOIN life l ON l.effective_version_id = a.ancestor_id) WHERE n = 1",
    "version_tree_labels": f"{_R}{BRANCHES}, up AS (SELECT v, arg_max(a, steps) AS root, max(steps) AS depth FROM line GROUP BY v), down AS (SELECT a, count(*) - 1 AS n FROM line GROUP BY a) SELECT 'E' || v AS version_id, 'E' || root AS tree, depth, n AS n_descendants FROM up JOIN down ON v = down.a",
    "branch_states": f"{_R}{BRANCHES} SELECT 'E' || line.v AS version_id, event_type, 'E' || max(a) AS last_event FROM line JOIN bv ON bv.v = line.a GROUP BY line.v, event_type",
    "training_eligibility": f"WITH {DOCS}, {LATEST} SELECT DISTINCT d.ref_id, coalesce(status, 'active') AS status, coalesce(status, 'active') = 'active' AS visible, coalesce(status, 'active') = 'active' AS trainable FROM docs d LEFT JOIN latest USING (ref_id)",
    "assertion_eligibility": f"""WITH {CURATION}, {LATEST}, ds AS (SELECT c.ref_id, coalesce(status, 'active') AS ds FROM cdocs c LEFT JOIN latest l ON c.ref_id = 'S' || substr(l.ref_id, 5)),
        own AS (SELECT DISTINCT id, CASE confidence WHEN 'hypothesis' THEN 'archived' WHEN 'medium' THEN 'superseded' ELSE 'active' END AS o FROM asr WHERE speculative),
        x AS (SELECT id, ref_id, ds <> 'active' AS hidden, ds, coalesce(o, 'active') AS o FROM asr LEFT JOIN ds USING (ref_id) LEFT JOIN own USING (id))
        SELECT id, ref_id, CASE WHEN hidden THEN ds ELSE o END AS status, NOT hidden AND o = 'active' AS visible FROM x""",
    "outbox_sequence": "SELECT event_id, event_type, 1000 + row_number() OVER (ORDER BY event_id) AS created_seq FROM events",
    "completeness_check": f"WITH {CURATION}, {complete('')} SELECT ref_id, status, n AS assertion_count, mu AS units_missing, ml AS locators_missing, charts_low, grade <> 'D' AND NOT lacking AND NOT (n = 0 AND NOT no_data) AS allows_formal, grade = 'C' OR mu > 0 AS requires_manual_review, lacking AS requires_return_upstream FROM cm",
    "completeness_issues": f"""WITH {CURATION}, {complete('')} SELECT ref_id, 'metadata_incomplete' AS code FROM cm WHERE lacking UNION ALL SELECT ref_id, 'no_assertions' FROM cm WHERE n = 0 AND NOT no_data UNION ALL SELECT ref_id, 'missing_units' FROM cm WHERE mu > 0 UNION ALL SELECT ref_id, 'missing_locators' FROM cm WHERE ml > 0
        UNION ALL SELECT ref_id, 'chart_quality_low' FROM cm WHERE charts_low UNION ALL SELECT ref_id, 'parsed_doc_manual_review' FROM cm WHERE grade = 'C' UNION ALL SELECT ref_id, 'parsed_doc_not_formal' FROM cm WHERE grade = 'D'""",
    "conflict_pairs": f"WITH {CURATION} SELECT new_id, existing_id, conflict_type FROM pairs",
    "conflict_counts": f"""WITH {CURATION} SELECT a.id, a.ref_id, count(*) FILTER (conflict_type = 'consistent') AS n_consistent, count(*) FILTER (conflict_type = 'condition_difference') AS n_condition, count(*) FILTER (conflict_type = 'numeric_conflict') AS n_numeric, count(*) FILTER (conflict_type = 'relation_conflict') AS n_relation
        FROM asr a LEFT JOIN pairs ON new_id = a.id AND new_ref = a.ref_id WHERE a.is_new GROUP BY a.id, a.ref_id""",
    "conflict_summary": f"WITH {CURATION} SELECT conflict_type, count(*) AS n FROM pairs GROUP BY conflict_type",
    "mechanism_violations": f"WITH {CURATION} SELECT * FROM viol",
    "quality_score": f"WITH {CURATE} SELECT * FROM quality",
    "decide_assertions": f"WITH {CURATE} SELECT * FROM decisions",
    "curation_report": f"WITH {CURATE} SELECT ref_id, n_accept, n_downgrade, n_pending_review, n_reject, n_return_upstream, report_status, total AS quality, total < 0.5 AS low_quality FROM report",
    "commit_eligibility": f"WITH {CURATE}, x AS (SELECT ref_id, CASE WHEN report_status = 'return_upstream' THEN 'returned_upstream' WHEN n = 0 THEN 'no_decisions' WHEN n_reject = n THEN 'all_rejected' END AS reason FROM report) SELECT ref_id, reason IS NULL AS publishable, reason FROM x",
    "admit_assertions": f"WITH {ADMITTED} SELECT id, ref_id, action, visibility, decided_confidence FROM adm",
    "snapshot_manifest": f"WITH {ADMITTED}, h AS (SELECT ref_id, sha256(id || '|' || visibility || '|' || decided_confidence) AS h FROM adm) SELECT ref_id, count(*) AS n_assertions, {set_hash('h')} AS content_hash FROM h GROUP BY ref_id",
    "slot_key_duplicates": f"""WITH {CURATION}, s AS (SELECT ref_id, substr(sha256({packed("NULL", "entity", "property", "CASE WHEN relation THEN 'relation' ELSE 'measurement' END", "CASE WHEN relation THEN 'enum' ELSE 'number' END", packed("'LineStatus'", "cond", "''"))}), 1, 16) AS slot_key FROM asr)
        SELECT ref_id, slot_key, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1""",
    "idempotent_snapshot_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS submissions FROM documents GROUP BY 1",
    "request_validation": f"WITH {CURATE} SELECT assertion_id AS id, 'missing_decision' AS error FROM decisions WHERE action = 'reject' UNION ALL SELECT assertion_id, 'duplicate_decision' FROM decisions WHERE action = 'return_upstream'",
    "normalize_identifiers": r"""WITH p AS (SELECT page_id, 'https://doi.org/10.1000/' || upper(url) AS d, trim(url) AS s, 'a title ' || lower(url) AS t FROM pages)
        SELECT page_id, substr(lower(d), 17) AS work_doi, substr(lower(d), 17) AS cited_doi, s AS stable_id, t AS title, 'eddo:page:' || replace(lower(s), ' ', '_') AS entity FROM p""",
    "normalize_title_nfkc": r"SELECT doc_id, nullif(replace(lower(nfc_normalize(trim(regexp_replace(text, '\s+', ' ', 'g')))), 'ß', 'ss'), '') AS title FROM documents",  # exact where a text has no sign that only compatibility folding changes
    "source_intake_classification": f"WITH {intake('sub')} SELECT seq, disposition, work_id, relation, conflict_reason FROM intake",
    # One row after the other; the recurring table holds what each key is known to name.
    "ordered_intake": f"""WITH RECURSIVE {SOURCES},
        both_ AS (SELECT seq * 2 AS seq, ref_id, fp, doi, sid, md5(ttl) AS t FROM hist UNION ALL SELECT seq * 2 + 1, ref_id, fp, doi, sid, md5(ttl) FROM sub),
        o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, *, 'r' || ref_id || '|' || fp AS rk FROM both_),
        st(k, w, seq, disposition, doi, sid, t) USING KEY (k) AS (
          SELECT 'at', 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR
          UNION
          SELECT u.k, CASE WHEN u.k = 'at' THEN i ELSE w END, seq, disposition, doi, sid, t FROM (
            SELECT *, CASE disposition WHEN 'new_work' THEN seq WHEN 'same_work_new_version' THEN coalesce(dw, sw) WHEN 'exact_replay' THEN kw WHEN 'identity_conflict' THEN kw END AS w FROM (
              SELECT *, CASE WHEN kw IS NOT NULL THEN CASE WHEN coalesce(doi <> kd, false) OR coalesce(sid <> ks, false) OR coalesce(t <> kt, false) THEN 'identity_conflict' ELSE 'exact_replay' END
                WHEN dw <> sw THEN 'identity_conflict' WHEN dw IS NOT NULL OR sw IS NOT NULL THEN 'same_work_new_version' WHEN tw IS NOT NULL THEN 'review_required' ELSE 'new_work' END AS disposition
              FROM (SELECT o.*, d.w AS dw, s.w AS sw, x.w AS tw, r.w AS kw, r.doi AS kd, r.sid AS ks, r.t AS kt FROM st p JOIN o ON o.i = p.w + 1
                LEFT JOIN recurring.st d ON d.k = 'd' || o.doi LEFT JOIN recurring.st s ON s.k = 's' || o.sid LEFT JOIN recurring.st x ON x.k = 't' || o.t LEFT JOIN recurring.st r ON r.k = o.rk WHERE p.k = 'at'))) y,
            (SELECT unnest(['at', 'out', 'd', 's', 't', 'r']) AS tag) g, LATERAL (SELECT CASE tag WHEN 'at' THEN 'at' WHEN 'out' THEN 'out' || i WHEN 'd' THEN CASE WHEN dw IS NULL THEN 'd' || doi END WHEN 's' THEN CASE WHEN sw IS NULL THEN 's' || sid END WHEN 't' THEN 't' || t ELSE rk END AS k) u
          WHERE u.k IS NOT NULL AND (tag IN ('at', 'out') OR disposition IN ('new_work', 'same_work_new_version'))
        )
        SELECT seq, disposition, w AS work_seq, CASE disposition WHEN 'identity_conflict' THEN CASE WHEN w IS NOT NULL THEN 'material contradiction on replay' ELSE 'doi and stable id of different works' END END AS conflict_reason FROM st WHERE starts_with(k, 'out')""",
    "explicit_lineage_classification": f"WITH {intake('lin')} SELECT seq, disposition, work_id, relation, conflict_reason FROM intake",
    "source_registration": f"""WITH {intake('lin')} SELECT ref_id, CASE WHEN disposition = 'new_work' THEN substr(sha256({packed("'new_work'", "ref_id", "fp")}), 1, 16) ELSE work_id END AS work_id, coalesce(erel, CASE WHEN disposition = 'new_work' THEN 'none' ELSE 'revision_of' END) AS relation, eprior AS prior_source_version_id, kind AS source_kind, doi AS norm_doi, sid AS norm_stable
        FROM intake WHERE disposition IN ('new_work', 'same_work_new_version')""",
    "align_content_units": f"WITH {UNITS} SELECT * FROM al",
    "alignment_errors": f"WITH {UNITS} SELECT * FROM err",
    "extraction_requests": f"WITH {UNITS}, x AS (SELECT pair_id, unnest(string_split(extract, ',')) AS unit_id, CASE WHEN mode = 'delta_safe' THEN 'changed_or_added_units_only' ELSE 'full_reextract_required' END AS reason FROM plan WHERE extract <> '') SELECT x.pair_id, x.unit_id, locator, reason FROM x JOIN un USING (pair_id, unit_id)",
    "content_delta_plan": f"WITH {UNITS} SELECT * FROM plan",
    "carry_forward": f"WITH {UNITS} SELECT * FROM carried",
    "assertion_transitions": f"WITH {MOVES} SELECT * FROM moves",
    "revision_actions": f"""WITH {MOVES}, o AS (SELECT DISTINCT pair_id, id FROM (SELECT pair_id, old_id AS id FROM moves WHERE action IN ('supersede', 'archive') UNION ALL SELECT pair_id, new_id FROM moves WHERE action = 'added') WHERE id IS NOT NULL), a AS (SELECT pair_id, string_agg(id, ',' ORDER BY id) AS affected FROM o GROUP BY pair_id)
        SELECT m.pair_id, coalesce(any_value(affected), '') AS affected, coalesce(string_agg(DISTINCT new_id, ',' ORDER BY new_id) FILTER (action IN ('supersede', 'added')), '') AS replacement, count(*) FILTER (action = 'supersede') AS n_supersede, count(*) FILTER (action = 'archive') AS n_archive, count(*) FILTER (action = 'added') AS n_added, count(*) FILTER (action = 'review_required') AS n_review_required, count(*) FILTER (action = 'review_required') > 0 AS needs_review
        FROM moves m LEFT JOIN a USING (pair_id) GROUP BY m.pair_id""",
    "evidence_normalization": f"WITH {RECORDS} SELECT query_id, rank, chunk_id, evidence_type, reasons, guardable, sha256(excerpt) AS excerpt_hash FROM rec",
    "coverage_by_subquery": f"WITH {RECORDS} SELECT 'b' || (q.query_id // 4) AS bundle_id, 'sq' || q.query_id AS coverage_key, count(r.chunk_id) AS hit_count, count(*) FILTER (guardable) AS guardable_count, count(*) FILTER (guardable) >= 1 AS covered FROM q LEFT JOIN rec r USING (query_id) GROUP BY q.query_id",
    "claim_policy": f"WITH {CLAIMS} SELECT i AS claim_id, policy, ['hypothesis', 'medium', 'high', 'verified'][lo + 1] AS effective_confidence, n AS n_anchors FROM pol",
    "claim_abstain": f"""WITH {CLAIMS}, x AS (SELECT i, n, concat_ws(',', CASE WHEN i % 11 = 10 THEN 'private_data_unauthorized' END, CASE WHEN i % 8 = 7 THEN 'low_retrieval_support' END,
        CASE WHEN i % 4 = 0 AND (i % 8 = 0 OR NOT EXISTS (SELECT 1 FROM rec WHERE guardable AND rec.query_id = i)) THEN 'subquestion_not_covered' END, CASE WHEN i % 3 = 0 AND coalesce(hi, 0) = 0 THEN 'critical_numeric_only_hypothesis_or_pending' END, CASE WHEN i % 9 = 8 THEN 'unsupported_inference_no_mechanism' END) AS reasons FROM pol)
        SELECT i AS claim_id, reasons <> '' OR n = 0 AS abstain, reasons FROM x""",
    "hallucination_h1": f"""WITH {CLAIMS}, k AS (SELECT a.*, m.ref_id IS NOT NULL AS known, EXISTS (SELECT 1 FROM locs l WHERE l.ref_id = a.ref_id) AS indexed, EXISTS (SELECT 1 FROM locs l WHERE l.ref_id = a.ref_id AND trim(l.locator) = trim(a.locator)) AS present FROM anchors a LEFT JOIN meta m ON m.ref_id = a.ref_id)
        SELECT i AS claim_id, 'ref_not_resolvable' AS finding, ref_id, NULL::VARCHAR AS locator_status FROM k WHERE NOT known UNION ALL SELECT i, 'locator_absent', ref_id, 'verified_absent' FROM k WHERE indexed AND NOT present UNION ALL SELECT i, 'no_anchor', NULL, NULL FROM pol WHERE n = 0""",
    "hallucination_h2": f"""WITH {CLAIMS}, k AS (SELECT a.i, a.ref_id, m.ref_id IS NOT NULL AS known, cref = a.ref_id AS cites, lower(cdoi) AS cdoi, lower(ctitle) AS ctitle, title, doi FROM anchors a JOIN clm ON clm.i = a.i LEFT JOIN meta m ON m.ref_id = a.ref_id WHERE evidence_type = 'literature')
        SELECT i AS claim_id, 'ref_not_found' AS finding, ref_id FROM k WHERE NOT known UNION ALL SELECT i, 'doi_mismatch', ref_id FROM k WHERE known AND cites AND doi <> cdoi UNION ALL SELECT i, 'title_mismatch', ref_id FROM k WHERE known AND cites AND title <> ctitle""",
    "hallucination_h2_status": f"""WITH {CLAIMS}, k AS (SELECT clm.*, m.ref_id IS NOT NULL AS known, m.title, m.doi, EXISTS (SELECT 1 FROM rec WHERE rec.query_id = clm.i AND rec.query_id % 23 <> 22) AS found FROM clm LEFT JOIN meta m ON m.ref_id = cref),
        s AS (SELECT i, CASE WHEN NOT found THEN 'metadata_unavailable' WHEN cref IS NULL AND cdoi IS NULL AND ctitle IS NULL AND len(ids) = 0 THEN 'not_applicable' WHEN cdoi IS NULL AND ctitle IS NULL THEN 'checked' WHEN NOT known THEN 'metadata_unavailable'
          WHEN (cdoi IS NULL OR doi IS NOT NULL) AND (ctitle IS NULL OR title IS NOT NULL) THEN 'checked' WHEN cdoi IS NOT NULL AND ctitle IS NOT NULL THEN 'partial' ELSE 'metadata_unavailable' END AS s FROM k) SELECT i AS claim_id, s = 'checked' AS h2_checked, s AS h2_status FROM s""",
    "hallucination_h3": f"WITH {CLAIMS}, bad AS (SELECT 'A' || item_id AS id FROM benchmark WHERE item_id % 5 = 0) SELECT i AS claim_id, CASE WHEN assertion_id IS NULL THEN 'not_checked' ELSE 'checked' END AS h3_status, coalesce(assertion_id IN (SELECT id FROM bad), false) AS violated FROM clm",
    "evidence_answer": f"""WITH {RECORDS}, cov AS (SELECT query_id, bool_or(guardable) AS covered FROM rec GROUP BY query_id), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM rec),
        first3 AS (SELECT query_id, bool_and(excerpt <> '') AS texts FROM f WHERE n <= 3 GROUP BY query_id), ok AS (SELECT query_id, count(*) AS c, string_agg(chunk_id, ',' ORDER BY rank) AS a FROM f JOIN cov USING (query_id) JOIN first3 USING (query_id) WHERE n <= 3 AND covered AND texts AND guardable AND confidence IN ('high', 'verified') GROUP BY query_id)
        SELECT q.query_id, CASE WHEN c IS NULL THEN 'abstain' ELSE 'answered' END AS status, coalesce(c, 0) AS n_claims, coalesce(a, '') AS anchors FROM q LEFT JOIN ok USING (query_id)""",
}

def evidence_hits(fine: str = "5", coarse: str = "10") -> str:
    """Records of the requests, each subquery down to depths that may depend on the request i."""
    depth = lambda name, rows, k: f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, split_part(query_id, '#', 1)::BIGINT AS i FROM {rows})) WHERE rank <= {k})"
    return f"""req AS (SELECT item_id AS i, text, CASE item_id % 3 WHEN 1 THEN [text[1:100], text[101:]] WHEN 2 THEN [text, 'zzqx qqzx'] ELSE [text] END AS subs, CASE WHEN item_id % 4 = 1 THEN ['sq1'] END AS need, item_id % 7 = 3 AS private, CASE item_id % 5 WHEN 2 THEN 0.1 WHEN 3 THEN 0.9 END AS support FROM benchmark),
        subq AS (SELECT i, unnest(range(0, len(subs))) AS pos, subs FROM req), {BM25.replace("SELECT item_id AS query_id, text FROM benchmark", "SELECT i || '#' || pos AS query_id, i, subs[pos + 1] AS text, i % 6 = 5 AS limited FROM subq")},
        may AS (SELECT s.* FROM scores s JOIN q USING (query_id) WHERE score > 0 AND (NOT limited OR (substr(ref_id, 5)::BIGINT BETWEEN i * 5 AND i * 5 + 200))),
        {depth("ck", "may WHERE level = 'coarse'", coarse)}, {rrf("picked", "SELECT *, 'keyword' AS channel FROM ck", 10)},
        {depth("fk", "may m WHERE level = 'fine' AND EXISTS (SELECT 1 FROM picked p WHERE p.query_id = m.query_id AND p.ref_id = m.ref_id)", fine)}, {rrf("final", "SELECT *, 'keyword' AS channel FROM fk", 5)},
        r AS (SELECT f.query_id, f.chunk_id, f.ref_id, f.rank, coalesce(trim(locator), '') <> '' AS guardable FROM final f JOIN (SELECT DISTINCT chunk_id, locator FROM chunks) USING (chunk_id))"""


def _quoted(items) -> str:
    return ", ".join("'" + x + "'" for x in items)


_TASKS = f"""txt AS (SELECT item_id, lower(text || ' ' || [{_quoted(PHRASES)}][(item_id % {len(PHRASES)} + 1)::INT]) AS l FROM benchmark),
kw AS (SELECT t, o, unnest(w) AS w FROM (VALUES {", ".join(f"('{t}', {o}, [{_quoted(w)}])" for o, (t, w) in enumerate(KEYWORDS.items()))}) v(t, o, w)),
votes AS (SELECT item_id, t, o, count(*) AS n FROM txt, kw WHERE contains(l, w) GROUP BY ALL),
t AS (SELECT item_id AS task_id, (SELECT v.t FROM votes v WHERE v.item_id = txt.item_id ORDER BY n DESC, o LIMIT 1) AS task_type FROM txt)"""
_STEPS = f"steps(task_type, l) AS (VALUES {', '.join(f"('{t}', [{_quoted(f'step-{k + 1}-{x}' for k, x in enumerate(w))}])" for t, w in STEPS.items())})"


def _first_gate(*gates: tuple[str, str, str]) -> str:
    """(status, name, what must be true), in order."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({rule}, false) THEN '{status}:{name}'" for status, name, rule in gates) + " END"


_GATES = _first_gate(
    ("package_review_required", "review_required", "NOT manual"), ("failed", "no_request", "source_ref IS NOT NULL"), ("failed", "unknown_version", "p.sv IS NOT NULL AND n.sv IS NOT NULL"), ("conflict", "prior_ref", "p.ref_id = prior_ref"),
    ("conflict", "new_ref", "n.ref_id = new_ref"), ("conflict", "relation", "n.relation = x.relation"), ("conflict", "work", "p.work_id = x.work_id AND n.work_id = x.work_id"), ("conflict", "prior_version", "n.prior = p.sv"), ("conflict", "bound_version", "p.kb = bound"),
    ("conflict", "no_snapshot", "p.snap IS NOT NULL"), ("conflict", "fingerprint", "x.fp = n.fp"), ("failed", "invalid_request", "source_ref = set_ref AND source_ref = report_ref"), ("conflict", "source_ref", "source_ref = new_ref"),
    ("conflict", "assertion_ids", "NOT EXISTS (SELECT 1 FROM tg FULL JOIN rq ON tg.package_id = rq.package_id AND tg.id = rq.id WHERE coalesce(tg.package_id, rq.package_id) = x.package_id AND (tg.id IS NULL OR rq.id IS NULL))"),
    ("conflict", "assertion_material", "NOT EXISTS (SELECT 1 FROM tg JOIN rq ON tg.package_id = rq.package_id AND tg.id = rq.id WHERE tg.package_id = x.package_id AND tg.m <> rq.m)"), ("conflict", "title", "title = n.nm"),
    ("failed", "repeated_decision", "x.package_id NOT IN (SELECT package_id FROM dc GROUP BY package_id, id HAVING count(*) > 1)"), ("conflict", "foreign_decision", "x.package_id NOT IN (SELECT package_id FROM dc WHERE (package_id, id) NOT IN (SELECT package_id, id FROM tg))"),
    ("failed", "action", "x.package_id NOT IN (SELECT package_id FROM dc WHERE action NOT IN ('accept', 'downgrade'))"), ("failed", "undecided", "x.package_id NOT IN (SELECT package_id FROM tg WHERE (package_id, id) NOT IN (SELECT package_id, id FROM dc))"),
    ("failed", "returned_upstream", "returned = 0"), ("failed", "report_status", "report_status NOT IN ('return_upstream', 'pending_review', 'rejected')"), ("approval_required", "no_approval", "NOT asks OR decision IS NOT NULL"), ("approval_rejected", "rejected", "NOT asks OR decision = 'approved'"),
    ("conflict", "approval_package", "NOT asks OR apkg = x.package_id"), ("conflict", "approval_scope", "NOT asks OR scope = x.package_id || '/' || source_ref || '/' || x.fp"), ("approval_required", "approval_identity", "NOT asks OR approver <> ''"),
)
_BUILT = _first_gate(
    ("", "unknown_work", "x.work_id IN (SELECT work_id FROM rg)"), ("", "unknown_prior", "p.sv IS NOT NULL"), ("", "unknown_new", "n.sv IS NOT NULL"), ("", "other_work", "p.work_id = x.work_id AND n.work_id = x.work_id"), ("", "other_prior", "n.prior = prior_id"), ("", "other_relation", "n.relation = x.relation"),
    ("", "prior_unbound", "p.kb IS NOT NULL AND p.snap IS NOT NULL"),
)
ORACLE |= {
    "task_classification": f"WITH {_TASKS} SELECT * FROM t",
    "task_plan": f"WITH {_TASKS}, {_STEPS}, u AS (SELECT task_id, task_type, l, unnest(range(0, len(l))) AS position FROM t JOIN steps USING (task_type)) SELECT task_id, task_type, position, l[position + 1] AS step, CASE WHEN position > 0 THEN l[position] END AS depends_on FROM u",
    "publication_gate": f"WITH {PACKAGES}, g AS (SELECT x.package_id, {_GATES} AS f FROM pk x LEFT JOIN rg p ON p.sv = prior_id LEFT JOIN rg n ON n.sv = new_id) SELECT package_id, f IS NULL AS allowed, coalesce(split_part(f, ':', 1), 'allowed') AS status, split_part(f, ':', 2) AS refused_by FROM g",
    "revision_packages": f"WITH {PACKAGES}, g AS (SELECT x.package_id, p.ref_id AS prior_ref, n.ref_id AS new_ref, {_BUILT} AS f FROM pk x LEFT JOIN rg p ON p.sv = prior_id LEFT JOIN rg n ON n.sv = new_id) SELECT package_id AS pair_id, f IS NULL AS built, prior_ref, new_ref, 'manual_correction' AS lifecycle_reason, split_part(f, ':', 2) AS error FROM g",
    "tamper_check": f"WITH {ADMITTED} SELECT DISTINCT adm.ref_id FROM adm JOIN asr USING (id) WHERE (suffix(id, '7') AND v IS NOT NULL) OR suffix(id, '13')",
    "assertion_set_json_decode": f"""WITH {CURATION} SELECT ref_id, id, CASE WHEN ok THEN entity END AS entity, CASE WHEN ok THEN property END AS property, CASE WHEN ok THEN v END AS value_num, CASE WHEN ok THEN unit END AS unit, CASE WHEN ok THEN confidence END AS confidence, CASE WHEN ok THEN 'primary' END AS source_claim_origin, CASE WHEN NOT ok THEN 'invalid:source_claim_origin' END AS errors
        FROM (SELECT *, locator IS DISTINCT FROM 'T5' AS ok FROM asr)""",
    "commit_documents": f"""WITH {ADMITTED}, n AS (SELECT ref_id, count(*) AS n_assertions FROM adm JOIN report USING (ref_id) WHERE report_status <> 'return_upstream' AND n_reject < n GROUP BY ref_id), s AS (SELECT *, row_number() OVER (ORDER BY ref_id) AS seq FROM n)
        SELECT ref_id, 'kbv-' || lpad(seq::VARCHAR, 4, '0') AS version_id, CASE WHEN seq > 1 THEN 'kbv-' || lpad((seq - 1)::VARCHAR, 4, '0') END AS prior_version_id, seq, n_assertions, 'idempotent_hit' AS status FROM s""",
    "resolve_versions": f"""WITH {ADMITTED}, ok AS (SELECT a.* FROM adm a JOIN report USING (ref_id) WHERE report_status <> 'return_upstream' AND n_reject < n),
        two AS (SELECT 1 AS round, * FROM ok UNION ALL SELECT 2, * FROM ok WHERE action <> 'downgrade'), g AS (SELECT round, ref_id, count(*) AS n, {set_hash("id")} AS ids_hash FROM two GROUP BY round, ref_id)
        SELECT ref_id, row_number() OVER (ORDER BY round, ref_id) AS seq, n AS n_assertions, 1 AS n_records, n AS n_vectors, ids_hash FROM g""",
    "outbox_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "evidence_bundles": f"""WITH {evidence_hits()},
        cov AS (SELECT s.i, 'sq' || (pos + 1) AS key, count(r.query_id) AS hits, count(*) FILTER (guardable) AS good FROM subq s LEFT JOIN r ON r.query_id = s.i || '#' || pos GROUP BY s.i, pos),
        miss AS (SELECT cov.i, string_agg(key, ',' ORDER BY key) FILTER (good = 0 AND (need IS NULL OR list_contains(need, key))) AS m, sum(hits)::BIGINT AS record_count, sum(good)::BIGINT AS guardable_count FROM cov JOIN req USING (i) GROUP BY cov.i),
        sx AS (SELECT i, list_aggregate(list_transform(subs, lambda x: length(x) || ':' || x), 'string_agg', '') AS sx FROM req),
        hx AS (SELECT split_part(query_id, '#', 1)::BIGINT AS i, string_agg(length(chunk_id) || ':' || chunk_id, '' ORDER BY split_part(query_id, '#', 2)::INT, rank, chunk_id) AS hx FROM r GROUP BY 1),
        b AS (SELECT i, text, sx, coalesce(hx, '') AS hx, concat_ws(',', CASE WHEN private THEN 'private_data_unauthorized' END, CASE WHEN support < 0.3 THEN 'low_retrieval_support' END, CASE WHEN m IS NOT NULL THEN 'subquestion_not_covered' END) AS reasons, coalesce(m, '') AS missing_keys, record_count, guardable_count FROM miss JOIN req USING (i) JOIN sx USING (i) LEFT JOIN hx USING (i))
        SELECT i AS request_id, 'evb_' || substr(sha256({packed("text", "sx", "hx")}), 1, 16) AS bundle_id, reasons <> '' AS abstain, reasons, missing_keys, record_count, guardable_count FROM b""",
    "evidence_records": f"""WITH {evidence_hits("CASE WHEN i % 2 = 0 THEN 3 ELSE 5 END", "CASE WHEN i % 4 = 0 THEN 6 ELSE 10 END")}
        SELECT split_part(query_id, '#', 1)::BIGINT AS request_id, 'sq' || (split_part(query_id, '#', 2)::INT + 1) AS coverage_key, rank, chunk_id, ref_id, guardable FROM r""",
}
