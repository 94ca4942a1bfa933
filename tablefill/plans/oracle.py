"""DuckDB oracle SQL for the registered queries, written from the operator
definitions (not generated from the Spark plans). Tables are the driver's
pre-registered views.
"""

from __future__ import annotations

from .prompts import INSTRUCTION as INSTR


def esc(x: str) -> str:
    """TREC escape as SQL."""
    return (f"(CASE WHEN {x} = '' THEN '[[:empty:]]' ELSE replace(replace(replace({x}, ' ', '[[:space:]]'), "
            f"'#', '[[:pound:]]'), chr(9), '[[:tab:]]') END)")


def unesc(x: str) -> str:
    return f"replace(replace(replace({x}, '[[:space:]]', ' '), '[[:pound:]]', '#'), '[[:tab:]]', chr(9))"


# FX-CUST keys, FX-RUNS (seeds=3, three orders) and FX-QREL.
CUST = "cust AS (SELECT *, printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id FROM customer)"

RUNS = f"""{CUST},
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c_custkey) AS rn FROM cust),
ranked AS (
  SELECT query_id, c_name,
         row_number() OVER (PARTITION BY query_id ORDER BY c_acctbal DESC, c_custkey) AS r_acctbal,
         row_number() OVER (PARTITION BY query_id ORDER BY md5(c_name), c_custkey) AS r_md5,
         row_number() OVER (PARTITION BY query_id ORDER BY c_custkey) AS r_custkey
  FROM cand WHERE rn > 3),
runs0 AS (
  SELECT 'acctbal' AS run_id, query_id, c_name, r_acctbal AS rank FROM ranked
  UNION ALL SELECT 'md5', query_id, c_name, r_md5 FROM ranked
  UNION ALL SELECT 'custkey', query_id, c_name, r_custkey FROM ranked),
runs AS (SELECT run_id, query_id, {esc('c_name')} AS doc_id, rank,
                pow(2.0, -(rank - 1))::DOUBLE AS score, run_id AS tag FROM runs0)"""

QRELS = f"""qrels AS (SELECT query_id, {esc('c_name')} AS doc_id,
                 CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS relevance FROM cust)"""

QRELS_NO_AFRICA = f"""qrels AS (SELECT query_id, {esc('c_name')} AS doc_id,
                 CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS relevance
          FROM cust JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0)"""


def eval_per_query(runs: str = "runs", qrels: str = "qrels") -> str:
    """CTEs top/per_query/metrics over a runs CTE and a qrels CTE."""
    return f"""judged AS (SELECT DISTINCT query_id FROM {qrels}),
top AS (
  SELECT run_id, query_id, doc_id,
         row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, doc_id DESC) AS pos
  FROM {runs} WHERE query_id IN (SELECT query_id FROM judged)),
hits AS (
  SELECT t.run_id, t.query_id, t.pos, coalesce(q.relevance, 0) >= 1 AS hit
  FROM top t LEFT JOIN {qrels} q ON q.query_id = t.query_id AND q.doc_id = t.doc_id
  WHERE t.pos <= 5),
per_query AS (
  SELECT run_id, query_id,
         max(CASE WHEN hit AND pos <= 1 THEN 1 ELSE 0 END)::DOUBLE AS success_1,
         max(CASE WHEN hit AND pos <= 5 THEN 1 ELSE 0 END)::DOUBLE AS success_5,
         (sum(CASE WHEN hit AND pos <= 5 THEN 1 ELSE 0 END)::DOUBLE / 5)::DOUBLE AS P_5
  FROM hits GROUP BY run_id, query_id),
metrics AS (
  SELECT run_id, query_id, 'success_1' AS metric, success_1 AS score FROM per_query
  UNION ALL SELECT run_id, query_id, 'success_5', success_5 FROM per_query
  UNION ALL SELECT run_id, query_id, 'P_5', P_5 FROM per_query)"""


SUMMARY = """summary AS (
  SELECT run_id, metric, round(avg(score), 4) AS score, count(DISTINCT query_id)::BIGINT AS queries
  FROM metrics GROUP BY run_id, metric)"""

KNN = """pairs AS (
  SELECT q.vec_id::VARCHAR AS query_id, e.vec_id::VARCHAR AS table_id,
         list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id),
nn AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS pos FROM pairs)
  WHERE pos <= 5)"""

ORACLE: dict[str, str] = {}

ORACLE["knn_topk"] = f"""WITH {KNN}
SELECT query_id, table_id, pos::BIGINT AS pos, round(score, 6) AS score FROM nn"""

ORACLE["knn_topk_reversed"] = f"""WITH {KNN}
SELECT query_id, table_id, (6 - pos)::BIGINT AS pos, round(score, 6) AS score FROM nn"""

ORACLE["knn_pruned"] = ORACLE["knn_topk"]

ORACLE["knn_eval_all"] = f"""WITH {KNN},
runs AS (SELECT 'knn' AS run_id, query_id, table_id AS doc_id, pow(2.0, -(pos - 1))::DOUBLE AS score FROM nn),
qrels AS (
  SELECT r.query_id, r.doc_id, (ql.label = dl.label)::INT AS relevance
  FROM runs r JOIN embeddings ql ON ql.vec_id::VARCHAR = r.query_id
              JOIN embeddings dl ON dl.vec_id::VARCHAR = r.doc_id),
{eval_per_query()},
{SUMMARY}
SELECT run_id, metric, score, queries FROM summary"""

ORACLE["eval_per_query"] = f"""WITH {RUNS},
{QRELS},
{eval_per_query()}
SELECT run_id, query_id, metric, score FROM metrics"""

ORACLE["eval_all"] = f"""WITH {RUNS},
{QRELS},
{eval_per_query()},
{SUMMARY}
SELECT * FROM summary"""

ORACLE["eval_tie_order"] = f"""WITH {RUNS.replace('pow(2.0, -(rank - 1))::DOUBLE AS score', '1.0::DOUBLE AS score')},
{QRELS},
{eval_per_query()}
SELECT run_id, query_id, metric, score FROM metrics"""

ORACLE["eval_query_overlap"] = f"""WITH {RUNS},
{QRELS_NO_AFRICA},
{eval_per_query()},
{SUMMARY}
SELECT * FROM summary"""

ORACLE["run_rank_dedupe"] = f"""WITH p AS (
  SELECT printf('part_%s_%d', replace(p_brand, '#', ''), p_partkey // 1000) AS query_id,
         {esc('p_name')} AS doc_id,
         row_number() OVER (PARTITION BY replace(p_brand, '#', ''), p_partkey // 1000 ORDER BY p_partkey) AS pos
  FROM part)
SELECT query_id, doc_id, min(pos)::BIGINT AS rank, pow(2.0, -(min(pos) - 1))::DOUBLE AS score
FROM p GROUP BY query_id, doc_id"""

ORACLE["trec_escape"] = f"""SELECT doc_id, md5({esc('text')}) AS escaped_md5,
       length({esc('text')})::BIGINT AS escaped_len FROM documents"""

ORACLE["trec_roundtrip"] = f"""SELECT doc_id, {unesc(esc('text'))} = text AS same,
       md5({unesc('text')}) AS unescaped_md5 FROM documents"""


GRID = f"""{CUST},
splits AS (SELECT DISTINCT query_id, CASE WHEN n_regionkey = 4 THEN 'validation' ELSE 'benchmark' END AS split
           FROM cust JOIN nation ON c_nationkey = n_nationkey),
c2 AS (SELECT cust.*, split, row_number() OVER (PARTITION BY cust.query_id ORDER BY c_custkey) AS rn
       FROM cust JOIN splits USING (query_id)),
gcand AS (SELECT c2.*, s.seeds FROM c2, (SELECT range::INT AS seeds FROM range(1, 6)) s WHERE rn > s.seeds),
granked AS (
  SELECT query_id, c_name, split, seeds,
         row_number() OVER (PARTITION BY query_id, seeds ORDER BY c_acctbal DESC, c_custkey) AS r_acctbal,
         row_number() OVER (PARTITION BY query_id, seeds ORDER BY md5(c_name), c_custkey) AS r_md5,
         row_number() OVER (PARTITION BY query_id, seeds ORDER BY c_custkey) AS r_custkey
  FROM gcand),
g0 AS (
  SELECT 'acctbal' AS method, query_id, c_name, split, seeds, r_acctbal AS rank FROM granked
  UNION ALL SELECT 'md5', query_id, c_name, split, seeds, r_md5 FROM granked
  UNION ALL SELECT 'custkey', query_id, c_name, split, seeds, r_custkey FROM granked),
runs AS (SELECT printf('%s_%s_s%d', method, split, seeds) AS run_id, query_id, {esc('c_name')} AS doc_id, rank,
                pow(2.0, -(rank - 1))::DOUBLE AS score, method AS tag, split, seeds FROM g0),
meta AS (
  SELECT r.run_id, 'data/' || r.split AS folder, r.seeds,
         r.answered = s.split_queries AS completed, r.method = 'custkey' AS debug,
         contains('data/' || r.split, 'validation') AS validation
  FROM (SELECT run_id, any_value(split) AS split, any_value(seeds) AS seeds, any_value(tag) AS method,
               count(DISTINCT query_id) AS answered FROM runs GROUP BY run_id) r
  LEFT JOIN (SELECT split, count(*) AS split_queries FROM splits GROUP BY split) s USING (split))"""


def pct(x: str) -> str:
    t = f"floor({x} * 1000.0 + 0.5)::BIGINT"
    return f"printf('%d.%d%%', ({t}) // 10, ({t}) % 10)"


LB = f"""lb AS (
  SELECT run_id, max(queries) AS queries,
         max(CASE WHEN metric = 'success_1' THEN score END) AS success_1,
         max(CASE WHEN metric = 'success_5' THEN score END) AS success_5,
         max(CASE WHEN metric = 'P_5' THEN score END) AS P_5
  FROM summary GROUP BY run_id),
lbr AS (
  SELECT *, printf('queries=%4d', queries) || ', success_1=' || {pct('success_1')}
            || ', success_5=' || {pct('success_5')} || ', P_5=' || {pct('P_5')} AS line
  FROM lb)"""

ORACLE["ensemble_vote"] = f"""WITH {RUNS},
m AS (SELECT * FROM (VALUES ('acctbal', 0), ('md5', 1), ('custkey', 2)) t(run_id, run_pos)),
f AS (SELECT query_id, doc_id, count(*) AS votes, sum(score ORDER BY run_pos) AS total,
             min(run_pos * 1000000 + rank) AS first_seen
      FROM runs JOIN m USING (run_id) GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, total DESC, first_seen) AS rn FROM f)
SELECT query_id, doc_id, rn::BIGINT AS rank, pow(2.0, -(rn - 1))::DOUBLE AS score FROM r"""

ORACLE["ensemble_eligible"] = f"""WITH {GRID},
members AS (SELECT run_id, dense_rank() OVER (ORDER BY run_id) AS run_pos, folder, seeds FROM meta),
first AS (SELECT folder, seeds FROM members WHERE run_pos = 1)
SELECT m.run_id, m.run_pos::BIGINT AS run_pos, (m.folder = f.folder AND m.seeds = f.seeds) AS eligible
FROM members m, first f"""

ORACLE["side_by_side"] = f"""WITH {RUNS},
{QRELS},
res AS (SELECT run_id, query_id, 'result' AS side, doc_id,
               row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, rank, doc_id) AS pos FROM runs),
gt AS (SELECT NULL::VARCHAR AS run_id, query_id, 'truth' AS side, doc_id,
              row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS pos
       FROM qrels WHERE query_id IN (SELECT query_id FROM runs))
SELECT run_id, query_id, side, pos::BIGINT AS pos, {unesc('doc_id')} AS value FROM (SELECT * FROM res UNION ALL SELECT * FROM gt)"""

ORACLE["covered_queries"] = f"""WITH {RUNS},
{QRELS},
{eval_per_query()}
SELECT DISTINCT run_id, metric, query_id FROM metrics WHERE score > 0"""

ORACLE["leaderboard"] = f"""WITH {GRID},
{QRELS},
{eval_per_query()},
{SUMMARY},
{LB}
SELECT run_id, queries, success_1, success_5, P_5,
       printf('name=%19s, seeds=%d, ', run_id, seeds) || line || CASE WHEN debug THEN ' (debug)' ELSE '' END
       || CASE WHEN validation THEN ' (validation)' ELSE '' END AS report
FROM lbr LEFT JOIN meta USING (run_id)"""

ORACLE["best_config"] = f"""WITH {GRID},
{QRELS},
{eval_per_query()},
{SUMMARY},
{LB}
SELECT split, run_id, success_1, success_5, P_5 FROM (
  SELECT lb.*, split_part(folder, '/', 2) AS split,
         row_number() OVER (PARTITION BY split_part(folder, '/', 2)
                            ORDER BY success_1 DESC, success_5 DESC, P_5 DESC, run_id) AS r
  FROM lb JOIN meta USING (run_id)) WHERE r = 1"""

ORACLE["baseline_compare"] = f"""WITH {RUNS.replace('runs AS (SELECT', 'runs_m AS (SELECT')},
bl0 AS (SELECT query_id, c_name, row_number() OVER (PARTITION BY query_id ORDER BY c_name DESC) AS rank
        FROM cand WHERE rn > 3),
runs AS (SELECT run_id, query_id, doc_id, rank, score, tag FROM runs_m
         UNION ALL
         SELECT 'baseline_name', query_id, {esc('c_name')}, rank, pow(2.0, -(rank - 1))::DOUBLE, 'baseline'
         FROM bl0),
{QRELS},
{eval_per_query()},
{SUMMARY},
{LB}
SELECT run_id, CASE WHEN run_id = 'baseline_name' THEN 'baseline' ELSE 'run' END AS kind,
       queries, success_1, success_5, P_5, line AS report FROM lbr"""

ORACLE["run_flags"] = f"""WITH {GRID}
SELECT run_id, folder, seeds::BIGINT AS seeds, completed, debug, validation FROM meta"""


CORPUS = """corpus AS (
  SELECT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id, c_custkey AS k, c_name AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT printf('supp_%d_%d', s_nationkey, s_suppkey // 1000), s_suppkey, s_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
crow AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rn,
                count(*) OVER (PARTITION BY query_id) AS cnt FROM corpus)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


ORACLE["seed_split"] = f"""WITH {CORPUS}
SELECT query_id, n::BIGINT AS seeds,
       coalesce(string_agg(name, '|' ORDER BY k) FILTER (WHERE rn <= n), '') AS seed_values,
       coalesce(string_agg(name, '|' ORDER BY k) FILTER (WHERE rn > n), '') AS ground_truth,
       (count(*) FILTER (WHERE rn > n))::BIGINT AS n_ground_truth,
       (count(*) FILTER (WHERE rn <= n))::BIGINT AS n_rows
FROM crow, (SELECT range::INT AS n FROM range(1, 6)) g
GROUP BY query_id, n"""

ORACLE["table_description"] = f"""WITH parts AS (
  SELECT DISTINCT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id,
         r_name AS a, n_name AS b, ' ' || n_name AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT DISTINCT printf('supp_%d_%d', s_nationkey, s_suppkey // 1000), n_name, 'Suppliers', ' '
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT DISTINCT printf('part_%s_%d', replace(p_brand, '#', ''), p_partkey // 1000), p_brand, '', 'Parts'
  FROM part),
s AS (SELECT query_id, {strip('a')} AS a, {strip('b')} AS b, {strip('c')} AS c FROM parts)
SELECT query_id,
       concat_ws(' - ', CASE WHEN a <> '' THEN a END,
                        CASE WHEN b <> '' AND b <> a THEN b END,
                        CASE WHEN c <> '' AND c <> a AND c <> b THEN c END) AS description
FROM s"""

ORACLE["hold_out"] = f"""WITH {CORPUS},
h AS (SELECT query_id, least(cnt, 3) AS m, rn, name, k FROM crow)
SELECT query_id, max(name) FILTER (WHERE rn = m) AS target,
       coalesce(string_agg(name, '|' ORDER BY k) FILTER (WHERE rn < m), '') AS seed_values,
       3::BIGINT AS seeds
FROM h GROUP BY query_id"""

ORACLE["qrels_from_split"] = f"""WITH {CORPUS}
SELECT DISTINCT query_id, {esc('name')} AS doc_id, 1::BIGINT AS relevance FROM crow WHERE rn > 3"""

CUST_QUERIES = """cq AS (SELECT DISTINCT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id
       FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PART_CANDS = """cands AS (SELECT DISTINCT printf('part_%s_%d', replace(p_brand, '#', ''), p_partkey // 1000) AS table_id
          FROM part)"""


def draw(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


ORACLE["sample_per_query"] = f"""WITH {CUST_QUERIES},
{PART_CANDS},
nb AS (SELECT count(*) AS n FROM cands),
cb AS (SELECT table_id, {draw('table_id')} % 4096 AS bucket FROM cands),
cl AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY table_id) - 1 AS local FROM cb),
off AS (SELECT bucket, coalesce(sum(cnt) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT bucket, count(*) AS cnt FROM cb GROUP BY bucket)),
ci AS (SELECT table_id, off + local AS idx FROM cl JOIN off USING (bucket)),
d AS (
  SELECT query_id, list_reduce(range((SELECT n FROM nb) - 3, (SELECT n FROM nb)),
           lambda acc, j: CASE WHEN list_contains(acc, {draw("'42|' || query_id || '|' || j::VARCHAR")} % (j + 1))
                               THEN list_append(acc, j)
                               ELSE list_append(acc, {draw("'42|' || query_id || '|' || j::VARCHAR")} % (j + 1)) END,
           []::BIGINT[]) AS draws
  FROM cq),
u AS (SELECT query_id, unnest(draws) AS idx, generate_subscripts(draws, 1) AS pos FROM d)
SELECT query_id, pos::BIGINT AS pos, table_id FROM u JOIN ci USING (idx)"""

ORACLE["sample_fixed"] = f"""WITH {CUST_QUERIES},
{PART_CANDS},
s AS (SELECT table_id, row_number() OVER (ORDER BY md5('7|' || table_id), table_id) AS pos FROM cands)
SELECT query_id, pos::BIGINT AS pos, table_id FROM cq, s WHERE pos <= 2"""

ORACLE["subsample_pool"] = f"""WITH {KNN.replace('WHERE pos <= 5', 'WHERE pos <= 10')}
SELECT query_id, pos::BIGINT AS pos, table_id FROM (
  SELECT query_id, table_id,
         row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || table_id), table_id) AS pos
  FROM nn) WHERE pos <= 3"""


def sql_text(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))


def jq(x: str) -> str:
    """JSON string literal of an ASCII value."""
    return "'\"' || replace(replace(" + x + ", '\\', '\\\\'), '\"', '\\\"') || '\"'"


CUSTQ = f"""cq0 AS (
  SELECT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id, c_custkey, c_name,
         r_name AS a, n_name AS b, ' ' || n_name AS c,
         row_number() OVER (PARTITION BY printf('cust_%d_%d', c_nationkey, c_custkey // 1000) ORDER BY c_custkey) AS rn
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cq AS (
  SELECT query_id,
         concat_ws(' - ', CASE WHEN {strip('any_value(a)')} <> '' THEN {strip('any_value(a)')} END,
                   CASE WHEN {strip('any_value(b)')} <> '' AND {strip('any_value(b)')} <> {strip('any_value(a)')}
                        THEN {strip('any_value(b)')} END,
                   CASE WHEN {strip('any_value(c)')} <> '' AND {strip('any_value(c)')} <> {strip('any_value(a)')}
                        AND {strip('any_value(c)')} <> {strip('any_value(b)')} THEN {strip('any_value(c)')} END) AS description,
         '[' || coalesce(string_agg({jq('c_name')}, ', ' ORDER BY c_custkey) FILTER (WHERE rn <= 3), '') || ']' AS seed_json
  FROM cq0 GROUP BY query_id)"""

PARTEX = f"""{PART_CANDS},
s AS (SELECT table_id, row_number() OVER (ORDER BY md5('7|' || table_id), table_id) AS pos FROM cands),
ex AS (SELECT table_id, pos FROM s WHERE pos <= 2),
prow AS (SELECT printf('part_%s_%d', replace(p_brand, '#', ''), p_partkey // 1000) AS table_id, p_partkey, p_name, p_brand,
                row_number() OVER (PARTITION BY replace(p_brand, '#', ''), p_partkey // 1000 ORDER BY p_partkey) AS rn
         FROM part),
pt AS (
  SELECT table_id, any_value(p_brand) || ' - Parts' AS description,
         '[' || coalesce(string_agg({jq('p_name')}, ', ' ORDER BY p_partkey) FILTER (WHERE rn <= 3), '') || ']' AS seed_json,
         '[' || coalesce(string_agg({jq('p_name')}, ', ' ORDER BY p_partkey) FILTER (WHERE rn > 3), '') || ']' AS rest_json
  FROM prow WHERE table_id IN (SELECT table_id FROM ex) GROUP BY table_id),
exb AS (SELECT ex.pos, pt.* FROM ex JOIN pt USING (table_id))"""


def inst_block(desc, headers_json, header0, col_json, tail):
    return (f"{sql_text('[INST] ' + INSTR + chr(10) + chr(10) + 'Table description:' + chr(10))} || {desc} || "
            f"{sql_text(chr(10) + 'All table headers:' + chr(10))} || {headers_json} || "
            f"{sql_text(chr(10) + 'Header of column to expand:' + chr(10))} || {header0} || "
            f"{sql_text(chr(10) + 'Column:' + chr(10))} || {col_json} || {sql_text(' [/INST]' + chr(10))} || {tail}")


CUST_HEADERS = "'[\"c_name\", \"c_custkey\", \"c_mktsegment\"]'"
PART_HEADERS = "'[\"p_name\", \"p_type\"]'"

ORACLE["json_list_ascii"] = f"""SELECT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id,
       '[' || string_agg({jq('c_name')}, ', ' ORDER BY c_custkey) || ']' AS json
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""

ORACLE["xml_escape"] = """SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5,
       length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))::BIGINT AS escaped_len
FROM documents"""

ORACLE["render_zero_shot"] = f"""WITH {CUSTQ}
SELECT query_id, {inst_block('description', CUST_HEADERS, "'c_name'", 'seed_json', "'[\"'")} AS prompt FROM cq"""

ORACLE["render_few_shot"] = f"""WITH {CUSTQ},
{PARTEX},
exs AS (SELECT string_agg({inst_block('description', PART_HEADERS, "'p_name'", 'seed_json', "rest_json || chr(10)")},
                          '' ORDER BY pos) AS t FROM exb)
SELECT query_id, (SELECT t FROM exs) || {inst_block('description', CUST_HEADERS, "'c_name'", 'seed_json', "'[\"'")} AS prompt
FROM cq"""


def xe(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def chat_user(desc, headers_json, header0, col_json, twice):
    first = "Table description:\n" * (2 if twice else 1)
    return (f"{sql_text(first)} || {desc} || {sql_text(chr(10) + 'All table headers:' + chr(10))} || {headers_json} || "
            f"{sql_text(chr(10) + 'Header of column to expand:' + chr(10))} || {header0} || "
            f"{sql_text(chr(10) + 'Column:' + chr(10))} || {col_json}")


ORACLE["render_chat_messages"] = f"""WITH {CUSTQ},
{PARTEX},
exu AS (SELECT pos, {chat_user('description', PART_HEADERS, "'p_name'", 'seed_json', True)} AS u, rest_json FROM exb),
exs AS (SELECT string_agg('<user>' || {xe('u')} || '</user>' || chr(10) || '<assistant>' || {xe('rest_json')}
                          || '</assistant>' || chr(10), '' ORDER BY pos) AS t,
               string_agg(u || chr(31) || rest_json, chr(31) ORDER BY pos) AS contents,
               count(*) AS n FROM exu),
qu AS (SELECT query_id, {chat_user('description', CUST_HEADERS, "'c_name'", 'seed_json', False)} AS u FROM cq)
SELECT query_id,
       {sql_text('<messages>' + chr(10) + '<system>' + INSTR + '</system>' + chr(10))} || (SELECT t FROM exs)
         || chr(10) || '<user>' || {xe('u')} || '</user>' || chr(10) || '</messages>' AS prompt,
       (2 + 2 * (SELECT n FROM exs))::BIGINT AS n_messages,
       'system,' || (SELECT string_agg('user,assistant', ',') FROM exu) || ',user' AS roles,
       md5({sql_text(INSTR)} || chr(31) || (SELECT contents FROM exs) || chr(31) || u) AS contents_md5
FROM qu"""


WS = "'[ \\t\\n\\r\\f\\x0B]+'"


def ntok(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {WS}), lambda t: t <> ''))"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {WS}), lambda t: t <> '')"


ORACLE["chat_token_count"] = f"""SELECT conv_id, count(*)::BIGINT AS n_messages,
       (sum(3 + {ntok('role')} + {ntok('text')}) + 3)::BIGINT AS tokens
FROM conversations GROUP BY conv_id"""

ORACLE["fit_messages"] = f"""WITH m AS (
  SELECT conv_id, turn, role, 3 + {ntok('role')} + {ntok('text')} AS cost,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'system') AS sys
  FROM conversations),
m2 AS (
  SELECT *,
         sum(CASE WHEN sys THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS j,
         sum(CASE WHEN sys THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix,
         sum(CASE WHEN sys THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_cost,
         sum(CASE WHEN sys THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS n
  FROM m),
s AS (
  SELECT conv_id,
         min(CASE WHEN NOT sys AND j % 2 = 0 AND sys_cost + suffix + 3 <= 200 THEN j END) AS c1,
         max(CASE WHEN n % 2 = 0 AND sys_cost + 3 <= 200 THEN n END) AS c2
  FROM m2 GROUP BY conv_id),
st AS (SELECT conv_id, CASE WHEN c1 IS NULL THEN c2 WHEN c2 IS NULL THEN c1 ELSE least(c1, c2) END AS start FROM s),
k AS (SELECT m2.*, start IS NULL AS overflow, (start IS NOT NULL AND (sys OR j >= start)) AS kept
      FROM m2 JOIN st USING (conv_id))
SELECT conv_id, turn, kept, overflow,
       (CASE WHEN overflow THEN NULL
             ELSE sum(CASE WHEN kept THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) + 3 END)::BIGINT AS tokens_after
FROM k"""

ORACLE["keep_last_tokens"] = f"""WITH t AS (SELECT doc_id, {toks('text')} AS tk FROM documents),
k AS (SELECT doc_id, CASE WHEN len(tk) > 768 THEN tk[len(tk) - 767:] ELSE tk END AS kept FROM t)
SELECT doc_id, len(kept)::BIGINT AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5 FROM k"""

ORACLE["extract_first_line"] = "SELECT doc_id, split_part(text, chr(10), 1) AS first_line FROM documents"

PYSPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\pZ]"

ORACLE["extract_csv_token"] = f"""WITH t AS (
  SELECT doc_id, regexp_replace(text, '^{PYSPACE}+|{PYSPACE}+$', '', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN starts_with(s, '"') THEN regexp_extract(s, '^"([^"]*)"', 1)
                    ELSE split_part(s, ',', 1) END AS token
FROM t"""

ORACLE["extract_list_truncated"] = f"""WITH r AS (
  SELECT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id, c_nationkey, c_custkey, c_name,
         row_number() OVER (PARTITION BY printf('cust_%d_%d', c_nationkey, c_custkey // 1000) ORDER BY c_custkey) AS rn
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT query_id,
             '[' || coalesce(string_agg({jq('c_name')}, ', ' ORDER BY c_custkey) FILTER (WHERE rn >= 1), '') || ']' AS whole,
             any_value(c_nationkey) AS nk
      FROM r GROUP BY query_id),
tc AS (SELECT query_id, left(whole, (length(whole) * (50 + nk) // 100)::BIGINT) AS text FROM t),
i AS (SELECT query_id, text, regexp_extract_all(left(text, length(text) - 1), '"([^"]*)"', 1) AS items FROM tc),
j AS (SELECT query_id, CASE WHEN len(items) = 0 THEN [text] ELSE items END AS items FROM i)
SELECT query_id, len(items)::BIGINT AS n_items, array_to_string(items, '|') AS items FROM j"""


def list_items(text: str) -> str:
    """Repair-extraction of a cut JSON list of quote-free strings."""
    ext = f"regexp_extract_all(left({text}, length({text}) - 1), '\"([^\"]*)\"', 1)"
    return f"CASE WHEN len({ext}) = 0 THEN [{text}] ELSE {ext} END"


ORACLE["complete_constant"] = f"""{CUST_QUERIES.replace('cq AS', 'WITH cq AS')}
SELECT query_id, '[\"Dummy[[:space:]]prediction' AS doc_id, 1::BIGINT AS rank, 1.0::DOUBLE AS score FROM cq"""

ORACLE["mean_pool"] = """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
           FROM embeddings),
s AS (SELECT label, dim, sum(v) / greatest(count(*)::DOUBLE, 1e-9) AS mean FROM e GROUP BY label, dim),
n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM s GROUP BY label)
SELECT label::BIGINT AS label, dim::BIGINT AS dim, round(mean / greatest(norm, 1e-12), 6) AS value
FROM s JOIN n USING (label)"""

ORACLE["embed_hash"] = f"""WITH t AS (SELECT doc_id, unnest({toks('text')}) AS tok FROM documents),
c AS (SELECT doc_id, ({draw('tok')} % 64)::INT AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY doc_id, bucket),
nm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
g AS (SELECT doc_id, range::INT AS dim FROM documents, range(64))
SELECT g.doc_id, g.dim::BIGINT AS dim, round(coalesce(c.n / nm.norm, 0.0), 6) AS value
FROM g LEFT JOIN c ON c.doc_id = g.doc_id AND c.bucket = g.dim LEFT JOIN nm ON nm.doc_id = g.doc_id"""


def flagship_sql(seeds_expr: str = "3") -> str:
    return f"""r AS (
  SELECT printf('cust_%d_%d', c_nationkey, c_custkey // 1000) AS query_id, c_custkey, c_name,
         row_number() OVER (PARTITION BY printf('cust_%d_%d', c_nationkey, c_custkey // 1000) ORDER BY c_custkey) AS rn,
         count(*) OVER (PARTITION BY printf('cust_%d_%d', c_nationkey, c_custkey // 1000)) AS cnt
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


RECORDED = """rec AS (
  SELECT query_id, variant, '["' || substr(left(whole, length(whole) * 80 // 100), 3) AS text FROM (""" + " UNION ALL ".join(
    f"""
    SELECT query_id, {v} AS variant,
           '[' || coalesce(string_agg({jq('c_name')}, ', ' ORDER BY c_custkey{order}) FILTER (WHERE rn >= {first}), '') || ']' AS whole
    FROM r GROUP BY query_id""" for v, first, order in ((0, 2, ""), (1, 3, ""), (2, 4, ""), (3, 1, " DESC"))) + "))"


def variant(query: str, key: str) -> str:
    """The recorded answer drawn for a query and the key of its examples."""
    return f"({draw(f"{query} || '|' || {key}")} % 4)"


FIXED_KEY = f"""{PART_CANDS},
fixed_key AS (SELECT md5(string_agg(table_id, ',' ORDER BY o)) AS key FROM (
  SELECT table_id, row_number() OVER (ORDER BY md5('7|' || table_id), table_id) AS o FROM cands) WHERE o <= 2)"""


def end_to_end(run_id: str) -> str:
    return f"""WITH {flagship_sql()},
{FIXED_KEY},
{RECORDED},
t AS (SELECT query_id, text FROM rec, fixed_key WHERE variant = {variant('query_id', 'key')}),
l AS (SELECT query_id, {list_items('text')} AS items FROM t),
u AS (SELECT query_id, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM l),
runs AS (SELECT '{run_id}' AS run_id, query_id, {esc('x')} AS doc_id, min(pos) AS pos0,
                pow(2.0, -(min(pos) - 1))::DOUBLE AS score FROM u GROUP BY query_id, {esc('x')}),
qrels AS (SELECT DISTINCT query_id, {esc('c_name')} AS doc_id, 1 AS relevance FROM r WHERE rn > 3),
{eval_per_query()},
{SUMMARY}
SELECT run_id, metric, score, queries FROM summary"""


ORACLE["suggest_end_to_end"] = end_to_end("flagship")
ORACLE["suggest_chat_end_to_end"] = end_to_end("chat")


def floyd(seed: int, k: int, query: str) -> str:
    """Distinct draws of candidate indexes as a list (Floyd's algorithm)."""
    d = draw(f"'{seed}|' || {query} || '|' || j::VARCHAR")
    return f"""list_reduce(range((SELECT n FROM nb) - {k}, (SELECT n FROM nb)),
           lambda acc, j: CASE WHEN list_contains(acc, {d} % (j + 1)) THEN list_append(acc, j)
                               ELSE list_append(acc, {d} % (j + 1)) END, []::BIGINT[])"""


INDEXED = """nb AS (SELECT count(*) AS n FROM cands),
cb AS (SELECT table_id, """ + draw('table_id') + """ % 4096 AS bucket FROM cands),
cl AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY table_id) - 1 AS local FROM cb),
off AS (SELECT bucket, coalesce(sum(cnt) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT bucket, count(*) AS cnt FROM cb GROUP BY bucket)),
ci AS (SELECT table_id, off + local AS idx FROM cl JOIN off USING (bucket))"""

ORACLE["sweep_grid"] = f"""WITH {flagship_sql()},
{FIXED_KEY},
{INDEXED},
{RECORDED},
cfg AS (SELECT tutor || '_' || ext || '_s' || n AS config_id, tutor, n, ext
        FROM (VALUES ('zero'), ('fixed'), ('random')) a(tutor), (VALUES ('list'), ('csv_token')) b(ext),
             (VALUES (1), (3), (5)) c(n)),
q AS (SELECT DISTINCT config_id, tutor, ext, n, query_id, config_id || '/' || query_id AS keyed FROM r, cfg),
drawn AS (SELECT keyed, {floyd(7, 2, 'keyed')} AS draws FROM q WHERE tutor = 'random'),
du AS (SELECT keyed, unnest(draws) AS idx, generate_subscripts(draws, 1) AS pos FROM drawn),
random_key AS (SELECT keyed, md5(string_agg(table_id, ',' ORDER BY pos)) AS key FROM du JOIN ci USING (idx) GROUP BY keyed),
k AS (SELECT q.*, CASE tutor WHEN 'zero' THEN '' WHEN 'fixed' THEN (SELECT key FROM fixed_key) ELSE random_key.key END AS key
      FROM q LEFT JOIN random_key USING (keyed)),
t AS (SELECT config_id, ext, n, k.query_id, text FROM k JOIN rec ON rec.query_id = k.query_id
      AND rec.variant = {variant('k.query_id', 'k.key')}),
l AS (SELECT config_id, n, query_id,
             CASE WHEN ext = 'list' THEN {list_items('text')}
                  ELSE [split_part(regexp_replace(substr(text, 3), '^{PYSPACE}+|{PYSPACE}+$', '', 'g'), ',', 1)] END AS items
      FROM t),
u AS (SELECT config_id, n, query_id, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM l),
runs AS (SELECT config_id AS run_id, config_id || '/' || query_id AS query_id, {esc('x')} AS doc_id,
                pow(2.0, -(min(pos) - 1))::DOUBLE AS score FROM u GROUP BY config_id, query_id, {esc('x')}),
qrels AS (SELECT DISTINCT config_id || '/' || query_id AS query_id, {esc('c_name')} AS doc_id, 1 AS relevance
          FROM r, cfg WHERE rn > n),
{eval_per_query()},
{SUMMARY}
SELECT run_id AS config_id, metric, score, queries FROM summary"""


def tried(turn: int, unsolved: str) -> str:
    """CTEs of one round: the draw of each unsolved query, and those accepted."""
    return f"""draw{turn} AS (SELECT * FROM (
  SELECT query_id, table_id, row_number() OVER (
    PARTITION BY query_id ORDER BY md5('{turn}|' || query_id || '|' || table_id), table_id) AS pos
  FROM pool WHERE query_id IN (SELECT query_id FROM {unsolved})) WHERE pos <= 2),
key{turn} AS (SELECT query_id, md5(string_agg(table_id, ',' ORDER BY pos)) AS key FROM draw{turn} GROUP BY query_id),
acc{turn} AS (SELECT h.query_id FROM h JOIN key{turn} k USING (query_id) JOIN rec ON rec.query_id = h.query_id
              AND rec.variant = {variant('h.query_id', 'k.key')} WHERE list_contains({list_items('text')}, target)),
left{turn} AS (SELECT query_id FROM {unsolved} WHERE query_id NOT IN (SELECT query_id FROM acc{turn}))"""


POOL = ORACLE["sample_per_query"].replace("(SELECT n FROM nb) - 3", "(SELECT n FROM nb) - 4")
POOL = POOL[len("WITH "):POOL.rindex("SELECT query_id, pos::BIGINT")].rstrip().rstrip(",")

ORACLE["pick_first_hit"] = f"""WITH {POOL},
pool AS (SELECT query_id, pos, table_id FROM u JOIN ci USING (idx)),
{flagship_sql()},
{RECORDED},
h AS (SELECT query_id, max(c_name) FILTER (WHERE rn = least(cnt, 3)) AS target FROM r GROUP BY query_id),
{tried(0, 'h')},
{tried(1, 'left0')}
SELECT query_id, pos::BIGINT AS pos, table_id, 0::BIGINT AS round FROM draw0 WHERE query_id IN (SELECT query_id FROM acc0)
UNION ALL
SELECT query_id, pos::BIGINT, table_id, 1::BIGINT FROM draw1 WHERE query_id IN (SELECT query_id FROM acc1)
UNION ALL
SELECT query_id, pos::BIGINT, table_id, -1::BIGINT FROM pool
WHERE pos <= 2 AND query_id IN (SELECT query_id FROM left1)"""


def hashed_vectors(src: str, id_col: str, text_col: str, name: str) -> str:
    """CTEs <name>_c (id, bucket, w) of L2-normalised hashed token counts."""
    return f"""{name}_t AS (SELECT {id_col} AS id, unnest({toks(text_col)}) AS tok FROM {src}),
{name}_n AS (SELECT id, ({draw('tok')} % 64)::INT AS bucket, count(*)::DOUBLE AS n FROM {name}_t GROUP BY id, bucket),
{name}_c AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_n)"""


ORACLE["knn_tutor"] = f"""WITH {CORPUS},
qs AS (SELECT query_id, string_agg(name, ', ' ORDER BY k) FILTER (WHERE rn <= 3) AS text
       FROM crow WHERE query_id LIKE 'cust%' GROUP BY query_id),
pr AS (SELECT printf('part_%s_%d', replace(p_brand, '#', ''), p_partkey // 1000) AS table_id, p_partkey, p_name FROM part),
es AS (SELECT table_id, string_agg(p_name, ', ' ORDER BY p_partkey) AS text FROM pr GROUP BY table_id),
{hashed_vectors('qs', 'query_id', 'text', 'qv')},
{hashed_vectors('es', 'table_id', 'text', 'ev')},
dots AS (SELECT q.id AS query_id, e.id AS table_id, sum(q.w * e.w ORDER BY q.bucket) AS s
         FROM qv_c q JOIN ev_c e ON q.bucket = e.bucket GROUP BY q.id, e.id),
pairs AS (SELECT qs.query_id, es.table_id, coalesce(d.s, 0.0) AS score
          FROM qs CROSS JOIN es LEFT JOIN dots d ON d.query_id = qs.query_id AND d.table_id = es.table_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS r FROM pairs)
       WHERE r <= 3)
SELECT query_id, (4 - r)::BIGINT AS pos, table_id, round(score, 6) AS score FROM nn"""


_REPLAY = (ORACLE["extract_list_truncated"]
           .replace("FILTER (WHERE rn >= 1)", "FILTER (WHERE rn >= 4)")
           .replace("SELECT query_id, len(items)::BIGINT AS n_items, array_to_string(items, '|') AS items FROM j", ""))
ORACLE["replay_end_to_end"] = _REPLAY.rstrip() + f""",
u AS (SELECT query_id, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM j),
runs AS (SELECT 'replay' AS run_id, query_id, {esc('x')} AS doc_id,
                pow(2.0, -(min(pos) - 1))::DOUBLE AS score FROM u GROUP BY query_id, {esc('x')}),
qrels AS (SELECT DISTINCT query_id, {esc('c_name')} AS doc_id, 1 AS relevance FROM r WHERE rn > 3),
{eval_per_query()},
{SUMMARY}
SELECT run_id, metric, score, queries FROM summary"""

ORACLE["knn_random_order"] = f"""WITH {KNN}
SELECT query_id, table_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('11|' || query_id || '|' || table_id))::BIGINT AS pos,
       round(score, 6) AS score FROM nn"""

ORACLE["mean_pool_masked"] = """WITH e AS (
  SELECT label, (vec_id % 3 <> 0)::INT AS m, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings),
s AS (SELECT label, dim, sum(v * m) / greatest(sum(m)::DOUBLE, 1e-9) AS mean FROM e GROUP BY label, dim),
n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM s GROUP BY label)
SELECT label::BIGINT AS label, dim::BIGINT AS dim, round(mean / greatest(norm, 1e-12), 6) AS value
FROM s JOIN n USING (label)"""

ORACLE["chat_token_count_names"] = f"""SELECT conv_id, count(*)::BIGINT AS n_messages,
       (sum(3 + {ntok('role')} + {ntok('text')} + CASE WHEN role = 'user' THEN 2 + 1 ELSE 0 END) + 3)::BIGINT AS tokens
FROM conversations GROUP BY conv_id"""

ORACLE["run_write_read"] = f"""WITH {RUNS}
SELECT run_id, query_id, doc_id, rank::BIGINT AS rank, score, tag, 'data/benchmark' AS folder, 3::BIGINT AS seeds, true AS completed
FROM runs"""

ORACLE["stored_vectors"] = ORACLE["embed_hash"].replace("SELECT g.doc_id, g.dim", f"""
, e AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents WHERE lang = 'en'),
a AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents)
SELECT g.doc_id, g.dim""").replace("AS value\nFROM g", """AS value,
       coalesce(d.text, '') IN (SELECT text FROM e) AS early, (SELECT count(*) FROM e) AS n_first,
       (SELECT count(*) FROM a) - (SELECT count(*) FROM e) AS n_second
FROM g JOIN documents d ON d.doc_id = g.doc_id""")

_LAST_50 = "([^ \\t\\n\\r\\f\\x0B]+[ \\t\\n\\r\\f\\x0B]*){50}$"
ORACLE["model_slot"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, {ntok('text')} > 50 AS long FROM d)
SELECT doc_id, md5(CASE WHEN long THEN regexp_extract(text, '{_LAST_50}') ELSE text END) AS completion, long AS truncated, true AS timed FROM n"""

ORACLE["run_folders"] = f"""WITH {RUNS},
c AS (SELECT run_id, count(*) AS n_rows FROM runs GROUP BY run_id)
SELECT run_id, CASE WHEN run_id = 'md5' THEN 'data/validation' ELSE 'data/benchmark' END AS folder,
       CASE run_id WHEN 'acctbal' THEN 1 WHEN 'md5' THEN 2 ELSE 3 END::BIGINT AS seeds,
       run_id <> 'custkey' AS completed, run_id = 'custkey' AS debug, run_id = 'md5' AS validation, true AS dated, n_rows FROM c"""

ORACLE["baselines_scan"] = f"""WITH {CUST},
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c_custkey) AS rn FROM cust),
s AS (SELECT unnest([1, 3, 5])::BIGINT AS seeds),
r AS (SELECT seeds, query_id, c_name, row_number() OVER (PARTITION BY seeds, query_id ORDER BY c_name DESC) AS rank FROM cand, s WHERE rn > seeds)
SELECT printf('BL3_coName_%d', seeds) AS run_id, seeds, query_id, {esc('c_name')} AS doc_id, rank, pow(2.0, -(rank - 1))::DOUBLE AS score, 'baseline' AS kind FROM r"""

ORACLE["qrels_read"] = f"""WITH {CUST}, {QRELS},
v AS (SELECT DISTINCT query_id FROM cust JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4)
SELECT 'all' AS run_id, query_id, doc_id, relevance::BIGINT AS relevance FROM qrels
UNION ALL SELECT 'held', query_id, doc_id, relevance::BIGINT FROM qrels WHERE query_id IN (SELECT query_id FROM v)"""

ORACLE["ensemble_written"] = f"""SELECT *, '["acctbal", "md5", "custkey"]' AS members, 1::BIGINT AS n_meta FROM ({ORACLE["ensemble_vote"]})"""
