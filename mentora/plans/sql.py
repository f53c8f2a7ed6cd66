"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

TURNS = """
lab AS (
  SELECT l_orderkey AS d, l_linenumber AS turn, min(l_returnflag) AS flag, list_sort(list(DISTINCT p_brand)) AS all_kcs
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ann AS (
  SELECT lab.d, turn, CASE flag WHEN 'A' THEN true WHEN 'R' THEN false END AS og, CASE WHEN flag IN ('A', 'R') THEN all_kcs ELSE [] END AS kcs,
    turn = max(turn) OVER (PARTITION BY lab.d) AS is_last, o_orderstatus AS status, CAST(o_orderpriority[1] AS INT) AS confusion, o_custkey % 5 + 1 AS interactions
  FROM lab JOIN orders ON lab.d = o_orderkey),
ov AS (
  SELECT *, CASE WHEN is_last AND og IS NOT NULL THEN CASE status WHEN 'F' THEN true WHEN 'O' THEN false WHEN 'P' THEN NULL ELSE og END ELSE og END AS correct FROM ann),
tag0 AS (SELECT *, count(*) OVER (PARTITION BY d) AS n_tagged FROM ov WHERE correct IS NOT NULL AND len(kcs) > 0),
tag AS (SELECT * FROM tag0 WHERE n_tagged >= 2),
obs AS (
  SELECT d, turn, unnest(range(len(kcs))) AS pos, unnest(kcs) AS kc, CAST(correct AS INT) AS correct, CASE WHEN d % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM tag)
"""
PREDICT = """
seq AS (SELECT *, row_number() OVER (PARTITION BY d, kc ORDER BY turn, pos) AS k FROM obs),
walk AS (
  SELECT d, kc, turn, pos, correct, k, CAST(0.5 AS DOUBLE) AS b FROM seq WHERE k = 1
  UNION ALL
  SELECT s.d, s.kc, s.turn, s.pos, s.correct, s.k,
    (CASE WHEN w.correct = 1 THEN w.b * 0.9 / (w.b * 0.9 + (1 - w.b) * 0.2) ELSE w.b * 0.1 / (w.b * 0.1 + (1 - w.b) * 0.8) END) * 0.9 + 0.1
  FROM walk w JOIN seq s ON s.d = w.d AND s.kc = w.kc AND s.k = w.k + 1),
pred AS (SELECT d, kc, turn, pos, correct, b * 0.9 + (1 - b) * 0.2 AS p FROM walk)
"""
_LABEL = "CASE WHEN {0} IS NULL THEN 'na' WHEN {0} THEN 'true' ELSE 'False' END"
_UTTER = """
u AS (SELECT conv_id AS d, turn AS pos, CASE WHEN role = 'user' THEN 'student' ELSE 'teacher' END AS role, text AS content FROM conversations)
"""
_COALESCED = f"""
WITH {_UTTER},
f AS (SELECT *, CASE WHEN role = 'teacher' AND lag(role) OVER w = 'student' THEN 1 ELSE 0 END AS flag, first(role) OVER w AS opener FROM u WINDOW w AS (PARTITION BY d ORDER BY pos)),
n AS (SELECT *, CASE WHEN opener = 'student' THEN 0 ELSE 1 END + sum(flag) OVER (PARTITION BY d ORDER BY pos) AS turn FROM f),
g AS (SELECT d, turn, list(content ORDER BY pos) FILTER (role = 'teacher') AS t, list(content ORDER BY pos) FILTER (role = 'student') AS s FROM n GROUP BY d, turn),
c AS (SELECT d, turn, {{t}} AS teacher, {{s}} AS student FROM g),
l AS (SELECT *, max(turn) OVER (PARTITION BY d) AS last FROM c)
"""


def _fold(column: str) -> str:
    return f"coalesce(list_reduce(list_transform({column}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda a, b: CASE WHEN a = '' OR a = b THEN b ELSE a || CASE WHEN right(a, 1) IN ('.', '!', '?') THEN '' ELSE '.' END || ' ' || b END), '')"


_COALESCED = _COALESCED.format(t=_fold("t"), s=_fold("s"))
_FAMILY = """
p AS (
  SELECT doc_id AS d, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, md5(text) AS confusion,
    CASE doc_id % 7 WHEN 0 THEN 'A: misunderstands what problem asks' WHEN 1 THEN 'B: weak principles / when to apply' WHEN 2 THEN 'C: relevant vs irrelevant info'
      WHEN 3 THEN 'D: wrong operation / number order' WHEN 4 THEN 'E: unsure which steps/procedures' WHEN 5 THEN 'F: cannot recognise problem type' ELSE 'OTHER' END AS family,
    CASE doc_id % 7 WHEN 0 THEN 'A comprehension' WHEN 1 THEN 'B principles' WHEN 2 THEN 'C relevance' WHEN 3 THEN 'D wrong-operation' WHEN 4 THEN 'E steps' WHEN 5 THEN 'F problem-type' ELSE 'B principles' END AS loose
  FROM documents)
"""
_RATERS = """
r0 AS (SELECT event_id, user_id, CAST(floor(value) AS INT) % 4 + 1 AS r1 FROM events),
r AS (SELECT event_id, r1, CASE WHEN event_id % 5 = 0 THEN r1 % 4 + 1 ELSE r1 END AS r2, CASE WHEN event_id % 7 = 0 THEN user_id % 4 + 1 ELSE r1 END AS r3 FROM r0)
"""


def _turn_prob(expression: str) -> str:
    return f"WITH RECURSIVE {TURNS}, {PREDICT} SELECT d, turn, CAST(max(correct) AS BIGINT) AS correct, round({expression}, 9) AS p FROM pred GROUP BY d, turn"


def _metrics(subset: str) -> str:
    return f"""
WITH RECURSIVE {TURNS}, {PREDICT},
tp AS (SELECT d, turn, max(correct) AS correct, round(avg(p), 9) AS p FROM pred GROUP BY d, turn),
x AS ({subset}),
h AS (SELECT *, CAST(round_even(p, 0) AS INT) AS hard, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM x),
t AS (SELECT count(*) AS n, sum(correct) AS pos, sum(CASE WHEN hard = correct THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN hard = 1 AND correct = 1 THEN 1 ELSE 0 END) AS tp, sum(hard) AS said,
  sum(CASE WHEN correct = 1 THEN CAST(r AS DOUBLE) ELSE 0 END) AS rs, sum(correct * ln(q) + (1 - correct) * ln(1 - q)) AS ll, sum((p - correct) * (p - correct)) AS sq FROM h)
SELECT CAST(n AS BIGINT) AS n, round(CAST(hits AS DOUBLE) / n, 8) AS accuracy, round((rs - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * (n - pos)), 8) AS auc,
  round(CASE WHEN said > 0 THEN CAST(tp AS DOUBLE) / said ELSE 0 END, 8) AS "precision", round(CAST(tp AS DOUBLE) / pos, 8) AS recall, round(CAST(2 * tp AS DOUBLE) / (said + pos), 8) AS f1, round(ll / n, 8) AS log_likelihood, round(sq / n, 8) AS brier FROM t
"""


def _pair(a: str, b: str) -> str:
    return f"SELECT '{a}-{b}' AS pair, round(avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(corr({a}, {b}), 8) AS pearson, round(1 - avg(({a} - {b}) * ({a} - {b})) / (avg({a} * {a}) + avg({b} * {b}) - 2 * avg({a}) * avg({b})), 8) AS qwk FROM r"


def _stats(source: str, kc: str = "kc") -> str:
    return f"SELECT {kc} AS kc, CAST(count(correct) AS BIGINT) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM {source} GROUP BY 1"


_STATS = f"WITH {TURNS}, st AS ({_stats('obs')})"
_TRAIN = f"WITH {TURNS}, st AS ({_stats('(SELECT * FROM obs WHERE split = ' + chr(39) + 'train' + chr(39) + ')')}), keep AS (SELECT * FROM st WHERE n >= 900 AND n_correct > 0 AND n_correct < n)"

_HISTORIES = f"{_COALESCED}, k AS (SELECT d, turn, CASE WHEN teacher <> '' THEN 'Teacher Turn ' || CAST(turn AS INT) || ': ' || teacher END AS t, CASE WHEN student <> '' THEN 'Student Turn ' || CAST(turn AS INT) || ': ' || student END AS s FROM l WHERE turn < last OR student <> ''), h AS (SELECT d, turn, t, string_agg(nullif(concat_ws(chr(10), t, s), ''), chr(10)) OVER (PARTITION BY d ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM k) SELECT d, CAST(turn AS BIGINT) AS turn, '[BEGIN DIALOGUE]' || chr(10) || concat_ws(chr(10), past, t) || chr(10) || '[END DIALOGUE]' AS history FROM h"

SQL = {
    "turns_coalesced": f"{_COALESCED} SELECT d, CAST(turn AS BIGINT) AS turn, teacher, student FROM l WHERE turn < last OR student <> ''",
    "turn_counts_by_dialogue": f"{_COALESCED} SELECT d, CAST(count(*) AS BIGINT) AS n_turns FROM l WHERE turn < last OR student <> '' GROUP BY d",
    "role_transitions": f"WITH {_UTTER}, x AS (SELECT role, lead(role) OVER (PARTITION BY d ORDER BY pos) AS after FROM u) SELECT role, after, CAST(count(*) AS BIGINT) AS n FROM x WHERE after IS NOT NULL GROUP BY 1, 2",
    "dialogue_text_prefix": f"SELECT d, turn, CAST(length(history) AS BIGINT) AS chars, md5(history) AS history_md5 FROM ({_HISTORIES})",
    "dialogue_histories": _HISTORIES,
    "chat_contexts": "WITH x AS (SELECT conv_id, turn, role, count(*) OVER w AS n_before, coalesce(sum(length(text)) OVER w, 0) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, CAST(n_before AS BIGINT) AS n_before, CAST(chars AS BIGINT) AS chars_before FROM x WHERE role = 'assistant' AND n_before > 0",
    "prompt_batches": "WITH x AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE role = 'user'), y AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS k FROM x) SELECT CAST(k // 64 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(h) AS first_h, max(h) AS last_h FROM y GROUP BY 1",
    "prompt_batch_members": "WITH x AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE role = 'user'), y AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS k FROM x) SELECT h, CAST(k // 64 AS BIGINT) AS batch, CAST(k % 64 AS BIGINT) AS place FROM y",
    "observations_long": f"WITH {TURNS} SELECT d, turn, CAST(pos AS BIGINT) AS pos, kc, CAST(correct AS BIGINT) AS correct, split FROM obs",
    "apply_final_override": f"WITH {TURNS} SELECT d, turn, {_LABEL.format('og')} AS og, {_LABEL.format('correct')} AS correct FROM ov WHERE is_last",
    "final_override_audit": f"WITH {TURNS} SELECT {_LABEL.format('og')} || ' -> ' || {_LABEL.format('correct')} AS transition, CAST(count(*) AS BIGINT) AS n FROM ov WHERE is_last AND og IS NOT NULL GROUP BY 1",
    "population_audit": f"WITH {TURNS} SELECT split, CAST(count(DISTINCT d) AS BIGINT) AS dialogues, CAST(count(DISTINCT (d, turn)) AS BIGINT) AS turns, CAST(count(*) AS BIGINT) AS observations, CAST(count(DISTINCT kc) AS BIGINT) AS kcs, CAST(sum(correct) AS BIGINT) AS n_correct FROM obs GROUP BY split",
    "typicality_retention": f"WITH {TURNS}, x AS (SELECT DISTINCT d, confusion, interactions FROM ann) SELECT CAST(c AS BIGINT) AS cutoff, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN confusion >= c AND interactions >= c THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM x, range(1, 6) AS t(c) GROUP BY c",
    "length_sensitivity": f"WITH {TURNS}, x AS (SELECT d, count(*) AS n FROM tag GROUP BY d) SELECT CAST(c AS BIGINT) AS least, CAST(sum(CASE WHEN d % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN d % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS test FROM x, range(2, 7) AS t(c) WHERE n >= c GROUP BY c",
    "kc_stats": f"{_STATS} SELECT * FROM st",
    "kc_degenerate": f"WITH {TURNS}, st AS ({_stats('(SELECT * FROM obs WHERE split = ' + chr(39) + 'train' + chr(39) + ')', 'kc || ' + chr(39) + '-' + chr(39) + ' || CAST(d % 97 AS VARCHAR)')}) SELECT * FROM st WHERE n_correct = 0 OR n_correct = n",
    "kc_rare_thresholds": f"WITH {TURNS}, st AS ({_stats('obs', 'kc || ' + chr(39) + '-' + chr(39) + ' || CAST(d % 997 AS VARCHAR)')}) SELECT CAST(sum(CASE WHEN n <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS at_most_1, CAST(sum(CASE WHEN n <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS at_most_2, CAST(sum(CASE WHEN n <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS at_most_5, CAST(sum(CASE WHEN n <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS at_most_10, CAST(count(*) AS BIGINT) AS kcs FROM st",
    "kc_keep_set": f"{_TRAIN} SELECT * FROM keep",
    "kc_keep_apply": f"{_TRAIN} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT kc) AS BIGINT) AS kcs FROM obs WHERE kc IN (SELECT kc FROM keep) GROUP BY split",
    "kc_keep_report": f"{_TRAIN} SELECT CAST(count(*) AS BIGINT) AS kcs, CAST(sum(CASE WHEN n_correct = 0 OR n_correct = n THEN 1 ELSE 0 END) AS BIGINT) AS degenerate, CAST(sum(CASE WHEN n < 900 THEN 1 ELSE 0 END) AS BIGINT) AS too_few, CAST(sum(CASE WHEN n < 900 OR n_correct = 0 OR n_correct = n THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(n) AS BIGINT) AS observations, CAST(sum(CASE WHEN n < 900 OR n_correct = 0 OR n_correct = n THEN n ELSE 0 END) AS BIGINT) AS dropped_observations FROM st",
    "kc_dictionary": f"WITH {TURNS}, x AS (SELECT d, turn, unnest(range(len(kcs))) AS pos, unnest(kcs) AS kc FROM ann), y AS (SELECT kc, min((d, turn, pos)) AS f FROM x GROUP BY kc) SELECT kc, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS kc_id FROM y",
    "kc_split_overlap": f"WITH {TURNS}, x AS (SELECT kc || '-' || CAST(d % 401 AS VARCHAR) AS kc, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS te, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS n FROM obs GROUP BY 1) SELECT CAST(sum(CASE WHEN tr = 1 AND te = 1 THEN 1 ELSE 0 END) AS BIGINT) AS \"both\", CAST(sum(CASE WHEN tr = 1 AND te = 0 THEN 1 ELSE 0 END) AS BIGINT) AS train_only, CAST(sum(CASE WHEN tr = 0 AND te = 1 THEN 1 ELSE 0 END) AS BIGINT) AS test_only, CAST(sum(CASE WHEN tr = 0 AND te = 1 THEN n ELSE 0 END) AS BIGINT) AS test_only_rows FROM x",
    "kcs_per_turn_hist": f"WITH {TURNS} SELECT CAST(len(kcs) AS BIGINT) AS n_kcs, CAST(count(*) AS BIGINT) AS turns FROM ann GROUP BY 1",
    "shape_summary": f"WITH {TURNS}, x AS (SELECT d, count(*) AS n, sum(len(kcs)) AS k, sum(CAST(correct AS INT)) AS c FROM tag GROUP BY d) SELECT CAST(count(*) AS BIGINT) AS dialogues, round(avg(n), 8) AS mean_turns, quantile_cont(n, 0.5) AS median_turns, CAST(min(n) AS BIGINT) AS min_turns, CAST(max(n) AS BIGINT) AS max_turns, round(CAST(sum(k) AS DOUBLE) / sum(n), 8) AS kcs_per_turn, round(greatest(CAST(sum(c) AS DOUBLE) / sum(n), 1 - CAST(sum(c) AS DOUBLE) / sum(n)), 8) AS majority FROM x",
    "corpus_statistics": f"WITH {TURNS} SELECT CAST(count(*) AS BIGINT) AS turns, CAST(count(DISTINCT d) AS BIGINT) AS dialogues, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS n_true, CAST(sum(CASE WHEN NOT correct THEN 1 ELSE 0 END) AS BIGINT) AS n_false, CAST(sum(CASE WHEN correct IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_na, CAST(sum(CASE WHEN len(kcs) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_kc, round(avg(CASE WHEN correct THEN len(kcs) END), 8) AS kcs_true, round(avg(CASE WHEN NOT correct THEN len(kcs) END), 8) AS kcs_false FROM ov",
    "family_counts_pivot": f"WITH {_FAMILY} SELECT family, CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test FROM p GROUP BY family",
    "family_loose_counts": f"WITH {_FAMILY} SELECT loose AS family, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1",
    "family_text_shares": f"WITH {_FAMILY} SELECT family, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT confusion) AS BIGINT) AS distinct_texts, round(CAST(count(DISTINCT confusion) AS DOUBLE) / count(*), 8) AS share FROM p GROUP BY family",
    "order_ids": f"WITH {TURNS}, x AS (SELECT d, turn, pos, row_number() OVER (PARTITION BY d ORDER BY turn, pos) - 1 AS k, row_number() OVER (ORDER BY d, turn, pos) - 1 AS g FROM obs) SELECT d, turn, CAST(pos AS BIGINT) AS pos, CAST(k AS BIGINT) AS order_in_dialogue, CAST(min(g) OVER (PARTITION BY d) AS BIGINT) AS dialogue_offset FROM x",
    "global_order_ids": f"WITH {TURNS} SELECT d, turn, CAST(pos AS BIGINT) AS pos, CAST(row_number() OVER (ORDER BY d, turn, pos) - 1 AS BIGINT) AS order_id FROM obs",
    "turn_ranges": f"WITH {TURNS} SELECT d, turn, CAST(sum(len(kcs)) OVER w - len(kcs) AS BIGINT) AS start, CAST(sum(len(kcs)) OVER w AS BIGINT) AS \"end\" FROM tag WINDOW w AS (PARTITION BY d ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "bkt_forward_fixed": f"WITH RECURSIVE {TURNS}, {PREDICT} SELECT d, turn, kc, CAST(correct AS BIGINT) AS correct, round(p, 9) AS p FROM pred",
    "turn_prob_mean": _turn_prob("avg(p)"),
    "turn_prob_prod": _turn_prob("product(p)"),
    "turn_prob_geo": _turn_prob("pow(product(p), 1.0 / count(p))"),
    "turn_metrics": _metrics("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY turn) AS k FROM tp) WHERE k > 1"),
    "final_turn_metrics": _metrics("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY turn DESC) AS k FROM tp) WHERE k = 1"),
    "weighted_fallback": f"{_STATS} SELECT " + ", ".join(f"round(sum(CAST(n_correct AS DOUBLE) / n / {k} * n) / sum(n), 8) AS {x}" for k, x in enumerate(("prior", "learns", "guesses", "slips"), 1)) + " FROM st",
    "majority_baseline": f"WITH {TURNS}, x AS (SELECT avg(CAST(correct AS INT)) AS share, count(*) AS n FROM tag) SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN share >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS majority, round(greatest(share, 1 - share), 8) AS accuracy FROM x",
    "rotating_folds": "WITH x AS (SELECT o_orderkey AS d, row_number() OVER (ORDER BY md5('221-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), y AS (SELECT d, n, f, (k + n - CAST(floor(n * (CAST(f - 1 AS DOUBLE) / 5)) AS BIGINT)) % n AS k FROM x, range(1, 6) AS t(f)), z AS (SELECT f, d, CASE WHEN k < floor(n * CAST(0.65 AS DOUBLE)) THEN 'train' WHEN k < floor(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS slice FROM y) SELECT CAST(f AS BIGINT) AS fold, CAST(count(*) FILTER (slice = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (slice = 'validation') AS BIGINT) AS n_validation, CAST(count(*) FILTER (slice = 'test') AS BIGINT) AS n_test, CAST(coalesce(sum(d) FILTER (slice = 'test'), 0) AS BIGINT) AS test_d_sum FROM z GROUP BY f",
    "rotating_fold_slices": "WITH x AS (SELECT o_orderkey AS d, row_number() OVER (ORDER BY md5('221-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), y AS (SELECT d, n, f, (k + n - CAST(floor(n * (CAST(f - 1 AS DOUBLE) / 5)) AS BIGINT)) % n AS k FROM x, range(1, 6) AS t(f)) SELECT CAST(f AS BIGINT) AS fold, CASE WHEN k < floor(n * CAST(0.65 AS DOUBLE)) THEN 'train' WHEN k < floor(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS slice, CAST(count(*) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d_sum FROM y GROUP BY 1, 2",
    "stratified_shortfall": f"WITH {_FAMILY}, x AS (SELECT family, d, row_number() OVER (PARTITION BY family ORDER BY md5('draw-' || CAST(d AS VARCHAR))) AS k FROM p WHERE split = 'train' AND d % 11 <> 0), y AS (SELECT family, count(*) AS have FROM p WHERE split = 'train' AND d % 11 = 0 GROUP BY family) SELECT x.family, d, CAST(k AS BIGINT) AS k FROM x LEFT JOIN y ON x.family = y.family WHERE k <= 13 - coalesce(have, 0)",
    "stratified_topup": f"WITH {_FAMILY}, x AS (SELECT family, count(*) FILTER (d % 11 = 0) AS have, count(*) FILTER (d % 11 <> 0) AS pool FROM p WHERE split = 'train' GROUP BY family) SELECT family, CAST(have AS BIGINT) AS have, CAST(pool AS BIGINT) AS pool, CAST(least(greatest(13 - have, 0), pool) AS BIGINT) AS drawn FROM x",
    "standards_options": "SELECT r_name AS domain, string_agg('ID: ' || CAST(n_nationkey AS VARCHAR) || ', Description: ' || n_name, chr(10) ORDER BY 'ID: ' || CAST(n_nationkey AS VARCHAR) || ', Description: ' || n_name) AS options FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "lm_output_extract": "SELECT n_nationkey, '{\"result\": pi' || CAST(n_nationkey AS VARCHAR) || '}' AS result FROM nation",
    "response_cache_misses": "WITH x AS (SELECT DISTINCT text FROM conversations WHERE role = 'user'), y AS (SELECT text FROM conversations WHERE role = 'user' AND conv_id % 3 = 0) SELECT CAST(count(*) AS BIGINT) AS misses, CAST(sum(length(text)) AS BIGINT) AS chars FROM x WHERE text NOT IN (SELECT text FROM y)",
    "success_at_k": """
WITH x AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey) AS hit FROM lineitem),
y AS (SELECT d, min(CASE WHEN pos % 2 = 0 AND hit THEN pos // 2 END) AS s, min(CASE WHEN pos % 2 = 1 AND hit THEN pos // 2 END) AS t FROM x GROUP BY d)
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN s <= k THEN 1.0 ELSE 0.0 END), 8) AS success, round(avg(CASE WHEN t <= least(coalesce(s, k), k) THEN 1.0 ELSE 0.0 END), 8) AS telling FROM y, range(1, 8) AS g(k) GROUP BY k
""",
    "rater_agreement": f"WITH {_RATERS} {_pair('r1', 'r2')} UNION ALL {_pair('r1', 'r3')} UNION ALL {_pair('r2', 'r3')}",
    "rater_alpha": f"WITH {_RATERS}, l AS (SELECT event_id, unnest([r1, r2, r3]) AS v FROM r), w AS (SELECT avg(x) AS a FROM (SELECT var_samp(v) AS x FROM l GROUP BY event_id)) SELECT round(1 - (SELECT a FROM w) / var_samp(v), 8) AS alpha FROM l",
    "rater_overlap": f"WITH {_RATERS} SELECT round(avg(CASE WHEN r2 = r1 AND r3 = r1 THEN 1.0 ELSE 0.0 END), 8) AS overlap, CAST(count(*) AS BIGINT) AS n FROM r",
    "learning_curve": f"WITH RECURSIVE {TURNS}, {PREDICT}, x AS (SELECT kc, row_number() OVER w AS occurrence, p - first(p) OVER w AS delta FROM pred WINDOW w AS (PARTITION BY d, kc ORDER BY turn, pos)) SELECT kc, CAST(occurrence AS BIGINT) AS occurrence, CAST(count(*) AS BIGINT) AS n, round(avg(delta), 8) AS mean_delta, round(stddev_pop(delta), 6) AS std_delta FROM x GROUP BY 1, 2",
    "qual_report": f"WITH RECURSIVE {TURNS}, {PREDICT}, tp AS (SELECT d, turn, max(correct) AS correct, round(avg(p), 9) AS p FROM pred GROUP BY d, turn) SELECT d, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN round_even(p, 0) = correct THEN 1.0 ELSE 0.0 END), 8) AS dialogue_accuracy FROM tp GROUP BY d",
    "embedding_kc_mean": "WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(i AS BIGINT) AS i, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM x GROUP BY 1, 2",
    "reload_parity": f"{_STATS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS DOUBLE) AS max_diff FROM st",
}
